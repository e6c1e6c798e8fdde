"""Written tables that cut lineage, in the folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlab.session import ensure_checkpoint_dir, ship_package

#: Bytes of an Arrow batch, so that batches of long texts stay small in Python workers.
BATCH_BYTES = str(16 << 20)
#: Rows of two numbers (16 bytes each) that may be broadcast.
BROADCAST_PAIRS = 500_000


def ready(spark: SparkSession) -> None:
    """Make this package importable in Python workers, and bound their batches by bytes."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def small(table: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """``F.broadcast`` for tables of two numbers with as many rows as the written ``table``, if that is few."""
    return F.broadcast if table.count() <= BROADCAST_PAIRS else lambda df: df


def written(df: DataFrame, name: str, tidy: bool = True) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    A lost executor then costs a re-read of shared files, not a recomputation,
    and the shuffles behind ``df`` are garbage: a collection lets Spark's
    cleaner remove their files before the next stage adds its own.  Without
    ``tidy`` they wait for the next collection, for tables of a few numbers a row.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    schema = df.schema
    for _ in range(2 if tidy else 0):  # the first lets go of the finished job's plan, the second of its shuffles
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
    return spark.read.schema(schema).parquet(path)
