"""Session helpers: one place for the configs the operators rely on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Broadcast a side only when its row count is known to be at most this: the driver builds it, a few at once.
BROADCAST_MAX_ROWS = 50_000


def get_spark(app: str = "shiftlab", master: str | None = None,
              shuffle_partitions: int | None = None, driver_memory: str = "8g") -> SparkSession:
    """Create or reuse a session with AQE on and the UI off.

    On a cluster the master and the checkpoint directory come from the
    submit configuration; a local default is only filled in when unset.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        # Local mode runs everything in the driver JVM; its heap is the only knob.
        builder = builder.master(master).config("spark.driver.memory", driver_memory)
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return ``spark.checkpoint.dir``; set a scratch one only if unset in local mode (tests).

    A folder of the driver's machine is no use to the executors of a cluster, so
    there an unset directory is an error.
    """
    sc = spark.sparkContext
    cp = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if cp:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(cp)
        return cp
    if not cp:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        cp = tempfile.mkdtemp(prefix="shiftlab-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", cp)
    spark.sparkContext.setCheckpointDir(cp)
    return cp


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``shiftlab`` importable in Python workers (like ``--py-files``).

    Operators that run Python per batch (SMOTE blocks, random Fourier
    features, TreeSHAP) reference helpers in this package; workers started
    from another directory would not find it.  Zips the package once per
    application and registers it with ``addPyFile``.
    """
    import zipfile

    import shiftlab

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(shiftlab.__file__))
    root = os.path.dirname(pkg)
    zpath = os.path.join(tempfile.mkdtemp(prefix="shiftlab-pyfiles-"), "shiftlab.zip")
    with zipfile.ZipFile(zpath, "w") as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(sc.applicationId)
