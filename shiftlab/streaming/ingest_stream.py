"""Incremental ingest of a document directory with Structured Streaming.

New ``CVE-*.json`` files arriving in the directory are flattened with the same
projection as the batch ingest and appended to a Parquet table.  The file
source remembers what it has read in the checkpoint, so re-running picks up
only new files, and a lost executor replays from the last committed batch.
``availableNow`` drains what is there and stops, which makes it a scheduled
compaction job rather than a long-running server.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from shiftlab.session import ensure_checkpoint_dir
from shiftlab.sources.ingest import CVE_SCHEMA, FILE_GLOB, file_year, flatten


def ingest_stream(spark: SparkSession, data_dir: str, out_path: str, checkpoint: str | None = None,
                  max_files_per_trigger: int = 10_000, year_min: int | None = None):
    """Start the stream; returns the ``StreamingQuery`` (call ``awaitTermination``)."""
    # A checkpoint of its own for each pair of source and target.
    name = hashlib.sha256(f"{data_dir}|{out_path}|{year_min}".encode()).hexdigest()[:16]
    cp = checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/ingest-stream-{name}"
    raw = (spark.readStream.schema(CVE_SCHEMA).option("multiLine", True)
           .option("pathGlobFilter", FILE_GLOB).option("maxFilesPerTrigger", max_files_per_trigger)
           .option("columnNameOfCorruptRecord", "_corrupt_record").json(data_dir))
    if year_min:
        # Year in the file name, like the batch pruning (unparsable names kept).
        y = file_year(F.col("_metadata.file_name"))
        raw = raw.where(y.isNull() | (y >= year_min))
    flat = flatten(raw)
    return (flat.writeStream.format("parquet").option("checkpointLocation", cp)
            .outputMode("append").trigger(availableNow=True).start(out_path))


def run_ingest_stream(spark: SparkSession, data_dir: str, out_path: str, checkpoint: str | None = None,
                      **kw) -> None:
    """Drain all available files into ``out_path`` and stop."""
    q = ingest_stream(spark, data_dir, out_path, checkpoint, **kw)
    q.awaitTermination()
