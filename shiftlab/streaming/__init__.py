from shiftlab.streaming.ingest_stream import ingest_stream, run_ingest_stream  # noqa: F401
