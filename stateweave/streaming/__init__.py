"""Programs on streams: scoring has no state, so the same projection serves batch and Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.program import Bundle, Program


def score_stream(stream: DataFrame, program: Program | Bundle, sink: str, checkpoint: str, output: str = "prediction") -> StreamingQuery:
    """Appends scored rows to a Parquet folder; stops when what is there now has been read."""
    return program.transform(stream, output).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", sink).outputMode("append").trigger(availableNow=True).start()
