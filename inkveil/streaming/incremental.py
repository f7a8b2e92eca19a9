"""Streams: the same expressions over arriving files, with exactly-once output and windowed counts.

Detection and rewriting are stateless row expressions, so a stream needs nothing but a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import detect, rewrite, routing


def read_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def sanitize_stream(stream: DataFrame, text: str = "text", policy: str = "routed", salt: str = rewrite.DEFAULT_SALT) -> DataFrame:
    """Detect, classify, route (a join with eight static rows) and rewrite."""
    prepared = routing.prepare(stream, text)
    return rewrite.transform(routing.route(prepared, policy), policy, text, salt)


def findings_per_window(stream: DataFrame, time: str, text: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Findings by window and pattern; rows later than the watermark no longer count."""
    spans = detect.detect(stream.withWatermark(time, late), text)
    found = spans.select(time, F.explode("spans").alias("s"))
    return found.groupBy(F.window(time, width), F.col("s.pattern").alias("pattern")).agg(F.count("*").alias("n"))


def write_stream(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", mode: str = "append", once: bool = True) -> StreamingQuery:
    """Files are committed once each; a restart goes on where the checkpoint ends."""
    writer = df.writeStream.format(fmt).outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
