"""Reading raw events, in batch and as a stream: one JSON document per row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def _as_payload(df: DataFrame, fmt: str, column: str = "payload") -> DataFrame:
    if fmt == "text":
        return df.withColumnRenamed("value", "payload")
    if fmt == "kafka":
        return df.select(F.col("value").cast("string").alias("payload"), "topic", "partition", "offset", "timestamp")
    return df if column == "payload" else df.withColumnRenamed(column, "payload")


def read_events(
    spark: SparkSession, path: str, fmt: str = "text", column: str = "payload", **options: str
) -> DataFrame:
    """Raw events from files: ``text`` (a document per line) or a table with a payload column."""
    return _as_payload(spark.read.format(fmt).options(**options).load(path), fmt, column)


def read_events_stream(
    spark: SparkSession, path: str | None = None, fmt: str = "text",
    schema: str | StructType | None = None, column: str = "payload", **options: str,
) -> DataFrame:
    """Raw events as a stream from a folder, or from Kafka (``fmt="kafka"`` with its options).

    ``maxFilesPerTrigger`` / ``maxOffsetsPerTrigger`` bound a batch; nothing is dropped, the
    source simply waits.
    """
    reader = spark.readStream.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return _as_payload(reader.load(path) if path else reader.load(), fmt, column)
