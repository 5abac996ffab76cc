"""The journal as a stream: append, resume, reuse, dedup on arrival, rolling counts.

State is bounded by watermarks; progress lies in the checkpoint folder, so a stopped run goes on where it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def arriving(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """New Parquet files of findings as they arrive."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def append_journal(decided: DataFrame, out: str, checkpoint: str):
    """Appends each decided row once; returns the started query, which ends when what has arrived is done."""
    stamped = decided.withColumn("decided_at", F.current_timestamp())
    return stamped.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def recover(findings: DataFrame, journal: DataFrame, key: str) -> DataFrame:
    """Findings that an interrupted run had not decided; rows of a torn last line have no key and count for nothing."""
    return findings.join(journal.where(F.col(key).isNotNull()).select(key), key, "left_anti")


def reuse(stream: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """Arriving findings with the earlier verdict of the same fingerprint, null where there is none."""
    return stream.join(history, key, "left")


def _timed(stream: DataFrame, time: str) -> DataFrame:
    """Watermarks need a timestamp with a zone; the session's is meant where the column has none."""
    return stream.withColumn(time, F.col(time).cast("timestamp"))


def first_arrivals(stream: DataFrame, time: str, keys: list[str], delay: str) -> DataFrame:
    """One row per key within the watermark. The first to arrive stays, where the batch rule keeps the richest."""
    return _timed(stream, time).withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def rolling_counts(stream: DataFrame, time: str, key: str, width: str, delay: str) -> DataFrame:
    """Counts by window and key; a window is final once the watermark has passed it."""
    return _timed(stream, time).withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def run_to_end(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Processes everything that has arrived, batch by batch, and waits for the end."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
