"""Shared helpers: table access, the shared scratch folder, written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The five separators that the word and exact-dedup contracts name, besides the blank: \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only where the session names none and runs on one machine (as in tests) a temporary folder is set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_dir.isEmpty():
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="spark-scratch-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            base = set_dir.get()
    return f"{base.rstrip('/')}/siftline-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read again.

    This cuts the lineage: a lost executor costs only the tasks that read its blocks, and
    what is not deterministic (packing, a fitted model) is decided once.
    """
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def salt(column: str, ways: int):
    """A salt in [0, ways) from a row's own id, so that a task that runs again deals rows alike."""
    return F.pmod(F.xxhash64(F.col(column)), F.lit(ways)).cast("int")


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 8 << 20, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Parts of Arrow batches of at most ``rows`` rows and ``most`` bytes in a text column; a longer text comes alone.

    Spark bounds the bytes of a batch itself (``maxBytesPerBatch``); this keeps what tasks make of one small, too.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        before, at = np.concatenate([[0], np.cumsum(sizes)]), 0
        while at < batch.num_rows:
            end = min(at + rows, int(np.searchsorted(before, before[at] + most, "right")) - 1)
            end = max(at + 1, end)
            yield batch.slice(at, end - at)
            at = end


def bounded_sample(df: DataFrame, keys: list[str], columns: list[str], most: int):
    """At most ``most`` rows as a local frame, the smallest by a hash of ``keys``.

    Rows are thinned by the hash where they lie, so what reaches the driver is about one and a half times the
    bound however many tasks there are; smaller inputs come whole.
    """
    count = df.count()
    hashed = df.withColumn("_hash", F.xxhash64(*keys))
    if count > 2 * most:
        share = 1.5 * most / count
        hashed = hashed.where(F.pmod(F.col("_hash"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return hashed.orderBy(F.pmod(F.col("_hash"), F.lit(1 << 30)), *keys).select(*columns).limit(most).toPandas()


def numbered(df: DataFrame, order: list[str], folder: str) -> DataFrame:
    """``df`` with pos (from 0, by ``order`` inside ``key``) and n (rows of the key), however many rows a key has.

    Rows are sorted in ranges; a row's place is its place in its range and the rows of its key in earlier ranges.
    Rows alike in all of ``order`` take places in any order; where they lie in the input spreads them over ranges.
    """
    spread = df.withColumn("_lies", F.monotonically_increasing_id())
    rows = written(spread.repartitionByRange("key", *order, "_lies").sortWithinPartitions("key", *order, "_lies").withColumn("_at", F.monotonically_increasing_id()), folder)
    rows = rows.withColumn("_range", F.shiftright("_at", 33)).drop("_lies")
    of = Window.partitionBy("key")
    ranges = rows.groupBy("key", "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(of.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("key", "_range", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(of).alias("n"))
    return rows.join(ranges, ["key", "_range"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")


#: crc32 as SQL: ``crc_table`` has the remainders of all bytes; a string's is folded over its bytes.
CRC_TABLE = """crc_table AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_concat([b::BIGINT], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(b)))"""


def crc_sql(text: str) -> str:
    """SQL for the unsigned crc32 of an ASCII string; needs ``crc_table`` in the FROM clause."""
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"
