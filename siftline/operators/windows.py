"""Ordered rules: budgets, caps, forward fills, spans and trimmed lists."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType


def trim_traces(df: DataFrame, key: str, order: list[str], step: str, limit: int) -> DataFrame:
    """The first third and the tail of each key's ordered steps, ``limit`` entries in all: key, steps, count of all.

    Ranks from both ends keep at most ``limit`` rows of a key, so no row holds a whole list however long it is.
    """
    head = max(1, limit // 3)
    tail = limit - head
    ranked = lambda order, most: df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_rank") <= most)
    item = F.struct(*order, F.col(step).alias("_step"))
    none = F.lit(None)
    first = ranked([F.col(c).asc() for c in order], limit).select(key, item.alias("_first"), none.alias("_last"), none.cast("long").alias("_n"))
    last = ranked([F.col(c).desc() for c in order], tail).select(key, none.alias("_first"), item.alias("_last"), none.cast("long").alias("_n"))
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).select(key, none.alias("_first"), none.alias("_last"), "_n")
    ends = first.unionByName(last).unionByName(counts).groupBy(key).agg(*(F.array_sort(F.collect_list(c)).alias(c) for c in ("_first", "_last")), F.max("_n").alias("n"))
    steps = F.when(F.col("n") <= limit, F.col("_first")).otherwise(F.concat(F.slice("_first", 1, head), F.col("_last")))
    return ends.select(key, F.transform(steps, lambda s: s["_step"]).alias("steps"), "n")


def installed_owner(path: Column) -> Column:
    """The package that an installed file belongs to, scoped names whole; null outside installed trees."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    at = F.greatest(F.array_position(parts, F.lit("node_modules")), F.array_position(parts, F.lit("vendor"))).cast("int")
    first, second = F.get(parts, at), F.get(parts, at + 1)
    scoped = F.startswith(first, F.lit("@")) | F.array_contains(parts, F.lit("vendor"))
    return F.when(at > 0, F.when(scoped & second.isNotNull(), F.concat_ws("/", first, second)).otherwise(first))


def greedy_budget(df: DataFrame, run: str, score: str, path: str, size: str, exempt: str, budget_pct: float, min_score: int) -> DataFrame:
    """Which review items a run's budget admits.

    Items come by score (highest first) and path. Exempt ones are always taken and counted, those below the
    least score deferred, and an item that would pass the allowance is deferred though later, smaller ones may still
    fit. That is no running sum, so each run's items stream in order through one task, which carries what is spent alone;
    runs are independent, and a run's totals are aggregated before. Adds deferred and overflowed.
    """
    n = F.col(size).cast("long")
    totals = df.groupBy(F.col(run).alias("_run")).agg(F.sum(size).alias("_total"), F.coalesce(F.sum(F.when(F.col(exempt), n)), F.lit(0)).alias("_exempt"))
    allowed = F.greatest(F.lit(1), F.bround(F.col("_total") * budget_pct / 100, 0)).cast("long")
    rows = df.join(totals.withColumn("_allowed", allowed), F.col(run).eqNullSafe(F.col("_run")))
    rows = rows.select(*df.columns, (F.col("_exempt") > F.col("_allowed")).alias("overflowed"), "_allowed", n.alias("_n"), (F.col(score) < min_score).alias("_low"), F.col(exempt).alias("_free"))
    ordered = rows.repartition(run).sortWithinPartitions(run, -F.col(score), path, *df.columns)
    given = [*df.columns, "overflowed"]
    schema = StructType([*rows.select(*given).schema.fields, StructField("deferred", BooleanType())])

    def fold(batches):
        at, spent = None, 0
        for batch in batches:
            decided = []
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (run, "_allowed", "_n", "_low", "_free")]
            for key, most, count, low, free in zip(*columns, strict=True):
                if at != (key,):
                    at, spent = (key,), 0
                later = not free and (bool(low) or spent + (count or 0) > most)
                spent += 0 if later else count or 0
                decided.append(later)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in given]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(decided, pa.bool_())], names=[*given, "deferred"])

    return ordered.mapInArrow(fold, schema).select(*df.columns, "deferred", "overflowed")


def cap(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """At most ``most`` rows per key, the first in order: a report's limit."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= most).drop("_rank")


def fill_forward(df: DataFrame, keys: list[str], order: str, header: Column, name: str) -> DataFrame:
    """Each row gets the last header at or before it: sections, blocks, stages."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(header, ignorenulls=True).over(w))


def spans(df: DataFrame, keys: list[str], start: str, end_of_file: str) -> DataFrame:
    """Each declaration ends before the next one begins; the last one at the end of its file."""
    w = Window.partitionBy(*keys).orderBy(start)
    return df.withColumn("end", F.coalesce(F.lead(start).over(w) - 1, F.col(end_of_file)))


def running_offset(df: DataFrame, keys: list[str], order: str, size: Column) -> DataFrame:
    """Where each piece begins when the pieces of a key are laid one behind the other."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long"))
