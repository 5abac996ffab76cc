"""Dedup, scorecards, summaries and plans as grouped aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import percent
from ..functions.versions import lenient_parts, major
from .graph import durable


def keep_best(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in the given order (end it with an ordinal, so that ties keep the first input)."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def best_by(df: DataFrame, keys: list[str], order: list[Column], values: list[str]) -> DataFrame:
    """Like ``keep_best`` for a few columns, by a combinable minimum instead of a sort: no window, no hot task."""
    packed = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), F.struct(*values).alias("v"))
    return df.groupBy(*keys).agg(F.min(packed).alias("_best")).select(*keys, *(F.col(f"_best.v.{v}").alias(v) for v in values))


def scorecard(df: DataFrame, verdict: str, truth: str, keys: list[str] | None = None) -> DataFrame:
    """Agreement, abstention, dangerous misses and false alarms over labelled records; shares are null over nothing."""
    v, t = F.col(verdict), F.col(truth)
    labelled = df.where(t.isNotNull())
    decided, agree = v != "unknown", v == t
    sums = [
        F.count(F.lit(1)).alias("total"),
        F.count_if(decided).alias("decided"),
        F.count_if(agree).alias("agree_all"),
        F.count_if(agree & decided).alias("agree_decided"),
        F.count_if(v == "unknown").alias("unknown"),
        F.count_if((t == "confirmed") & (v == "false_positive")).alias("dangerous_misses"),
        F.count_if((t == "false_positive") & (v == "confirmed")).alias("false_alarms"),
    ]
    out = labelled.groupBy(*keys).agg(*sums) if keys else labelled.agg(*sums)
    return (
        out.withColumn("agreement_all", percent(F.col("agree_all"), F.col("total")))
        .withColumn("agreement_decided", percent(F.col("agree_decided"), F.col("decided")))
        .withColumn("abstention_rate", percent(F.col("unknown"), F.col("total")))
    )


def index_percentiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """p50, p95 and max picked by index (n div 2, int(n * 0.95)), not interpolated; nulls are left out.

    Rows are dealt by ranges of keys and value and numbered inside each range; what lies before a range is a sum over
    one row for each range, so a key with most of the rows is no one task's work.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, value)
    ranged = durable(rows.repartitionByRange(*keys, value).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_size"))
    across = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    starts = sizes.withColumns({"_before": F.coalesce(F.sum("_size").over(across), F.lit(0)), "n": F.sum("_size").over(whole)})
    inside = Window.partitionBy(*keys, "_range").orderBy(value)
    placed = ranged.withColumn("_at", F.row_number().over(inside) - 1).alias("p")
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*keys, "_range")]
    joined = placed.join(starts.alias("s"), same).select("p.*", "_before", "n")
    at = F.col("_at") + F.col("_before")
    pick = lambda place: F.max(F.when(at == place, F.col(value)))
    return joined.groupBy(*keys).agg(pick(F.floor(F.col("n") / 2)).alias("p50"), pick(F.floor(F.col("n") * 0.95)).alias("p95"), F.max(value).alias("max"), F.max("n").alias("n"))


def fixed_domain_counts(df: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """Counts for each value of a fixed list, zero where there is none; other values are left out."""
    names = df.sparkSession.createDataFrame([(d, i) for i, d in enumerate(domain)], f"{column} string, ordinal int")
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(names).join(counts, column, "left").select("ordinal", column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def all_or_null_sum(value: Column) -> Column:
    """A sum that is null when any row lacks the value."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))


def prefix_rollup(df: DataFrame, path: str) -> DataFrame:
    """Files counted for each directory above them."""
    parts = F.split(F.regexp_replace(F.col(path), "^/+", ""), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat_ws("/", F.slice(parts, F.lit(1), n)))
    dirs = df.select(F.explode(F.when(F.size(parts) > 1, above)).alias("directory"))
    return dirs.groupBy("directory").agg(F.count(F.lit(1)).alias("files"))


def upgrade_plan(df: DataFrame) -> DataFrame:
    """Per package and installed version: advisories, the highest fix as target, whether that crosses a major, and
    the best fix inside the major with how many advisories it covers.

    Rows: ordinal, package, installed, advisory, verdict, fix (lowest fix above the installed version, or null).
    An advisory counts once, by its first row.
    """
    # By a minimum instead of a sort, and once for each fix: a package version has no more fixes than its releases.
    first = best_by(df, ["package", "installed", "advisory"], [F.col("ordinal")], ["verdict", "fix"])
    by_fix = first.groupBy("package", "installed", "fix").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "confirmed").alias("confirmed"), F.count_if(F.col("verdict") == "unknown").alias("open")
    )
    by_fix = by_fix.withColumns({"current": lenient_parts(F.col("installed")), "parts": lenient_parts(F.col("fix"))})
    key = F.struct("parts", "fix")
    grouped = by_fix.groupBy("package", "installed").agg(
        F.sum("n").alias("advisories"),
        F.sum("confirmed").alias("confirmed"),
        F.sum("open").alias("open"),
        F.coalesce(F.sum(F.when(F.col("fix").isNull(), F.col("n"))), F.lit(0)).alias("unfixed"),
        F.max(F.when(F.col("parts").isNotNull(), key)).alias("top"),
        F.max(F.when(F.col("parts").isNotNull() & (major(F.col("parts")) == major(F.col("current"))), key)).alias("inside"),
        F.collect_list(F.struct("parts", "n")).alias("fixes"),
        F.first("current").alias("current"),
    )
    crossing = F.coalesce(major(F.col("top.parts")) > major(F.col("current")), F.lit(False))
    grouped = grouped.withColumn("major", crossing).withColumn("inside", F.when(F.col("major"), F.col("inside")))
    covers = F.aggregate(F.filter("fixes", lambda x: x["parts"] <= F.col("inside.parts")), F.lit(0).cast("long"), lambda total, x: total + x["n"])
    return grouped.select(
        "package", "installed", F.coalesce("top.fix", F.lit("")).alias("target"), "advisories", "confirmed", "open", "unfixed", "major",
        F.coalesce("inside.fix", F.lit("")).alias("same_major"), F.when(F.col("inside").isNotNull(), covers).otherwise(0).cast("long").alias("same_major_covers"),
    )
