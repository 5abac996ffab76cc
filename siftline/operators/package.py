"""One wide evidence row for each finding, and the flat summary of a dependency chain's result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rows(df: DataFrame, key: str, order: list[str], shown: str, most: int) -> DataFrame:
    """key, items: the first ``most`` values of each key in order; tasks keep no more of a key before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order, shown))
    kept = df.where(F.col(key).isNotNull()).withColumn("_rank", rank).where(F.col("_rank") <= most)
    items = F.array_sort(F.collect_list(F.struct(F.col("_rank").alias("rank"), F.col(shown).alias("shown"))))
    return kept.groupBy(key).agg(F.transform(items, lambda i: i["shown"]).alias("items"))


def evidence_package(findings: DataFrame, key: str, sources: dict[str, tuple[DataFrame, list[str], str, int]], facts: dict[str, DataFrame] | None = None) -> DataFrame:
    """``findings`` with an array for each source and a struct for each fact; one row a finding, whatever the sources hold.

    A source is (rows with ``key``, columns of its order, column shown, how many are kept); a fact is a table with at most one row a key, of which the least counts
    if there are more. All of it is one long table: every task keeps the first rows of each finding and source that it sees before anything is shuffled, so a
    finding that most rows belong to sends no more than others, and no join multiplies rows. A source without rows is an empty array, a fact without one null; rows of
    unknown or null keys are left out, findings without a key keep their row. Extra columns of sources are not read.
    """
    facts = facts or {}
    rows = []
    for name, (df, order, shown, most) in sources.items():
        place = F.struct(*(F.col(c).alias(f"o{k}") for k, c in enumerate(order)))
        ranked = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), place.alias("_order"), F.col(shown).alias("_value"))
        # Of equal places the least value comes first, as a value of its own kind: 22 before 116.
        rank = F.row_number().over(Window.partitionBy("_key").orderBy("_order", "_value"))
        kept = ranked.withColumn("_rank", rank).where(F.col("_rank") <= most)
        rows.append(kept.select("_key", F.lit(name).alias("_source"), "_rank", F.col("_value").cast("string").alias("_shown")))
    item = F.struct(F.col("_rank").alias("rank"), F.col("_shown").alias("shown"))
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col("_source") == n, item))), lambda i: i["shown"]).alias(n) for n in sources]
    merged = reduce(DataFrame.unionByName, rows).groupBy("_key").agg(*lists)
    for name, df in facts.items():
        columns = [c for c in df.columns if c != key]
        one = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(*columns)).alias(name))
        merged = merged.join(one, "_key", "full")
    empty = F.array().cast("array<string>")
    out = findings.join(merged, findings[key] == merged["_key"], "left")
    return out.select(*(findings[c] for c in findings.columns), *(F.coalesce(merged[n], empty).alias(n) for n in sources), *(merged[n] for n in facts))


#: Lists of the summary and how many of their entries a report shows.
CAPS = {"call_sites": 5, "trace": 6, "condition_tokens": 4, "condition_hits": 4, "analyser_calls": 12, "problems": 4, "loaded_via": 4}


def summary_columns(result: Column) -> list[Column]:
    """The flat report columns of a chain's result, a struct of package, version, upgrade, symbol, matched_symbol, outcome, note, condition (statement, state, owner, tokens, hits),
    dataflow (file, line, steps), reach_trace, call_sites, analyser_calls, problems, shipping (shipped, runtime, via) and owner.

    Texts that are missing are empty. A condition outside the code is said with what to look for and where; one of the infrastructure names its owner. The trace is the data flow's,
    else that of the reach; the call sites are the flow's two ends, else the reach's trace, else the hits.
    """
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    some = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    cut = lambda c, name: F.slice(some(c), 1, CAPS[name]).alias(name)
    condition, flow, shipping = result["condition"], result["dataflow"], result["shipping"]
    looked = F.coalesce(F.nullif(F.array_join(F.slice(some(condition["tokens"]), 1, CAPS["condition_tokens"]), ", "), F.lit("")), F.lit("undetermined"))
    where = F.coalesce(F.nullif(condition["owner"], F.lit("")), F.lit("environment and deployment"))
    external = F.when(condition["state"] == "external", F.concat(condition["statement"], F.lit("; look for: "), looked, F.lit("; where: "), where)).when(condition["state"] == "infrastructure", condition["statement"])
    keeper = F.when(condition["state"] == "infrastructure", F.coalesce(F.nullif(condition["owner"], F.lit("")), F.lit("owner of the system")))
    at = F.concat(flow["file"], F.lit(":"), flow["line"].cast("string"))
    sites = F.when(flow.isNotNull(), F.array(F.concat(F.get(some(flow["steps"]), 0), F.lit(" (source)")), F.concat(at, F.lit(" (call)")))).when(F.size(some(result["reach_trace"])) > 0, F.slice(some(result["reach_trace"]), 1, CAPS["trace"])).otherwise(F.slice(some(result["call_sites"]), 1, CAPS["call_sites"]))
    trace = F.when(flow.isNotNull(), F.array_join(some(flow["steps"]), " -> ")).otherwise(F.array_join(some(result["reach_trace"]), " -> "))
    return [
        text(result["package"]).alias("package"), text(result["version"]).alias("installed_version"), text(result["upgrade"]).alias("upgrade"),
        text(F.coalesce(F.nullif(result["matched_symbol"], F.lit("")), result["symbol"])).alias("symbol"), text(result["outcome"]).alias("outcome"), text(result["note"]).alias("outcome_note"),
        F.filter(sites, lambda s: s.isNotNull()).alias("call_sites"), trace.alias("trace"), text(external).alias("external"), text(F.coalesce(keeper, result["owner"])).alias("owner"),
        text(condition["statement"]).alias("condition"), text(condition["state"]).alias("condition_state"), cut(condition["hits"], "condition_hits"), cut(result["analyser_calls"], "analyser_calls"),
        cut(result["problems"], "problems"), text(shipping["shipped"]).alias("shipped"), text(shipping["runtime"]).alias("runtime"), cut(shipping["via"], "loaded_via"),
    ]
