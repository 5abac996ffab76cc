"""Evidence packages and chain summaries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import package
from .registry import query, table


def _list(rows: str, key: str, most: int, order: str, shown: str, name: str) -> str:
    return f"{name} AS (SELECT k, list(v ORDER BY r) AS v FROM (SELECT {key} AS k, CAST({shown} AS VARCHAR) AS v, row_number() OVER (PARTITION BY {key} ORDER BY {order}, {shown}) AS r FROM {rows}) WHERE r <= {most} GROUP BY 1)"


@query(
    "p29_evidence_package",
    f"""WITH {_list("lineitem", "l_orderkey", 3, "l_linenumber", "'part ' || l_partkey", "code")}, {_list("lineitem WHERE l_returnflag = 'R'", "l_orderkey", 2, "l_shipdate, l_linenumber", "l_suppkey", "trace")},
    {_list("lineitem JOIN part ON p_partkey = l_partkey", "l_orderkey", 4, "p_size DESC, p_partkey, l_linenumber", "p_brand", "symbols")},
    h AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey)[1:3] AS earlier FROM orders GROUP BY 1)
    SELECT o_orderkey, coalesce(code.v, []) AS code, coalesce(trace.v, []) AS trace, coalesce(symbols.v, []) AS symbols, c_name AS component, c_nationkey % 3 = 0 AS exposed, earlier
    FROM orders LEFT JOIN code ON code.k = o_orderkey LEFT JOIN trace ON trace.k = o_orderkey LEFT JOIN symbols ON symbols.k = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN h USING (o_custkey)""",
)
def p29(spark, d):
    """Orders as findings: code lines, trace steps and symbol lines from their items, a component and its exposure, and what was decided earlier for it."""
    orders, items, parts = (table(spark, d, n) for n in ("orders", "lineitem", "part"))
    rows = items.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate", F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("said"))
    symbols = rows.join(parts, F.col("p_partkey") == F.col("l_partkey")).withColumn("small", -F.col("p_size"))
    sources = {
        "code": (rows, ["l_linenumber"], "said", 3),
        "trace": (rows.where("l_returnflag = 'R'"), ["l_shipdate", "l_linenumber"], "l_suppkey", 2),
        "symbols": (symbols, ["small", "p_partkey", "l_linenumber"], "p_brand", 4),
    }
    # What a component's earlier findings were is found once for the component and goes to its findings as one value.
    rank = package.first_rows(orders.select("o_custkey", "o_orderkey"), "o_custkey", ["o_orderkey"], "o_orderkey", 3)
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("component"), (F.col("c_nationkey") % 3 == 0).alias("exposed"))
    # Of a component that is not listed the earlier findings are known all the same.
    component = rank.withColumnRenamed("items", "earlier").join(customers, "o_custkey", "left")
    facts = {"about": orders.select("o_orderkey", "o_custkey").join(component, "o_custkey").select("o_orderkey", "component", "exposed", "earlier")}
    found = package.evidence_package(orders.select("o_orderkey"), "o_orderkey", sources, facts)
    return found.select("o_orderkey", "code", "trace", "symbols", "about.component", "about.exposed", "about.earlier")


@query(
    "p35_chain_summary",
    """SELECT l_orderkey, l_linenumber, 'pkg' || l_partkey AS package, CAST(l_quantity AS INTEGER)::VARCHAR AS installed_version, CASE WHEN l_linenumber % 2 = 0 THEN 'f' || l_suppkey ELSE 's' || l_suppkey END AS symbol,
    CASE WHEN l_partkey % 3 = 0 THEN ['a (source)', 'b.js:' || l_linenumber || ' (call)'] WHEN l_partkey % 3 = 1 THEN ['r1', 'r2'] ELSE list_transform(range(least(l_linenumber + 2, 5)), lambda i: 'h' || i) END AS call_sites,
    CASE WHEN l_partkey % 3 = 0 THEN 'a -> c' WHEN l_partkey % 3 = 1 THEN 'r1 -> r2' ELSE '' END AS trace,
    CASE WHEN l_suppkey % 4 = 0 THEN 'needs x; look for: t1, t2, t3, t4; where: ops' WHEN l_suppkey % 4 = 1 THEN 'needs x; look for: undetermined; where: environment and deployment' WHEN l_suppkey % 4 = 2 THEN 'needs x' ELSE '' END AS external,
    CASE WHEN l_suppkey % 4 = 2 THEN 'owner of the system' WHEN l_returnflag = 'A' THEN 'team' ELSE '' END AS owner, CASE WHEN l_suppkey % 4 < 3 THEN CASE WHEN l_suppkey % 4 = 2 THEN 'infrastructure' ELSE 'external' END ELSE '' END AS condition_state,
    list_transform(range(least(l_linenumber, 4)), lambda i: 'p' || i) AS problems, CASE WHEN l_linestatus = 'O' THEN 'runtime' ELSE '' END AS shipped FROM lineitem""",
)
def p35(spark, d):
    """Items as results of the chain: with a data flow, a reach or hits; with conditions outside the code; with longer lists than a report shows."""
    items = table(spark, d, "lineitem")
    s = lambda c: F.col(c).cast("string")
    numbered = lambda head, n: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.lit(head), i.cast("string")))
    flow = F.when(F.col("l_partkey") % 3 == 0, F.struct(F.lit("b.js").alias("file"), F.col("l_linenumber").alias("line"), F.array(F.lit("a"), F.lit("c")).alias("steps")))
    m = F.col("l_suppkey") % 4
    condition = F.when(m < 3, F.struct(F.lit("needs x").alias("statement"), F.when(m == 2, "infrastructure").otherwise("external").alias("state"), F.when(m == 0, "ops").alias("owner"), F.when(m == 0, numbered("t", F.lit(7))).alias("tokens"), F.array(F.lit("hit")).alias("hits")))
    condition = F.when(m == 0, condition.withField("tokens", F.slice(condition["tokens"], 2, 6))).otherwise(condition)
    result = F.struct(
        F.concat(F.lit("pkg"), s("l_partkey")).alias("package"), F.col("l_quantity").cast("int").alias("version"), F.lit(None).cast("string").alias("upgrade"), F.concat(F.lit("s"), s("l_suppkey")).alias("symbol"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("f"), s("l_suppkey"))).otherwise("").alias("matched_symbol"), F.lit("actual").alias("outcome"), F.lit(None).cast("string").alias("note"), condition.alias("condition"), flow.alias("dataflow"),
        F.when(F.col("l_partkey") % 3 == 1, F.array(F.lit("r1"), F.lit("r2"))).alias("reach_trace"), numbered("h", F.col("l_linenumber") + 2).alias("call_sites"), F.lit(None).cast("array<string>").alias("analyser_calls"), numbered("p", F.col("l_linenumber")).alias("problems"),
        F.when(F.col("l_linestatus") == "O", F.struct(F.lit("runtime").alias("shipped"), F.lit("server").alias("runtime"), F.lit(None).cast("array<string>").alias("via"))).alias("shipping"), F.when(F.col("l_returnflag") == "A", "team").alias("owner"),
    )
    rows = items.select("l_orderkey", "l_linenumber", result.alias("r"))
    return rows.select("l_orderkey", "l_linenumber", *package.summary_columns(F.col("r"))).select(
        "l_orderkey", "l_linenumber", "package", "installed_version", "symbol", "call_sites", "trace", "external", "owner", "condition_state", "problems", "shipped"
    )
