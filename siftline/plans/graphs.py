"""Graph operators over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from .registry import query, table


def _chain(spark, d):
    """Customers as packages: each depends on the one with half its key, and on the next where it is a multiple of five."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("src"), "c_nationkey")
    half = c.where("src > 1").select("src", F.floor(F.col("src") / 2).cast("long").alias("dst"))
    near = c.where("src % 5 = 0").select("src", (F.col("src") + 1).alias("dst"))
    return half.unionByName(near)


_EDGES = """e AS (SELECT c_custkey AS src, c_custkey // 2 AS dst FROM customer WHERE c_custkey > 1 UNION ALL SELECT c_custkey, c_custkey + 1 FROM customer WHERE c_custkey % 5 = 0)"""


@query("g1_graph_build", "SELECT l_partkey AS src, count(DISTINCT l_suppkey) AS dependencies FROM lineitem GROUP BY 1")
def g1(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), "l_suppkey").distinct().groupBy("src").agg(F.count(F.lit(1)).alias("dependencies"))


@query(
    "g2_closure",
    f"""WITH RECURSIVE {_EDGES}, r AS (SELECT c_custkey AS node FROM customer WHERE c_nationkey = 3 UNION SELECT dst FROM r JOIN e ON src = node) SELECT node FROM r""",
)
def g2(spark, d):
    starts = table(spark, d, "customer").where("c_nationkey = 3").select("c_custkey")
    return graph.reach(_chain(spark, d), starts, "src", "dst").select("node")


@query(
    "g3_package_scope",
    f"""WITH RECURSIVE {_EDGES}, p AS (SELECT c_custkey AS node FROM customer WHERE c_custkey > 1000 AND c_nationkey = 1 UNION SELECT dst FROM p JOIN e ON src = node),
        v AS (SELECT c_custkey AS node FROM customer WHERE c_custkey > 1000 AND c_nationkey = 2 UNION SELECT dst FROM v JOIN e ON src = node)
        SELECT c_custkey AS node, CASE WHEN c_custkey IN (FROM p) THEN 'runtime' WHEN c_custkey IN (FROM v) THEN 'dev' ELSE 'unknown' END AS scope FROM customer""",
)
def g3(spark, d):
    customers = table(spark, d, "customer")
    roots = customers.where("c_custkey > 1000 and c_nationkey in (1, 2)").select(F.col("c_custkey").alias("node"), (F.col("c_nationkey") == 2).alias("dev"))
    return graph.scopes(customers.select(F.col("c_custkey").alias("node")), _chain(spark, d), roots)


@query(
    "g4_roots_of_package",
    """WITH RECURSIVE e AS (SELECT c_custkey AS child, c_custkey // 2 AS parent FROM customer WHERE c_custkey > 1),
       r AS (SELECT c_custkey AS node, c_custkey AS top, c_custkey <= 8 AS is_root FROM customer UNION ALL SELECT r.node, e.parent, e.parent <= 8 FROM r JOIN e ON e.child = r.top WHERE NOT r.is_root)
       SELECT node, top AS root FROM r WHERE is_root""",
)
def g4(spark, d):
    """The requirement above each package, climbing until the first root."""
    at = table(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.col("c_custkey").alias("root"))
    parents = table(spark, d, "customer").where("c_custkey > 1").select(F.col("c_custkey").alias("root"), F.floor(F.col("c_custkey") / 2).cast("long").alias("up"))
    done, open_ = at.where("root <= 8"), at.where("root > 8")
    while not open_.isEmpty():
        open_ = graph.durable(open_.join(parents, "root").select("node", F.col("up").alias("root")))
        done, open_ = done.unionByName(open_.where("root <= 8")), open_.where("root > 8")
    return done


@query(
    "g5_introduction_paths",
    f"""WITH RECURSIVE {_EDGES}, r AS (SELECT c_custkey AS node, 0 AS hops FROM customer WHERE c_custkey % 250 = 0 UNION SELECT dst, hops + 1 FROM r JOIN e ON src = node WHERE hops < 12)
        SELECT node, min(hops) AS hops FROM r GROUP BY 1""",
)
def g5(spark, d):
    starts = table(spark, d, "customer").where("c_custkey % 250 = 0").select("c_custkey")
    paths = graph.shortest_paths(_chain(spark, d), starts, "src", "dst", 12)
    return paths.select("node", (F.size("path") - 1).alias("hops"))


@query("g6_runtime_dependents", "SELECT l_suppkey, count(DISTINCT l_partkey) AS dependents FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1")
def g6(spark, d):
    lines = table(spark, d, "lineitem").where("l_returnflag <> 'R'").select("l_suppkey", "l_partkey").distinct()
    return lines.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("dependents"))


@query(
    "g7_perimeter",
    r"""WITH RECURSIVE l AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/]+)', 1) AS host, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS target FROM pages),
       e AS (SELECT DISTINCT a.host AS src, b.host AS dst FROM l a JOIN l b ON a.target = b.target AND a.host <> b.host AND length(a.target) > 12),
       r AS (SELECT min(host) AS node, 0 AS hops FROM l UNION SELECT dst, hops + 1 FROM r JOIN e ON src = node WHERE hops < 3)
       SELECT node, min(hops) AS hops FROM r GROUP BY 1""",
)
def g7(spark, d):
    """Hosts within three hops of the first one, by shared long link targets; linking goes through the target, not through pairs."""
    links = table(spark, d, "pages").select(
        F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), 1)).alias("target")
    )
    links = links.distinct()
    long_links = links.where(F.length("target") > 12)
    both = long_links.select(F.concat(F.lit("h"), "host").alias("src"), F.concat(F.lit("t"), "target").alias("dst"))
    both = both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    first = links.agg(F.concat(F.lit("h"), F.min("host")).alias("node"))
    found = graph.reach(both, first, "src", "dst", 6).where(F.startswith("node", F.lit("h")))
    return found.select(F.substring("node", 2, 1 << 20).alias("node"), F.floor(F.col("hops") / 2).cast("int").alias("hops"))


@query(
    "g10_inheritance_walk",
    """SELECT c_custkey, CASE WHEN c_custkey // 2 = 5 OR c_custkey // 4 = 5 OR c_custkey // 8 = 5 THEN true ELSE false END AS extends_base FROM customer""",
)
def g10(spark, d):
    aliases = table(spark, d, "customer").select(F.col("c_custkey").alias("name"), F.floor(F.col("c_custkey") / 2).cast("long").alias("target"))
    out = None
    for depth in (1, 2, 3):
        step = graph.resolve_chain(aliases, "name", "target", depth).select("name", (F.col("final") == 5).alias(f"d{depth}"))
        out = step if out is None else out.join(step, "name")
    return out.select(F.col("name").alias("c_custkey"), (F.col("d1") | F.col("d2") | F.col("d3")).alias("extends_base"))


@query(
    "g11_alias_groups",
    """WITH RECURSIVE e AS (SELECT o_custkey AS a, o_custkey - o_custkey % 10 AS b FROM orders UNION SELECT o_custkey - o_custkey % 10, o_custkey FROM orders),
       r AS (SELECT DISTINCT a AS node, a AS label FROM e UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.node)
       SELECT node, min(label) AS label FROM r GROUP BY 1""",
)
def g11(spark, d):
    edges = table(spark, d, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_custkey") - F.col("o_custkey") % 10).alias("b"))
    return graph.smallest_label(edges, "a", "b")


@query("j26_alias_resolution", "SELECT c_custkey AS name, CASE WHEN c_custkey > 63 THEN c_custkey // 64 ELSE 0 END AS final FROM customer")
def j26(spark, d):
    aliases = table(spark, d, "customer").select(F.col("c_custkey").alias("name"), F.floor(F.col("c_custkey") / 2).cast("long").alias("target"))
    out = graph.resolve_chain(aliases, "name", "target", 6)
    return out.select("name", "final")
