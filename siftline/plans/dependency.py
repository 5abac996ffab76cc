"""The dependency chain and the validation of proposed verdicts, over the given tables.

Facts are dealt to rows by remainders, in expressions that both engines read alike; the SQL restates the rules.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dependency, validation
from .registry import query, table

_H = "(l_orderkey * 31 + l_linenumber * 17 + l_suppkey * 7 + l_partkey * 3)"


def _three(remainder: str, yes: int, no: int) -> str:
    """True, false or null by a remainder."""
    return f"CASE WHEN {remainder} = {yes} THEN true WHEN {remainder} = {no} THEN false END"


_FACTS = {
    "graph": _three(f"{_H} % 23", 0, 1),
    "graph_checked": f"{_H} % 2 = 0",
    "graph_reopened": f"{_H} % 29 = 1",
    "call_is_safe": f"{_H} % 3 = 0",
    "flow": _three(f"{_H} % 19", 0, 1),
    "checked": f"CASE {_H} % 7 WHEN 0 THEN 'wrong_receiver' WHEN 1 THEN 'not_shipped' WHEN 2 THEN 'test_only' WHEN 3 THEN 'no_input_path' WHEN 4 THEN 'unused' WHEN 5 THEN 'only_in_tests' END",
    "reopened": f"{_H} % 31 = 0",
    "wrong_receiver": f"{_H} % 13 = 2",
    "dev_only": f"{_H} % 13 = 3",
    "used": _three(f"{_H} % 11", 0, 1),
    "test_only": "l_returnflag = 'A'",
    "direct": "l_linestatus = 'F'",
    "input_driven": _three("l_linenumber % 4", 1, 2),
    "weakness_needs_input": "l_suppkey % 2 = 0",
    "names_paths": "l_partkey % 5 = 0",
    "paths_used": _three("l_orderkey % 5", 0, 1),
    "symbol": "CASE l_partkey % 6 WHEN 0 THEN 'none' WHEN 1 THEN 'vague' WHEN 2 THEN 'not_distributed' ELSE 'usable' END",
    "presence": "CASE l_suppkey % 8 WHEN 0 THEN 'absent' WHEN 1 THEN 'not_searchable' WHEN 2 THEN 'call_unconfirmed' WHEN 3 THEN 'referenced' WHEN 4 THEN 'only_in_tests' WHEN 5 THEN NULL ELSE 'called' END",
    "condition": "CASE l_orderkey % 17 WHEN 0 THEN 'absent' WHEN 1 THEN 'absent_by_text' WHEN 2 THEN 'infrastructure' WHEN 3 THEN 'met' END",
    "resolver_found_none": f"{_H} % 4 = 1",
    "reach": "CASE l_linenumber % 3 WHEN 0 THEN 'reachable' WHEN 1 THEN 'no_input_path' END",
}
_FACT_ROWS = "SELECT l_orderkey, l_linenumber, " + ", ".join(f"{sql} AS {name}" for name, sql in _FACTS.items()) + " FROM lineitem"


@query(
    "d14_dependency_verdict",
    f"""WITH f AS ({_FACT_ROWS})
    SELECT l_orderkey, l_linenumber, CASE
      WHEN graph THEN CASE WHEN flow THEN 'actual' WHEN call_is_safe THEN 'condition_absent' ELSE 'actual' END
      WHEN NOT graph THEN CASE WHEN NOT graph_reopened AND graph_checked THEN 'not_reached' ELSE 'present_unproven' END
      WHEN reopened THEN 'present_unproven'
      WHEN wrong_receiver THEN CASE WHEN checked = 'wrong_receiver' THEN 'wrong_receiver' ELSE 'present_unproven' END
      WHEN dev_only THEN CASE WHEN checked = 'not_shipped' THEN 'not_shipped' ELSE 'present_unproven' END
      WHEN flow THEN 'actual'
      WHEN NOT used AND test_only AND direct THEN CASE WHEN checked = 'test_only' THEN 'test_only_import' ELSE 'present_unproven' END
      WHEN NOT flow AND input_driven THEN CASE WHEN checked = 'no_input_path' THEN 'condition_absent' ELSE 'present_unproven' END
      WHEN symbol <> 'none' AND names_paths AND NOT paths_used AND direct THEN CASE WHEN checked = 'unused' THEN 'unused' ELSE 'present_unproven' END
      WHEN symbol IN ('vague', 'not_distributed') AND names_paths AND paths_used THEN 'actual'
      WHEN NOT used AND direct THEN CASE WHEN checked = 'unused' THEN 'unused' ELSE 'present_unproven' END
      WHEN NOT used THEN 'no_direct_call'
      WHEN condition = 'absent_by_text' THEN CASE WHEN resolver_found_none THEN 'not_called' ELSE 'present_unproven' END
      WHEN condition = 'absent' THEN 'condition_absent'
      WHEN condition = 'infrastructure' THEN 'infrastructure'
      WHEN symbol = 'none' THEN 'undecided'
      WHEN symbol = 'not_distributed' THEN 'not_applicable'
      WHEN symbol = 'vague' OR presence IS NULL OR presence = 'not_searchable' THEN 'undecided'
      WHEN presence = 'absent' THEN CASE WHEN resolver_found_none THEN 'not_called' ELSE 'no_direct_call' END
      WHEN presence = 'call_unconfirmed' THEN 'call_unconfirmed'
      WHEN presence = 'referenced' THEN CASE WHEN resolver_found_none THEN 'not_called' ELSE 'mentioned_only' END
      WHEN presence = 'only_in_tests' THEN CASE WHEN checked = 'only_in_tests' THEN 'only_in_tests' ELSE 'present_unproven' END
      WHEN input_driven IS NULL AND NOT weakness_needs_input THEN 'present_unproven'
      WHEN NOT input_driven THEN 'actual'
      WHEN reach = 'reachable' THEN 'actual'
      ELSE 'present_unproven' END AS outcome FROM f""",
)
def d14(spark, d):
    facts = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(F.expr(sql).alias(name) for name, sql in _FACTS.items()))
    verdict = dependency.dependency_verdict(dependency.facts_of(**{name: F.col(name) for name in _FACTS}))
    return facts.select("l_orderkey", "l_linenumber", verdict["outcome"].alias("outcome"))


_SHIP = {
    "ecosystem": "CASE l_partkey % 4 WHEN 0 THEN 'composer' WHEN 1 THEN 'yarn' WHEN 2 THEN 'npm' END",
    "declared": "CASE l_suppkey % 4 WHEN 0 THEN 'dependencies' WHEN 1 THEN 'devDependencies' WHEN 2 THEN 'transitive' ELSE '' END",
    "scope": "CASE l_orderkey % 3 WHEN 0 THEN 'runtime' WHEN 1 THEN 'dev' ELSE 'unknown' END",
    "imported": "l_partkey % 7 = 0",
    "loaded": "l_partkey % 7 = 1",
    "started": "l_partkey % 5 = 1",
    "has_roots": "l_suppkey % 3 = 0",
    "tree": "CASE l_linenumber % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'production' WHEN 2 THEN 'none' ELSE 'unknown' END",
    "server": "l_orderkey % 2 = 0",
    "client": "l_orderkey % 5 = 0",
    "shared": "l_orderkey % 7 = 0",
    "bundler": "l_suppkey % 2 = 0",
    "rendered": "l_suppkey % 5 = 0",
}


@query(
    "d23_shipping_facts",
    f"""WITH f AS (SELECT l_orderkey, l_linenumber, {", ".join(f"{sql} AS {name}" for name, sql in _SHIP.items())} FROM lineitem),
    w AS (SELECT *, CASE WHEN shared AND rendered THEN 'both' WHEN (server OR shared AND NOT bundler) AND (client OR shared AND bundler) THEN 'both'
      WHEN server OR shared AND NOT bundler THEN 'node' WHEN client OR shared AND bundler THEN 'browser' ELSE 'unknown' END AS place FROM f),
    v AS (SELECT *, CASE WHEN NOT loaded THEN 'node' WHEN started AND place = 'browser' THEN 'both' WHEN started AND place = 'unknown' THEN 'node' ELSE place END AS via FROM w)
    SELECT l_orderkey, l_linenumber,
      CASE WHEN ecosystem = 'composer' THEN CASE WHEN scope = 'runtime' OR declared = 'dependencies' THEN 'runtime' WHEN scope = 'dev' OR declared = 'devDependencies' THEN CASE WHEN tree = 'full' THEN 'image_only' ELSE 'build_only' END ELSE 'unknown' END
        WHEN imported OR loaded OR started THEN 'runtime'
        WHEN has_roots OR scope <> 'unknown' THEN CASE tree WHEN 'full' THEN 'image_only' WHEN 'production' THEN CASE WHEN scope <> 'runtime' THEN 'build_only' ELSE 'image_only' END WHEN 'none' THEN 'build_only' ELSE CASE WHEN scope = 'dev' THEN 'build_only' ELSE 'unknown' END END
        ELSE 'unknown' END AS shipped,
      CASE WHEN ecosystem = 'composer' THEN CASE WHEN scope = 'runtime' OR declared = 'dependencies' THEN 'server' ELSE 'unknown' END WHEN imported THEN place WHEN loaded OR started THEN via ELSE 'unknown' END AS side FROM v""",
)
def d23(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(F.expr(sql).alias(name) for name, sql in _SHIP.items()))
    rows = rows.withColumn("place", dependency.shipping_side(*map(F.col, ("server", "client", "shared", "bundler", "rendered"))))
    facts = dependency.shipping(*map(F.col, ("ecosystem", "declared", "scope", "imported", "loaded", "started", "has_roots", "tree", "place")))
    return rows.withColumn("f", facts).select("l_orderkey", "l_linenumber", "f.shipped", "f.side")


@query(
    "d25_reach_assessment",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 'unknown' WHEN l_partkey % 3 <> 0 AND l_suppkey % 4 = 1 THEN 'no_input_path'
       WHEN l_returnflag = 'R' AND (l_partkey % 3 = 0 OR l_suppkey % 4 = 0) THEN 'reachable' ELSE 'unknown' END AS reach FROM lineitem""",
)
def d25(spark, d):
    answer = F.when(F.col("l_suppkey") % 4 == 0, "yes").when(F.col("l_suppkey") % 4 == 1, "no")
    reach = dependency.reach_assessment(F.col("l_quantity") >= 10, F.col("l_returnflag") == "R", F.col("l_partkey") % 3 == 0, answer)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", reach.alias("reach"))


_STAGE = {
    "license": "o_orderkey % 41 = 0",
    "misconfiguration": "o_orderkey % 11 = 0",
    "platform": "o_custkey % 2 = 0",
    "secret": "o_orderkey % 13 = 0",
    "confirms": "o_custkey % 5 = 0",
    "hard": "o_orderkey % 7 = 0",
    "authoritative": "o_custkey % 17 = 0",
    "mismatch": "o_orderkey % 19 = 0",
    "dependency": "o_custkey % 3 <> 0",
    "advisory": "o_custkey % 23 = 0",
    "closes": "o_orderstatus = 'F'",
    "policy": "CASE o_custkey % 4 WHEN 0 THEN 'false_positive' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'unknown' ELSE '' END",
    "final": "o_orderkey % 2 = 0",
}


@query(
    "d26_record_stage",
    f"""WITH f AS (SELECT o_orderkey, {", ".join(f"{sql} AS {name}" for name, sql in _STAGE.items())} FROM orders)
    SELECT o_orderkey, CASE WHEN license THEN 'license' WHEN NOT confirms AND misconfiguration THEN CASE WHEN platform THEN 'platform_handled' ELSE 'misconfiguration' END
      WHEN NOT confirms AND secret THEN 'secret' WHEN NOT confirms AND NOT authoritative AND hard THEN 'heuristics' WHEN NOT confirms AND mismatch THEN 'deployment_mismatch'
      WHEN authoritative THEN 'trace_gate'
      WHEN dependency THEN CASE WHEN advisory THEN 'deployment_mismatch' WHEN closes AND (policy = 'false_positive' OR policy <> 'confirmed' AND final) THEN 'chain_closed' WHEN policy <> '' THEN 'policy' ELSE 'model' END
      ELSE 'model' END AS stage FROM f""",
)
def d26(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", *(F.expr(sql).alias(name) for name, sql in _STAGE.items()))
    return rows.select("o_orderkey", dependency.record_stage(*map(F.col, _STAGE)).alias("stage"))


_VERDICT = "CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'false_positive' ELSE 'unknown' END"
_OUTCOME = "CASE o_custkey % 5 WHEN 0 THEN 'call_unconfirmed' WHEN 1 THEN 'mentioned_only' WHEN 2 THEN 'actual' WHEN 3 THEN 'present_unproven' ELSE 'undecided' END"
_LEVEL = "CASE o_orderkey % 6 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' WHEN 4 THEN 'none' ELSE '' END"


def _proposed(spark, d, **columns: str):
    return table(spark, d, "orders").select("o_orderkey", F.expr(_VERDICT).alias("said"), F.expr(_OUTCOME).alias("outcome"), *(F.expr(sql).alias(name) for name, sql in columns.items()))


@query(
    "d6_unproven_call",
    f"""WITH f AS (SELECT o_orderkey, {_VERDICT} AS said, {_OUTCOME} AS outcome, CASE o_orderkey % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'codeql' ELSE '' END AS route, o_custkey % 7 = 0 AS parent, o_orderkey % 3 = 0 AS resolved FROM orders)
    SELECT o_orderkey, CASE WHEN said = 'confirmed' AND NOT parent AND (outcome IN ('call_unconfirmed', 'mentioned_only') OR route = 'text' AND NOT resolved) THEN 'unknown' ELSE said END AS verdict,
      CASE WHEN said = 'confirmed' AND NOT parent AND outcome IN ('call_unconfirmed', 'mentioned_only') THEN 'unproven_call: name only' WHEN said = 'confirmed' AND NOT parent AND route = 'text' AND NOT resolved THEN 'unproven_call: text route' END AS override FROM f""",
)
def d6(spark, d):
    rows = _proposed(spark, d, route="CASE o_orderkey % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'codeql' ELSE '' END", parent="o_custkey % 7 = 0", resolved="o_orderkey % 3 = 0")
    step = validation.unproven_call(F.col("said"), F.col("outcome"), F.col("route"), F.col("resolved"), F.col("parent"))
    return rows.withColumn("s", step).select("o_orderkey", "s.verdict", "s.override")


_REASON = "CASE o_custkey % 4 WHEN 0 THEN 'The package is a devDependency, so it is not shipped.' WHEN 1 THEN 'The value is escaped first.' ELSE 'The call is elsewhere.' END"
_EVIDENCE = "CASE o_orderkey % 5 WHEN 0 THEN 'import' WHEN 1 THEN 'lsp' WHEN 2 THEN 'text' ELSE '' END"
_SHIPPED = "CASE o_orderkey % 3 WHEN 0 THEN 'runtime' WHEN 1 THEN 'build_only' ELSE '' END"
_CLASS = "CASE o_custkey % 3 WHEN 0 THEN 'sanitized_dataflow' ELSE 'insufficient_context' END"


@query(
    "d7_dependency_guard",
    f"""WITH f AS (SELECT o_orderkey, {_VERDICT} AS said, {_OUTCOME} AS outcome, o_custkey % 4 = 0 AS blames, {_EVIDENCE} AS evidence, {_SHIPPED} AS shipped, {_CLASS} AS kind FROM orders),
    c AS (SELECT *, said = 'false_positive' AND shipped = 'runtime' AND blames AS a, said = 'false_positive' AND outcome IN ('present_unproven', 'actual') AND evidence IN ('import', 'lsp') AND kind <> 'sanitized_dataflow' AS b FROM f)
    SELECT o_orderkey, CASE WHEN a OR b THEN 'unknown' ELSE said END AS verdict, CASE WHEN a THEN 'shipping_conflict' WHEN b THEN 'chain_conflict' END AS override FROM c""",
)
def d7(spark, d):
    rows = _proposed(spark, d, evidence=_EVIDENCE, shipped=_SHIPPED, reason=_REASON, kind=_CLASS)
    step = validation.guarded_closure(*map(F.col, ("said", "outcome", "evidence", "shipped", "reason", "kind")))
    return rows.withColumn("s", step).select("o_orderkey", "s.verdict", "s.override")


@query(
    "d8_unproven_dependency",
    f"""WITH f AS (SELECT o_orderkey, {_VERDICT} AS said, o_custkey % 4 <> 0 AS chain, CASE o_orderkey % 9 WHEN 0 THEN false WHEN 1 THEN true END AS installed, o_custkey % 3 AS m, o_orderkey % 8 = 0 AS parent, o_orderkey % 10 = 0 AS graph, o_custkey % 11 = 0 AS outside, o_orderkey % 2 = 0 AS flow FROM orders),
    c AS (SELECT *, CASE WHEN said <> 'confirmed' OR NOT chain THEN NULL WHEN NOT installed THEN 'symbol not installed' WHEN m = 1 AND NOT parent AND NOT graph THEN 'public entry only' WHEN outside THEN 'condition unchecked' WHEN NOT flow AND NOT parent AND NOT graph THEN 'no path' END AS why FROM f)
    SELECT o_orderkey, CASE WHEN why IS NULL THEN said ELSE 'unknown' END AS verdict, 'unproven_dependency: ' || why AS override FROM c""",
)
def d8(spark, d):
    """Every third symbol is matched itself, every third by another name, every third by a public entry."""
    rows = _proposed(
        spark, d, chain="o_custkey % 4 <> 0", installed="CASE o_orderkey % 9 WHEN 0 THEN false WHEN 1 THEN true END", matched="CASE o_custkey % 3 WHEN 0 THEN 'lib::parse' WHEN 1 THEN 'lib::other' ELSE 'load' END",
        parent="o_orderkey % 8 = 0", graph="o_orderkey % 10 = 0", condition="CASE WHEN o_custkey % 11 = 0 THEN 'external' END", flow="o_orderkey % 2 = 0",
    )
    c = F.col
    step = validation.unproven_dependency(c("said"), c("chain"), c("installed"), F.lit("parse"), c("matched"), F.array(F.lit("load")), c("parent"), c("graph"), c("condition"), c("flow"))
    return rows.withColumn("s", step).select("o_orderkey", "s.verdict", "s.override")


@query(
    "d9_dependency_review",
    f"""WITH f AS (SELECT o_orderkey, {_VERDICT} AS said, {_LEVEL} AS priority, CASE o_custkey % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'low' END AS severity, o_custkey % 2 = 0 AS fix, CASE WHEN o_custkey % 7 > 0 THEN (o_orderkey % 100) / 100.0::DOUBLE END AS stated FROM orders),
    p AS (SELECT *, CASE WHEN priority = '' THEN 'medium' ELSE priority END AS level FROM f)
    SELECT o_orderkey, CASE said WHEN 'unknown' THEN true WHEN 'confirmed' THEN level IN ('critical', 'high') AND coalesce(severity = 'critical', false) OR NOT fix AND level IN ('critical', 'high', 'medium') ELSE coalesce(stated, 0) <= 0.86 END AS person FROM p""",
)
def d9(spark, d):
    rows = _proposed(spark, d, priority=_LEVEL, severity="CASE o_custkey % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'low' END", fix="o_custkey % 2 = 0")
    stated = F.when(F.col("o_custkey") % 7 > 0, (F.col("o_orderkey") % 100) / 100.0)
    rows = rows.join(table(spark, d, "orders").select("o_orderkey", stated.alias("stated")), "o_orderkey")
    return rows.select("o_orderkey", validation.review_needed(*map(F.col, ("said", "priority", "severity", "fix", "stated"))).alias("person"))


@query(
    "d11_trace_gate",
    """WITH f AS (SELECT item_id, text, item_id % 6 AS m FROM benchmark)
    SELECT item_id, CASE WHEN m = 5 AND length(text) >= 4 THEN 'false_positive' ELSE 'confirmed' END AS verdict,
      CASE m WHEN 0 THEN 'baseline kept: model error' WHEN 1 THEN 'baseline kept: no answer' WHEN 2 THEN 'baseline kept: not refuted' WHEN 5 THEN 'baseline refuted' ELSE 'baseline kept: not grounded' END AS override FROM f""",
)
def d11(spark, d):
    """Answers about benchmark passages: errors, none, agreement, invented quotes, vague reasons, and grounded refutations."""
    m, text = F.col("item_id") % 6, F.col("text")
    quotes = F.when(m == 3, F.array(F.substring("text", 1, 12), F.lit("### never said ###"))).otherwise(F.array(F.substring("text", 1, 12), F.substring("text", 5, 30)))
    step = validation.trace_gate(
        F.when(m == 2, "confirmed").when(m >= 3, "false_positive"), F.when(m == 4, "Looks fine to me, as far as I see.").otherwise("The vulnerable branch is not reached: the input is fixed."),
        F.lit(None).cast("string"), quotes, text, F.when(m == 0, "timeout"),
    )
    return table(spark, d, "benchmark").withColumn("s", step).select("item_id", "s.verdict", "s.override")


@query(
    "d3_route_signal",
    r"""WITH f AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS area, page_id % 4 AS hops FROM pages)
    SELECT page_id, CASE WHEN area = 'en' THEN 'inside an HTTP entry point: /' || area WHEN hops > 0 THEN hops || ' hop(s) from an HTTP entry point' ELSE 'unknown' END AS reachability,
      CASE WHEN area = 'en' THEN 'toward_confirmed' WHEN hops > 0 THEN 'neutral' END AS direction, CASE WHEN area = 'en' THEN 0.6 WHEN hops > 0 THEN 0.0 END::DOUBLE AS weight FROM f""",
)
def d3(spark, d):
    area = F.regexp_extract("url", r"^https?://[^/]+/([a-z]+)/", 1)
    hops = F.col("page_id") % 4
    signal = validation.route_signal(F.when(area == "en", F.concat(F.lit("/"), area)), F.when(hops > 0, hops), F.lit("unknown"))
    return table(spark, d, "pages").withColumn("s", signal).select("page_id", "s.reachability", "s.direction", "s.weight")


@query(
    "p6_dependency_facts",
    """WITH f AS (SELECT page_id, page_id % 6 AS m, CAST(page_id AS VARCHAR) AS i FROM pages)
    SELECT page_id, CASE m WHEN 0 THEN 'lib' || i WHEN 1 THEN 'scope/p' || i WHEN 2 THEN 'name' || i WHEN 3 THEN 'lone' || i WHEN 5 THEN 'both' || i END AS package,
      CASE m WHEN 0 THEN 'npm' WHEN 1 THEN 'composer' WHEN 2 THEN 'pypi' WHEN 3 THEN '' WHEN 5 THEN 'go' END AS ecosystem,
      CASE m WHEN 0 THEN '1.' || i WHEN 1 THEN '2.3' WHEN 2 THEN '0.1' WHEN 5 THEN '7' END AS installed_version,
      CASE m WHEN 0 THEN ['2.0', '2.1', '3'] WHEN 1 THEN ['2.4'] WHEN 2 THEN [] WHEN 3 THEN [] WHEN 5 THEN ['8'] END AS fixed_versions,
      CASE m WHEN 0 THEN 'https://x.example/a' END AS advisory_url FROM f""",
)
def p6(spark, d):
    i, m = F.col("page_id").cast("string"), F.col("page_id") % 6
    said = (
        F.when(m == 0, F.concat(F.lit("Found\n Package: nodejs/lib"), i, F.lit("\nInstalled Version: 1."), i, F.lit("\nFixed Versions: 2.0, 2.1 or 3\nLink: [a](https://x.example/a)\n")))
        .when(m == 1, F.concat(F.lit("CVE-2024-1 in php/scope/p"), i, F.lit("@2.3, see\nbelow fixed=2.4 now")))
        .when(m == 3, F.concat(F.lit("component : lone"), i))
        .when(m == 5, F.concat(F.lit("Package: other\nVersion: 6\nFixed Version: 8")))
    )
    props = F.when(m == 2, F.array(F.lit("x"), F.concat(F.lit("see pkg:pip/name"), i, F.lit("@0.1?a=b")))).when(m == 5, F.array(F.concat(F.lit("pkg:golang/both"), i, F.lit("@7")))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, d, "pages").select("page_id", said.alias("said"), props.alias("props"))
    return dependency.with_dependency_facts(rows, "said", "props").drop("said", "props")


@query(
    "p42_discovered_findings",
    """WITH p AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'npm' WHEN 1 THEN 'composer' ELSE 'cargo' END AS ecosystem, p_size || '.0' AS version FROM part WHERE p_size % 10 <> 0),
    a AS (SELECT l_partkey, l_suppkey, min(l_linenumber) AS line FROM lineitem GROUP BY 1, 2)
    SELECT 'ADV-' || l_suppkey || '-p' || p_partkey AS finding_id, 'ADV-' || l_suppkey AS rule_id, CASE line WHEN 1 THEN 'critical' WHEN 2 THEN 'medium' WHEN 3 THEN 'medium' ELSE 'low' END AS severity,
      CASE ecosystem WHEN 'composer' THEN 'composer.json' ELSE 'package.json' END AS file_path, version AS installed_version, CASE WHEN p_partkey % 4 = 0 THEN true END AS dev_only FROM p JOIN a ON l_partkey = p_partkey""",
)
def p42(spark, d):
    part = table(spark, d, "part")
    ecosystem = F.when(F.col("p_partkey") % 3 == 0, "npm").when(F.col("p_partkey") % 3 == 1, "composer").otherwise("cargo")
    version = F.when(F.col("p_size") % 10 == 0, "=> ../local").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".0")))
    listed = part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"), ecosystem.alias("ecosystem"), version.alias("version"), (F.col("p_partkey") % 4 == 0).alias("dev"), F.col("p_partkey").alias("key"))
    line = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min("l_linenumber").alias("line"))
    level = F.when(F.col("line") == 1, "CRITICAL").when(F.col("line") == 2, "weird").when(F.col("line") > 3, "low")
    advisories = listed.join(line, F.col("key") == F.col("l_partkey")).select(
        "name", "ecosystem", "version", F.concat(F.lit("ADV-"), F.col("l_suppkey").cast("string")).alias("advisory_id"), F.lit("").alias("summary"), level.alias("level"), F.array(F.lit("9")).alias("fixed_versions")
    )
    packages = listed.drop("key")
    found, _ = dependency.discovered_findings(packages.unionByName(packages.where("dev")), advisories)
    return found.select("finding_id", "rule_id", "severity", "file_path", "installed_version", "dev_only")


@query(
    "d27_symbol_candidates",
    r"""WITH w AS (SELECT doc_id, list_distinct(regexp_split_to_array(text, '[^A-Za-z]+')) AS w FROM documents),
    f AS (SELECT doc_id, list_filter(w, lambda x: regexp_full_match(x, '[a-z]{7}')) AS a, list_filter(w, lambda x: regexp_full_match(x, '[A-Z][a-z]{9,}')) AS b, list_filter(w, lambda x: regexp_full_match(x, '[a-z]{12}')) AS c FROM w),
    g AS (SELECT *, list_filter(a, lambda w: starts_with(w, 'th')) AS own FROM f)
    SELECT doc_id, CASE WHEN len(own) > 0 THEN 'advisory' WHEN len(b) > 0 THEN 'prose' WHEN len(c) > 0 THEN 'diff' ELSE 'none' END AS candidates_from,
      least(40, CASE WHEN len(own) > 0 THEN len(own) WHEN len(b) > 0 THEN len(b) ELSE len(c) END) AS candidates FROM g""",
)
def d27(spark, d):
    words = lambda pattern: F.filter("words", lambda w: w.rlike(pattern))
    docs = table(spark, d, "documents").select("doc_id", F.split("text", "[^A-Za-z]+").alias("words"))
    docs = docs.select("doc_id", words("^[a-z]{7}$").alias("listed"), words("^[A-Z][a-z]{9,}$").alias("prose"), words("^[a-z]{12}$").alias("changed"))
    docs = docs.withColumn("exported", F.filter("listed", lambda w: F.startswith(w, F.lit("th"))))
    found = dependency.symbol_candidates(docs, "listed", "exported", "prose", "changed")
    return found.select("doc_id", "candidates_from", F.size("candidates").cast("long").alias("candidates"))
