"""Joins over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import versions
from ..operators import joins
from .registry import query, table


@query("j1_rule_lookup", "SELECT l_orderkey, l_linenumber, p_brand AS rule_name FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size > 10")
def j1(spark, d):
    rules = table(spark, d, "part").where("p_size > 10").select("p_partkey", F.col("p_brand").alias("rule_name"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return lines.join(rules, F.col("l_partkey") == F.col("p_partkey"), "left").select("l_orderkey", "l_linenumber", "rule_name")


@query(
    "j2_unique_suffix",
    """WITH c AS (SELECT DISTINCT list_last(string_split(p_type, ' ')) AS tail, p_type AS full_name, p_brand AS v FROM part),
       q AS (SELECT DISTINCT p_brand AS v, tail AS name FROM c, (SELECT DISTINCT p_brand FROM part)),
       m AS (SELECT q.name, q.v, count(DISTINCT full_name) AS n, min(full_name) AS any_name, count(DISTINCT CASE WHEN c.v = q.v THEN full_name END) AS k,
                    min(CASE WHEN c.v = q.v THEN full_name END) AS same FROM q JOIN c ON c.tail = q.name GROUP BY 1, 2)
       SELECT name || ' ' || v AS finding, CASE WHEN n = 1 THEN any_name WHEN k = 1 THEN same ELSE name END AS qualified FROM m""",
)
def j2(spark, d):
    part = table(spark, d, "part")
    catalogue = part.select(F.replace("p_type", F.lit(" "), F.lit("/")).alias("full"), F.col("p_brand").alias("v")).distinct()
    names = part.select(F.element_at(F.split("p_type", " "), -1).alias("name")).distinct()
    brands = part.select(F.col("p_brand").alias("version")).distinct()
    # Names of types and brands: both fixed lists of a few dozen.
    findings = names.crossJoin(F.broadcast(brands)).withColumn("finding", F.concat_ws(" ", "name", "version"))
    out = joins.unique_suffix(findings, "finding", "name", "version", catalogue, "full", "v")
    return out.select("finding", F.replace("qualified", F.lit("/"), F.lit(" ")).alias("qualified"))


@query(
    "j3_version_range",
    """SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'unknown' WHEN 1 THEN 'unknown' WHEN 2 THEN 'affected'
         ELSE CASE WHEN p_size BETWEEN 5 AND 14 OR p_size >= 30 THEN 'affected' ELSE 'unaffected' END END AS state FROM part""",
)
def j3(spark, d):
    kind = F.col("p_partkey") % 7
    version = F.concat(F.col("p_size").cast("string"), F.lit(".2.0"))
    none = F.lit(None).cast("string")
    event = lambda i=none, f=none, la=none: F.struct(i.alias("introduced"), f.alias("fixed"), la.alias("last_affected"), none.alias("limit"))
    bad = F.when(kind == 0, "not a version").otherwise("5.0.0")
    ranges = F.array(
        F.struct(F.lit("GIT").alias("type"), F.array(event(F.lit("0"))).alias("events")),
        F.struct(F.when(kind == 1, "GIT").otherwise("SEMVER").alias("type"), F.array(event(bad), event(f=F.lit("15.0.0")), event(F.lit("30.0.0-rc1"))).alias("events")),
    )
    listed = F.when(kind == 2, F.array(version))
    return table(spark, d, "part").select("p_partkey", versions.version_state(version, F.lit("npm"), listed, ranges).alias("state"))


@query(
    "j4_package_advisories",
    """WITH p AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) SELECT p_brand, count(*) AS pairs FROM p JOIN part ON p_partkey = l_partkey GROUP BY 1""",
)
def j4(spark, d):
    packages = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    advisories = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return packages.join(advisories, "l_partkey").groupBy("p_brand").agg(F.count(F.lit(1)).alias("pairs"))


@query(
    "j5_advisory_merge",
    """SELECT source, arg_min(doc_id, (-length(text), doc_id)) AS longest, arg_min(lang, doc_id) AS first_lang, list_sort(list(DISTINCT lang)) AS langs FROM documents GROUP BY 1""",
)
def j5(spark, d):
    rows = table(spark, d, "documents")
    return rows.groupBy("source").agg(
        F.min_by("doc_id", F.struct(-F.length("text"), F.col("doc_id"))).alias("longest"),
        F.min_by("lang", "doc_id").alias("first_lang"),
        F.array_sort(F.collect_set("lang")).alias("langs"),
    )


@query(
    "j6_first_alias",
    """SELECT event_id, coalesce(a.quality, b.quality) AS quality FROM events LEFT JOIN labels a ON a.doc_id = user_id LEFT JOIN labels b ON b.doc_id = user_id + 1""",
)
def j6(spark, d):
    events = table(spark, d, "events").select("event_id", F.array(F.col("user_id"), F.col("user_id") + 1).alias("aliases"))
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("alias"), "quality")
    return joins.first_alias(events, "event_id", "aliases", labels, "alias", ["quality"]).select("event_id", "quality")


@query("j7_label_join", "SELECT doc_id, quality, toxic FROM documents JOIN labels USING (doc_id)")
def j7(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id").select("doc_id", "quality", "toxic")


@query(
    "j8_reuse_split",
    """WITH f AS (SELECT doc_id, left(sha256(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))), 32) AS fp FROM documents),
       h AS (SELECT fp, min(doc_id) AS reused_from FROM f WHERE doc_id % 2 = 0 GROUP BY 1)
       SELECT doc_id, reused_from, CASE WHEN reused_from IS NULL THEN 'new_or_changed' WHEN reused_from % 10 = 0 THEN 'redo:unknown' ELSE 'reused' END AS reason
       FROM f LEFT JOIN h USING (fp) WHERE doc_id % 2 = 1""",
)
def j8(spark, d):
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, d, "documents").select("doc_id", F.substring(F.sha2(F.trim(F.regexp_replace(text, r"\s+", " ")), 256), 1, 32).alias("fp"))
    # Odd documents are this run's findings, even ones the last run's verdicts.
    history = rows.where("doc_id % 2 = 0").groupBy("fp").agg(F.min("doc_id").alias("reused_from"))
    reason = F.when(F.col("reused_from").isNull(), "new_or_changed").when(F.col("reused_from") % 10 == 0, "redo:unknown").otherwise("reused")
    return rows.where("doc_id % 2 = 1").join(history, "fp", "left").select("doc_id", "reused_from", reason.alias("reason"))


@query(
    "j10_enclosing_span",
    """SELECT a.conv_id, a.turn, max(b.turn) AS span FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.role = 'user' AND b.turn <= a.turn GROUP BY 1, 2""",
)
def j10(spark, d):
    rows = joins.as_of(table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", F.when(F.col("role") == "user", F.col("turn")), "span")
    return rows.where("span is not null").select("conv_id", "turn", "span")


@query("j11_call_site_semi", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 200000)")
def j11(spark, d):
    hits = table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(hits, "l_orderkey", "left_semi")


@query(
    "j12_keyword_join",
    """WITH k AS (SELECT DISTINCT lower(r_name) AS keyword FROM region UNION SELECT DISTINCT unnest(string_split(lower(text), ' ')) FROM benchmark),
       w AS (SELECT DISTINCT doc_id, unnest(string_split(lower(text), ' ')) AS keyword FROM documents)
       SELECT keyword, count(*) AS docs FROM w JOIN k USING (keyword) WHERE keyword <> '' GROUP BY 1""",
)
def j12(spark, d):
    """Keywords as they stand between blanks, with their punctuation."""
    words = lambda name: table(spark, d, name).select(F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("keyword")).where("keyword <> ''")
    names = table(spark, d, "region").select(F.lower("r_name").alias("keyword")).union(words("benchmark")).distinct()
    return words("documents").groupBy("keyword").agg(F.count(F.lit(1)).alias("docs")).join(names, "keyword")


@query(
    "j12_every_keyword",
    """WITH k AS (SELECT DISTINCT lower(r_name) AS keyword FROM region UNION SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[\\s.,]+')) FROM benchmark),
       w AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[\\s.,]+')) AS keyword FROM documents)
       SELECT keyword, count(*) AS docs FROM w JOIN k USING (keyword) WHERE keyword <> '' GROUP BY 1""",
)
def j12_every(spark, d):
    """Keywords without their punctuation."""
    words = lambda name: table(spark, d, name).select(F.explode(F.array_distinct(F.split(F.lower("text"), r"[\s.,]+"))).alias("keyword")).where("keyword <> ''")
    names = table(spark, d, "region").select(F.lower("r_name").alias("keyword")).union(words("benchmark")).distinct()
    # Counted before the join, so that a common word is one row there.
    return words("documents").groupBy("keyword").agg(F.count(F.lit(1)).alias("docs")).join(names, "keyword")


@query(
    "j14_variant_search",
    """WITH l AS (SELECT doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '\\s+', ' ', 'g')) AS shape FROM documents),
       s AS (SELECT DISTINCT shape FROM l WHERE doc_id % 50 = 0 AND length(shape) >= 12),
       c AS (SELECT l.shape, l.doc_id FROM l JOIN s USING (shape) WHERE l.doc_id % 50 <> 0 GROUP BY 1, 2),
       r AS (SELECT *, row_number() OVER (PARTITION BY shape ORDER BY doc_id) AS k FROM c)
       SELECT md5(shape) AS seed, doc_id FROM r WHERE k <= 20""",
)
def j14(spark, d):
    from ..operators.windows import cap

    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    shapes = lines.select("doc_id", F.trim(F.regexp_replace("line", r"\s+", " ")).alias("shape"))
    seeds = shapes.where((F.col("doc_id") % 50 == 0) & (F.length("shape") >= 12)).select("shape").distinct()
    # The report shows at most twenty variants of a seed.
    found = shapes.where("doc_id % 50 <> 0").join(seeds, "shape").select("shape", "doc_id").distinct()
    return cap(found, ["shape"], [F.col("doc_id")], 20).select(F.md5("shape").alias("seed"), "doc_id")


@query(
    "j18_import_usage",
    """WITH h AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_matches(url, '/(fr|de)/') AS is_test FROM pages)
       SELECT host, CASE WHEN bool_or(NOT is_test) THEN 'production' ELSE 'test_only' END AS usage FROM h GROUP BY 1""",
)
def j18(spark, d):
    pages = table(spark, d, "pages").select(F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), F.col("url").rlike("/(fr|de)/").alias("is_test"))
    return pages.groupBy("host").agg(F.when(F.bool_or(~F.col("is_test")), "production").otherwise("test_only").alias("usage"))


@query(
    "j23_marker_search",
    """WITH l AS (SELECT source, doc_id, string_split(text, chr(10)) AS lines FROM documents), e AS (SELECT source, doc_id, unnest(range(1, len(lines) + 1)) AS line, unnest(lines) AS t FROM l),
       k AS (SELECT unnest(['@', '+1 (', '####']) AS marker)
       SELECT source, marker, min(doc_id * 1000000 + line) // 1000000 AS doc_id, min(doc_id * 1000000 + line) % 1000000 AS line FROM e JOIN k ON contains(t, marker) GROUP BY 1, 2""",
)
def j23(spark, d):
    lines = table(spark, d, "documents").select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("at", "t"))
    hits = lines.select("source", "doc_id", (F.col("at") + 1).cast("long").alias("line"), F.explode(F.filter(F.array(*map(F.lit, ("@", "+1 (", "####"))), lambda m: F.contains("t", m))).alias("marker"))
    best = hits.groupBy("source", "marker").agg(F.min(F.struct("doc_id", "line")).alias("b"))
    return best.select("source", "marker", "b.doc_id", "b.line")


@query(
    "j24_condition_groups",
    """WITH g AS (SELECT DISTINCT item_id, unnest(string_split(lower(text), ' ')) AS part FROM benchmark),
       w AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS part FROM documents)
       SELECT item_id, count(*) AS parts, count(w.part) AS found, CASE WHEN count(w.part) = count(*) THEN 'holds' ELSE 'absent' END AS state FROM g LEFT JOIN w USING (part) GROUP BY 1""",
)
def j24(spark, d):
    """Every word of a passage, as it stands between blanks, in any document."""
    hits = table(spark, d, "documents").select(F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("part"))
    parts = table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("part"))
    return joins.every_part(parts, hits, "item_id", "part")


@query(
    "j24_every_part",
    """WITH g AS (SELECT DISTINCT item_id, unnest(regexp_split_to_array(lower(text), '[\\s.,]+')) AS part FROM benchmark),
       w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[\\s.,]+')) AS part FROM documents),
       p AS (SELECT item_id, g.part, w.part AS hit FROM g LEFT JOIN w USING (part) WHERE g.part <> '')
       SELECT item_id, count(p.part) AS parts, count(hit) AS found, CASE WHEN count(p.part) = 0 THEN 'external' WHEN count(hit) = count(p.part) THEN 'holds' ELSE 'absent' END AS state
       FROM (SELECT DISTINCT item_id FROM benchmark) LEFT JOIN p USING (item_id) GROUP BY 1""",
)
def j24_every(spark, d):
    """Every word of a passage without its punctuation; a passage without words is external."""
    words = F.filter(F.array_distinct(F.split(F.lower("text"), r"[\s.,]+")), lambda w: w != "")
    hits = table(spark, d, "documents").select(F.explode(words).alias("part"))
    parts = table(spark, d, "benchmark").select("item_id", F.explode_outer(words).alias("part"))
    return joins.every_part(parts, hits, "item_id", "part")


@query(
    "j27_longest_prefix",
    """WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS path FROM pages)
       SELECT page_id, CASE WHEN path = 'fr' OR path LIKE 'fr/%' THEN 'fr' WHEN path = 'en' OR path LIKE 'en/%' THEN 'en' END AS prefix FROM p""",
)
def j27(spark, d):
    catalogue = spark.createDataFrame([("en", "english"), ("fr", "french"), ("enx", "none")], "prefix string, owner string")
    pages = table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1).alias("path"))
    return joins.longest_prefix(pages, "page_id", "path", catalogue, "prefix", "owner").select("page_id", "prefix")


@query("j29_most_specific", "SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'nation' WHEN n_regionkey IN (1, 2) THEN 'region' ELSE 'base' END AS prompt FROM nation")
def j29(spark, d):
    entries = spark.createDataFrame([("nation", 1, [f"n{i}" for i in range(0, 25, 4)]), ("region", 2, ["r1", "r2"])], "prompt string, ordinal int, applies_to array<string>")
    spread = entries.select("prompt", "ordinal", F.explode("applies_to").alias("key"))
    keys = table(spark, d, "nation").select("n_nationkey", F.explode(F.array(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"))).alias("key"))
    best = keys.join(F.broadcast(spread), "key", "left").groupBy("n_nationkey").agg(F.min_by("prompt", "ordinal").alias("prompt"))
    return best.select("n_nationkey", F.coalesce("prompt", F.lit("base")).alias("prompt"))


@query(
    "j30_dev_membership",
    """SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'production' WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') THEN 'dev' END AS membership FROM customer""",
)
def j30(spark, d):
    orders = table(spark, d, "orders")
    sets = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_or(F.col("o_orderstatus") == "F").alias("prod"), F.bool_or(F.col("o_orderstatus") == "O").alias("dev"))
    state = F.when(F.col("prod"), "production").when(F.col("dev"), "dev")
    return table(spark, d, "customer").select("c_custkey").join(sets, "c_custkey", "left").select("c_custkey", state.alias("membership"))


@query("j35_resume", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30)")
def j35(spark, d):
    done = table(spark, d, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


@query(
    "j37_answer_lookup",
    """SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount >= 0.09) THEN true WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity < 10) THEN false END AS reached FROM orders""",
)
def j37(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_discount", "l_quantity")
    orders = table(spark, d, "orders").select("o_orderkey")
    return joins.answered(orders, "o_orderkey", lines.where("l_quantity < 10"), lines.where("l_discount >= 0.09"))


@query("j13_platform_handled", "SELECT p_partkey, CASE WHEN contains(lower(p_type), 'steel') THEN 'metal' WHEN contains(lower(p_type), 'promo') THEN 'promo' END AS handled FROM part")
def j13(spark, d):
    return table(spark, d, "part").select("p_partkey", F.when(F.contains(F.lower("p_type"), F.lit("steel")), "metal").when(F.contains(F.lower("p_type"), F.lit("promo")), "promo").alias("handled"))


@query(
    "j16_first_access_rule",
    """SELECT page_id, CASE WHEN regexp_matches(url, '/de/') THEN 1 WHEN regexp_matches(url, '/[0-9]*5') THEN 2 WHEN regexp_matches(url, '^https') THEN 3 END AS rule FROM pages""",
)
def j16(spark, d):
    rules = [(1, "/de/"), (2, "/[0-9]*5"), (3, "^https")]
    rule = F.coalesce(*(F.when(F.col("url").rlike(p), F.lit(n)) for n, p in rules))
    return table(spark, d, "pages").select("page_id", rule.alias("rule"))


@query("j17_containment", "SELECT item_id, count(doc_id) AS docs FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY 1")
def j17(spark, d):
    """Passages found in documents, by words inside the passage, then as a whole."""
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("passage"))
    sure = joins.containing(table(spark, d, "documents"), "doc_id", "text", items, "item_id", "passage")
    return items.select("item_id").join(sure.groupBy("item_id").agg(F.count(F.lit(1)).alias("docs")), "item_id", "left").select("item_id", F.coalesce("docs", F.lit(0)).cast("long").alias("docs"))
