"""Normalisers over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores, text, versions
from ..operators import filters
from .registry import query, table

WORDS_SQL = "CASE lower(trim({c})) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.SEVERITY_WORDS.items()) + " ELSE 'unknown' END"


@query("p1_severity_word", f"SELECT event_id, {WORDS_SQL.format(c='event_type')} AS severity FROM events")
def p1(spark, d):
    return table(spark, d, "events").select("event_id", text.severity_word(F.col("event_type")).alias("severity"))


@query(
    "p2_sarif_severity",
    """SELECT event_id, CASE WHEN event_type = 'click' AND value / 10 >= 9 THEN 'critical' WHEN event_type = 'click' AND value / 10 >= 7 THEN 'high'
         WHEN event_type = 'click' AND value IS NOT NULL THEN 'medium' WHEN event_type = 'error' THEN 'high' WHEN event_type = 'view' THEN 'low' ELSE 'unknown' END AS severity
       FROM events""",
)
def p2(spark, d):
    none = F.lit(None).cast("string")
    kind = F.col("event_type")
    score = F.when(kind == "click", (F.col("value") / 10).cast("string"))
    level = F.when(kind == "error", "error")
    default = F.when(kind == "view", "note")
    severity = text.sarif_severity(score, none, none, none, F.array(F.lit("tag"), kind), level, default)
    return table(spark, d, "events").select("event_id", severity.alias("severity"))


@query("p3_cwe_of_tags", "SELECT p_partkey, 'CWE-' || CAST(CAST(regexp_replace(p_brand, '[^0-9]', '', 'g') AS INTEGER) AS VARCHAR) AS cwe FROM part")
def p3(spark, d):
    tags = F.array(F.lit("security"), F.lit("external/cwe/none"), F.concat(F.lit("external/CWE/cwe-0"), F.col("p_brand")))
    return table(spark, d, "part").select("p_partkey", text.cwe_of(tags).alias("cwe"))


@query(
    "p4_ecosystem_alias",
    "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'go' WHEN 1 THEN 'composer' ELSE lower(trim(coalesce(lang, ''))) END AS ecosystem FROM documents",
)
def p4(spark, d):
    m = F.col("doc_id") % 3
    name = F.when(m == 0, "Golang ").when(m == 1, "Packagist").otherwise(F.col("lang"))
    return table(spark, d, "documents").select("doc_id", filters.ecosystem_name(name).alias("ecosystem"))


@query(
    "p5_package_url",
    r"""SELECT page_id, 'npm' AS type, '@' || regexp_extract(url, '^https?://([^/]+)', 1) || '/pkg' AS name, '1.' || page_id AS version FROM pages""",
)
def p5(spark, d):
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    purl = F.concat(F.lit("pkg:npm/%40"), host, F.lit("/pkg@1."), F.col("page_id").cast("string"), F.lit("?arch=x#sub"))
    return table(spark, d, "pages").select("page_id", text.purl_parts(purl).alias("p")).select("page_id", "p.type", "p.name", "p.version")


_VECTOR = """'CVSS:3.1/AV:' || CASE l_linenumber % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'A' WHEN 2 THEN 'L' ELSE 'P' END
  || '/AC:' || CASE WHEN l_linestatus = 'O' THEN 'L' ELSE 'H' END || '/PR:' || CASE l_returnflag WHEN 'A' THEN 'N' WHEN 'N' THEN 'L' ELSE 'H' END
  || '/UI:' || CASE WHEN l_quantity < 25 THEN 'N' ELSE 'R' END || '/S:' || CASE WHEN l_discount < 0.05 THEN 'U' ELSE 'C' END
  || '/C:' || CASE WHEN l_tax < 0.03 THEN 'H' WHEN l_tax < 0.06 THEN 'L' ELSE 'N' END || '/I:' || CASE WHEN l_suppkey % 2 = 0 THEN 'L' ELSE 'N' END
  || '/A:' || CASE l_partkey % 3 WHEN 0 THEN 'H' WHEN 1 THEN 'L' ELSE 'N' END"""


@query(
    "p10_cvss_base_score",
    """WITH w AS (
  SELECT l_orderkey, l_linenumber,
    CASE l_linenumber % 4 WHEN 0 THEN 0.85 WHEN 1 THEN 0.62 WHEN 2 THEN 0.55 ELSE 0.2 END::DOUBLE AS av, CASE WHEN l_linestatus = 'O' THEN 0.77 ELSE 0.44 END::DOUBLE AS ac,
    l_discount >= 0.05 AS changed,
    CASE WHEN l_discount < 0.05 THEN CASE l_returnflag WHEN 'A' THEN 0.85 WHEN 'N' THEN 0.62 ELSE 0.27 END
         ELSE CASE l_returnflag WHEN 'A' THEN 0.85 WHEN 'N' THEN 0.68 ELSE 0.5 END END::DOUBLE AS pr,
    CASE WHEN l_quantity < 25 THEN 0.85 ELSE 0.62 END::DOUBLE AS ui,
    CASE WHEN l_tax < 0.03 THEN 0.56 WHEN l_tax < 0.06 THEN 0.22 ELSE 0 END::DOUBLE AS c, CASE WHEN l_suppkey % 2 = 0 THEN 0.22 ELSE 0 END::DOUBLE AS i,
    CASE l_partkey % 3 WHEN 0 THEN 0.56 WHEN 1 THEN 0.22 ELSE 0 END::DOUBLE AS a
  FROM lineitem
), s AS (
  SELECT *, 1 - (1 - c) * (1 - i) * (1 - a) AS iss FROM w
), m AS (
  SELECT *, CASE WHEN changed THEN 7.52::DOUBLE * (iss - 0.029::DOUBLE) - 3.25::DOUBLE * pow(iss - 0.02::DOUBLE, 15) ELSE 6.42::DOUBLE * iss END AS impact FROM s
), r AS (
  SELECT *, CAST(round_even(least(10::DOUBLE, (CASE WHEN changed THEN 1.08::DOUBLE ELSE 1 END) * (impact + 8.22::DOUBLE * av * ac * pr * ui)) * 100000, 0) AS BIGINT) AS scaled FROM m
), f AS (
  SELECT l_orderkey, l_linenumber, CASE WHEN impact <= 0 THEN 0 WHEN scaled % 10000 = 0 THEN scaled / 100000.0 ELSE (scaled // 10000 + 1) / 10.0 END::DOUBLE AS score FROM r
)
SELECT score, CASE WHEN score >= 9 THEN 'critical' WHEN score >= 7 THEN 'high' WHEN score >= 4 THEN 'medium' ELSE 'low' END AS level, count(*) AS n FROM f GROUP BY 1, 2""",
)
def p10(spark, d):
    scored = scores.cvss3_scores(table(spark, d, "lineitem").select(F.expr(_VECTOR).alias("vector")), "vector")
    return scored.groupBy("score", "level").agg(F.sum("n").alias("n"))


@query(
    "p17_upgrade_target",
    """WITH v AS (SELECT p_partkey, p_size AS s, [p_size + 9, p_size // 2, p_size + 2] AS f FROM part)
       SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '1.' || (s + 9) || '.0' ELSE '1.' || (s + 2) || '.0' END AS target FROM v""",
)
def p17(spark, d):
    s = F.col("p_size")
    installed = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("1."), s, F.lit("-beta"))).otherwise(F.concat(F.lit("v1."), s, F.lit(".3")))
    fixed = F.array(*(F.concat(F.lit("1."), x.cast("int"), F.lit(".0")) for x in (s + 9, F.floor(s / 2), s + 2)), F.lit("2.0-rc1"))
    return table(spark, d, "part").select("p_partkey", versions.upgrade_target(installed, fixed).alias("target"))


@query(
    "p18_lenient_major",
    """SELECT p_partkey, [p_size % 3, CAST(p_size || '7' AS BIGINT)]::BIGINT[] AS parts,
              CASE WHEN p_size % 3 = 0 THEN [0, CAST(p_size || '7' AS BIGINT)] ELSE [p_size % 3] END::BIGINT[] AS major FROM part""",
)
def p18(spark, d):
    version = F.concat(F.lit("V"), (F.col("p_size") % 3).cast("string"), F.lit("."), F.col("p_size").cast("string"), F.lit("rc7.5"))
    parts = versions.lenient_parts(version)
    return table(spark, d, "part").select("p_partkey", parts.alias("parts"), versions.major(parts).alias("major"))


@query(
    "p19_ordered_versions",
    """SELECT p_brand, max(CASE WHEN p_size % 2 = 0 THEN p_size * 10 + 9 ELSE p_size * 10 END) AS newest FROM part GROUP BY 1""",
)
def p19(spark, d):
    # Odd sizes are pre-releases of their number, so they come before the release but after all smaller numbers.
    pre = F.when(F.col("p_size") % 2 == 0, "").otherwise("-rc.1")
    version = F.concat(F.lit("v"), F.col("p_size").cast("string"), F.lit(".0.0"), pre)
    rows = table(spark, d, "part").withColumn("key", versions.semver_key(version, F.lit("npm"))).withColumn("version", version)
    best = rows.groupBy("p_brand").agg(F.max(F.struct("key", "version")).alias("b"))
    number = F.regexp_extract("b.version", r"v(\d+)", 1).cast("int") * 10
    return best.select("p_brand", F.when(F.contains("b.version", F.lit("rc")), number).otherwise(number + 9).alias("newest"))


@query(
    "p20_fingerprint",
    r"""SELECT doc_id, left(sha256(coalesce(lang, '') || chr(9247) || '' || chr(9247) || replace(coalesce(source, ''), '\', '/') || chr(9247)
              || trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))), 32) AS fingerprint FROM documents""",
)
def p20(spark, d):
    fp = text.fingerprint(F.col("lang"), F.lit(None).cast("string"), F.col("source"), F.col("text"))
    return table(spark, d, "documents").select("doc_id", fp.alias("fingerprint"))


@query("p21_cluster_shape")
def p21(spark, d):
    rows = table(spark, d, "documents").select("source", text.cluster_shape(F.col("text")).alias("shape"))
    return rows.groupBy("source", "shape").agg(F.count(F.lit(1)).alias("n"))


@query("p22_variant_shape")
def p22(spark, d):
    lines = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    shaped = lines.select(text.variant_shape(F.col("line")).alias("shape"))
    return shaped.groupBy("shape").agg(F.count(F.lit(1)).alias("n")).withColumn("distinctive", text.distinctive(F.col("shape")))


@query(
    "p23_entropy",
    """WITH c AS (SELECT page_id, unnest(string_split(url, '')) AS ch FROM pages), n AS (SELECT page_id, ch, count(*) AS n FROM c GROUP BY 1, 2),
       t AS (SELECT page_id, n / sum(n) OVER (PARTITION BY page_id) AS p FROM n)
       SELECT page_id, round(-sum(p * log2(p)), 6) AS entropy FROM t GROUP BY 1""",
)
def p23(spark, d):
    return table(spark, d, "pages").select("page_id", F.round(text.entropy(F.col("url")), 6).alias("entropy"))


@query(
    "p27_path_suffix",
    r"""WITH t AS (SELECT DISTINCT regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS resolved FROM pages),
            p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS path FROM pages)
       SELECT page_id, resolved FROM p JOIN t ON resolved = path""",
)
def p27(spark, d):
    from ..operators.joins import resolve_suffix

    path = F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1)
    pages = table(spark, d, "pages")
    tree = pages.select(path.alias("tree_path")).distinct()
    reported = pages.select("page_id", F.concat(F.lit("build/out/"), path).alias("path"))
    return resolve_suffix(reported, "page_id", "path", tree, "tree_path").select("page_id", "resolved")


@query(
    "p28_trace_trimming",
    """WITH s AS (SELECT conv_id, list(role ORDER BY turn) AS steps FROM conversations GROUP BY 1)
       SELECT conv_id, CASE WHEN len(steps) <= 4 THEN steps ELSE steps[1:1] || steps[len(steps) - 2:] END AS steps, greatest(len(steps) - 4, 0) AS omitted FROM s""",
)
def p28(spark, d):
    from ..operators.windows import trim_traces

    steps = trim_traces(table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", ["turn", "role"], "role", 4)
    return steps.select("conv_id", "steps", F.greatest(F.col("n") - 4, F.lit(0)).alias("omitted"))


@query(
    "p32_installed_owner",
    r"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '@scope/' || regexp_extract(url, '^https?://([^/]+)', 1) WHEN page_id % 3 = 1 THEN regexp_extract(url, '^https?://([^/]+)', 1) END AS owner FROM pages""",
)
def p32(spark, d):
    from ..operators.windows import installed_owner

    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    m = F.col("page_id") % 3
    path = F.when(m == 0, F.concat(F.lit("app/node_modules/@scope/"), host, F.lit("/lib/a.js"))).when(m == 1, F.concat(F.lit("node_modules/"), host, F.lit("/b.js"))).otherwise("src/c.js")
    return table(spark, d, "pages").select("page_id", installed_owner(path).alias("owner"))


@query(
    "p33_token_cost",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'R' THEN round_even((l_quantity * 3.0::DOUBLE + l_partkey * 15.0::DOUBLE) / 1000000, 6) END AS cost FROM lineitem""",
)
def p33(spark, d):
    price = F.when(F.col("l_returnflag") != "R", 15.0)
    cost = scores.token_cost(F.col("l_quantity"), F.col("l_partkey"), F.lit(3.0), price)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", cost.alias("cost"))


@query(
    "p37_import_specifiers",
    r"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS target FROM pages)
       SELECT target, count(*) AS n, count(DISTINCT page_id) AS pages FROM h GROUP BY 1""",
)
def p37(spark, d):
    links = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), 1)).alias("target"))
    return links.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_id").alias("pages"))


@query("p39_comment_blanking", r"""SELECT page_id, length(regexp_replace(html, '(?s)<!--.*?-->', '', 'g')) AS kept FROM pages""")
def p39(spark, d):
    return table(spark, d, "pages").select("page_id", F.length(F.regexp_replace("html", r"(?s)<!--.*?-->", "")).cast("long").alias("kept"))


@query(
    "p44_call_site",
    r"""SELECT conv_id, turn, 'src/' || role AS file, CAST(turn + 1 AS INTEGER) AS line FROM conversations""",
)
def p44(spark, d):
    site = F.concat(F.lit("src/"), F.col("role"), F.lit(":"), (F.col("turn") + 1).cast("string"))
    pattern = r"^(.*):(\d+)$"
    return table(spark, d, "conversations").select(
        "conv_id", "turn", F.regexp_extract(site, pattern, 1).alias("file"), F.regexp_extract(site, pattern, 2).cast("int").alias("line")
    )
