"""Readers over texts that are made of the given tables: lock files, manifests, advisories, feeds, traces and run documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import dependencies, runs, traces
from .registry import query, table


def _text(column) -> F.col:
    return column.cast("string")


def _files(df, project, value):
    return df.select(_text(project).alias("project"), value.alias("value"))


@query(
    "s6_cyclonedx_components",
    """SELECT CAST(p_partkey AS VARCHAR) AS project, unnest(['a', 'b', 'c', 'd']) AS name, unnest(['npm', 'npm', 'composer', 'composer']) AS ecosystem,
       unnest([p_size || '.0', '2.' || p_size, '3', '4']) AS version, unnest([false, p_size % 2 = 0, false, false]) AS dev FROM part""",
)
def s6(spark, d):
    """Components nested three deep."""
    size = _text(F.col("p_size"))
    deep = F.struct(F.lit("r4").alias("bom-ref"), F.lit("pkg:composer/d@4").alias("purl"))
    third = F.struct(F.lit("r3").alias("bom-ref"), F.lit("pkg:composer/c@3").alias("purl"), F.array(deep).alias("components"))
    mark = F.array(F.struct(F.lit("cdx:npm:package:development").alias("name"), F.when(F.col("p_size") % 2 == 0, "true").otherwise("false").alias("value")))
    second = F.struct(F.concat(F.lit("pkg:npm/b@2."), size).alias("purl"), mark.alias("properties"), F.array(third).alias("components"))
    first = F.struct(F.lit("r1").alias("bom-ref"), F.concat(F.lit("pkg:npm/a@"), size, F.lit(".0")).alias("purl"))
    part = table(spark, d, "part")
    components, _ = dependencies.cyclonedx_rows(_files(part, F.col("p_partkey"), F.to_json(F.struct(F.array(first).alias("components")))))
    more, _ = dependencies.cyclonedx_rows(_files(part, F.col("p_partkey"), F.to_json(F.struct(F.array(second).alias("components")))))
    return components.unionByName(more).select("project", "name", "ecosystem", "version", "dev")


@query(
    "s7_npm_lock",
    """SELECT CAST(s_suppkey AS VARCHAR) AS project, unnest(CASE WHEN s_suppkey % 2 = 0 THEN ['a', '@s/b'] ELSE ['a', 'c', 'e'] END) AS name,
       unnest(CASE WHEN s_suppkey % 2 = 0 THEN ['1.' || s_nationkey, '2.0'] ELSE ['1.0', '3.0', '5.' || s_nationkey] END) AS version,
       unnest(CASE WHEN s_suppkey % 2 = 0 THEN [false, true] ELSE [false, true, false] END) AS dev FROM supplier""",
)
def s7(spark, d):
    """Lock files of version 3 and of version 1, whose packages are nested."""
    nation = _text(F.col("s_nationkey"))
    flat = F.concat(F.lit('{"packages":{"":{"name":"x"},"node_modules/a":{"version":"1.'), nation, F.lit('","dependencies":{"@s/b":"^2"}},"node_modules/a/node_modules/@s/b":{"version":"2.0","dev":true}}}'))
    nested = F.concat(F.lit('{"dependencies":{"a":{"version":"1.0","requires":{"c":"3"},"dependencies":{"c":{"version":"3.0","dev":true,"dependencies":{"e":{"version":"5.'), nation, F.lit('"}}}}}}}'))
    files = _files(table(spark, d, "supplier"), F.col("s_suppkey"), F.when(F.col("s_suppkey") % 2 == 0, flat).otherwise(nested))
    return dependencies.npm_lock_rows(files)[0].select("project", "name", "version", "dev")


@query(
    "s8_composer_lock",
    """SELECT CAST(s_suppkey AS VARCHAR) AS project, unnest(['v/p', 'd/q']) AS name, unnest(['1.' || s_nationkey, '2.0']) AS version, unnest([false, true]) AS dev FROM supplier""",
)
def s8(spark, d):
    value = F.concat(F.lit('{"packages":[{"name":"v/p","version":"v1.'), _text(F.col("s_nationkey")), F.lit('","require":{"php":">=8","x/y":"*"}}],"packages-dev":[{"name":"d/q","version":"2.0"}]}'))
    return dependencies.composer_lock_rows(_files(table(spark, d, "supplier"), F.col("s_suppkey"), value))[0].select("project", "name", "version", "dev")


@query(
    "s9_yarn_lock",
    """SELECT CAST(s_suppkey AS VARCHAR) AS project, unnest(['@s/a', 'b']) AS name, unnest(['1.' || s_nationkey, '2.0.1']) AS version FROM supplier""",
)
def s9(spark, d):
    """Every other file in the newer format."""
    nation = _text(F.col("s_nationkey"))
    old = F.concat(F.lit('# yarn lockfile v1\n\n"@s/a@^1", "@s/a@^1.1":\n  version "1.'), nation, F.lit('"\n  dependencies:\n    b "^2"\n\nb@^2:\n  version "2.0.1"\n'))
    new = F.concat(F.lit('__metadata:\n  version: 6\n\n"@s/a@npm:^1":\n  version: 1.'), nation, F.lit('\n  dependencies:\n    b: ^2\n\n"b@npm:^2":\n  version: 2.0.1\n'))
    files = _files(table(spark, d, "supplier"), F.col("s_suppkey"), F.when(F.col("s_suppkey") % 2 == 0, old).otherwise(new))
    return dependencies.yarn_lock_rows(files)[0].select("project", "name", "version")


@query(
    "s11_manifests",
    """SELECT project, ecosystem, name, dev FROM (SELECT CAST(s_suppkey AS VARCHAR) AS project,
         unnest(CASE s_suppkey % 4 WHEN 0 THEN ['npm', 'npm'] WHEN 1 THEN ['composer'] WHEN 2 THEN ['go'] ELSE ['pypi', 'pypi'] END) AS ecosystem,
         unnest(CASE s_suppkey % 4 WHEN 0 THEN ['a' || s_nationkey, 'd'] WHEN 1 THEN ['v/p' || s_nationkey] WHEN 2 THEN ['github.com/x/y' || s_nationkey] ELSE ['flask', 'zope.x' || s_nationkey] END) AS name,
         unnest(CASE s_suppkey % 4 WHEN 0 THEN [false, true] WHEN 3 THEN [false, false] ELSE [s_suppkey % 4 = 1] END) AS dev FROM supplier)""",
)
def s11(spark, d):
    kind, nation = F.col("s_suppkey") % 4, _text(F.col("s_nationkey"))
    npm = F.concat(F.lit('{"dependencies":{"a'), nation, F.lit('":"1"},"devDependencies":{"d":"1"}}'))
    composer = F.concat(F.lit('{"require":{"php":">=8"},"require-dev":{"v/p'), nation, F.lit('":"1"}}'))
    go = F.concat(F.lit("module m\n\nrequire (\n\tgithub.com/x/y"), nation, F.lit(" v1.2.3\n\tgithub.com/i/j v1.0.0 // indirect\n)\n"))
    pip = F.concat(F.lit("Flask==2.0\n# note\n-r other.txt\nzope.x"), nation, F.lit(">=1\n"))
    file = F.when(kind == 0, "package.json").when(kind == 1, "composer.json").when(kind == 2, "go.mod").otherwise("requirements.txt")
    value = F.when(kind == 0, npm).when(kind == 1, composer).when(kind == 2, go).otherwise(pip)
    return dependencies.declared_rows(table(spark, d, "supplier").select(_text(F.col("s_suppkey")).alias("project"), file.alias("file"), value.alias("value")))


@query(
    "s26_go_sum",
    """SELECT CAST(s_suppkey AS VARCHAR) AS project, unnest(['m.io/a', 'm.io/b']) AS name, unnest(['v1.' || (s_nationkey + 1) || '.0', 'v0.2.0']) AS version FROM supplier""",
)
def s26_sum(spark, d):
    """The newest version counts as a number: v1.10 comes after v1.9, and a release after its candidate."""
    nation = F.col("s_nationkey")
    value = F.concat(
        F.lit("m.io/a v1."), _text(nation), F.lit(".0 h1:x=\nm.io/a v1."), _text(nation + 1), F.lit(".0/go.mod h1:y=\nm.io/b v0.2.0-rc.1 h1:z=\nm.io/b v0.2.0 h1:z=\nbroken line\n"),
    )
    return dependencies.go_sum_rows(_files(table(spark, d, "supplier"), F.col("s_suppkey"), value))


@query(
    "s12_advisories",
    """SELECT 'A-' || p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'medium' WHEN 1 THEN 'critical' ELSE '' END AS severity, ['1.' || p_size, '2.0'] AS fixed_versions, ['h/commit/' || p_partkey, 'h/x'] AS refs FROM part""",
)
def s12(spark, d):
    """Severity by label, by vector, and by neither."""
    i, kind = _text(F.col("p_partkey")), F.col("p_partkey") % 3
    vector = F.when(kind == 1, F.array(F.struct(F.lit("CVSS_V3").alias("type"), F.lit("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H").alias("score")))).otherwise(F.array())
    event = lambda intro, fixed: F.struct(intro.alias("introduced"), fixed.alias("fixed"))
    none = F.lit(None).cast("string")
    events = F.array(event(F.lit("0"), none), event(none, F.concat(F.lit("1."), _text(F.col("p_size")))), event(none, F.lit("2.0")), event(none, F.lit("2.0")))
    affected = F.array(F.struct(F.struct(F.lit("a").alias("name"), F.lit("npm").alias("ecosystem")).alias("package"), F.array(F.struct(F.lit("SEMVER").alias("type"), events.alias("events"))).alias("ranges")))
    refs = F.array(F.struct(F.lit("WEB").alias("type"), F.lit("h/x").alias("url")), F.struct(F.lit("FIX").alias("type"), F.concat(F.lit("h/commit/"), i).alias("url")))
    doc = F.struct(
        F.concat(F.lit("A-"), i).alias("id"), vector.alias("severity"), affected.alias("affected"), refs.alias("references"), F.struct(F.when(kind == 0, "Moderate").alias("severity")).alias("database_specific")
    )
    raw = table(spark, d, "part").select(F.from_json(F.to_json(doc), dependencies._OSV).alias("o")).select("o.*")
    return dependencies.advisory_rows(raw).select("id", "severity", "fixed_versions", F.col("references").alias("refs"))


@query(
    "s13_nvd_records",
    """SELECT 'CVE-2024-' || p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name END AS summary, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name || chr(10) || p_brand END AS details, ['h/fix', 'h/a'] AS refs FROM part""",
)
def s13(spark, d):
    """English descriptions only; patches first."""
    words = lambda lang, value: F.struct(lang.alias("lang"), value.alias("value"))
    lang = F.when(F.col("p_partkey") % 4 == 0, "de").otherwise("en")
    cve = F.struct(
        F.concat(F.lit("cve-2024-"), _text(F.col("p_partkey"))).alias("id"),
        F.array(words(F.lit("es"), F.lit("no")), words(lang, F.col("p_name")), words(lang, F.col("p_brand"))).alias("descriptions"),
        F.array(F.struct(F.lit("h/a").alias("url"), F.array().cast("array<string>").alias("tags")), F.struct(F.lit("h/fix").alias("url"), F.array(F.lit("Patch")).alias("tags"))).alias("references"),
    )
    cve = F.to_json(F.struct(F.array(F.struct(cve.alias("cve"))).alias("vulnerabilities")))
    raw = table(spark, d, "part").select(F.from_json(cve, dependencies.NVD)["vulnerabilities"].alias("vulnerabilities"))
    return dependencies.nvd_rows(raw).select("id", "summary", "details", F.col("references").alias("refs"))


@query(
    "s14_feeds",
    """SELECT 'CVE-' || p_partkey AS cve, CASE WHEN p_size % 3 > 0 THEN p_size / 100.0::DOUBLE END AS epss, CASE WHEN p_partkey % 5 = 0 THEN p_size % 2 = 0 END AS ransomware FROM part""",
)
def s14(spark, d):
    """Predictions and known exploitation; a score that is no number is none."""
    part = table(spark, d, "part")
    cve = F.concat(F.lit("cve-"), _text(F.col("p_partkey")))
    score = F.when(F.col("p_size") % 3 > 0, _text(F.col("p_size") / 100.0)).otherwise("n/a")
    predicted = F.to_json(F.struct(F.array(F.struct(cve.alias("cve"), score.alias("epss"), F.lit("0.5").alias("percentile"))).alias("data")))
    known = F.to_json(F.struct(F.array(F.struct(cve.alias("cveID"), F.when(F.col("p_size") % 2 == 0, "KNOWN").otherwise("Unknown").alias("knownRansomwareCampaignUse"))).alias("vulnerabilities")))
    epss = dependencies.epss_rows(part.select(F.from_json(predicted, dependencies.EPSS)["data"].alias("data")))
    kev = dependencies.kev_rows(part.where("p_partkey % 5 = 0").select(F.from_json(known, dependencies.KEV)["vulnerabilities"].alias("vulnerabilities")))
    return epss.join(kev, "cve", "left").select("cve", "epss", "ransomware")


@query(
    "s4_call_traces",
    """SELECT 'trace:GO-' || s_suppkey || ':m/v' AS finding_id, CASE WHEN s_suppkey % 2 = 0 THEN 'high' ELSE 'medium' END AS severity, CASE WHEN s_suppkey % 2 = 0 THEN 'main.go' ELSE 'go.mod' END AS file_path,
       CASE WHEN s_suppkey % 2 = 0 THEN 7 ELSE 1 END AS start_line, CASE WHEN s_suppkey % 2 = 0 THEN 'v1.0' ELSE 'v0.9' END AS installed_version, ['v1.1', 'v1.2'] AS fixed_versions,
       CASE WHEN s_suppkey % 2 = 0 THEN ['source root.main', 'step m/w.R.Do', 'sink m/v.Bad'] ELSE [] END AS steps FROM supplier""",
)
def s4(spark, d):
    """Streams without separators: every other advisory is called, the rest only required."""
    i = _text(F.col("s_suppkey"))
    head = F.concat(F.lit('{"SBOM":{"modules":[{"path":"root"},{"path":"m/v","version":"v0.9"}]}}{"osv":{"id":"GO-'), i, F.lit('","summary":"a } { b"}}\n'))
    plain = F.concat(F.lit('{"finding":{"osv":"GO-'), i, F.lit('","fixed_version":"v1.2","trace":[{"module":"m/v"}]}}'))
    frames = '{"module":"m/v","version":"v1.0","function":"Bad","position":{"filename":"v.go","line":3}},{"module":"m/w","version":"v2.0","receiver":"R","function":"Do"},{"module":"root","function":"main","position":{"filename":"main.go","line":7}}'
    called = F.concat(F.lit('{"finding":{"osv":"GO-'), i, F.lit('","fixed_version":"v1.1","trace":['), F.when(F.col("s_suppkey") % 2 == 0, frames).otherwise('{"module":"m/v"}'), F.lit("]}}"))
    reports = table(spark, d, "supplier").select(i.alias("report"), F.concat(head, plain, called).alias("value"))
    found = traces.call_trace_findings(reports)
    return found.select("finding_id", "severity", "file_path", "start_line", "installed_version", "fixed_versions", F.transform("trace", lambda s: F.concat_ws(" ", s["role"], s["message"])).alias("steps"))


@query(
    "s19_scan_coverage",
    """SELECT user_id, count(*) FILTER (WHERE event_type <> 'error') AS ran, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type = 'error') = 0 AS complete FROM events GROUP BY 1""",
)
def s19(spark, d):
    scan = F.struct(F.col("event_type").alias("scanner"), (F.col("event_type") != "error").alias("ok"), F.when(F.col("value") > 50, F.repeat(F.lit("x"), 300)).alias("error"))
    docs = table(spark, d, "events").groupBy("user_id").agg(F.to_json(F.struct(F.collect_list(scan).alias("scans"))).alias("value"))
    found = runs.scan_coverage(docs.select(F.col("user_id").alias("report"), "value"))
    return found.select(F.col("report").alias("user_id"), F.size("ran").cast("long").alias("ran"), F.size("failed").cast("long").alias("failed"), "complete")


@query(
    "s21_deployment_facts",
    """SELECT n_regionkey AS report, 'fact' AS kind, lower(n_name) AS name, CAST(n_nationkey % 2 = 0 AS VARCHAR) AS value FROM nation
       UNION ALL SELECT n_regionkey, 'image', n_name, CASE n_nationkey % 3 WHEN 0 THEN 'On' ELSE 'Off' END FROM nation WHERE n_nationkey % 3 < 2""",
)
def s21(spark, d):
    nation = table(spark, d, "nation")
    setting = F.when(F.col("n_nationkey") % 3 == 0, " TRUE ").when(F.col("n_nationkey") % 3 == 1, "0").otherwise("default")
    docs = nation.groupBy("n_regionkey").agg(
        F.map_from_entries(F.collect_list(F.struct(F.lower("n_name"), F.col("n_nationkey") % 2 == 0))).alias("facts"), F.collect_list(F.struct(F.col("n_name").alias("image"), setting.alias("register_argc_argv"))).alias("php_ini_by_image")
    )
    raw = docs.select(F.col("n_regionkey").alias("report"), F.to_json(F.struct("facts", "php_ini_by_image")).alias("value"))
    facts, _, _, images = runs.deployment_tables(raw)
    facts = facts.select("report", F.lit("fact").alias("kind"), F.col("fact").alias("name"), _text(F.col("holds")).alias("value"))
    return facts.unionByName(images.select("report", F.lit("image").alias("kind"), F.col("image").alias("name"), F.col("register_argc_argv").alias("value")))


@query(
    "s22_test_path_patterns",
    """SELECT n_regionkey, 'directory' AS kind, lower(n_name) AS pattern FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_regionkey, 'glob', '*' || lower(n_name) || '*' FROM nation WHERE n_nationkey % 2 = 1""",
)
def s22(spark, d):
    """Bullets of one section; those of the section behind it do not count."""
    name = F.lower("n_name")
    bullet = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("- `"), name, F.lit("/`"))).otherwise(F.concat(F.lit("  * *"), name, F.lit("*")))
    nation = table(spark, d, "nation")
    lines = nation.select("n_regionkey", (F.col("n_nationkey") + 10).alias("at"), bullet.alias("line"))
    rest = nation.select("n_regionkey", (F.col("n_nationkey") + 100).alias("at"), F.concat(F.lit("- other"), name).alias("line"))
    region = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"))
    heads = region.select("n_regionkey", F.lit(1).alias("at"), F.lit("## Test Paths").alias("line")).unionByName(region.select("n_regionkey", F.lit(90).alias("at"), F.lit("## Others").alias("line")))
    return runs.path_patterns(lines.unionByName(rest).unionByName(heads), ["n_regionkey"], "at", "line", "test paths")
