"""Scanner reports: SARIF and native JSON as one findings table, with what can't be read kept aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cwe_of, first_given, sarif_severity, severity_word

_TEXT = "struct<text:string>"
_PLACE = f"struct<physicalLocation:struct<artifactLocation:struct<uri:string,uriBaseId:string>,region:struct<startLine:int,endLine:int,snippet:{_TEXT}>,contextRegion:struct<snippet:{_TEXT}>>,message:{_TEXT}>"
_PROPS = "struct<tags:array<string>,`security-severity`:string,`problem.severity`:string,severity:string,impact:string,precision:string>"
SARIF = f"""runs array<struct<
  tool:struct<driver:struct<name:string,rules:array<struct<id:string,name:string,shortDescription:{_TEXT},defaultConfiguration:struct<level:string>,properties:{_PROPS},
    relationships:array<struct<target:struct<id:string>>>>>>>,
  invocations:array<struct<executionSuccessful:boolean>>,
  results:array<struct<guid:string,correlationGuid:string,ruleId:string,level:string,message:{_TEXT},properties:{_PROPS},locations:array<{_PLACE}>,
    codeFlows:array<struct<threadFlows:array<struct<locations:array<struct<location:{_PLACE},kinds:array<string>>>>>>>>>>>, _bad string"""

# Taint rule names that stand for a weakness, and words of flow messages.
TAINT_RULES = {
    "TaintedSql": "CWE-89", "TaintedTextWithQuotes": "CWE-89", "TaintedHtml": "CWE-79", "TaintedShell": "CWE-78", "TaintedInclude": "CWE-98", "TaintedEval": "CWE-95",
    "TaintedUnserialize": "CWE-502", "TaintedSSRF": "CWE-918", "TaintedLdap": "CWE-90", "TaintedFile": "CWE-22", "TaintedHeader": "CWE-113", "TaintedXpath": "CWE-643",
    "TaintedCallable": "CWE-95", "TaintedSystemSecret": "CWE-200", "TaintedCookie": "CWE-79",
}
SOURCE_WORDS = ("source", "user input", "untrusted", "taint source")
SANITIZER_WORDS = ("sanitiz", "escape", "encode", "validat")
SINK_WORDS = ("sink", "dangerous", "executes", "query")
# Column names under which native reports give each field.
ALIASES = {
    "finding_id": ("finding_id", "id", "uuid", "key", "issue_id"),
    "scanner": ("scanner", "tool", "source_tool", "analyzer"),
    "rule_id": ("rule_id", "rule", "check_id", "query_id", "ruleId"),
    "cwe": ("cwe", "cwe_id", "cweId", "vulnerability_class"),
    "title": ("title", "name", "summary", "short_description"),
    "description": ("description", "message", "detail", "full_description"),
    "severity": ("severity", "level", "risk", "priority"),
    "file_path": ("file_path", "path", "file", "filename", "location", "uri"),
    "start_line": ("start_line", "line", "line_number", "startLine"),
    "end_line": ("end_line", "endLine", "line_end"),
    "snippet": ("snippet", "code", "code_context", "excerpt", "fragment"),
}
CONTAINERS = ("findings", "results", "issues", "vulnerabilities", "items", "data")


def read_sarif(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(findings, unreadable files) of SARIF 2.1.0 reports below a path."""
    raw = (
        spark.read.schema(SARIF).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
        .option("recursiveFileLookup", True).option("pathGlobFilter", "*.{json,sarif}").json(path).withColumn("report", F.col("_metadata.file_path"))
    )
    bad = raw.where(F.col("runs").isNull()).select("report", "_bad")
    return sarif_findings(raw.where(F.col("runs").isNotNull())), bad


def _role(step: Column) -> Column:
    """The role of a flow step: what its kinds say, else what its message hints at, in the order source, sanitizer, sink."""
    kinds = F.transform(F.coalesce(step["kinds"], F.array().cast("array<string>")), lambda k: F.lower(k))
    said = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(F.coalesce(step["location"]["message"]["text"], F.lit(""))), w))
    has = lambda *names: F.arrays_overlap(kinds, F.array(*map(F.lit, names)))
    return (
        F.when(has("source", "entrypoint"), "source").when(has("sink", "vulnerable-function"), "sink").when(has("sanitizer"), "sanitizer").when(has("step", "call"), "step")
        .when(said(SOURCE_WORDS), "source").when(said(SANITIZER_WORDS), "sanitizer").when(said(SINK_WORDS), "sink").otherwise("step")
    )


def flow_trace(flows: Column) -> Column:
    """All steps of all flows in order, with roles; where no step has one, the first is the source and the last the sink."""
    threads = F.flatten(F.transform(flows, lambda f: f["threadFlows"]))
    places = F.flatten(F.transform(threads, lambda t: t["locations"]))
    steps = F.transform(
        places,
        lambda s: F.struct(
            first_given(s["location"]["physicalLocation"]["artifactLocation"]["uri"]).alias("file_path"),
            s["location"]["physicalLocation"]["region"]["startLine"].alias("line"),
            s["location"]["message"]["text"].alias("message"),
            _role(s).alias("role"),
        ),
    )
    told = F.exists(steps, lambda s: s["role"] != "step")
    ends = F.transform(steps, lambda s, i: s.withField("role", F.when(i == 0, "source").when(i == F.size(steps) - 1, "sink").otherwise("step")))
    return F.when(told, steps).otherwise(ends)


def sarif_findings(raw: DataFrame) -> DataFrame:
    """One finding per result; its rule is looked up inside its own run."""
    runs = raw.select("report", F.posexplode("runs").alias("run", "r"))
    rows = runs.select("report", "run", F.col("r.tool.driver.name").alias("scanner"), F.col("r.tool.driver.rules").alias("rules"), F.posexplode("r.results").alias("result", "x"))
    rule = F.get(F.filter("rules", lambda r: r["id"] == F.col("x.ruleId")), F.lit(0))
    place = F.get(F.col("x.locations"), F.lit(0))["physicalLocation"]
    rows = rows.withColumn("rule", rule).withColumn("place", place)
    prop = lambda name: F.coalesce(F.col("x.properties")[name], F.col("rule.properties")[name])
    tags = F.concat(F.coalesce("rule.properties.tags", F.array()), F.coalesce("x.properties.tags", F.array()))
    related = F.transform(F.coalesce("rule.relationships", F.array()), lambda r: r["target"]["id"])
    taint = F.create_map(*(F.lit(x) for kv in TAINT_RULES.items() for x in kv))
    name = first_given(F.col("rule.name"), F.col("rule.shortDescription.text"))
    snippet = first_given(F.col("place.contextRegion.snippet.text"), F.col("place.region.snippet.text"))
    fallback = F.concat_ws(":", "scanner", "run", "result", "x.ruleId")
    lowered = F.transform(tags, lambda t: F.lower(t))
    return rows.select(
        first_given(F.col("x.guid"), F.col("x.correlationGuid"), fallback).alias("finding_id"),
        "scanner",
        F.col("x.ruleId").alias("rule_id"),
        F.coalesce(F.element_at(taint, name), cwe_of(F.concat(tags, related))).alias("cwe"),
        F.col("x.message.text").alias("title"),
        sarif_severity(prop("security-severity"), prop("problem.severity"), prop("severity"), prop("impact"), F.col("rule.properties.tags"), F.col("x.level"), F.col("rule.defaultConfiguration.level")).alias("severity"),
        F.coalesce(first_given(F.col("place.artifactLocation.uri"), F.col("place.artifactLocation.uriBaseId")), F.lit("<unknown>")).alias("file_path"),
        F.col("place.region.startLine").alias("start_line"),
        snippet.alias("snippet"),
        (F.col("place.region.endLine").isNotNull() & snippet.isNull()).alias("truncated"),
        flow_trace(F.col("x.codeFlows")).alias("trace"),
        (F.array_contains(lowered, "misconfiguration") & (F.lower(prop("precision")) == "very-high")).alias("misconfiguration"),
        "report",
    )


def report_health(raw: DataFrame) -> DataFrame:
    """Per report: results, and whether it can be believed (it ran to its end, and has a rule or a result)."""
    runs = raw.select("report", F.explode("runs").alias("r"))
    sizes = runs.groupBy("report").agg(
        F.sum(F.size(F.coalesce("r.tool.driver.rules", F.array()))).alias("rules"),
        F.sum(F.size(F.coalesce("r.results", F.array()))).alias("results"),
        F.bool_or(F.exists(F.coalesce("r.invocations", F.array()), lambda i: i["executionSuccessful"] == F.lit(False))).alias("broke"),
    )
    return sizes.select("report", "results", (~F.coalesce("broke", F.lit(False)) & ((F.col("rules") > 0) | (F.col("results") > 0))).alias("healthy"))


def native_findings(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(findings, rows without a file path) of native JSON: each text a list, a container of findings or one finding."""
    parsed = lines.select(F.expr(f"try_parse_json({column})").alias("v"))
    boxed = F.coalesce(*(F.try_variant_get("v", f"$.{c}", "array<variant>") for c in CONTAINERS), F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    each = parsed.where(F.col("v").isNotNull()).select(F.explode(boxed).alias("f"))

    def pick(field: str) -> Column:
        return first_given(*(F.try_variant_get("f", f"$.{a}", "string") for a in ALIASES[field]))

    rows = each.select(
        *(pick(f).alias(f) for f in ("finding_id", "scanner", "rule_id", "title", "description", "file_path", "snippet")),
        pick("start_line").try_cast("int").alias("start_line"),
        pick("end_line").try_cast("int").alias("end_line"),
        severity_word(pick("severity")).alias("severity"),
        cwe_of(F.array(F.concat(F.lit("cwe-"), pick("cwe")))).alias("cwe"),
    )
    return rows.where(F.col("file_path").isNotNull()), rows.where(F.col("file_path").isNull())


def read_native(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Native reports below a path: JSON files whole, JSON lines by line."""
    whole = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).text(path)
    lines = spark.read.option("pathGlobFilter", "*.{jsonl,ndjson}").option("recursiveFileLookup", True).text(path)
    return native_findings(whole.select("value").union(lines.where(F.trim("value") != "").select("value")))
