"""What a run says about itself: which scanners ran, what is deployed, which paths are tests, and the run's own tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import reports

MANIFEST = "scans array<struct<scanner:string,ok:boolean,error:string,findings:long,duration_s:double>>"
DEPLOYMENT = """enabled boolean, description string, facts map<string,boolean>, platform_handles array<struct<rule:string,requires:string,why:string>>,
  out_of_scope_components array<struct<id:string,requires:string,keywords:array<string>,owner:string>>, php_ini_by_image array<struct<image:string,register_argc_argv:string,checked:string>>"""

#: Reports by format: what each suffix or key stands for, and the reader of a folder.
READERS = {"sarif": reports.read_sarif, "native": reports.read_native}


def scan_coverage(manifests: DataFrame) -> DataFrame:
    """report, ran, failed (scanner and reason), complete: from manifests (report, value). One that is missing or broken is never complete."""
    parsed = manifests.select("report", F.from_json("value", MANIFEST)["scans"].alias("scans"))
    name = lambda s: F.coalesce(F.nullif(s["scanner"], F.lit("")), F.lit("?"))
    ok = lambda s: F.coalesce(s["ok"], F.lit(False))
    why = lambda s: F.substring(F.coalesce(F.nullif(s["error"], F.lit("")), F.lit("no reason recorded")), 1, 200)
    none = F.array().cast("array<struct<scanner:string,ok:boolean,error:string,findings:bigint,duration_s:double>>")
    scans = F.coalesce("scans", none)
    failed = F.transform(F.filter(scans, lambda s: ~ok(s)), lambda s: F.struct(name(s).alias("scanner"), why(s).alias("error")))
    return parsed.select("report", F.transform(F.filter(scans, ok), name).alias("ran"), failed.alias("failed"), (F.col("scans").isNotNull() & (F.size(failed) == 0)).alias("complete"))


def write_manifest(scans: DataFrame, path: str) -> None:
    """A scan manifest of the rows (scanner, ok, error, findings, duration_s), one document."""
    scans.agg(F.collect_list(F.struct(*scans.columns)).alias("scans")).write.mode("overwrite").json(path)


def on_off(value: Column) -> Column:
    """On, Off or null of a php.ini value as YAML or JSON give it."""
    text = F.lower(F.trim(value.cast("string")))
    return F.when(text.isin("on", "1", "true", "yes"), "On").when(text.isin("off", "0", "false", "no"), "Off")


def deployment_tables(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(facts, rules that the platform handles, components out of scope, PHP images) of deployment documents (report, value).

    Facts that are no booleans, rules and components without a name and images without a clear setting are left out.
    """
    docs = raw.select("report", F.from_json("value", DEPLOYMENT).alias("d"))
    facts = docs.select("report", F.explode("d.facts").alias("fact", "holds")).where("holds is not null")
    rules = docs.select("report", F.explode("d.platform_handles").alias("r")).where("coalesce(r.rule, '') <> ''").select("report", "r.*")
    outside = docs.select("report", F.explode("d.out_of_scope_components").alias("c")).where("coalesce(c.id, '') <> ''").select("report", "c.*")
    outside = outside.withColumns({"owner": F.coalesce(F.nullif("owner", F.lit("")), F.lit("platform-security")), "keywords": F.filter("keywords", lambda k: F.trim(k) != "")})
    images = docs.select("report", F.explode("d.php_ini_by_image").alias("i")).select("report", F.trim("i.image").alias("image"), on_off(F.col("i.register_argc_argv")).alias("register_argc_argv"))
    return facts, rules, outside, images.where("image <> '' and register_argc_argv is not null")


def path_patterns(lines: DataFrame, keys: list[str], order: str, line: str, section: str) -> DataFrame:
    """keys, kind (directory or glob), pattern: the bullets below one heading of a context document, given as numbered lines.

    A bullet that ends in a slash names directories; others are globs. Names may stand in back quotes.
    """
    from ..operators.windows import fill_forward

    title = F.when(F.col(line).rlike(r"^#+\s"), F.lower(F.trim(F.regexp_replace(line, r"^#+\s*", ""))))
    inside = fill_forward(lines, keys, order, title, "_title").where(F.col("_title") == section.lower())
    bullet = F.trim(F.regexp_replace(F.regexp_extract(line, r"^\s*[-*]\s+(.*)$", 1), "`", ""))
    kind = F.when(F.endswith(bullet, F.lit("/")), "directory").otherwise("glob")
    return inside.where(bullet != "").select(*keys, kind.alias("kind"), F.regexp_replace(bullet, "/+$", "").alias("pattern")).distinct()


def read_findings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(findings, quarantine) of all reports below a folder, whatever their formats; hidden folders and the scan manifest are left out.

    What can't be read is kept aside with its file. A folder that yields no finding at all raises ValueError, as that
    says that something did not run, not that nothing was found.
    """
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{json,sarif,jsonl,ndjson}").text(path)
    files = files.select(F.col("_metadata.file_path").alias("report"), "value")
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath().rstrip("/")
    inside = F.substring_index("report", base, -1)
    files = files.where(~inside.rlike(r"/\.") & ~F.endswith("report", F.lit("/scan-manifest.json")))
    whole = files.where(F.endswith("report", F.lit(".json")) | F.endswith("report", F.lit(".sarif"))).withColumn("v", F.expr("try_parse_json(value)"))
    is_sarif = F.endswith("report", F.lit(".sarif")) | F.try_variant_get("v", "$.runs", "array<variant>").isNotNull()
    runs = whole.where(is_sarif & F.col("v").isNotNull()).select("report", "value", F.from_json("value", reports.SARIF)["runs"].alias("runs"))
    lines = files.where(F.lower("report").rlike(r"\.(jsonl|ndjson)$")).select("report", F.explode(F.split("value", r"\r?\n")).alias("value")).where("trim(value) <> ''")
    native = whole.where(~is_sarif & F.col("v").isNotNull()).select("report", "value").unionByName(lines.where("try_parse_json(value) is not null"))
    good, pathless = reports.native_findings(native)
    shared = ["finding_id", "scanner", "rule_id", "cwe", "title", "severity", "file_path", "start_line", "snippet"]
    found = reports.sarif_findings(runs.where("runs is not null").select("report", "runs")).select(*shared).unionByName(good.select(*shared))
    broken = whole.where("v is null").select("report", F.lit("no JSON").alias("reason")).unionByName(lines.where("try_parse_json(value) is null").select("report", F.lit("no JSON in a line").alias("reason")))
    broken = broken.unionByName(runs.where("runs is null").select("report", F.lit("no runs").alias("reason"))).unionByName(pathless.select(F.lit(None).cast("string").alias("report"), F.lit("no file path").alias("reason")))
    if found.isEmpty():
        raise ValueError(f"{path}: no findings in any report")
    return found, broken


def write_tables(tables: dict[str, DataFrame], folder: str, form: str = "json") -> None:
    """Report tables, the queue, variants or the upgrade plan: each below the folder under its name, as JSON lines, CSV or Parquet."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(form).save(f"{folder.rstrip('/')}/{name}")
