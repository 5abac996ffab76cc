"""Bills of materials, lock files, manifests, advisories and feeds as node, edge and range tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import cvss3_base, level_of_score
from ..functions.text import first_given, lookup, purl_parts
from ..functions.versions import semver_key

# Severity labels of advisory databases.
LABELS = {"critical": "critical", "high": "high", "moderate": "medium", "medium": "medium", "low": "low", "none": "low"}


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    return files.select(F.regexp_extract("_metadata.file_path", r"^(.*)/[^/]+$", 1).alias("project"), "value")


def _levels(top: DataFrame, below) -> DataFrame:
    """All levels of a nesting: ``below`` of each, until one is empty."""
    found, level = top, below(top)
    while not level.isEmpty():
        found, level = found.unionByName(level), below(level)
    return found


def cyclonedx(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(components, edges) of the CycloneDX documents below a path."""
    return cyclonedx_rows(_files(spark, path, "*.cdx.json"))


def cyclonedx_rows(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(components, edges) of CycloneDX documents (project, value); components nested at any depth are flattened. What is no JSON gives nothing."""
    docs = files.select("project", F.expr("try_parse_json(value)").alias("v"))
    level = docs.select("project", F.explode(F.try_variant_get("v", "$.components", "array<variant>")).alias("c"))
    found = _levels(level, lambda df: df.select("project", F.explode(F.try_variant_get("c", "$.components", "array<variant>")).alias("c")))
    text = lambda p: F.try_variant_get("c", p, "string")
    purl = purl_parts(text("$.purl"))
    dev = F.coalesce(F.exists(F.try_variant_get("c", "$.properties", "array<struct<name:string,value:string>>"), lambda p: F.endswith(p["name"], F.lit("development")) & (p["value"] == "true")), F.lit(False))
    components = found.select(
        "project", first_given(text("$['bom-ref']"), text("$.purl")).alias("ref"),
        purl["type"].alias("ecosystem"), F.coalesce(purl["name"], text("$.name")).alias("name"), F.coalesce(purl["version"], text("$.version")).alias("version"), dev.alias("dev"),
    )
    deps = docs.select("project", F.explode(F.try_variant_get("v", "$.dependencies", "array<struct<ref:string,dependsOn:array<string>>>")).alias("d"))
    return components, deps.select("project", F.col("d.ref").alias("src"), F.explode("d.dependsOn").alias("dst"))


def npm_lock(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the npm lock files below a path."""
    return npm_lock_rows(_files(spark, path, "package-lock.json"))


def npm_lock_rows(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of npm lock files (project, value): the ``packages`` map of versions 2 and 3, else the nested ``dependencies`` of version 1."""
    body = "map<string,struct<version:string,dev:boolean,dependencies:map<string,string>,optionalDependencies:map<string,string>,peerDependencies:map<string,string>>>"
    docs = files.select("project", F.from_json("value", f"packages {body}")["packages"].alias("packages"), F.expr("try_parse_json(value)").alias("v"))
    rows = docs.select("project", F.explode("packages").alias("place", "p")).where("place <> ''").withColumn("name", F.element_at(F.split("place", "node_modules/"), -1))
    nodes = rows.select("project", F.lit("npm").alias("ecosystem"), "name", F.col("p.version").alias("version"), F.coalesce("p.dev", F.lit(False)).alias("dev"))
    needs = F.concat(*(F.coalesce(F.map_keys(f"p.{k}"), F.array().cast("array<string>")) for k in ("dependencies", "optionalDependencies", "peerDependencies")))
    edges = rows.select("project", F.col("name").alias("src"), F.explode(F.array_distinct(needs)).alias("dst"))
    inner = lambda c: F.explode(F.map_entries(F.try_variant_get(c, "$.dependencies", "map<string,variant>")))
    top = docs.where("packages is null").select("project", inner("v").alias("e")).select("project", F.col("e.key").alias("name"), F.col("e.value").alias("p"))
    first = _levels(top, lambda df: df.select("project", inner("p").alias("e")).select("project", F.col("e.key").alias("name"), F.col("e.value").alias("p")))
    read = lambda path, kind: F.try_variant_get("p", path, kind)
    nodes_1 = first.select("project", F.lit("npm").alias("ecosystem"), "name", read("$.version", "string").alias("version"), F.coalesce(read("$.dev", "boolean"), F.lit(False)).alias("dev"))
    edges_1 = first.select("project", F.col("name").alias("src"), F.explode(F.map_keys(read("$.requires", "map<string,string>"))).alias("dst"))
    return nodes.unionByName(nodes_1), edges.unionByName(edges_1)


def composer_lock(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the composer.lock files below a path."""
    return composer_lock_rows(_files(spark, path, "composer.lock"))


def composer_lock_rows(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of composer.lock; only ``vendor/name`` requirements are packages."""
    package = "array<struct<name:string,version:string,require:map<string,string>>>"
    docs = files.select("project", F.from_json("value", f"packages {package}, `packages-dev` {package}").alias("l"))
    rows = docs.select("project", F.lit(False).alias("dev"), F.explode("l.packages").alias("p")).unionByName(docs.select("project", F.lit(True).alias("dev"), F.explode("l.packages-dev").alias("p")))
    nodes = rows.select("project", F.lit("composer").alias("ecosystem"), "p.name", F.regexp_replace("p.version", "^v", "").alias("version"), "dev")
    edges = rows.select("project", F.col("p.name").alias("src"), F.explode(F.filter(F.map_keys("p.require"), lambda k: F.contains(k, F.lit("/")))).alias("dst"))
    return nodes, edges


def yarn_lock(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the yarn.lock files below a path."""
    return yarn_lock_rows(_files(spark, path, "yarn.lock"))


def yarn_lock_rows(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of yarn.lock, both formats: indented blocks below unindented headers."""
    from ..operators.windows import fill_forward

    lines = files.select("project", F.posexplode(F.split("value", r"\r?\n")).alias("at", "line"))
    header = F.when(F.col("line").rlike(r"^\S.*:$") & ~F.startswith("line", F.lit("#")), F.struct("at", "line"))
    rows = fill_forward(lines, ["project"], "at", header, "block").where("block is not null")
    section = F.when(F.col("line").rlike(r"^  \S"), F.regexp_extract("line", r"^  \"?(\w+)", 1))
    rows = fill_forward(rows, ["project", "block"], "at", section, "section")
    name = F.regexp_extract("block.line", r'^"?(@?[^@"]+)@', 1)
    version = F.regexp_extract("line", r'^  "?version"?:? "?([^"]+)"?$', 1)
    nodes = rows.where(version != "").select("project", F.lit("npm").alias("ecosystem"), name.alias("name"), version.alias("version")).where("name not in ('', '__metadata')")
    dep = F.regexp_extract("line", r'^    "?(@?[^@" :]+)"?[: ]', 1)
    edges = rows.where(F.col("section").isin("dependencies", "optionalDependencies", "peerDependencies") & (dep != "")).select("project", name.alias("src"), dep.alias("dst")).distinct()
    return nodes.distinct(), edges


def declared(spark: SparkSession, path: str) -> DataFrame:
    """Requirements that the manifests below a path declare."""
    names = ("package.json", "composer.json", "go.mod", "requirements*.txt")
    found = [_files(spark, path, glob).withColumn("file", F.lit(glob.replace("*", ""))) for glob in names]
    return declared_rows(reduce(DataFrame.unionByName, found))


def declared_rows(files: DataFrame) -> DataFrame:
    """project, ecosystem, name, dev of manifests (project, file, value); installed trees are left out."""
    own = files.where(~F.col("project").rlike(r"/(node_modules|vendor)(/|$)"))
    js = own.where("file = 'package.json'").select("project", F.from_json("value", "dependencies map<string,string>, devDependencies map<string,string>").alias("m"))
    php = own.where("file = 'composer.json'").select("project", F.from_json("value", "require map<string,string>, `require-dev` map<string,string>").alias("m"))
    both = lambda df, eco, prod, dev: df.select("project", F.lit(eco).alias("ecosystem"), F.explode(F.map_keys(f"m.{prod}")).alias("name"), F.lit(False).alias("dev")).unionByName(
        df.select("project", F.lit(eco).alias("ecosystem"), F.explode(F.map_keys(f"m.{dev}")).alias("name"), F.lit(True).alias("dev"))
    )
    go = own.where("file = 'go.mod'").select("project", F.explode(F.split("value", "\n")).alias("line"))
    module = F.regexp_extract("line", r"^\s*(?:require\s+)?([\w.\-]+\.[\w.\-]+/\S+|\S+\.\S+)\s+v\d", 1)
    gomod = go.where((module != "") & ~F.contains("line", F.lit("// indirect"))).select("project", F.lit("go").alias("ecosystem"), module.alias("name"), F.lit(False).alias("dev"))
    pip = own.where("file = 'requirements.txt'").select("project", F.explode(F.split("value", "\n")).alias("line"))
    req = F.lower(F.regexp_extract("line", r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)", 1))
    pypi = pip.where(req != "").select("project", F.lit("pypi").alias("ecosystem"), req.alias("name"), F.lit(False).alias("dev"))
    php_only = both(php, "composer", "require", "require-dev").where(F.contains("name", F.lit("/")))
    return both(js, "npm", "dependencies", "devDependencies").unionByName(php_only).unionByName(gomod).unionByName(pypi).distinct()


def go_sum_rows(files: DataFrame) -> DataFrame:
    """project, name, version of go.sum files (project, value): of each module the newest version listed; lines of a mere go.mod count like others."""
    lines = files.select("project", F.explode(F.split("value", r"\r?\n")).alias("line")).select("project", F.split(F.trim("line"), r"\s+").alias("p")).where("size(p) >= 3")
    version = F.regexp_replace(F.get("p", F.lit(1)), "/go.mod$", "")
    rows = lines.select("project", F.get("p", F.lit(0)).alias("name"), version.alias("version")).distinct()
    key = semver_key(F.col("version"), F.lit("go"))
    return rows.withColumn("key", key).where("key is not null").groupBy("project", "name").agg(F.max_by("version", "key").alias("version"))


_OSV = """id string, aliases array<string>, summary string, details string, severity array<struct<type:string,score:string>>, database_specific struct<severity:string,cwe_ids:array<string>>,
  references array<struct<type:string,url:string>>,
  affected array<struct<package:struct<name:string,ecosystem:string>,versions array<string>,ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string,limit:string>>>>,database_specific:struct<severity:string>>>""".replace("versions array", "versions:array")


def advisories(spark: SparkSession, path: str) -> DataFrame:
    """The OSV advisories below a path."""
    return advisory_rows(spark.read.schema(_OSV).option("multiLine", True).json(path))


def advisory_rows(raw: DataFrame) -> DataFrame:
    """OSV advisories: one row each, with affected packages, fixed versions, ranked fix references and a severity level."""
    label = F.coalesce(*(lookup(LABELS, F.lower(F.trim(c))) for c in (F.col("database_specific.severity"), F.get("affected.database_specific.severity", F.lit(0)))))
    vector = F.get(F.filter("severity", lambda s: F.startswith(s["score"], F.lit("CVSS:")))["score"], F.lit(0))
    events = F.flatten(F.transform(F.flatten(F.transform("affected", lambda a: a["ranges"])), lambda r: r["events"]))
    return raw.select(
        "id", F.coalesce("aliases", F.array()).alias("aliases"), "summary", F.substring("details", 1, 8000).alias("details"),
        F.coalesce(label, level_of_score(cvss3_base(vector))).alias("severity"),
        F.array_distinct(F.filter(F.transform(events, lambda e: e["fixed"]), lambda v: v.isNotNull())).alias("fixed_versions"),
        ranked_references("references").alias("references"), F.coalesce("database_specific.cwe_ids", F.array()).alias("cwe_ids"), "affected",
    )


def ranked_references(references: str):
    """Distinct addresses: fixes first, then commits before patches before pulls before others, in their order."""
    shape = lambda u: F.when(F.contains(u, F.lit("/commit/")), 0).when(F.contains(u, F.lit(".patch")) | F.contains(u, F.lit("/patch/")), 1).when(F.contains(u, F.lit("/pull/")), 2).otherwise(3)
    keyed = F.transform(references, lambda r, i: F.struct(F.when(F.upper(r["type"]) == "FIX", 0).otherwise(1).alias("tier"), shape(r["url"]).alias("shape"), i.alias("pos"), r["url"].alias("url")))
    return F.array_distinct(F.transform(F.array_sort(keyed), lambda k: k["url"]))


KEV = "vulnerabilities array<struct<cveID:string,dueDate:string,knownRansomwareCampaignUse:string>>"
EPSS = "data array<struct<cve:string,epss:string,percentile:string>>"
_NVD_REF = "struct<url:string,tags:array<string>>"
NVD = f"vulnerabilities array<struct<cve:struct<id:string,descriptions:array<struct<lang:string,value:string>>,references:array<{_NVD_REF}>>>>"


def nvd_rows(raw: DataFrame) -> DataFrame:
    """Records of the national database (columns of ``NVD``): id, summary, details (English ones), ranked references.

    A summary is the first description's beginning, as in the advisory tables; no fixed versions are known here.
    """
    rows = raw.select(F.explode("vulnerabilities").alias("v")).select(F.col("v.cve").alias("c"))
    said = F.transform(F.filter("c.descriptions", lambda x: x["lang"] == "en"), lambda x: x["value"])
    refs = F.transform(F.coalesce("c.references", F.array().cast(f"array<{_NVD_REF}>")), lambda r: F.struct(F.when(F.exists(F.coalesce(r["tags"], F.array().cast("array<string>")), lambda t: F.lower(t) == "patch"), "FIX").otherwise("WEB").alias("type"), r["url"].alias("url")))
    rows = rows.select(F.upper("c.id").alias("id"), F.coalesce(said, F.array().cast("array<string>")).alias("said"), refs.alias("refs"))
    return rows.select("id", F.substring(F.coalesce(F.get("said", F.lit(0)), F.lit("")), 1, 300).alias("summary"), F.substring(F.concat_ws("\n", "said"), 1, 8000).alias("details"), ranked_references("refs").alias("references"))


def kev(spark: SparkSession, path: str) -> DataFrame:
    """The snapshot of known exploited vulnerabilities at a path."""
    return kev_rows(spark.read.schema(KEV).option("multiLine", True).json(path))


def kev_rows(raw: DataFrame) -> DataFrame:
    """Known exploited vulnerabilities: cve, due date, ransomware."""
    rows = raw.select(F.explode("vulnerabilities").alias("v"))
    return rows.select(F.upper("v.cveID").alias("cve"), F.col("v.dueDate").alias("due"), (F.lower("v.knownRansomwareCampaignUse") == "known").alias("ransomware"))


def epss(spark: SparkSession, path: str) -> DataFrame:
    """The snapshot of exploit predictions at a path."""
    return epss_rows(spark.read.schema(EPSS).option("multiLine", True).json(path))


def epss_rows(raw: DataFrame) -> DataFrame:
    """Exploit predictions: cve, score, percentile."""
    return raw.select(F.explode("data").alias("d")).select(F.upper("d.cve").alias("cve"), F.col("d.epss").try_cast("double").alias("epss"), F.col("d.percentile").try_cast("double").alias("percentile"))


def source_files(spark: SparkSession, path: str, suffixes: list[str], most_bytes: int = 400_000, skipped: tuple[str, ...] = ("node_modules", "vendor", ".git", "dist")) -> DataFrame:
    """First-party source files below a path: path, text. Larger files and skipped directories are left out before reading."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(s.lstrip(".") for s in suffixes) + "}").text(path)
    inside = F.split("_metadata.file_path", "/")
    return files.where((F.col("_metadata.file_size") <= most_bytes) & ~F.arrays_overlap(inside, F.array(*map(F.lit, skipped)))).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
