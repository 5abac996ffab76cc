"""Call-trace reports: streams of JSON objects, one after the other, as findings."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_given

_FRAME = "struct<module:string,version:string,package:string,receiver:string,function:string,position:struct<filename:string,line:int>>"
OBJECT = f"""struct<osv:struct<id:string,summary:string,details:string,aliases:array<string>>,SBOM:struct<modules:array<struct<path:string,version:string>>>,
  finding:struct<osv:string,fixed_version:string,trace:array<{_FRAME}>>>"""


def stream_objects(text: Column) -> Column:
    """The texts of the JSON objects of a stream, which no separator parts; what follows broken JSON is left out."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        decoder = json.JSONDecoder()

        def objects(text):
            out, at = [], 0
            while text is not None:
                while at < len(text) and text[at].isspace():
                    at += 1
                if at >= len(text):
                    break
                try:
                    _, end = decoder.raw_decode(text, at)
                except ValueError:
                    break
                out.append(text[at:end])
                at = end
            return out

        return texts.map(objects)

    return cut(text)


def frame_path(frame: Column, root: Column) -> Column:
    """Where a frame is: its file in the project itself, ``module@version/file`` in a dependency."""
    prefix = F.concat(frame["module"], F.when(F.coalesce(frame["version"], F.lit("")) != "", F.concat(F.lit("@"), frame["version"])).otherwise(""))
    file = first_given(frame["position"]["filename"])
    own = (F.coalesce(frame["module"], F.lit("")) == "") | (frame["module"] == root)
    return F.when(own, F.coalesce(file, F.lit("go.mod"))).otherwise(F.concat(prefix, F.coalesce(F.concat(F.lit("/"), file), F.lit(""))))


def frame_symbol(frame: Column) -> Column:
    """``package.Receiver.function`` as far as it is known."""
    name = first_given(frame["function"])
    symbol = F.coalesce(F.concat(first_given(frame["receiver"]), F.lit("."), name), name)
    return F.concat_ws(".", first_given(frame["package"], frame["module"]), symbol)


def call_trace_findings(reports: DataFrame) -> DataFrame:
    """One finding for each advisory of a report (report, value): the occurrence with the richest trace, the first of equals.

    A trace of several frames that begins with a function proves a call. Steps go from the project's frame to the
    vulnerable one.
    """
    cut = reports.select("report", F.posexplode(stream_objects(F.col("value"))).alias("at", "text"))
    objects = cut.select("report", "at", F.from_json("text", OBJECT).alias("o"))
    modules = objects.where("o.SBOM is not null").select("report", F.posexplode("o.SBOM.modules").alias("place", "m"))
    root = modules.where("place = 0").groupBy("report").agg(F.min("m.path").alias("root"))
    versions = modules.groupBy("report", F.col("m.path").alias("module")).agg(F.max("m.version").alias("listed"))
    advisories = objects.where("o.osv is not null").groupBy("report", F.col("o.osv.id").alias("rule_id")).agg(F.max_by("o.osv", "at").alias("advisory"))
    trace = F.coalesce("o.finding.trace", F.array().cast(f"array<{_FRAME}>"))
    named = F.size(F.filter(trace, lambda f: F.coalesce(f["function"], F.lit("")) != ""))
    hits = objects.where("o.finding.osv is not null").select("report", F.col("o.finding.osv").alias("rule_id"), "at", trace.alias("trace"), named.alias("named"), first_given(F.col("o.finding.fixed_version")).alias("fixed"))
    richest = hits.groupBy("report", "rule_id").agg(
        F.max_by("trace", F.struct("named", F.size("trace"), -F.col("at"))).alias("trace"), F.sort_array(F.collect_set("fixed")).alias("fixed_versions")
    )
    rows = richest.join(root, "report", "left").join(advisories, ["report", "rule_id"], "left").withColumn("bad", F.get("trace", F.lit(0))).withColumn("module", F.coalesce("bad.module", F.lit("")))
    rows = rows.join(versions, ["report", "module"], "left")
    reached = (F.size("trace") > 1) & (F.coalesce("bad.function", F.lit("")) != "")
    n = F.size("trace")
    steps = F.transform(
        F.reverse("trace"),
        lambda f, i: F.struct(
            frame_path(f, F.col("root")).alias("file_path"), f["position"]["line"].alias("line"), frame_symbol(f).alias("message"), F.when(i == 0, "source").when(i == n - 1, "sink").otherwise("step").alias("role")
        ),
    )
    own = F.get(F.filter(F.reverse("trace"), lambda f: F.coalesce(f["module"], F.lit("")) == F.coalesce(F.col("root"), F.lit(""))), F.lit(0))
    package = F.coalesce(first_given(F.col("module")), F.lit("stdlib"))
    rows = rows.withColumns({"reached": reached, "own": own, "package": package})
    return rows.select(
        "report", F.concat(F.lit("trace:"), "rule_id", F.lit(":"), "package").alias("finding_id"), "rule_id",
        F.coalesce(first_given(F.col("advisory.summary")), F.col("rule_id")).alias("title"), F.when(F.col("reached"), "high").otherwise("medium").alias("severity"),
        F.when(F.col("own").isNotNull(), frame_path(F.col("own"), F.col("root"))).otherwise("go.mod").alias("file_path"),
        F.when(F.col("own").isNotNull(), F.col("own.position.line")).otherwise(1).alias("start_line"), "package",
        first_given(F.col("bad.version"), F.col("listed")).alias("installed_version"), "fixed_versions", F.coalesce("advisory.aliases", F.array().cast("array<string>")).alias("aliases"),
        F.when(F.col("reached"), steps).otherwise(F.array().cast("array<struct<file_path:string,line:int,message:string,role:string>>")).alias("trace"), "reached",
    )
