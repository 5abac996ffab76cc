"""Evidence packages and chain summaries by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.operators import package


def test_one_row_a_finding(spark):
    findings = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d")], "id long, note string")
    code = spark.createDataFrame([(1, k, f"line {k}") for k in range(50)] + [(2, 5, "x"), (2, None, "first"), (9, 1, "nobody's"), (None, 1, "null"), (2, 5, None)], "id long, at int, text string")
    trace = spark.createDataFrame([(1, 2, 7), (1, 1, 8), (1, 1, 6)], "id long, at int, step int")
    about = spark.createDataFrame([(1, "npm", 2), (1, "npm", 1), (3, None, 5), (None, "x", 1)], "id long, ecosystem string, hops int")
    got = package.evidence_package(findings, "id", {"code": (code, ["at"], "text", 3), "trace": (trace, ["at", "step"], "step", 2)}, {"about": about, "none": about.where("false")})
    rows = {r.note: r for r in got.collect()}
    assert len(rows) == 4 == got.count() and got.columns == ["id", "note", "code", "trace", "about", "none"]
    assert rows["a"].code == ["line 0", "line 1", "line 2"] and rows["a"].trace == ["6", "8"] and tuple(rows["a"].about) == ("npm", 1)
    assert rows["b"].code == ["first", None, "x"] and rows["b"].trace == [] and rows["b"].about is None
    assert rows["c"].code == [] and tuple(rows["c"].about) == (None, 5) and rows["d"].code == [] and rows["d"].about is None and all(r.none is None for r in rows.values())


def test_ties_go_by_the_value_and_unlisted_components_keep_their_history(spark, tmp_path):
    from siftline.plans.registry import QUERIES

    save = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    save("orders", [(1, 10), (2, 99), (3, 99), (4, None)], "o_orderkey long, o_custkey long")
    save("customer", [(10, "c", 3)], "c_custkey long, c_name string, c_nationkey int")
    save("part", [(5, 1, "b")], "p_partkey long, p_size int, p_brand string")
    item = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_shipdate timestamp"
    save("lineitem", [(1, 5, s, 1, "R", None) for s in (116, 22, 3)], item)
    got = {r.o_orderkey: r for r in QUERIES["p29_evidence_package"](spark, str(tmp_path)).collect()}
    assert got[1].trace == ["3", "22"] and got[1].component == "c" and got[1].earlier == [1]
    assert got[2].component is None and got[2].exposed is None and got[2].earlier == got[3].earlier == [2, 3] and got[4].earlier is None


def test_tasks_keep_the_first_rows_before_the_shuffle(spark):
    code = spark.range(1000).select((F.col("id") % 2).alias("id"), F.col("id").alias("at"), F.col("id").cast("string").alias("text"))
    df = package.evidence_package(spark.createDataFrame([(0,), (1,)], "id long"), "id", {"code": (code, ["at"], "text", 3)})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
    assert {r.id: r.code for r in df.collect()} == {0: ["0", "2", "4"], 1: ["1", "3", "5"]}


def test_summary_of_nothing(spark):
    kinds = "package string, version string, upgrade string, symbol string, matched_symbol string, outcome string, note string, condition struct<statement:string,state:string,owner:string,tokens:array<string>,hits:array<string>>"
    kinds += ", dataflow struct<file:string,line:int,steps:array<string>>, reach_trace array<string>, call_sites array<string>, analyser_calls array<string>, problems array<string>, shipping struct<shipped:string,runtime:string,via:array<string>>, owner string"
    rows = [(None,) * 15, ("p", "1", None, "s", "", "actual", None, ("needs", "infrastructure", "", None, list("abcdef")), ("f", 3, []), ["r"], ["c"], None, None, None, "me")]
    df = spark.createDataFrame(rows, kinds)
    got = [r.asDict() for r in df.select(*package.summary_columns(F.struct(*df.columns))).collect()]
    assert all(v in ("", []) for v in got[0].values())
    assert got[1]["symbol"] == "s" and got[1]["external"] == "needs" and got[1]["owner"] == "owner of the system" and got[1]["condition_hits"] == list("abcd") and got[1]["call_sites"] == ["f:3 (call)"] and got[1]["trace"] == ""
