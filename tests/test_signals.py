"""Signals of code by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.operators import heuristics


def test_the_literal_of_most_entropy_counts(spark):
    rows = [
        (1, f'k("{"a" * 40}", "q8Zr2Lw9Xt5Bv1Ny")', None),
        (2, 'k("q8Zr2Lw9Xt5Bv1Ny", "' + "ab" * 30 + '")', "CWE-798"),
        (3, 'k(" app.core.Main ")', "CWE-259"),
        (4, 'k("{{ vault.key }}", "aaaa")', None),
        (5, 'k("q8Zr2Lw9Xt5Bv1Ny")', "CWE-79"),
        (6, 'k("abcd", "abcdabcd")', None),
        (7, "k()", None),
        (8, None, None),
    ]
    df = spark.createDataFrame(rows, "i int, code string, weakness string")
    found = heuristics.signals(F.lit("src/a.py"), F.col("code"), F.col("weakness"), F.lit(False), F.lit(False))
    got = {r.i: ([s["name"] for s in r.found], r.why) for r in df.select("i", found.alias("found")).withColumn("why", heuristics.hard_false_positive(F.col("found"))).collect()}
    assert got[1] == (["high_entropy_literal"], None) and got[2] == (["high_entropy_literal"], None)
    assert got[3] == (["class_or_type_reference"], None)
    assert got[4] == (["template_expression", "low_entropy_literal"], "template")
    assert got[5] == ([], None) and got[6] == (["low_entropy_literal"], None) and got[7] == ([], None) and got[8] == (["no_code_context"], None)


def test_uses_are_found_inside_words_of_any_alphabet(spark):
    df = spark.createDataFrame([(1, "aktivés = rand()"), (2, "échantillon = rand()"), (3, "xjitterß = rand()")], "i int, code string")
    found = heuristics.signals(F.lit("a.py"), F.col("code"), F.lit("CWE-330"), F.lit(False), F.lit(False))
    got = {r.i: [s["name"] for s in r.found] for r in df.select("i", found.alias("found")).collect()}
    assert got == {1: ["security_context_hint"], 2: [], 3: ["nonsecurity_context_hint"]}


def test_passages_whose_words_lie_anywhere(spark, tmp_path):
    """The condition and keyword queries read every word of a passage and every document."""
    from siftline.plans.registry import QUERIES

    spark.createDataFrame([(1, "aa bb cc zz"), (2, "aa bb cc dd yy")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "aa bb", "fr"), (2, "cc zz ", "de"), (3, "dd", None)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("ASIA",)], "r_name string").write.parquet(f"{tmp_path}/region.parquet")
    got = {tuple(r) for r in QUERIES["j24_condition_groups"](spark, str(tmp_path)).select("item_id", "parts", "found", "state").collect()}
    assert got == {(1, 4, 4, "holds"), (2, 5, 4, "absent")}
    assert {r.keyword for r in QUERIES["j12_keyword_join"](spark, str(tmp_path)).collect()} == {"aa", "bb", "cc", "zz", "dd"}
