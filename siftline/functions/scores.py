"""Scores from fixed formulas and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let, lookup

# The weights of CVSS 3 metrics.
CVSS3 = {
    "AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2},
    "AC": {"L": 0.77, "H": 0.44},
    "UI": {"N": 0.85, "R": 0.62},
    "C": {"H": 0.56, "L": 0.22, "N": 0.0},
    "I": {"H": 0.56, "L": 0.22, "N": 0.0},
    "A": {"H": 0.56, "L": 0.22, "N": 0.0},
}
CVSS3_PRIVILEGES = {"U": {"N": 0.85, "L": 0.62, "H": 0.27}, "C": {"N": 0.85, "L": 0.68, "H": 0.5}}
# How strong each closing outcome is by itself, and which of them need an audit.
CLOSURE_STRENGTH = {
    "version_unaffected": 0.95, "not_applicable": 0.90, "wrong_receiver": 0.85, "not_reached": 0.80, "condition_absent": 0.75,
    "not_shipped": 0.70, "test_only_import": 0.70, "unused": 0.60, "not_called": 0.60, "infrastructure": 0.60,
}
AUDITED_CLOSURES = ("not_reached", "unused", "not_shipped", "test_only_import", "wrong_receiver", "not_called")
# What the review queue adds for verdicts and severities.
QUEUE_VERDICT = {"confirmed": 45, "unknown": 28, "false_positive": 3}
QUEUE_SEVERITY = {"critical": 12, "high": 9, "medium": 5, "low": 2, "info": 0, "unknown": 4}


def clamp(value: Column, low, high) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def cvss3_base(vector: Column) -> Column:
    """Base score of a CVSS 3 vector, null where a metric is missing or unknown.

    Few vectors exist: over many rows, score the distinct ones (``cvss3_scores``).
    """

    def weights(parts):
        at = lambda k: F.element_at(parts, F.lit(k))
        changed = at("S") == "C"
        pr = F.when(changed, lookup(CVSS3_PRIVILEGES["C"], at("PR"))).otherwise(lookup(CVSS3_PRIVILEGES["U"], at("PR")))
        return F.struct(changed.alias("changed"), pr.alias("PR"), *(lookup(v, at(k)).alias(k) for k, v in CVSS3.items()))

    def impact(w):
        iss = 1 - (1 - w["C"]) * (1 - w["I"]) * (1 - w["A"])
        value = let(iss, lambda x: F.when(w["changed"], 7.52 * (x - 0.029) - 3.25 * F.pow(x - 0.02, F.lit(15))).otherwise(6.42 * x))
        return F.struct(w["changed"].alias("changed"), value.alias("impact"), (8.22 * w["AV"] * w["AC"] * w["PR"] * w["UI"]).alias("ease"))

    def rounded(scaled):
        return F.when(scaled % 10000 == 0, scaled / 100000.0).otherwise((F.floor(scaled / 10000) + 1) / 10.0)

    def score(x):
        raw = F.when(x["changed"], 1.08 * (x["impact"] + x["ease"])).otherwise(x["impact"] + x["ease"])
        found = let(F.bround(F.least(raw, F.lit(10.0)) * 100000, 0).cast("long"), rounded)
        return F.when(x["impact"] <= 0, F.lit(0.0)).when((x["impact"] + x["ease"]).isNotNull(), found)

    parts = F.when(F.startswith(vector, F.lit("CVSS:3")), F.str_to_map(vector, F.lit("/"), F.lit(":")))
    return let(parts, lambda p: F.when(F.element_at(p, F.lit("S")).isNotNull(), let(weights(p), lambda w: let(impact(w), score))))


def cvss3_scores(df: DataFrame, vector: str) -> DataFrame:
    """The distinct vectors of ``df`` with their rows' number, score and level."""
    counted = df.groupBy(vector).agg(F.count(F.lit(1)).alias("n")).withColumn("score", cvss3_base(F.col(vector)))
    return counted.withColumn("level", level_of_score(F.col("score")))


def level_of_score(score: Column) -> Column:
    return F.when(score >= 9.0, "critical").when(score >= 7.0, "high").when(score >= 4.0, "medium").when(score.isNotNull(), "low").otherwise("")


def exploit_rank(in_kev: Column, epss: Column, percentile: Column) -> Column:
    """Observed exploitation first, then its prediction; no data stays unknown."""
    p = F.coalesce(percentile, F.lit(0.0))
    return (
        F.when(in_kev, "known_exploited").when(epss.isNull(), "unknown").when((epss >= 0.10) | (p >= 0.95), "high").when((epss >= 0.01) | (p >= 0.80), "medium").otherwise("low")
    )


def closure_confidence(outcome: Column, audited: Column) -> Column:
    """Confidence of a finding closed by rule: its strength, more with an audit, at most 0.45 where one is due but missing."""
    strength = F.coalesce(lookup(CLOSURE_STRENGTH, outcome), F.lit(0.5))
    gated = outcome.isin(*AUDITED_CLOSURES)
    score = F.when(gated & audited, strength + 0.05).when(gated, F.least(strength, F.lit(0.45))).otherwise(strength)
    return clamp(F.bround(score, 2), 0.05, 0.95)


def confidence_band(score: Column) -> Column:
    return F.when(score >= 0.75, "high").when(score >= 0.5, "medium").otherwise("low")


def token_cost(prompt: Column, completion: Column, prompt_price: Column, completion_price: Column) -> Column:
    """Price of a call, prices per million tokens; null when any part is missing."""
    return F.bround((prompt * prompt_price + completion * completion_price) / 1000000, 6)


def percent(part: Column, whole: Column) -> Column:
    """A share in percent with one decimal, null over nothing."""
    return F.when(whole > 0, F.bround(100.0 * part / whole, 1))
