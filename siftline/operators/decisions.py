"""Rule cascades: ordered cases over columns. Unknown stays its own value, and validation never raises a verdict."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scores import QUEUE_SEVERITY, QUEUE_VERDICT, clamp
from ..functions.text import lookup

# Bonuses of the review queue for confirmed findings.
EXPLOITABILITY_BONUS = {"trivial": 8, "moderate": 3, "difficult": 0}
IMPACT_BONUS = {"critical": 8, "high": 5, "medium": 2, "low": 0}
ALWAYS_REVIEW_SIGNALS = ("known_secret_shape", "tls_validation_disabled")
ALWAYS_REVIEW_OVERRIDES = ("contradictory_rationale", "contradictory_trace", "sanity_conflict")
PRIORITIES = ("critical", "high", "medium", "low", "none")
NEEDS_MODEL = ("present_unproven", "call_unconfirmed", "mentioned_only", "undecided", "infrastructure")


def any_override(overrides: Column, start: str) -> Column:
    return F.coalesce(F.exists(overrides, lambda o: F.startswith(o, F.lit(start))), F.lit(False))


def any_signal(overrides: Column, name: str) -> Column:
    return F.coalesce(F.exists(overrides, lambda o: F.contains(o, F.lit(name))), F.lit(False))


def always_review(overrides: Column) -> Column:
    """Never deferred by a budget."""
    out = F.lit(False)
    for name in ALWAYS_REVIEW_SIGNALS:
        out = out | any_signal(overrides, name)
    for kind in ALWAYS_REVIEW_OVERRIDES:
        out = out | any_override(overrides, kind)
    return out


def queue_score(verdict: Column, cwe_weight: Column, severity: Column, path: Column, login_only: Column, overrides: Column, error: Column, band: Column, exploitability: Column, impact: Column) -> Column:
    """0 to 100: verdict and consequence, less for code that is not shipped, more where rules object to the verdict."""
    yes = lambda cond, n: F.when(F.coalesce(cond, F.lit(False)), n).otherwise(0)
    shipped_not = F.lower(F.replace(path, F.lit("\\"), F.lit("/"))).rlike(r"(^|/)(tests?|spec|docs?|examples?|fixtures?|vendor|node_modules)/")
    total = lookup(QUEUE_VERDICT, verdict) + cwe_weight + F.coalesce(lookup(QUEUE_SEVERITY, severity), F.lit(4))
    total = total - yes(shipped_not, 12) - yes(login_only, 8)
    for name in ALWAYS_REVIEW_SIGNALS:
        total = total + yes(any_signal(overrides, name), 15)
    for kind in ALWAYS_REVIEW_OVERRIDES:
        total = total + yes(any_override(overrides, kind), 12)
    total = total + yes(any_override(overrides, "hallucinated_evidence"), 8) + yes(error != "", 10)
    total = total + yes((verdict != "unknown") & (band == "medium"), 6)
    bonus = F.coalesce(lookup(EXPLOITABILITY_BONUS, exploitability), F.lit(0)) + F.coalesce(lookup(IMPACT_BONUS, impact), F.lit(0))
    return clamp(total + F.when(verdict == "confirmed", bonus).otherwise(0), 0, 100)


def lift(priority: Column, severity: Column) -> Column:
    """A critical advisory is never below medium."""
    return F.when((severity == "critical") & priority.isin("low", "none"), "medium").otherwise(priority)


def dependency_policy(
    outcome: Column, shipped: Column, severity: Column, version_known: Column, build_risk: Column, proven: Column, parent_calls: Column, bridge: Column, condition: Column, symbol_absent: Column, other_flaw: Column
) -> Column:
    """(label, priority, person, rule) of a dependency finding; an empty label leaves the verdict to a model.

    ``outcome`` and ``parent_calls`` may be null: nothing decided, nobody asked. The order of the cases is the policy.
    """
    as_struct = lambda label, priority, person, rule: F.struct(
        F.lit(label).alias("label"),
        (priority if isinstance(priority, Column) else F.lit(priority)).alias("priority"),
        (person if isinstance(person, Column) else F.lit(person)).alias("person"),
        F.lit(rule).alias("rule"),
    )
    sev = F.lower(F.coalesce(severity, F.lit("")))
    severe = sev.isin("critical", "high")
    is_ = lambda name: F.coalesce(outcome == name, F.lit(False))
    build_only = is_("not_shipped") | (shipped == "build_only")
    image = outcome.isNotNull() & ~is_("not_shipped") & (shipped == "image_only")
    no_parent = F.coalesce(~parent_calls, F.lit(False))
    return (
        F.when(~version_known, as_struct("unknown", "medium", True, "version_unclear"))
        .when(build_only & build_risk, as_struct("confirmed", "low", False, "build_risk"))
        .when(image & build_risk, as_struct("confirmed", "low", False, "image_only_build_risk"))
        .when(image, as_struct("false_positive", "low", False, "image_only"))
        .when(is_("not_called"), as_struct("false_positive", "none", False, "lsp_not_called"))
        .when(other_flaw, as_struct("false_positive", "low", False, "needs_other_vuln"))
        .when(symbol_absent & ~is_("not_reached"), as_struct("unknown", "medium", True, "installed_symbol_absent"))
        .when(is_("actual") & proven & (condition == "external"), as_struct("unknown", "medium", True, "external_condition"))
        .when(is_("actual") & proven, as_struct("confirmed", F.when(sev == "critical", "critical").otherwise("high"), severe, "actual"))
        .when(build_only & ~build_risk, as_struct("false_positive", "low", False, "build_only"))
        .when(no_parent & severe, as_struct("unknown", lift(F.lit("medium"), sev), True, "bridge_no_path_severe"))
        .when(no_parent, as_struct("false_positive", "low", False, "bridge_no_path"))
        .when(bridge & parent_calls.isNull(), as_struct("unknown", "low", True, "bridge_unchecked"))
        .when(condition == "external", as_struct("unknown", "medium", True, "external_condition"))
        .when(is_("actual"), as_struct("", F.when(severe, "high").otherwise("medium"), False, "model_called"))
        .when(is_("no_direct_call") & F.coalesce(parent_calls, F.lit(False)), as_struct("", lift(F.lit("medium"), sev), False, "model_parent_calls"))
        .when(is_("no_direct_call"), as_struct("unknown", "low", True, "call_path_unproven"))
        .when(outcome.isNull() | outcome.isin(*NEEDS_MODEL), as_struct("", lift(F.lit("medium"), sev), False, "model"))
        .otherwise(as_struct("false_positive", "none", False, "closed"))
    )


def model_priority(label: Column, outcome: Column, severity: Column, evidence: Column) -> Column:
    """Priority of a verdict that a model gave."""
    severe = severity.isin("critical", "high")
    base = (
        F.when((outcome == "present_unproven") & (evidence == "import"), F.when(severe, "high").otherwise("medium"))
        .when(outcome.isin("call_unconfirmed", "mentioned_only"), F.when(severe, "medium").otherwise("low"))
        .otherwise("medium")
    )
    return F.when(label == "false_positive", "none").when(label != "confirmed", "medium").otherwise(lift(base, severity))


def measured_confidence(
    grounded: Column, ungrounded: Column, confirmed_flow: Column, scanner_trace: Column, corroborated: Column, agreeing: Column, opposing: Column, no_code: Column, version_and_fix: Column, version_missing: Column, server_missing: Column, rewritten: Column
) -> Column:
    """Confidence from what was checked, not from what was claimed: sums first, then caps in order, two decimals."""
    score = F.lit(0.5) + F.when(grounded >= 2, 0.15).when(grounded == 1, 0.08).otherwise(-0.15) - 0.1 * F.least(ungrounded, F.lit(3))
    score = score + F.when(confirmed_flow, 0.1).when(scanner_trace, 0.05).otherwise(0.0) + F.when(corroborated, 0.1).otherwise(0.0)
    score = score + F.least(F.lit(0.15), agreeing * 0.2) - F.least(F.lit(0.25), opposing * 0.3)
    score = F.when(no_code, F.least(score, F.lit(0.45))).when(version_and_fix, score + 0.15).when(version_missing, F.least(score, F.lit(0.5))).otherwise(score)
    score = F.when(server_missing, F.least(score, F.lit(0.55))).otherwise(score)
    score = F.when(rewritten, F.least(score, F.lit(0.6))).otherwise(score)
    return clamp(F.bround(score, 2), 0.05, 0.95)


def confidence_policy(verdict: Column, stated: Column) -> Column:
    """Whether a person has to look: unknown always, stated confidence above 0.86 not."""
    return F.when(verdict == "unknown", True).otherwise(F.coalesce(stated, F.lit(0.0)) <= 0.86)


def downgrade(verdict: Column, overrides: Column, when: Column, reason: Column) -> tuple[Column, Column]:
    """One validation step: where it applies the verdict becomes unknown and the reason is appended. It never raises."""
    applies = F.coalesce(when, F.lit(False)) & (verdict != "unknown")
    return F.when(applies, "unknown").otherwise(verdict), F.when(applies, F.concat(overrides, F.array(reason))).otherwise(overrides)
