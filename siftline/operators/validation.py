"""Validation steps for verdicts that a model proposes. Each is (verdict, override): the verdict only ever moves to unknown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Outcomes and routes of the dependency chain, words of a concrete refutation, and what counts as a sure closure.
NAME_ONLY = ("call_unconfirmed", "mentioned_only")
RESOLVED_ROUTES = ("codeql", "callgraph")
BOUND_CALL = ("present_unproven", "actual")
BINDING_EVIDENCE = ("import", "codeql", "psalm", "lsp")
NAMED_DEFENCE = ("sanitized_dataflow", "identifier_only")
NOT_SHIPPED = r"(?i)not shipped|не поставляется|dev[- ]?only|devdependencies|development only|только для разработки"
REFUTES = r"(?i)\b(?:not|outside|patched|fixed|development|dev[- ]only|test|unreachable|absent|different|wrong|does not|no vulnerable|not affected|not shipped)\b"
SURE = 0.86


def _unknown(verdict: Column, cases: list[tuple[Column, str]]) -> Column:
    """struct(verdict, override): unknown by the first case that holds, else as it was."""
    out = None
    for when, reason in cases:
        found = F.struct(F.lit("unknown").alias("verdict"), F.lit(reason).alias("override"))
        out = F.when(F.coalesce(when, F.lit(False)), found) if out is None else out.when(F.coalesce(when, F.lit(False)), found)
    return out.otherwise(F.struct(verdict.alias("verdict"), F.lit(None).cast("string").alias("override")))


def unproven_call(verdict: Column, outcome: Column, route: Column, resolved: Column, parent_path: Column) -> Column:
    """A confirmation needs a resolved call, or a quoted path through a parent package; a name that looks alike is none."""
    claimed = (verdict == "confirmed") & ~parent_path
    text_only = (route == "text") & ~(resolved | route.isin(*RESOLVED_ROUTES))
    return _unknown(verdict, [(claimed & outcome.isin(*NAME_ONLY), "unproven_call: name only"), (claimed & text_only, "unproven_call: text route")])


def guarded_closure(verdict: Column, outcome: Column, evidence: Column, shipped: Column, reason: Column, evidence_class: Column) -> Column:
    """A closure does not overrule the shipping check, nor a call bound to the package unless it names a defence."""
    closed = verdict == "false_positive"
    bound = outcome.isin(*BOUND_CALL) & evidence.isin(*BINDING_EVIDENCE) & ~evidence_class.isin(*NAMED_DEFENCE)
    return _unknown(verdict, [(closed & (shipped == "runtime") & reason.rlike(NOT_SHIPPED), "shipping_conflict"), (closed & bound, "chain_conflict")])


def unproven_dependency(verdict: Column, in_chain: Column, symbol_installed: Column, symbol: Column, matched: Column, entries: Column, parent_calls: Column, graph_called: Column, condition: Column, flow: Column) -> Column:
    """An affected version alone confirms nothing: the symbol must be installed and reached, and what the environment must give checked."""
    claimed = (verdict == "confirmed") & in_chain
    leaf = F.element_at(F.split(F.coalesce(matched, F.lit("")), "::"), -1)
    short = (F.coalesce(symbol, F.lit("")) != "") & (leaf != symbol) & ~F.coalesce(F.array_contains(entries, leaf), F.lit(False))
    helped = parent_calls | graph_called
    return _unknown(
        verdict,
        [
            (claimed & ~symbol_installed, "unproven_dependency: symbol not installed"),
            (claimed & short & ~helped, "unproven_dependency: public entry only"),
            (claimed & (condition == "external"), "unproven_dependency: condition unchecked"),
            (claimed & ~flow & ~helped, "unproven_dependency: no path"),
        ],
    )


def review_needed(verdict: Column, priority: Column, severity: Column, has_fix: Column, stated: Column) -> Column:
    """Whether a person looks at a dependency verdict: severe confirmations, those without a fix, and closures that were not sure."""
    level = F.when(F.coalesce(priority, F.lit("")) == "", "medium").otherwise(priority)
    severe = level.isin("critical", "high") & F.coalesce(severity.isin("critical", "high"), F.lit(False))
    confirmed = (verdict == "confirmed") & (severe | (~has_fix & level.isin("critical", "high", "medium")))
    return (verdict == "unknown") | confirmed | ((verdict == "false_positive") & (F.coalesce(stated, F.lit(0.0)) <= SURE))


def trace_gate(candidate: Column, reason: Column, rationale: Column, quotes: Column, haystack: Column, error: Column) -> Column:
    """struct(verdict, override) of a finding that a call trace proves: confirmed, unless the model refutes it with exact quotes and a concrete reason.

    Null or empty quotes ground nothing; blank and very short ones neither.
    """
    grounded = (F.size(F.coalesce(quotes, F.array().cast("array<string>"))) > 0) & F.forall(quotes, lambda q: F.contains(haystack, q) & (F.length(F.trim(q)) >= 4))
    concrete = (F.length(F.trim(reason)) >= 20) & F.concat_ws(" ", reason, rationale).rlike(REFUTES)
    as_ = lambda verdict, why: F.struct(F.lit(verdict).alias("verdict"), F.lit(why).alias("override"))
    return (
        F.when(F.coalesce(error, F.lit("")) != "", as_("confirmed", "baseline kept: model error"))
        .when(candidate.isNull(), as_("confirmed", "baseline kept: no answer"))
        .when(candidate != "false_positive", as_("confirmed", "baseline kept: not refuted"))
        .when(F.coalesce(grounded & concrete, F.lit(False)), as_("false_positive", "baseline refuted"))
        .otherwise(as_("confirmed", "baseline kept: not grounded"))
    )


def route_signal(route: Column, hops: Column, existing: Column) -> Column:
    """struct(reachability, direction, weight): inside a routed method, some hops from one, or what was known before."""
    as_ = lambda text, direction, weight: F.struct(text.alias("reachability"), F.lit(direction).cast("string").alias("direction"), F.lit(weight).cast("double").alias("weight"))
    return (
        F.when(route.isNotNull(), as_(F.concat(F.lit("inside an HTTP entry point: "), route), "toward_confirmed", 0.6))
        .when(hops.isNotNull(), as_(F.concat(hops.cast("string"), F.lit(" hop(s) from an HTTP entry point")), "neutral", 0.0))
        .otherwise(as_(existing, None, None))
    )
