"""The dependency chain: what is known of a vulnerable package, ordered into one outcome.

Facts are columns; null always means that nobody asked or nothing answered. A closing outcome (one that calls a finding
harmless) also needs the check that is aimed at its blind spot: without it the package counts as present and
unproven, whatever the facts say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SEVERITY_ORDER, lookup
from .filters import ECOSYSTEMS, ecosystem_name

#: Facts of a dependency finding, with the type each null stands in for.
FACTS = {
    "graph": "boolean",  # whether the call graph reaches the vulnerable function
    "graph_checked": "boolean",  # the graph's closure was checked for calls it can't see
    "graph_reopened": "boolean",  # that check quoted such a call
    "call_is_safe": "boolean",  # the call site was read and doesn't trigger the flaw
    "flow": "boolean",  # whether an analyser found a data flow into the call
    "checked": "string",  # the closure whose blind spot was checked
    "reopened": "boolean",  # that check quoted something against it
    "wrong_receiver": "boolean",  # all call sites belong to another type
    "dev_only": "boolean",
    "used": "boolean",  # whether the project's code names the package
    "test_only": "boolean",  # only tests import it
    "direct": "boolean",  # a requirement of the project itself
    "input_driven": "boolean",  # whether the flaw needs an attacker's input
    "weakness_needs_input": "boolean",  # what its weakness class says about that
    "names_paths": "boolean",  # the advisory names import paths
    "paths_used": "boolean",  # whether one of them is imported
    "symbol": "string",  # none, usable, vague or not_distributed
    "presence": "string",  # absent, not_distributed, not_searchable, call_unconfirmed, referenced, only_in_tests or called
    "condition": "string",  # absent, absent_by_text, infrastructure, external or met
    "resolver_found_none": "boolean",  # a language server or analyser resolved all calls and found none
    "reach": "string",  # reachable, no_input_path or unknown
}


# Outcomes that rest on a fact and close a finding.
CLOSING = (
    "not_applicable", "not_shipped", "unused", "condition_absent", "infrastructure", "wrong_receiver", "not_reached", "test_only_import", "only_in_tests", "not_called", "version_unaffected",
)


def closes(outcome: Column) -> Column:
    """Whether an outcome closes a finding by a fact, not by failing to find something; null does not."""
    return F.coalesce(outcome.isin(*CLOSING), F.lit(False))


def facts_of(**known: Column) -> dict[str, Column]:
    """All facts, those not given as typed nulls."""
    strange = set(known) - set(FACTS)
    if strange:
        raise ValueError(f"no such facts: {sorted(strange)}")
    return {name: known.get(name, F.lit(None)).cast(kind) for name, kind in FACTS.items()}


def dependency_verdict(facts: dict[str, Column]) -> Column:
    """struct(outcome, rule): the first case that holds, in the order of evidence: graph, audit, receiver, shipping, flow, use, condition, symbol, reach."""
    yes = lambda name: F.coalesce(facts[name], F.lit(False))
    no = lambda name: F.coalesce(~facts[name], F.lit(False))
    is_ = lambda name, *values: F.coalesce(facts[name].isin(*values), F.lit(False))
    open_ = F.lit("present_unproven")
    closed = lambda outcome, kind: F.when(is_("checked", kind), outcome).otherwise(open_)
    unless_resolved = lambda outcome: F.when(yes("resolver_found_none"), "not_called").otherwise(outcome)
    has_symbol = ~is_("symbol", "none") & facts["symbol"].isNotNull()
    cases = (
        ("graph_with_flow", yes("graph") & yes("flow"), F.lit("actual")),
        ("graph_but_safe_call", yes("graph") & yes("call_is_safe"), F.lit("condition_absent")),
        ("graph", yes("graph"), F.lit("actual")),
        ("graph_blind_spot", no("graph") & yes("graph_reopened"), open_),
        ("graph_none", no("graph"), F.when(yes("graph_checked"), "not_reached").otherwise(open_)),
        ("closure_reopened", yes("reopened"), open_),
        ("receiver", yes("wrong_receiver"), closed("wrong_receiver", "wrong_receiver")),
        ("build_only", yes("dev_only"), closed("not_shipped", "not_shipped")),
        ("flow", yes("flow"), F.lit("actual")),
        ("imported_in_tests", no("used") & yes("test_only") & yes("direct"), closed("test_only_import", "test_only")),
        ("no_flow", no("flow") & yes("input_driven"), closed("condition_absent", "no_input_path")),
        ("path_unused", has_symbol & yes("names_paths") & no("paths_used") & yes("direct"), closed("unused", "unused")),
        ("path_is_flaw", is_("symbol", "vague", "not_distributed") & yes("names_paths") & yes("paths_used"), F.lit("actual")),
        ("unused", no("used") & yes("direct"), closed("unused", "unused")),
        ("transitive", no("used"), F.lit("no_direct_call")),
        ("condition_by_text", is_("condition", "absent_by_text"), unless_resolved(open_)),
        ("condition", is_("condition", "absent"), F.lit("condition_absent")),
        ("infrastructure", is_("condition", "infrastructure"), F.lit("infrastructure")),
        ("no_symbol", ~has_symbol, F.lit("undecided")),
        ("not_distributed", is_("symbol", "not_distributed") | is_("presence", "not_distributed"), F.lit("not_applicable")),
        ("not_searchable", is_("symbol", "vague") | facts["presence"].isNull() | is_("presence", "not_searchable"), F.lit("undecided")),
        ("absent", is_("presence", "absent"), unless_resolved("no_direct_call")),
        ("receiver_unknown", is_("presence", "call_unconfirmed"), F.lit("call_unconfirmed")),
        ("referenced", is_("presence", "referenced"), unless_resolved("mentioned_only")),
        ("called_in_tests", is_("presence", "only_in_tests"), closed("only_in_tests", "only_in_tests")),
        ("class_unknown", facts["input_driven"].isNull() & ~yes("weakness_needs_input"), open_),
        ("call_is_enough", no("input_driven"), F.lit("actual")),
        ("reachable", is_("reach", "reachable"), F.lit("actual")),
    )
    out = None
    for rule, when, outcome in cases:
        value = F.struct((F.lit(outcome) if isinstance(outcome, str) else outcome).alias("outcome"), F.lit(rule).alias("rule"))
        out = F.when(when, value) if out is None else out.when(when, value)
    return out.otherwise(F.struct(open_.alias("outcome"), F.lit("reach_unproven").alias("rule")))


def reach_assessment(hits: Column, entry: Column, taint: Column, answer: Column) -> Column:
    """reachable, no_input_path or unknown: an entry point above a call *and* a flow into it; a reader's answer counts only where no flow is known.

    ``answer`` is the grounded yes or no of who read the code, null without one.
    """
    read = ~taint & F.coalesce(hits, F.lit(False))
    flows = taint | F.coalesce(answer == "yes", F.lit(False))
    return F.when(~F.coalesce(hits, F.lit(False)), "unknown").when(read & F.coalesce(answer == "no", F.lit(False)), "no_input_path").when(entry & flows, "reachable").otherwise("unknown")


def shipping_side(server: Column, client: Column, shared: Column, bundler: Column, rendered: Column) -> Column:
    """Where importing files run: node, browser, both or unknown; shared files go with the bundler, and with both if pages are rendered on the server."""
    on_server, on_client = server | (shared & ~bundler), client | (shared & bundler)
    return F.when((shared & rendered) | (on_server & on_client), "both").when(on_server, "node").when(on_client, "browser").otherwise("unknown")


def shipping(ecosystem: Column, declared: Column, scope: Column, imported: Column, loaded: Column, started: Column, has_roots: Column, tree: Column, side: Column) -> Column:
    """struct(shipped, side): runtime, image_only, build_only or unknown.

    Only the npm family is known by its imports: own code imports the package, or loads or starts one that pulls it
    in. Everything else goes by scope and declaration. ``tree`` says what the image installs: full, production, none or unknown.
    """
    as_ = lambda shipped, where: F.struct((F.lit(shipped) if isinstance(shipped, str) else shipped).alias("shipped"), (F.lit(where) if isinstance(where, str) else where).alias("side"))
    npm = F.coalesce(F.lower(ecosystem), F.lit("")).isin("npm", "node", "javascript", "yarn", "")
    by_scope = (
        F.when((scope == "runtime") | (declared == "dependencies"), as_("runtime", "server"))
        .when((scope == "dev") | (declared == "devDependencies"), as_(F.when(tree == "full", "image_only").otherwise("build_only"), "unknown"))
        .otherwise(as_("unknown", "unknown"))
    )
    via = F.when(loaded, side).otherwise("node")
    via = F.when(started & (via == "browser"), "both").when(started & (via == "unknown"), "node").otherwise(via)
    idle = (
        F.when(tree == "full", "image_only")
        .when(tree == "production", F.when(scope != "runtime", "build_only").otherwise("image_only"))
        .when(tree == "none", "build_only")
        .otherwise(F.when(scope == "dev", "build_only").otherwise("unknown"))
    )
    return (
        F.when(~npm, by_scope)
        .when(imported, as_("runtime", side))
        .when(loaded | started, as_("runtime", via))
        .when(has_roots | (scope != "unknown"), as_(idle, "unknown"))
        .otherwise(as_("unknown", "unknown"))
    )


def record_stage(
    license_: Column, misconfiguration: Column, platform_rule: Column, secret: Column, model_confirms: Column, hard_false: Column, authoritative: Column, mismatch: Column, dependency: Column, advisory_mismatch: Column, closes: Column, policy: Column, final: Column
) -> Column:
    """Which step of the record pipeline decides a finding; later ones never see it.

    ``policy`` is the dependency policy's label, empty where it leaves the finding to a model; ``model_confirms`` marks
    pattern matches, which no rule closes before the model has seen them.
    """
    chain = dependency & ~authoritative
    return (
        F.when(license_, "license")
        .when(misconfiguration & ~model_confirms & platform_rule, "platform_handled")
        .when(misconfiguration & ~model_confirms, "misconfiguration")
        .when(secret & ~model_confirms, "secret")
        .when(hard_false & ~authoritative & ~model_confirms, "heuristics")
        .when(mismatch & ~model_confirms, "deployment_mismatch")
        .when(chain & advisory_mismatch, "deployment_mismatch")
        .when(chain & closes & ((policy == "false_positive") | ((policy != "confirmed") & final)), "chain_closed")
        .when(chain & (policy != ""), "policy")
        .when(authoritative, "trace_gate")
        .otherwise("model")
    )


# The manifest that stands for an ecosystem's requirements.
MANIFESTS = {"npm": "package.json", "composer": "composer.json", "go": "go.mod", "pypi": "requirements.txt", "maven": "pom.xml"}

# Labelled lines, one-line descriptions and package addresses of scanner texts.
_LABEL = r"(?im)^\s*(?:{})\s*:\s*(.+?)\s*$"
_ONE_LINE = r"(?is)\bin\s+([a-z][\w.-]*)/([\w./@-]+?)@([^\s,]+)(?:.*?\bfixed=([^\s]+))?"
_PURL = r"(?i)pkg:([a-z]+)/([^@?#]+)(?:@([^?#]+))?"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    got = F.regexp_extract(text, pattern, group)
    return F.when(got != "", got)


def with_dependency_facts(df: DataFrame, text: str, properties: str) -> DataFrame:
    """``df`` with package, ecosystem, installed_version, fixed_versions and advisory_url drawn from a scanner's text.

    A package address in any of the ``properties`` (array of text) is believed first, then labelled lines, then a one-line description.
    A leading ecosystem in the package's name is taken off. Without a package all five are null.
    """
    said = F.coalesce(F.col(text), F.lit(""))
    address = F.get(F.filter(F.col(properties), lambda p: p.rlike(_PURL)), F.lit(0))
    label = lambda names: _found(said, _LABEL.format(names))
    df = df.withColumns({"_purl": address, "_label": label("Package|Artifact|Component"), "_fixed": label("Fixed Versions?")})
    df = df.withColumn("_line", F.coalesce(_found(F.col("_purl"), _PURL, 2), F.col("_label")).isNull())
    line = lambda group: F.when(F.col("_line"), _found(said, _ONE_LINE, group))
    df = df.withColumns(
        {
            "package": F.coalesce(_found(F.col("_purl"), _PURL, 2), F.col("_label"), line(2)),
            "ecosystem": F.coalesce(_found(F.col("_purl"), _PURL, 1), line(1)),
            "installed_version": F.trim(F.coalesce(_found(F.col("_purl"), _PURL, 3), label("Installed Version|Version|Current Version"), line(3))),
            "_fixed": F.coalesce(line(4), F.col("_fixed")),
            "advisory_url": _found(said, r"(?im)^\s*Link\s*:\s*\[?[^\]\n]*\]?\(?(https?://\S+?)\)?\s*$"),
        }
    )
    head = F.lower(F.substring_index("package", "/", 1))
    peeled = F.contains("package", F.lit("/")) & head.isin(*ECOSYSTEMS)
    fixed = F.filter(F.transform(F.split(F.coalesce("_fixed", F.lit("")), r"[,;]| or "), lambda v: F.trim(v)), lambda v: v != "")
    known = F.col("package").isNotNull()
    return df.withColumns(
        {
            "ecosystem": F.when(known, ecosystem_name(F.coalesce("ecosystem", F.when(peeled, head)))),
            "package": F.trim(F.when(peeled, F.regexp_replace("package", "^[^/]*/", "")).otherwise(F.col("package"))),
            "installed_version": F.when(known, F.nullif("installed_version", F.lit(""))),
            "fixed_versions": F.when(known, fixed),
            "advisory_url": F.when(known, F.col("advisory_url")),
        }
    ).drop("_purl", "_label", "_line", "_fixed")


def discovered_findings(packages: DataFrame, advisories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings, packages without a usable version): one finding for each package version and advisory.

    ``packages``: name, ecosystem, version, dev; a package version listed twice counts once (runtime before development).
    ``advisories``: name, ecosystem, version, advisory_id, summary, level, fixed_versions, already matched to versions and one for each flaw.
    A level the scale lacks is medium.
    """
    once = packages.where(F.coalesce("version", F.lit("")) != "").groupBy("name", "ecosystem", "version").agg(F.bool_and(F.coalesce("dev", F.lit(False))).alias("dev"))
    usable = F.col("version").rlike(r"^[vV]?\d[0-9A-Za-z.+~:_-]*$")
    level = F.lower("level")
    found = once.where(usable).join(advisories, ["name", "ecosystem", "version"]).select(
        F.concat_ws("-", "advisory_id", "name").alias("finding_id"),
        F.col("advisory_id").alias("rule_id"),
        F.substring(F.coalesce(F.nullif("summary", F.lit("")), F.col("advisory_id")), 1, 200).alias("title"),
        F.when(level.isin(*SEVERITY_ORDER, "unknown"), level).otherwise("medium").alias("severity"),
        F.coalesce(lookup(MANIFESTS, F.col("ecosystem")), F.lit("package.json")).alias("file_path"),
        F.col("name").alias("package"),
        "ecosystem",
        F.col("version").alias("installed_version"),
        "fixed_versions",
        F.when(F.col("dev"), True).alias("dev_only"),
    )
    return found, once.where(~usable)


def symbol_candidates(df: DataFrame, listed: str, exported: str, prose: str, changed: str, most: int = 40) -> DataFrame:
    """``df`` with candidates (array) and where they are from: what the advisory lists and the package exports, else its prose, else the fix's diff.

    The limit on candidates is the search's own.
    """
    none = F.array().cast("array<string>")
    own = F.array_distinct(F.filter(F.coalesce(listed, none), lambda s: F.coalesce(F.array_contains(F.coalesce(exported, none), s), F.lit(False))))
    said, diff = F.array_distinct(F.coalesce(prose, none)), F.array_distinct(F.coalesce(changed, none))
    origin = F.when(F.size(own) > 0, "advisory").when(F.size(said) > 0, "prose").when(F.size(diff) > 0, "diff").otherwise("none")
    chosen = F.when(origin == "advisory", own).when(origin == "prose", said).otherwise(diff)
    return df.withColumns({"candidates": F.slice(chosen, 1, most), "candidates_from": origin})
