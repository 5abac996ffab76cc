"""Filters that keep what they exclude, and predicates in three-valued logic."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SEVERITY_ORDER, lookup, matches_pattern

# Names of package ecosystems and what each is called here.
ECOSYSTEMS = {
    "go": "go", "golang": "go",
    "npm": "npm", "node": "npm", "nodejs": "npm", "javascript": "npm", "js": "npm", "ts": "npm", "typescript": "npm", "yarn": "npm", "pnpm": "npm",
    "composer": "composer", "php": "composer", "packagist": "composer",
    "pypi": "pypi", "python": "pypi", "pip": "pypi",
    "nuget": "nuget", "dotnet": "nuget", "csharp": "nuget", "c#": "nuget",
    "maven": "maven", "java": "maven", "gradle": "maven", "kotlin": "maven",
    "gem": "gem", "rubygems": "gem", "ruby": "gem",
    "cargo": "cargo", "crates": "cargo", "rust": "cargo",
}
# Weakness families.
SECRET_FAMILY = ("CWE-798", "CWE-259", "CWE-321", "CWE-256", "CWE-522", "CWE-540", "CWE-547")
RANDOMNESS_FAMILY = ("CWE-330", "CWE-338", "CWE-336", "CWE-337")


def ecosystem_name(name: Column) -> Column:
    """The canonical name; an unknown one in lower case, none as empty."""
    plain = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return F.coalesce(lookup(ECOSYSTEMS, plain), plain)


@dataclass
class Scope:
    """What is triaged. An empty rule list excludes nothing."""

    exclude_rules: list[str] = field(default_factory=list)
    exclude_paths: list[str] = field(default_factory=list)
    only_ecosystems: list[str] = field(default_factory=list)
    only_cwes: list[str] = field(default_factory=list)
    min_severity: str | None = None


def scope_rule(scope: Scope, rule: Column, path: Column, ecosystem: Column, cwe: Column, severity: Column) -> Column:
    """The first rule that excludes a finding, null if it is in scope.

    ``ecosystem`` is null for code weaknesses. Unknown ecosystems and unknown severities are never excluded.
    """
    cases = [F.when(matches_pattern(rule, p), F.lit(f"rule:{p}")) for p in scope.exclude_rules]
    cases += [F.when(matches_pattern(path, p), F.lit(f"path:{p}")) for p in scope.exclude_paths]
    if wanted := sorted({ECOSYSTEMS.get(e.strip().lower(), e.strip().lower()) for e in scope.only_ecosystems if e.strip()}):
        name = ecosystem_name(ecosystem)
        cases.append(F.when(ecosystem.isNotNull() & (name != "") & ~name.isin(wanted), F.concat(F.lit("ecosystem:"), name)))
    if scope.only_cwes:
        cases.append(F.when(~F.coalesce(cwe.isin(scope.only_cwes), F.lit(False)), F.lit("cwe_not_in_scope")))
    if scope.min_severity:
        below = SEVERITY_ORDER[: SEVERITY_ORDER.index(scope.min_severity)]
        cases.append(F.when(severity.isin(*below), F.lit("below_min_severity")))
    return F.coalesce(*cases, F.lit(None).cast("string"))


def split_by_rule(df: DataFrame, rule: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, excluded with the rule that excluded them): nothing is dropped."""
    ruled = df.withColumn("scope_rule", rule)
    return ruled.where(F.col("scope_rule").isNull()).drop("scope_rule"), ruled.where(F.col("scope_rule").isNotNull())


def in_directories(path: Column, names: list[str]) -> Column:
    """Whether one of the path's directories has one of the names."""
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, names)))


def test_path(path: Column, directories: list[str], globs: list[str]) -> Column:
    """A path inside a test directory, with a test file's name, or a compose file."""
    from ..functions.text import base_name, glob_regex

    name = base_name(path)
    out = in_directories(path, directories) | name.rlike(r"(?i)^(docker-)?compose[^/]*\.ya?ml$")
    for g in globs:
        out = out | name.rlike(glob_regex(g))
    return out


def first_matching(value: Column, patterns: dict[str, str]) -> Column:
    """The name of the first pattern found in a value, in table order."""
    return F.coalesce(*(F.when(value.rlike(p), F.lit(name)) for name, p in patterns.items()), F.lit(None).cast("string"))


def needs_redo(verdict: Column, error: Column, overrides: Column, redo: list[str]) -> Column:
    """Whether an earlier verdict is decided anew: by its label, after an error, or where rules had to rewrite it."""
    if "all" in redo:
        return F.lit(True)
    out = F.coalesce(verdict.isin(redo), F.lit(False))
    if "error" in redo:
        out = out | F.coalesce(error != "", F.lit(False))
    if "overridden" in redo:
        out = out | F.coalesce(F.size(overrides) > 0, F.lit(False))
    return out


def gate_count(df: DataFrame, verdict: str, fail_on: str) -> DataFrame:
    """How many rows would fail a run: none, those confirmed, or those confirmed and unknown."""
    labels = {"none": [], "confirmed": ["confirmed"], "unknown": ["confirmed", "unknown"]}[fail_on]
    return df.agg(F.count_if(F.col(verdict).isin(labels) if labels else F.lit(False)).alias("failing"))
