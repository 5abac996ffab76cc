"""Normalisers over text columns: severities, weakness ids, package addresses, fingerprints, code shapes."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity words of scanner reports.
SEVERITY_WORDS = {
    "critical": "critical", "crit": "critical", "blocker": "critical",
    "high": "high", "error": "high", "major": "high",
    "medium": "medium", "warning": "medium", "moderate": "medium",
    "low": "low", "note": "low", "minor": "low",
    "info": "info", "informational": "info", "none": "info",
}
# Severity words of SARIF tags and properties, and SARIF levels.
TAG_WORDS = {"critical": "critical", "high": "high", "medium": "medium", "moderate": "medium", "low": "low", "info": "info"}
LEVEL_WORDS = {"error": "high", "warning": "medium", "note": "low", "none": "info"}
# From least to most severe; "unknown" has no place in it.
SEVERITY_ORDER = ("info", "low", "medium", "high", "critical")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lookup(words: dict, key: Column) -> Column:
    """The value of a small fixed table; null for keys it lacks."""
    flat = [F.lit(x) for pair in words.items() for x in pair]
    return F.element_at(F.create_map(*flat), key)


def first_given(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.when(c != "", c) for c in columns))


def severity_word(word: Column) -> Column:
    """One of six levels; a word outside the table, or none, is ``unknown``."""
    return F.coalesce(lookup(SEVERITY_WORDS, F.lower(F.trim(word))), F.lit("unknown"))


def score_severity(text: Column) -> Column:
    """Level of a numeric security severity: 9 critical, 7 high, below it medium and never low; null if no number."""
    value = text.try_cast("double")
    return F.when(value >= 9, "critical").when(value >= 7, "high").when(value.isNotNull(), "medium")


def sarif_severity(security: Column, problem: Column, severity: Column, impact: Column, tags: Column, level: Column, default_level: Column) -> Column:
    """The first of the properties that says anything, then tags, then the result's level, then the rule's."""
    known_tag = F.get(F.filter(F.transform(tags, lambda t: lookup(TAG_WORDS, F.lower(t))), lambda t: t.isNotNull()), F.lit(0))
    word = lambda c: lookup(TAG_WORDS, F.lower(c))
    by_level = lookup(LEVEL_WORDS, F.lower(first_given(level, default_level)))
    return F.coalesce(word(security), score_severity(security), word(problem), word(severity), word(impact), known_tag, by_level, F.lit("unknown"))


def cwe_of(candidates: Column) -> Column:
    """``CWE-<number>`` from the first of an array of texts that names a weakness and has digits."""
    digits = F.transform(F.filter(candidates, lambda c: F.contains(F.lower(c), F.lit("cwe"))), lambda c: F.regexp_replace(c, "[^0-9]", ""))
    first = F.get(F.filter(digits, lambda d: d != ""), F.lit(0))
    return F.when(first.isNotNull(), F.concat(F.lit("CWE-"), first.try_cast("decimal(38,0)").cast("string")))


def purl_parts(purl: Column) -> Column:
    """(type, name, version) of ``pkg:type/name@version``, qualifiers off, percent-decoded; null if it is none."""
    body = F.regexp_replace(F.substring(purl, 5, 1 << 20), r"[?#].*$", "")
    kind = F.regexp_extract(body, r"^([^/]+)/", 1)
    rest = F.regexp_replace(body, r"^[^/]+/", "")
    version = F.regexp_extract(rest, r"@([^@]*)$", 1)
    name = F.regexp_replace(rest, r"@[^@]*$", "")
    decode = lambda c: F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)
    parts = F.struct(F.lower(kind).alias("type"), decode(name).alias("name"), decode(version).alias("version"))
    return F.when(F.startswith(purl, F.lit("pkg:")) & (kind != "") & (name != ""), parts)


def fingerprint(rule: Column, cwe: Column, path: Column, snippet: Column) -> Column:
    """32 hex digits that survive moved lines but not changed code; nulls count as empty and keep their place."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    code = F.trim(F.regexp_replace(blank(snippet), r"(?U)\s+", " "))
    return F.substring(F.sha2(F.concat_ws("␟", blank(rule), blank(cwe), F.replace(blank(path), F.lit("\\"), F.lit("/")), code), 256), 1, 32)


def cluster_shape(snippet: Column) -> Column:
    """The snippet with literals and names as single letters and no white space, 120 characters at most."""
    out = F.coalesce(snippet, F.lit(""))
    for pattern, letter in (
        (r"""(["'])(?:\\.|(?!\1).)*\1""", "S"),
        (r"(?U)\b\d+\b", "N"),
        (r"(?U)\$\w+", "V"),
        (r"(?U)\b[A-Za-z_]\w*\b", "I"),
        (r"(?U)\s+", ""),
    ):
        out = F.regexp_replace(out, pattern, letter)
    return F.substring(out, 1, 120)


def variant_shape(line: Column) -> Column:
    """A line's skeleton: call names and member punctuation stay, values and member names go."""
    out = F.trim(line)
    for pattern, to in (
        (r"""(["'])(?:\.|(?!\1).)*\1""", '""'),
        (r"(?U)\b\d+\b", "0"),
        (r"(?U)\$\w+", r"\$V"),
        (r"(?U)(->|\.)\w+(?![\w(])", "$1M"),
        (r"(?U)\s+", " "),
    ):
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def distinctive(shape: Column) -> Column:
    """Whether a shape would find something and not everything."""
    return (F.length(shape) >= 12) & (shape.rlike(r"(?U)\w\s*\(") | shape.rlike(r"[=!]==|===|!=="))


def entropy(text: Column) -> Column:
    """Shannon entropy in bits per character; 0 for an empty text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    total = F.size(chars).cast("double")
    share = lambda c: F.size(F.filter(chars, lambda d: d == c)) / total
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a shell glob (``*``, ``?``, ``[...]``), made once when a rule table is read."""
    out, i = "", 0
    while i < len(pattern):
        c, i = pattern[i], i + 1
        if c == "[" and (end := pattern.find("]", i + 1)) > 0:
            inside = pattern[i:end].replace("\\", "\\\\")
            out += "[" + ("^" + inside[1:] if inside[:1] == "!" else inside) + "]"
            i = end + 1
        else:
            out += {"*": ".*", "?": "."}.get(c) or re.escape(c)
    return rf"(?s)\A{out}\z"


def matches_pattern(value: Column, pattern: str) -> Column:
    """Glob match or regular-expression search; a pattern that is no regular expression counts as a glob only."""
    try:
        re.compile(pattern)
    except re.error:
        return value.rlike(glob_regex(pattern))
    return value.rlike(glob_regex(pattern)) | value.rlike(pattern)


def identifiers(*texts: Column) -> Column:
    """Distinct vulnerability ids in the texts, GHSA first, then in order of appearance."""
    every = F.concat(*(F.regexp_extract_all(F.upper(F.coalesce(t, F.lit(""))), F.lit(r"(CVE-\d{4}-\d{4,}|GHSA(?:-[0-9A-Z]{4}){3}|GO-\d{4}-\d{4,})"), 1) for t in texts))
    distinct = F.array_distinct(every)
    first = F.filter(distinct, lambda i: F.startswith(i, F.lit("GHSA")))
    return F.concat(first, F.filter(distinct, lambda i: ~F.startswith(i, F.lit("GHSA"))))


def repository_path(uri: Column, root: Column) -> Column:
    """A file address made relative to the repository: decoded, ``.`` and ``..`` folded; null for what lies outside."""
    path = F.coalesce(F.try_url_decode(F.replace(F.regexp_replace(uri, "^file://", ""), F.lit("+"), F.lit("%2B"))), uri)
    inside = F.when(F.startswith(path, F.concat(root, F.lit("/"))), F.substr(path, F.length(root) + 2)).when(~F.startswith(path, F.lit("/")), path)
    start = F.array().cast("array<string>")
    up = lambda acc: F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1))
    folded = F.aggregate(F.split(inside, "/"), start, lambda acc, p: F.when(p == "..", up(acc)).when(p.isin(".", ""), acc).otherwise(F.concat(acc, F.array(p))))
    return F.when(folded.isNotNull() & (F.size(folded) > 0), F.array_join(folded, "/"))


def flaw_paragraph(summary: Column, details: Column, most: int = 420) -> Column:
    """The summary and the details without a repeated summary, cut behind the last sentence that fits; details that only begin with the same letters repeat nothing."""
    behind = F.substr(details, F.length(summary) + 1)
    rest = F.when(F.startswith(details, summary) & ~behind.rlike(r"^[\p{L}\p{N}_]"), F.trim(behind)).otherwise(details)
    return cut_behind_sentence(F.concat_ws(" ", summary, rest), most)


def cut_behind_sentence(paragraph: Column, most: int = 420) -> Column:
    """At most so many characters of a paragraph, up to the last full stop in them if there is one."""
    whole = F.trim(paragraph)
    head = F.substring(whole, 1, most)
    end = F.length(head) - F.locate(".", F.reverse(head)) + 1
    return F.when(F.length(whole) <= most, whole).when(F.contains(head, F.lit(".")), F.substr(head, F.lit(1), end)).otherwise(head)


def attack_conditions(text: Column) -> Column:
    """Readable conditions of the CVSS vector found anywhere in a text; empty without one."""
    vector = F.regexp_extract(text, r"(CVSS:\d\.\d(?:/[A-Za-z]{1,3}:[A-Za-z])+)", 1)
    # What the metrics say.
    words = {
        "AV:N": "over the network", "AV:A": "from the adjacent network", "AV:L": "locally", "AV:P": "with physical access", "AC:L": "without special conditions", "AC:H": "under special conditions",
        "PR:N": "without an account", "PR:L": "with an ordinary account", "PR:H": "with an administrator's account", "UI:N": "without the user", "UI:R": "with the user's help",
    }
    said = F.transform(F.split(vector, "/"), lambda m: lookup(words, m))
    return F.filter(said, lambda x: x.isNotNull())
