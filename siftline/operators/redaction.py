"""Secrets in structured configuration, hidden by the key that they stand below: YAML, JSON, PHP arrays and XML; placeholders and switches stay.

Lines and their number stay, so places in a file keep their meaning.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .code import FILE

HIDDEN = "<REDACTED>"
# Keys whose values are secret, what may stand for one, and values that are none.
_KEY = r"(?:[\w.-]+[_.-])?(?:passwords?|secrets?|tokens?|api_keys?|private_keys?)"
_PLACEHOLDER = r"%env\([^\r\n]*?\)%|\$\{[^\r\n}]+\}"
_CLASS_NAME = r"[\\A-Za-z_]\w*(?:\\+\w+)+(?:::class)?|\b\w+::class\b"
_SWITCH = r"true|false|yes|no|on|off|null|~"

_HEAD = rf"""(?<![\w.-])["']?{_KEY}["']?[ \t]*(?:=>|:=|:|=)[ \t]*"""
_HANDLER = r"""["']?token_handler["']?[ \t]*:"""
_ENDS = r"[ \t]*(?:[,;}\]<>#\r\n]|$)"
_STAYS = rf"""(?!["']?(?:{_PLACEHOLDER}|{_CLASS_NAME})["']?{_ENDS})(?!(?:{_SWITCH}){_ENDS})"""
_ASSIGNED = rf"""(?im)({_HEAD}){_STAYS}(?:"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|[^ \t\n\r,;}}\]{{\[<>#"'|][^\n\r,;}}\]<>]*)"""
_QUOTED = r""""[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+'"""


def _block(levels: int = 6) -> str:
    """A bracketed block whose inner brackets are closed, ``levels`` deep."""
    inner = rf"[^\[\]{{}}\"']|{_QUOTED}"
    for _ in range(levels):
        inner = rf"[^\[\]{{}}\"']|{_QUOTED}|\[(?:{inner})*+\]|\{{(?:{inner})*+\}}"
    return rf"(?:\[(?:{inner})*+\]|\{{(?:{inner})*+\}})"


def hidden_blocks(text: Column) -> Column:
    """``text`` with the bracketed blocks of secret keys hidden; one that is never closed, or is deeper than blocks are followed, is hidden to the end."""
    head = rf"(?:(?!(?<![\w.-])[\"']?access_token[\"']?[ \t]*(?:=>|:=|:|=)[ \t]*\{{[ \t]*{_HANDLER}){_HEAD})"
    # A head begins at a quote or a letter with none of a name's characters before it; all else is passed over in runs.
    other = rf"(?:[^\w.\-\"']++|(?<=[\w.\-])[\w.\-]++|(?!{head}[\[{{]).)++"
    pieces = F.regexp_extract_all(text, F.lit(rf"(?is){head}(?:{_block()}|[\[{{].*)|{other}"), 0)
    opened = rf"(?is)^({_HEAD})[\[{{].*$"
    lines = lambda p: F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit("")))
    hide = lambda p: F.concat(F.regexp_extract(p, opened, 1), F.lit(HIDDEN), F.repeat(F.lit("\n"), lines(p)))
    whole = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(opened) & p.rlike(rf"(?is)^{head}"), hide(p)).otherwise(p)), "")
    return F.when(text.rlike(rf"(?i){_HEAD}[\[{{]"), whole).otherwise(text)


def hidden_values(text: Column) -> Column:
    """``text`` with assigned values, elements and attributes of secret keys hidden; placeholders, class names and switches stay."""
    value = rf"(?!\s*(?:{_PLACEHOLDER}|{_SWITCH})\s*<)[^<]*"
    tag = r"parameter|argument|item"
    out = F.regexp_replace(text, _ASSIGNED, f"$1{HIDDEN}")
    out = F.regexp_replace(out, rf"(?i)(<({_KEY})\b[^>]*>){value}(</\2\s*>)", f"$1{HIDDEN}$3")
    out = F.regexp_replace(out, rf"""(?i)(<(?:{tag})\b[^>]*\b(?:key|name)\s*=\s*["']{_KEY}["'][^>]*>){value}(</[^>]+>)""", f"$1{HIDDEN}$2")
    attribute = rf"""(?!["'](?:{_PLACEHOLDER}|{_SWITCH})["'])(?:"[^"]*"|'[^']*')"""
    named = rf"""\b(?:key|name)\s*=\s*["']{_KEY}["']"""
    out = F.regexp_replace(out, rf"(?i)(<(?:{tag})\b[^>]*{named}[^>]*\bvalue\s*=\s*){attribute}", f"$1{HIDDEN}")
    return F.regexp_replace(out, rf"(?i)(<(?:{tag})\b[^>]*\bvalue\s*=\s*){attribute}(?=[^>]*{named})", f"$1{HIDDEN}")


# What is known of a line, below its indent: opens a block, opens one unless a handler follows, is blank, is an item, is a handler.
_OPENS, _MAY_OPEN, _BLANK, _ITEM, _HANDLES, _INDENT = 1, 2, 4, 8, 16, 32


def covered_lines(marks: list[int]) -> list[bool] | None:
    """Which of a file's lines stand below an open secret key, in one pass; None if no line opens anything. A block inside an open one ends with it or before, so one level is kept."""
    if not any(m & (_OPENS | _MAY_OPEN) for m in marks):
        return None
    out, level = [], None
    for k, m in enumerate(marks):
        indent = m // _INDENT
        if level is not None and not m & _BLANK and (indent < level or indent == level and not m & _ITEM):
            level = None
        out.append(level is not None)
        if level is None and m & (_OPENS | _MAY_OPEN):
            following = next((marks[j] for j in range(k + 1, len(marks)) if not marks[j] & _BLANK), 0) if m & _MAY_OPEN else 0
            if m & _OPENS or not following & _HANDLES:
                level = indent
    return out


def redacted_lines(files: DataFrame) -> DataFrame:
    """project, path, line, code: the lines of configuration files without their secrets.

    A secret key without a value on its line (or with a block mark) hides what is indented below it, lists at its own indent included, until a line stands
    at its indent or before. A file stays one row until its lines are known, so nothing is shuffled. Null text has no lines.
    """
    clean = files.where(F.col("text").isNotNull()).select(*FILE, F.split(hidden_blocks(F.col("text")), "\n").alias("_all"))
    key = rf"""(?i)^[ \t]*(?:-[ \t]+)?["']?({_KEY})["']?[ \t]*:[ \t]*(.*?)\s*$"""

    def mark(c: Column) -> Column:
        value = F.regexp_extract(c, key, 2)
        empty = F.trim(F.split(value, "#")[0]) == ""
        opens = F.when(~F.contains(c, F.lit(":")) | ~c.rlike(key), 0).when(value.rlike(r"^[|>]"), _OPENS).when(~empty, 0).when(F.lower(F.regexp_extract(c, key, 1)) == "access_token", _MAY_OPEN).otherwise(_OPENS)
        flag = lambda condition, n: F.when(condition, n).otherwise(0)
        blank, item = F.trim(F.regexp_replace(c, r"\r$", "")) == "", F.startswith(F.ltrim(c), F.lit("- "))
        return opens + flag(blank, _BLANK) + flag(item, _ITEM) + flag(c.rlike(rf"^[ \t]*{_HANDLER}"), _HANDLES) + F.length(F.regexp_extract(c, r"^(\s*)", 1)) * _INDENT

    @F.pandas_udf("array<boolean>")
    def covered(marks: pd.Series) -> pd.Series:
        return pd.Series([covered_lines(m.tolist()) for m in marks], dtype=object)

    known = clean.select(*FILE, "_all", F.coalesce(covered(F.transform("_all", mark)), F.array().cast("array<boolean>")).alias("_covered"))
    # An outer explode, as the filter that Spark puts below a plain one would work out the lines a second time.
    lines = known.select(*FILE, F.posexplode_outer(F.arrays_zip(F.col("_all").alias("code"), F.col("_covered").alias("covered"))).alias("_at", "x"))
    code = F.col("x.code")
    # Whatever is hidden on a line of its own has one of the keys.
    shown = F.when(code.rlike(rf"(?i){_KEY}"), hidden_values(code)).otherwise(code)
    hidden = F.concat(F.regexp_extract(code, r"^([^\S\r\n]*)", 1), F.lit(HIDDEN))
    return lines.select(*FILE, (F.col("_at") + 1).cast("long").alias("line"), F.when(F.col("x.covered"), hidden).otherwise(shown).alias("code"))
