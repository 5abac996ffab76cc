"""Version texts as arrays and structs that Spark compares natively. Three notions that must not be merged:

``release_parts`` (strict, for upgrade targets), ``lenient_parts`` (for majors) and ``semver_key`` (for ranges).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def release_parts(version: Column) -> Column:
    """Plain dotted numbers as an array; null for anything else."""
    text = F.regexp_replace(F.lower(F.trim(version)), "^v+", "")
    return F.when(text.rlike(r"^\d{1,9}(\.\d{1,9})*$"), F.transform(F.split(text, r"\."), lambda p: p.cast("int")))


def lenient_parts(version: Column) -> Column:
    """Leading numbers by piece; the first piece with anything but digits gives its digits and ends it. Null if there are none."""
    pieces = F.split(F.regexp_replace(F.lower(F.trim(version)), "^v+", ""), r"\.")

    def numbers(pieces):
        # 0 where all pieces are numbers.
        end = F.array_position(F.transform(pieces, lambda p: p.rlike(r"^\d+$")), False)
        kept = F.slice(pieces, F.lit(1), F.when(end > 0, end).otherwise(F.size(pieces)).cast("int"))
        return F.transform(F.filter(F.transform(kept, lambda p: F.regexp_replace(p, r"\D", "")), lambda d: d != ""), lambda d: d.cast("bigint"))

    return let(let(pieces, numbers), lambda out: F.when(F.size(out) > 0, out))


def major(parts: Column) -> Column:
    """What a major release changes: the first number, or the first two where the first is 0."""
    return F.when(F.get(parts, F.lit(0)) == 0, F.slice(parts, 1, 2)).otherwise(F.slice(parts, 1, 1))


def upgrade_target(installed: Column, fixed: Column) -> Column:
    """The lowest fixed version above the installed one; the first listed where that one can't be ordered."""
    current = release_parts(installed)
    above = F.filter(
        F.transform(fixed, lambda v: F.struct(release_parts(v).alias("parts"), v.alias("raw"))),
        lambda s: s["parts"].isNotNull() & (s["parts"] > current),
    )
    return F.when(current.isNull(), F.get(fixed, F.lit(0))).otherwise(F.array_min(above)["raw"])


_TAGGED = r"(?i)^v?(\d+(?:\.\d+)*)[-.]?(alpha|beta|rc|patch|pl|p|a|b)\.?(\d*)$"
_PLAIN = r"^v?(\d{1,9}(?:\.\d{1,9})*)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$"
_PART = "struct<k:int,n:bigint,s:string>"


def semver_key(version: Column, ecosystem: Column) -> Column:
    """A key struct (numbers, rank of the release, pre-release parts) that orders versions; null if unorderable.

    Go prefixes and suffixes are dropped; Composer's stability tags count as pre-releases, patches as
    later releases. A pre-release comes before its release; numbers come before words in it.
    """
    eco = F.lower(F.trim(ecosystem))
    text = F.trim(version)
    text = F.when(eco.isin("go", "golang"), F.regexp_replace(F.regexp_replace(text, r"\+incompatible$", ""), "^go", "")).otherwise(text)

    def tag_of(t):
        number = F.coalesce(F.nullif(F.regexp_extract(t, _TAGGED, 3), F.lit("")), F.lit("0"))
        found = F.struct(F.regexp_extract(t, _TAGGED, 1).alias("base"), F.lower(F.regexp_extract(t, _TAGGED, 2)).alias("tag"), number.alias("number"))
        return let(F.struct(t.alias("t"), F.when(eco.isin("composer", "packagist", "php") & t.rlike(_TAGGED), found).alias("php")), plain_of)

    def plain_of(f):
        tag, base, number = (f["php"][k] for k in ("tag", "base", "number"))
        patch = F.coalesce(tag.isin("patch", "pl", "p"), F.lit(False))
        long_tag = F.when(tag == "a", "alpha").when(tag == "b", "beta").otherwise(tag)
        t = F.when(patch, base).when(tag.isNotNull(), F.concat(base, F.lit("-"), long_tag, F.lit("."), number)).otherwise(f["t"])
        return let(F.struct(t.alias("t"), F.when(patch, number).alias("patch")), lambda x: F.when(x["t"].rlike(_PLAIN), key_of(x)))

    def key_of(f):
        main = let(F.transform(F.split(F.regexp_extract(f["t"], _PLAIN, 1), r"\."), lambda p: p.cast("int")), main_of)
        patch = F.array(F.struct(F.lit(0).alias("k"), f["patch"].cast("bigint").alias("n"), F.lit("").alias("s"))).cast(f"array<{_PART}>")
        none = F.array().cast(f"array<{_PART}>")
        pre = lambda p: F.when(f["patch"].isNotNull(), patch).when(p == "", none).otherwise(F.transform(F.split(p, r"\."), part_of))
        whole = lambda p: F.struct(main.alias("main"), F.when(p == "", 1).otherwise(0).alias("rel"), pre(p).alias("pre"))
        return let(F.regexp_extract(f["t"], _PLAIN, 2), whole)

    def main_of(numbers):
        # Zeros at the end of more than three numbers say nothing.
        padded = F.concat(numbers, F.array_repeat(F.lit(0), F.greatest(F.lit(0), 3 - F.size(numbers))))
        return let(padded, lambda m: F.slice(m, F.lit(1), F.array_max(F.transform(m, lambda p, i: F.when((p != 0) | (i < 3), i + 1).otherwise(0)))))

    def part_of(p):
        number = p.rlike(r"^\d+$")
        return F.struct(F.when(number, 0).otherwise(1).alias("k"), F.coalesce(p.try_cast("bigint"), F.lit(0)).alias("n"), F.when(number, "").otherwise(p).alias("s"))

    return let(text, tag_of)


def version_state(installed: Column, ecosystem: Column, listed: Column, ranges: Column) -> Column:
    """affected, unaffected or unknown for an installed version.

    ``listed`` are explicitly affected versions; ``ranges`` an array of (type, events), each event a struct of
    introduced, fixed, last_affected, limit. The order of the ranges and events counts: the first bound
    that can't be ordered makes the answer unknown, the first range that holds the version affected.
    Ranges by commit alone say unknown.
    """
    ordered = F.filter(ranges, lambda r: F.upper(r["type"]).isin("SEMVER", "ECOSYSTEM"))
    key = f"struct<main:array<int>,rel:int,pre:array<{_PART}>>"
    empty = F.lit(None).cast(key)
    state = lambda key, from_zero, is_open, answer: F.struct(key.alias("key"), from_zero.alias("zero"), is_open.alias("open"), answer.alias("answer"))
    no, yes, text = F.lit(False), F.lit(True), lambda x: F.lit(x).cast("string")

    def keyed(e):
        bound = F.coalesce(e["fixed"], e["last_affected"], e["limit"])
        return F.struct(
            e["introduced"].alias("intro"), semver_key(e["introduced"], ecosystem).cast(key).alias("low"), bound.alias("bound"), semver_key(bound, ecosystem).cast(key).alias("high"),
            (e["fixed"].isNull() & e["last_affected"].isNotNull()).alias("inclusive"),
        )

    def by_range(current):
        def event(acc, e):
            after = acc["zero"] | (current >= acc["key"])
            before = F.when(e["inclusive"], current <= e["high"]).otherwise(current < e["high"])
            opened = F.when(e["intro"] == "0", state(empty, yes, yes, text(None))).when(e["low"].isNull(), state(empty, no, no, text("unknown"))).otherwise(state(e["low"], no, yes, text(None)))
            closed = F.when(e["high"].isNull(), state(empty, no, no, text("unknown"))).when(after & before, state(empty, no, no, text("affected"))).otherwise(state(empty, no, no, text(None)))
            return F.when(acc["answer"].isNotNull(), acc).when(e["intro"].isNotNull(), opened).when(~acc["open"] | e["bound"].isNull(), acc).otherwise(closed)

        def one(answer, r):
            end = F.aggregate(F.transform(r["events"], keyed), state(empty, no, no, text(None)), event)
            at_end = let(end, lambda x: F.when(x["answer"].isNotNull(), x["answer"]).when(x["open"] & (x["zero"] | (current >= x["key"])), "affected"))
            return F.coalesce(answer, at_end)

        found = F.aggregate(ordered, text(None), one)
        return F.when(current.isNull(), "unknown").otherwise(F.coalesce(found, F.when(F.size(ordered) == 0, "unknown").otherwise("unaffected")))

    return (
        F.when(installed.isNull() | (F.trim(installed) == ""), "unknown")
        .when(F.array_contains(F.coalesce(listed, F.array().cast("array<string>")), installed), "affected")
        .when(ranges.isNull(), "unknown")
        .otherwise(let(semver_key(installed, ecosystem).cast(key), by_range))
    )
