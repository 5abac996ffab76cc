"""What a service container's configuration says about the class behind a name: aliases, classes, decorators and arguments as a graph with typed edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .code import FILE
from .graph import durable

#: Declared types that are no services.
_PLAIN = ("array", "string", "int", "float", "bool", "callable", "iterable", "mixed", "object", "static", "self")
_CLASS = r"^\\?[A-Z]\w*(?:\\[A-Z]\w*)*$"


def _short(name: Column) -> Column:
    return F.element_at(F.split(name, r"\\"), -1)


def services(files: DataFrame) -> DataFrame:
    """project, id, kind, target, name: the ``services`` blocks of YAML files below ``config/``; kind is alias, class, decorates or argument (with its name).

    Entries are the lines of the block's first indent; ids that begin with an underscore are settings. Of an id's several lines of one kind the last file and line count.
    """
    rows = files.where(F.col("path").rlike(r"(?:^|/)config/.*\.ya?ml$") & F.col("text").isNotNull()).select(*FILE, F.posexplode(F.split("text", r"\r?\n")).alias("line", "raw"))
    rows = rows.where(~F.col("raw").rlike(r"^\s*(?:#.*)?$")).withColumn("indent", F.length(F.regexp_extract("raw", "^( *)", 1)))
    so_far = Window.partitionBy(*FILE).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    top = F.last(F.when(F.col("indent") == 0, F.regexp_extract("raw", r"^([^:\s]+)\s*:", 1)), ignorenulls=True).over(so_far)
    inside = rows.withColumn("top", top).where("top = 'services' and indent > 0")
    least = inside.withColumn("first", F.min("indent").over(Window.partitionBy(*FILE)))
    key = F.regexp_extract("raw", r"""^\s*['"]?([^'":\s]+(?:::[^'":\s]+)*)['"]?\s*:""", 1)
    value = F.regexp_extract("raw", r"""^\s*[^:]+(?:::[^:]+)*:\s*['"]?([^'"#]*?)['"]?\s*(?:#.*)?$""", 1)
    placed = least.select(*FILE, "line", (F.col("indent") == F.col("first")).alias("is_entry"), key.alias("key"), F.regexp_replace(value, "^@", "").alias("value"), F.startswith(value, F.lit("@")).alias("refers"))
    entry = F.last(F.when(F.col("is_entry"), F.col("key")), ignorenulls=True).over(so_far)
    named = placed.withColumn("id", entry).where("id <> '' and not startswith(id, '_') and value <> ''")
    kind = F.when(F.col("is_entry"), "alias").when(F.col("key").isin("class", "alias", "decorates"), F.col("key")).when(F.startswith("key", F.lit("$")) & F.col("refers"), "argument")
    said = named.withColumns({"kind": kind, "name": F.when(kind == "argument", F.regexp_replace("key", r"^\$", ""))}).where("kind is not null")
    return said.groupBy("project", "id", "kind", "name").agg(F.max_by("value", F.struct("path", "line")).alias("target")).select("project", "id", "kind", "target", "name")


def resolved_services(wiring: DataFrame) -> DataFrame:
    """project, id, class, hops: the class at the end of each id's aliases and classes; null where they run in a loop or end in no class.

    An alias comes before a class of the same id; a class of its own name is an end, an alias of itself a loop. Pointers are doubled until no further id ends, so what is left then runs in loops.
    """
    edge = wiring.where("kind = 'alias' or kind = 'class' and id <> target").groupBy("project", "id").agg(F.min_by("target", "kind").alias("to"))
    ends = wiring.select("project", F.col("target").alias("id")).union(wiring.select("project", "id")).distinct().join(edge, ["project", "id"], "left_anti")
    points = durable(edge.withColumn("hops", F.lit(1).cast("long")))
    left = None
    while True:
        up = points.select("project", F.col("id").alias("to"), F.col("to").alias("_to"), F.col("hops").alias("_hops"))
        points = durable(points.join(up, ["project", "to"], "left").select("project", "id", F.coalesce("_to", "to").alias("to"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"), F.col("_to").isNotNull().alias("moved"))).drop("moved")
        going = points.join(edge.select("project", F.col("id").alias("to")), ["project", "to"], "left_semi").count()
        if going in (0, left):
            break
        left = going
    stuck = points.join(edge.select("project", F.col("id").alias("to")), ["project", "to"], "left_semi").select("project", "id", F.lit(True).alias("stuck"))
    final = points.join(stuck, ["project", "id"], "left")
    class_ = F.when(F.col("stuck").isNull() & F.col("to").rlike(_CLASS), F.col("to"))
    alone = ends.select("project", "id", F.when(F.col("id").rlike(_CLASS), F.col("id")).alias("class"), F.lit(0).cast("long").alias("hops"))
    return final.select("project", "id", class_.alias("class"), F.when(F.col("stuck").isNull(), F.col("hops")).alias("hops")).unionByName(alone)


def property_types(files: DataFrame) -> DataFrame:
    """project, path, owner, property, type: declared types of the properties of PHP classes, by property or by constructor argument, and the class's full name."""
    code = files.where(F.col("path").rlike(r"\.php$") & F.col("text").isNotNull())
    pairs = lambda text, pattern: F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 1).alias("type"), F.regexp_extract_all(text, F.lit(pattern), 2).alias("property"))
    typed = pairs(F.col("text"), r"(?:private|protected|public|readonly)\s+(?:readonly\s+)?\??([\w\\]+)\s+\$(\w+)\b")
    given = pairs(F.regexp_extract("text", r"function\s+__construct\s*\(([^)]*)\)", 1), r"\??([\w\\]+)\s+\$(\w+)\b")
    space, name = F.regexp_extract("text", r"(?m)^\s*namespace\s+([\w\\]+)\s*;", 1), F.regexp_extract("text", r"(?m)^\s*(?:final\s+|abstract\s+)*class\s+(\w+)", 1)
    owner = F.when(name == "", F.lit(None)).when(space != "", F.concat(space, F.lit("\\"), name)).otherwise(name)
    rows = code.select(*FILE, owner.alias("owner"), F.posexplode(F.concat(typed, given)).alias("at", "p")).where(~F.lower("p.type").isin(*_PLAIN))
    return rows.groupBy(*FILE, "owner", F.col("p.property").alias("property")).agg(F.min_by("p.type", "at").alias("type"))


def receivers_by_configuration(sites: DataFrame, files: DataFrame, wiring: DataFrame) -> DataFrame:
    """``sites`` (project, path, line, receiver, class) with found and called: the class that the container puts behind ``$this->property``, and whether it is the one asked for.

    In a decorator's own file the property is the argument that the configuration names, or what it decorates; else it is the class behind its declared type if the
    configuration leads on from there. Loops, unknown properties and types that nothing resolves leave both null: not known, never no.
    """
    ends = resolved_services(wiring).select("project", F.col("id").alias("_id"), F.col("class").alias("_class"))
    property_ = F.regexp_extract("receiver", r"^\$this->(\w+)$", 1)
    asked = sites.withColumn("property", property_).join(property_types(files), [*FILE, "property"], "left")
    arguments = wiring.where("kind = 'argument' and target <> '.inner'").select("project", F.col("id").alias("owner"), F.col("name").alias("property"), F.col("target").alias("argument"))
    decorated = wiring.where("kind = 'decorates'").select("project", F.col("id").alias("owner"), F.col("target").alias("decorates"))
    asked = asked.join(arguments, ["project", "owner", "property"], "left").join(decorated, ["project", "owner"], "left")
    asked = asked.withColumn("_id", F.coalesce("argument", "decorates", "type")).join(ends, ["project", "_id"], "left")
    by_owner = F.coalesce("argument", "decorates").isNotNull()
    found = _short(F.when(by_owner | (F.col("_class") != F.col("type")), F.col("_class")))
    out = asked.withColumn("found", found)
    return out.select(*sites.columns, "found", F.when(F.lower("found") == F.lower("class"), True).alias("called"))
