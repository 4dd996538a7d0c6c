"""JSON values as VARIANT columns: kinds, values and children, in which absent and null stay apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What one value of a path is: its kind (none for an array of objects, which speak for themselves), its text, its number
#: if it is one, and whether it counts as a sighting of the path.
OBSERVATION = "struct<kind:string,text:string,number:double,counted:boolean>"


def kind(v: Column) -> Column:
    """null, bool, int, float, str, arr or obj; null where the value is absent. Whole decimals beyond 64 bits are ints."""
    name = F.schema_of_variant(v)
    big = name.rlike(r"^DECIMAL\((?:19|2\d|3\d),0\)$")
    out = F.when(name == "VOID", "null").when(name == "BOOLEAN", "bool").when((name == "BIGINT") | big, "int").when(name == "STRING", "str")
    return out.when(name.startswith("OBJECT"), "obj").when(name.startswith("ARRAY"), "arr").when(name.isNotNull(), "float")


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def items(v: Column) -> Column:
    """The elements of an array; null if it is none."""
    return F.try_variant_get(v, "$", "array<variant>")


def entries(v: Column) -> Column:
    """The members of an object, as an array of (key, value); null if it is none."""
    return F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))


def child(v: Column, key: str) -> Column:
    """The member of that name; null if it is absent, and a variant of null if it is null."""
    quote = '"' if "'" in key else "'"
    return F.try_variant_get(v, f"$[{quote}{key}{quote}]", "variant")


def text(v: Column) -> Column:
    """Strings as they are, anything else as JSON; null for null."""
    name = F.schema_of_variant(v)
    return F.when(name == "STRING", F.try_variant_get(v, "$", "string")).when(name != "VOID", F.to_json(v))


def number(v: Column) -> Column:
    """Numbers and truth values as a double; null for all else, texts that look like numbers included."""
    return F.when(kind(v).isin("int", "float", "bool"), F.try_variant_get(v, "$", "double"))


def _objects(v: Column) -> Column:
    """The object itself, or the elements of an array of nothing but objects; else none."""
    none, many = F.array().cast("array<variant>"), items(v)
    return F.when(is_object(v), F.array(v)).when((F.size(many) > 0) & F.forall(many, is_object), many).otherwise(none)


def _one(v: Column, counted: Column) -> Column:
    return F.struct(kind(v).alias("kind"), text(v).alias("text"), number(v).alias("number"), counted.alias("counted"))


def _leaf(v: Column) -> Column:
    none, many, yes = F.array().cast(f"array<{OBSERVATION}>"), items(v), F.lit(True)
    said = lambda kind: F.array(F.struct(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("number"), yes.alias("counted")))
    listed = F.when(F.size(many) == 0, said("null")).when(F.forall(many, is_object), said("none")).otherwise(F.transform(many, lambda x, i: _one(x, i == 0)))
    return F.when(v.isNull() | is_object(v), none).when(many.isNotNull(), listed).otherwise(F.array(_one(v, yes)))


def observed(v: Column, path: str) -> Column:
    """All values of a dotted path in a record, as an array of OBSERVATION; arrays of objects on the way are unnested.

    An absent path gives none, a null one of kind null. Of an array, each element is a value and the first counts as a
    sighting, an empty one is a null; an array of objects, or an object, has no value of its own. The work is in
    proportion to the record.
    """

    def down(at: Column, parts: list[str]) -> Column:
        below = child(at, parts[0])
        return _leaf(below) if len(parts) == 1 else F.flatten(F.transform(_objects(below), lambda x: down(x, parts[1:])))

    parts = path.split(".")
    return F.flatten(F.transform(_objects(v), lambda x: down(x, parts)))


def coerced(v: Column, to: str) -> Column:
    """The value as integer, number, boolean or string where it can be one; what can't stays as it is, absent and null too.

    Integers are cut towards zero, truth values count 1 and 0, texts are read as numbers, and true or false in any case.
    """
    x = text(v)
    as_number = F.when(kind(v) == "str", F.trim(x).try_cast("double")).otherwise(number(v))
    fine = as_number.isNotNull() & ~F.isnan(as_number) & (F.abs(as_number) < 2.0**63)
    made: dict[str, Callable[[], Column]] = {
        "integer": lambda: F.when(fine, F.when(as_number < 0, F.ceil(as_number)).otherwise(F.floor(as_number)).cast("long")).cast("variant"),
        "number": lambda: F.when(~F.isnan(as_number), as_number).cast("variant"),
        "boolean": lambda: F.when(F.lower(x) == "true", True).when(F.lower(x) == "false", False).when(number(v).isNotNull(), number(v) != 0).cast("variant"),
        "string": lambda: x.cast("variant"),
    }
    return F.coalesce(made[to](), v)
