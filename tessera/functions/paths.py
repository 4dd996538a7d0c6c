"""Dotted field paths over nested schemas, compiled to columns; arrays on the way are unnested."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def leaf_paths(schema: T.StructType, prefix: str = "") -> list[tuple[str, T.DataType]]:
    """(path, type) of every scalar in the schema; maps are leaves, as their keys are data."""
    out: list[tuple[str, T.DataType]] = []
    for f in schema.fields:
        path, kind = f"{prefix}{f.name}", f.dataType
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        out += leaf_paths(kind, f"{path}.") if isinstance(kind, T.StructType) else [(path, kind)]
    return out


def _walk(col: Column, kind: T.DataType, parts: list[str]) -> tuple[Column, T.DataType] | None:
    """An array of the values below ``col``, nulls kept; an absent parent gives none."""
    if isinstance(kind, T.ArrayType):
        inner = _walk(F.lit(None), kind.elementType, parts)
        if inner is None:
            return None
        each = F.transform(F.coalesce(col, F.array().cast(kind)), lambda x: _walk(x, kind.elementType, parts)[0])
        return F.flatten(each), inner[1]
    if not parts:
        return F.array(col), kind
    if isinstance(kind, T.StructType) and parts[0] in kind.names:
        below = _walk(col[parts[0]], kind[parts[0]].dataType, parts[1:])
        return None if below is None else (F.when(col.isNull(), F.array().cast(T.ArrayType(below[1]))).otherwise(below[0]), below[1])
    return None


def values(schema: T.StructType, path: str) -> tuple[Column, T.DataType] | None:
    """All values of a path in a record, in order, nulls kept; None if the schema has no such path."""
    parts = path.split(".")
    if path in schema.names:
        return _walk(F.col(f"`{path}`"), schema[path].dataType, [])
    return _walk(F.col(f"`{parts[0]}`"), schema[parts[0]].dataType, parts[1:]) if parts[0] in schema.names else None


def scalars(schema: T.StructType, path: str) -> tuple[Column, T.DataType] | None:
    """The non-null values of a path in a record."""
    found = values(schema, path)
    return found and (F.filter(found[0], lambda x: x.isNotNull()), found[1])


def first_scalar(schema: T.StructType, path: str) -> Column:
    """The first non-null value of a path; null if there is none or no such path."""
    found = scalars(schema, path)
    return F.lit(None) if found is None else F.get(found[0], F.lit(0))


def raw(schema: T.StructType, path: str) -> tuple[Column, T.DataType] | None:
    """The column itself where no array lies on the way, for checks of arrays as a whole."""
    col, kind = None, schema
    for part in path.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return None
        col = F.col(f"`{part}`") if col is None else col[part]
        kind = kind[part].dataType
    return col, kind


@dataclass
class Values:
    """The non-null values of a path in a record: the value itself where no array lies on the way, else an array."""

    of: Column
    kind: T.DataType
    flat: bool

    def test(self, bad: Callable[[Column], Column]) -> Column:
        """Whether the record has such a value."""
        return F.coalesce(self.of.isNotNull() & bad(self.of), F.lit(False)) if self.flat else F.exists(self.of, bad)

    def count(self, bad: Callable[[Column], Column] | None = None) -> Column:
        """How many such values the record has; all of them without a test."""
        if self.flat:
            return (self.of.isNotNull() if bad is None else self.test(bad)).cast("int")
        return F.size(self.of if bad is None else F.filter(self.of, bad))

    def total(self, bad: Callable[[Column], Column] | None = None) -> Column:
        """How many such values all records have, an aggregate: a plain conditional count where there is no array."""
        if self.flat:
            return F.count(self.of) if bad is None else F.count_if(self.of.isNotNull() & bad(self.of))
        return F.coalesce(F.sum(self.count(bad).cast("long")), F.lit(0).cast("long"))

    def first(self, bad: Callable[[Column], Column]) -> Column:
        """The record's first such value; null if it has none."""
        return F.when(bad(self.of), self.of) if self.flat else F.get(F.filter(self.of, bad), F.lit(0))

    def map(self, f: Callable[[Column], Column], kind: T.DataType) -> Values:
        return Values(f(self.of) if self.flat else F.transform(self.of, f), kind, self.flat)

    def least(self) -> Column:
        return self.of if self.flat else F.array_min(self.of)

    def greatest(self) -> Column:
        return self.of if self.flat else F.array_max(self.of)


def found(schema: T.StructType, path: str) -> Values | None:
    """The non-null values of a path; None if the schema has no such path."""
    one = (F.col(f"`{path}`"), schema[path].dataType) if path in schema.names else raw(schema, path)
    if one is not None and not isinstance(one[1], (T.ArrayType, T.StructType, T.MapType)):
        return Values(*one, True)
    many = scalars(schema, path)
    return many and Values(*many, False)


def absent(wanted: Column, there: Column) -> Column:
    """How many elements of one array the other doesn't have, nulls and repeats counted. Both are sorted into one, in which
    an element follows its like, so the work is that of a sort however many are missing."""
    tagged = lambda arr, tag: F.transform(arr, lambda x: F.struct(x.alias("v"), F.lit(tag).alias("tag")))
    both = F.sort_array(F.concat(tagged(F.coalesce(there, F.array()), 0), tagged(wanted, 1)))
    # s: the last element that is there, none at first, and how many are missing.
    met = lambda s, x: F.coalesce(s["last"]["v"] == x["v"], F.lit(False))
    step = lambda s, x: F.struct(F.when(x["tag"] == 0, x).otherwise(s["last"]).alias("last"), F.when((x["tag"] == 0) | met(s, x), s["n"]).otherwise(s["n"] + 1).alias("n"))
    start = F.struct(F.when(F.lit(False), F.get(both, F.lit(0))).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(both, start, step, lambda s: s["n"])


def contract_type(kind: T.DataType) -> str:
    """boolean, integer, number or string."""
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "number"
    return "string"
