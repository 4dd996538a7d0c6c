"""Raw JSON lines as observations, where absent and null, and the kinds of single values, must be told apart."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "path string, kind string, sval string, dval double, counted boolean"


def _kind(v: object) -> str:
    if v is None:
        return "null"
    for kind, of in (("bool", bool), ("int", int), ("float", float), ("str", str), ("arr", list)):
        if isinstance(v, of):
            return kind
    return "obj"


def _values(path: str, v: object) -> Iterator[tuple[str, str, str | None, float | None, bool]]:
    """(path, kind, text, number, whether it counts as a sighting of the path) of all that a value holds."""
    if isinstance(v, dict):
        for k, x in v.items():
            yield from _values(f"{path}.{k}" if path else k, x)
    elif isinstance(v, list) and v and all(isinstance(x, dict) for x in v):
        yield path, "none", None, None, True  # the array was seen, its elements speak for themselves
        for x in v:
            yield from _values(path, x)
    elif isinstance(v, list):
        for i, x in enumerate(v or [None]):
            yield _one(path, x, i == 0)
    else:
        yield _one(path, v, True)


def _one(path: str, v: object, counted: bool) -> tuple[str, str, str | None, float | None, bool]:
    text = None if v is None else v if isinstance(v, str) else json.dumps(v, sort_keys=True)
    return path, _kind(v), text, float(v) if isinstance(v, (bool, int, float)) else None, counted


def observations(lines: DataFrame, column: str = "value", tolerant: bool = False) -> DataFrame:
    """A row for each value of each dotted path of JSON objects; arrays of objects are unnested.

    Null and blank lines have none. A malformed line fails, or has none if ``tolerant``.
    """
    good = lines.where(F.try_parse_json(column).isNotNull()) if tolerant else lines

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for line in batch[column] if line and line.strip() for r in _values("", json.loads(line)) if r[0]]
            yield pd.DataFrame(rows, columns=["path", "kind", "sval", "dval", "counted"])

    return good.select(column).mapInPandas(read, SCHEMA)


def profile(obs: DataFrame) -> DataFrame:
    """(path, type, seen, observed, nulls, cardinality): types are boolean, integer, number or else string."""
    value, counted = F.col("kind") != "none", F.col("counted")
    some = value & (F.col("kind") != "null")
    every = lambda *k: F.bool_and(F.when(some, F.col("kind").isin(*k)))
    kind = F.when(every("bool"), "boolean").when(every("int"), "integer").when(every("int", "float"), "number").otherwise("string")
    rendered = F.when(some, F.concat_ws(":", F.when(F.col("kind") == "str", "s").otherwise("v"), F.col("sval")))
    out = obs.groupBy("path").agg(kind.alias("type"), F.count_if(counted).alias("seen"), F.count_if(some).alias("observed"), F.count_if(value & (F.col("kind") == "null")).alias("nulls"), F.count_distinct(rendered).alias("cardinality"))
    return out.where("observed + nulls > 0")
