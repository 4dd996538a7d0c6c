"""Record adapters: rewrites of columns, nested or in arrays, without copying records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import leading_version


def _rewrite(col: Column, kind: T.DataType, parts: list[str], f: Callable[[Column, T.DataType], Column]) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: _rewrite(x, kind.elementType, parts, f))
    if not parts:
        return f(col, kind)
    if isinstance(kind, T.StructType) and parts[0] in kind.names:
        return F.when(col.isNotNull(), col.withField(parts[0], _rewrite(col[parts[0]], kind[parts[0]].dataType, parts[1:], f)))
    return col


def map_path(df: DataFrame, path: str, f: Callable[[Column, T.DataType], Column]) -> DataFrame:
    """``df`` with every value of a path replaced by f(value, type); unchanged if there is no such path."""
    head, *rest = path.split(".")
    if head not in df.columns:
        return df
    return df.withColumn(head, _rewrite(df[head], df.schema[head].dataType, rest, f))


def _in_parent(df: DataFrame, path: str, f: Callable[[Column, T.StructType], Column]) -> DataFrame:
    parent = path.rpartition(".")[0]
    return map_path(df, parent, lambda c, k: f(c, k) if isinstance(k, T.StructType) else c)


def rename(df: DataFrame, old: str, new: str) -> DataFrame:
    """Rename within one parent; skipped if the target exists or the source doesn't."""
    a, b = old.rpartition(".")[2], new.rpartition(".")[2]
    if "." not in old:
        return df.withColumnRenamed(a, b) if a in df.columns and b not in df.columns else df
    return _in_parent(df, old, lambda c, k: c.withField(b, c[a]).dropFields(a) if a in k.names and b not in k.names else c)


def scale(df: DataFrame, path: str, factor: float, only: Callable[[Column], Column] | None = None) -> DataFrame:
    """Multiply numbers (where ``only`` holds) and round to six places."""
    def f(c: Column, k: T.DataType) -> Column:
        if not isinstance(k, T.NumericType):
            return c
        x = F.round(c.cast("double") * factor, 6)
        return x if only is None else F.when(only(c), x).otherwise(c.cast("double"))

    return map_path(df, path, f)


def default(df: DataFrame, path: str, value: object) -> DataFrame:
    """Set absent values. Typed data can't tell absent from null, so nulls are set too."""
    head, _, leaf = path.rpartition(".")
    if not head:
        return df.withColumn(leaf, F.coalesce(df[leaf], F.lit(value)) if leaf in df.columns else F.lit(value))
    return _in_parent(df, path, lambda c, k: c.withField(leaf, F.coalesce(c[leaf], F.lit(value)) if leaf in k.names else F.lit(value)))


def set_value(df: DataFrame, path: str, value: object) -> DataFrame:
    head, _, leaf = path.rpartition(".")
    return df.withColumn(leaf, F.lit(value)) if not head else _in_parent(df, path, lambda c, _: c.withField(leaf, F.lit(value)))


def remove(df: DataFrame, path: str) -> DataFrame:
    head, _, leaf = path.rpartition(".")
    return df.drop(leaf) if not head else _in_parent(df, path, lambda c, k: c.dropFields(leaf) if leaf in k.names and len(k.names) > 1 else c)


def coerce(df: DataFrame, path: str, to: str) -> DataFrame:
    """Cast to integer, number, string or boolean. A typed column can't keep a value that fails, so it becomes null."""
    def f(c: Column, k: T.DataType) -> Column:
        if to == "boolean":
            return F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes")
        if to == "integer":
            return F.floor(F.abs(c.try_cast("double"))).cast("long") * F.when(c.try_cast("double") < 0, -1).otherwise(1)
        return c.try_cast("double") if to == "number" else c.cast("string")

    return map_path(df, path, f)


def enum_replace(df: DataFrame, path: str, old: list[str], new: str) -> DataFrame:
    return map_path(df, path, lambda c, _: F.when(c.cast("string").isin([str(x) for x in old]), F.lit(new)).otherwise(c.cast("string")))


def version_normalize(df: DataFrame, path: str, segments: int = 2) -> DataFrame:
    return map_path(df, path, lambda c, _: leading_version(c.cast("string"), segments))


def majority_version(df: DataFrame, column: str = "schema_version") -> DataFrame:
    """(version, n): the most frequent version, the smallest of several."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("version")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "version").limit(1)


def apply_rule(df: DataFrame, rule: dict) -> DataFrame:
    """One adapter rule; optional_field changes nothing, and so does a rule of no known type."""
    kind, field = rule["type"], rule.get("field", rule.get("from"))
    if kind in ("field_rename", "alias"):
        return rename(df, rule["from"], rule["to"])
    if kind == "numeric_scaling":
        return scale(df, field, float(rule["factor"]), rule.get("only"))
    if kind == "default_value":
        return default(df, field, rule["value"])
    if kind == "set_value":
        return set_value(df, field, rule["value"])
    if kind == "remove_field":
        return remove(df, field)
    if kind == "type_coercion":
        return coerce(df, field, rule["to"])
    if kind == "enum_replace":
        return enum_replace(df, field, rule["values"], rule["value"])
    return version_normalize(df, field, rule.get("segments", 2)) if kind == "version_normalize" else df


def apply_rules(df: DataFrame, rules: list[dict]) -> DataFrame:
    """Rules in order, each once: one that repeats another is left out."""
    seen: list[dict] = []
    for rule in rules:
        if rule not in seen:
            seen.append(rule)
            df = apply_rule(df, rule)
    return df
