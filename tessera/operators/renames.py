"""Which added field each removed field has become, for any number of contracts at once.

Fields fit within a contract and a shape (type, format, pattern). Where the removed and added ones of such a group make few
pairs, as in most contracts, the group is one row and an executor matches it in the order of its removed fields. Elsewhere
pairs that could score enough are found by three equi-joins: the same leaf, a common token, or a common element among the rarest of a name's characters. None is missed: two names that share
neither leaf nor token must have matching blocks over more than half of their characters, so the rarest elements of each
(all but the share that the overlap needs, and one) meet. Executors score the pairs, which are then matched one to one in
rounds, which give what taking the removed fields in their order would: a field takes its best open partner as soon as
no field before it has that partner among its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import tokens
from tessera.operators.evolution import RENAME_LEAST, similarity, similarity_bound
from tessera.sources.shared import kept

_SHAPE = ("type", "format", "pattern")
#: Pairs of a group that is matched as one row.
DIRECT = 4096


def _elements(df: DataFrame) -> DataFrame:
    """A name's keys: its leaf, its tokens, and as many of its rarest characters, repeats numbered, as an overlap can't spare."""
    chars = F.split("field", "")
    numbered = F.transform(chars, lambda c, i: F.struct((-F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x == c))).alias("n"), c.alias("c")))
    # A ratio of t needs t / (2 - t) of either name's characters in common.
    spare = F.size(chars) - F.ceil(F.size(chars) * (RENAME_LEAST / (2 - RENAME_LEAST))) + 1
    rarest = F.slice(F.array_sort(numbered), F.lit(1), spare.cast("int"))
    leaf = F.concat(F.lit("l"), F.substring_index("field", ".", -1))
    keys = F.concat(F.array(leaf), F.transform(tokens(F.col("field"), 2), lambda t: F.concat(F.lit("t"), t)), F.transform(rarest, lambda e: F.concat(F.lit("c"), e["c"], e["n"].cast("string"))))
    return df.withColumn("__key", F.explode(F.array_distinct(keys)))


def _whole(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    for name in (*_SHAPE, "enum", "position"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast({"enum": "array<string>", "position": "long"}.get(name, "string")))
    return df.where(F.col("field").isNotNull()).dropDuplicates([*keys, "field"]).select(*keys, "field", *_SHAPE, "enum", "position")


def scored(removed: DataFrame, added: DataFrame, keys: Sequence[str] = ("contract_id",)) -> DataFrame:
    """(keys..., old_field, new_field, position, score): every pair of a removed and an added field of a contract that fit and
    score at least ``RENAME_LEAST``. Tables: keys, field, and where known type, format, pattern, enum and position."""
    a, b = (_elements(_whole(x, keys)) for x in (removed, added))
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*keys, *_SHAPE, "__key")]
    many = lambda s: F.size(F.coalesce(F.col(f"{s}.enum"), F.array().cast("array<string>"))) > 0
    same = (F.size(F.array_except("a.enum", "b.enum")) == 0) & (F.size(F.array_except("b.enum", "a.enum")) == 0)
    met = a.alias("a").join(b.alias("b"), on).where(~many("a") | ~many("b") | same)
    pairs = met.select(*[f"a.{k}" for k in keys], F.col("a.field").alias("old_field"), F.col("b.field").alias("new_field"), F.col("a.position").alias("position")).distinct()

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for old, new in batches:
            yield pd.Series([similarity(x, y) for x, y in zip(old, new, strict=True)], dtype="float64")

    return pairs.withColumn("score", score("old_field", "new_field")).where(F.col("score") >= RENAME_LEAST)


def _in_order(old: Iterable[tuple[str, str | None]], new: Iterable[tuple[str, str | None]]) -> list[tuple[str, str, float]]:
    """(old, new, score) of one group, removed fields in their order; fields are (name, enumeration)."""
    open_, out = dict(new), []
    for name, enum in old:
        best = (0.0, "")
        for bound, other in sorted((-similarity_bound(name, n), n) for n, e in open_.items() if enum is None or e is None or enum == e):
            if (bound, other) > best or -bound < RENAME_LEAST:  # so are all that follow
                break
            best = min(best, (-similarity(name, other), other))
        if -best[0] >= RENAME_LEAST:
            out.append((name, best[1], -best[0]))
            del open_[best[1]]
    return out


def _matched_by_row(a: DataFrame, b: DataFrame) -> DataFrame:
    """(__group, old_field, new_field, score) of groups that are small enough to be a row."""
    enum = F.when(F.size("enum") > 0, F.to_json(F.sort_array(F.array_distinct("enum"))))
    first = F.struct(F.coalesce("position", F.lit(0)).alias("p"), "field", enum.alias("enum"))
    rows = lambda df, name: df.groupBy("__group").agg(F.sort_array(F.collect_list(first)).alias(name))

    @F.pandas_udf("array<struct<old_field string, new_field string, score double>>")
    def match(old: pd.Series, old_enum: pd.Series, new: pd.Series, new_enum: pd.Series) -> pd.Series:
        found = (_in_order(zip(a, x, strict=True), zip(b, y, strict=True)) for a, x, b, y in zip(old, old_enum, new, new_enum, strict=True))
        return pd.Series([[{"old_field": o, "new_field": n, "score": s} for o, n, s in f] for f in found], dtype="object")

    pairs = rows(a, "old").join(rows(b, "new"), "__group").select("__group", match("old.field", "old.enum", "new.field", "new.enum").alias("found"))
    return pairs.select("__group", F.inline("found"))


def matched(removed: DataFrame, added: DataFrame, keys: Sequence[str] = ("contract_id",), direct: int = DIRECT) -> DataFrame:
    """(keys..., old_field, new_field, score): the pairs, each field in one at most.

    Removed fields choose in the order of position (where it is null or equal, of name), each the highest score, then the
    least name. Null names take no part; repeated rows count once; empty tables give none. Fields of a contract and shape
    that make at most ``direct`` pairs are matched as one row, others by joins, in rounds.
    """
    # Structs of nulls are equal, so one join serves shapes that lack a format or pattern.
    a, b = (_whole(x, keys).withColumn("__group", F.struct(*keys, *_SHAPE)) for x in (removed, added))
    size = lambda df, name: df.groupBy("__group").agg(F.count("*").alias(name))
    large = kept(size(a, "m").join(size(b, "n"), "__group").where(F.col("m") * F.col("n") > direct).select("__group"))
    columns = [*keys, "old_field", "new_field", "score"]
    own = lambda df: df.select(*[F.col("__group")[k].alias(k) for k in keys], "old_field", "new_field", "score")
    if large.isEmpty():
        return own(_matched_by_row(a, b))
    few, many = ([x.join(large, "__group", how) for x in (a, b)] for how in ("left_anti", "left_semi"))
    return own(_matched_by_row(*few)).unionByName(_matched_in_rounds(*[x.drop("__group") for x in many], keys).select(*columns))


def _matched_in_rounds(removed: DataFrame, added: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``matched`` for groups of any size."""
    open_ = kept(scored(removed, added, keys))
    first = F.struct(F.coalesce("position", F.lit(0)).alias("p"), F.col("old_field").alias("f"))
    done = []
    while not open_.isEmpty():
        best = Window.partitionBy(*keys, "old_field").orderBy(F.desc("score"), "new_field")
        ranked = open_.withColumns({"__best": F.row_number().over(best), "__first": F.min(first).over(Window.partitionBy(*keys, "new_field"))})
        settled = kept(ranked.where((F.col("__best") == 1) & (F.col("__first") == first)).select(*keys, "old_field", "new_field", "score"))
        done.append(settled)
        for side in ("old_field", "new_field"):
            s = settled.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(side).alias("__side"))
            open_ = open_.join(s, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col(side) == F.col("__side")], "left_anti")
        open_ = kept(open_)
    if not done:
        return open_.select(*keys, "old_field", "new_field", "score")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
