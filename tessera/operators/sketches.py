"""Profiles that add up: distinct counts (HyperLogLog) and quantiles (KLL) as sketches, kept by day and merged over days.

Profiling reads a table once, in one aggregation over all columns, and leaves a row of a few tens of KB for each column (and
group). Merging reads such rows only, so a baseline over a year never scans its data again. Counts, nulls, least and
greatest values are exact; a distinct count is within about 1 % (2 % with near certainty), the rank of a quantile
within about half a percent of the rows. Quantile sketches toss coins: two of the same rows differ within that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.records import exists

LOG_REGISTERS, ITEMS = 14, 1024
WARN, FAIL = 0.1, 0.25
PROBABILITIES = (0.05, 0.25, 0.5, 0.75, 0.95)
_ROW = ["path", "n", "nulls", "minimum", "maximum", "distinct_sketch", "quantile_sketch"]


def _number(c: Column, kind: T.DataType) -> Column:
    """The value as a double, if it is a number; NaN isn't one."""
    if not isinstance(kind, T.NumericType):
        return F.lit(None).cast("double")
    x = c.cast("double")
    return F.when(~F.isnan(x), x)


def sketched(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., path, n, nulls, minimum, maximum, distinct_sketch, quantile_sketch) of top-level columns.

    n counts the rows. Null and NaN count as nulls; minimum, maximum and quantiles are of numbers only, null for other
    types and for columns without any number. Values are told apart by their text. An empty table gives no rows if it is grouped,
    else rows of zeros. Repeated rows count each.
    """
    def row(name: str) -> Column:
        c, kind = F.col(f"`{name}`"), df.schema[name].dataType
        x = _number(c, kind)
        known = x if isinstance(kind, (T.DoubleType, T.FloatType)) else c
        # 0.0 and -0.0 are the same number.
        value = F.when(known == 0, F.lit(0.0)).otherwise(known) if isinstance(kind, (T.DoubleType, T.FloatType)) else known
        text = value.cast("string") if isinstance(kind, T.AtomicType) else F.to_json(F.struct(value.alias("v")))
        quantiles = F.kll_sketch_agg_double(x, ITEMS) if isinstance(kind, T.NumericType) else F.lit(None).cast("binary")
        return F.struct(F.lit(name).alias("path"), F.count("*").alias("n"), F.count_if(known.isNull()).alias("nulls"), F.min(x).alias("minimum"), F.max(x).alias("maximum"), F.hll_sketch_agg(F.when(known.isNotNull(), text), LOG_REGISTERS).alias("distinct_sketch"), quantiles.alias("quantile_sketch"))

    out = df.groupBy(*by).agg(F.array(*[row(c) for c in columns]).alias("__rows"))
    return out.select(*by, F.explode("__rows").alias("__r")).select(*by, *[f"__r.{c}" for c in _ROW])


def merged(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches of the union of what the parts were made of, by path and further columns."""
    return parts.groupBy(*by, "path").agg(
        F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.min("minimum").alias("minimum"), F.max("maximum").alias("maximum"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"),
    )


def estimates(parts: DataFrame, probabilities: Sequence[float] = PROBABILITIES) -> DataFrame:
    """The same rows with ``distinct_count`` and ``quantiles`` (null without numbers) in place of the sketches."""
    some = F.col("minimum").isNotNull()
    q = F.when(some, F.kll_sketch_get_quantile_double(F.when(some, F.col("quantile_sketch")), F.array(*[F.lit(float(p)) for p in probabilities])))
    keep = [c for c in parts.columns if not c.endswith("_sketch")]
    return parts.select(*keep, F.hll_sketch_estimate("distinct_sketch").alias("distinct_count"), q.alias("quantiles"))


def keep_day(parts: DataFrame, folder: str, day: str) -> None:
    """Keep a day's sketches; those of a day that is run again are replaced."""
    parts.write.mode("overwrite").parquet(f"{folder}/day={day}")


def days(spark: SparkSession, folder: str, since: str = "", until: str = "") -> DataFrame | None:
    """Kept sketches with their ``day``, from ``since`` to before ``until``; only those days' files are read. None if nothing is kept."""
    if not exists(spark, folder):
        return None
    kept = spark.read.parquet(folder).withColumn("day", F.col("day").cast("string"))
    kept = kept.where(F.col("day") >= since) if since else kept
    return kept.where(F.col("day") < until) if until else kept


def drift(current: DataFrame, baseline: DataFrame | None, probabilities: Sequence[float] = PROBABILITIES, warn: float = WARN, fail: float = FAIL) -> DataFrame:
    """(path, status, shift, null_change, distinct_ratio): how far current sketches have moved from the baseline's.

    The shift is the greatest move of a quantile, in spans between the baseline's outer quantiles (a span of none: any move
    counts as 1). WARN above ``warn``, FAIL above ``fail``, of the shift or of the change in the share of nulls; BASELINE_SET
    for a column that the baseline doesn't have, GONE for one that is no more.
    """
    now = estimates(merged(current), probabilities)
    before = estimates(merged(baseline if baseline is not None else current.limit(0)), probabilities)
    j = now.alias("a").join(before.alias("b"), "path", "full_outer")
    a, b = F.col("a.quantiles"), F.col("b.quantiles")
    span = F.element_at(b, -1) - F.element_at(b, 1)
    move = F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    shift = F.when(a.isNotNull() & b.isNotNull(), F.when(span > 0, move / span).otherwise((move > 0).cast("double"))).otherwise(F.lit(0.0))
    share = lambda s: F.coalesce(F.try_divide(F.col(f"{s}.nulls"), F.col(f"{s}.n")), F.lit(0.0))
    j = j.select("path", F.col("a.n").alias("now"), F.col("b.n").alias("was"), shift.alias("shift"), (share("a") - share("b")).alias("null_change"), F.try_divide(F.col("a.distinct_count"), F.col("b.distinct_count")).alias("distinct_ratio"))
    worst = F.greatest("shift", F.abs("null_change"))
    status = F.when(F.col("was").isNull(), "BASELINE_SET").when(F.col("now").isNull(), "GONE").when(worst > fail, "FAIL").when(worst > warn, "WARN").otherwise("PASS")
    both = F.col("now").isNotNull() & F.col("was").isNotNull()
    return j.select("path", status.alias("status"), *[F.when(both, F.col(c)).alias(c) for c in ("shift", "null_change", "distinct_ratio")])
