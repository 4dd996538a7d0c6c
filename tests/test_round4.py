"""Work that grew faster than its input."""

import time

from pyspark.sql import functions as F

from tessera.functions import paths
from tessera.operators import evolution


def test_absent_takes_many_missing_in_the_time_of_a_sort(spark):
    """Looking up what is missing for each element took the square of it: minutes for one record of this size."""
    n = 20_000
    ids = lambda a, b: F.transform(F.sequence(F.lit(a), F.lit(b)), lambda i: F.concat(F.lit("s"), i.cast("string")))
    df = spark.range(1).select(F.concat(ids(1, n), ids(1, n), F.array(F.lit(None).cast("string"))).alias("w"), ids(n - 9, n + 9).alias("t"))
    began = time.monotonic()
    assert df.select(paths.absent(F.col("w"), F.col("t")).alias("n")).first()["n"] == 2 * (n - 10) + 1
    assert time.monotonic() - began < 30


def test_absent_by_widths_and_special_numbers(spark):
    df = spark.createDataFrame([([1, 2, None, 3], [1, 4], [1.0, float("nan"), -0.0]), (None, [1], [2.0, 2.0])], "i array<int>, l array<bigint>, d array<double>")
    found = df.select(paths.absent(F.col("i"), F.col("l")).alias("a"), paths.absent(F.col("l"), F.col("i")).alias("b"), paths.absent(F.col("d"), F.array(F.lit(float("nan")), F.lit(0.0))).alias("c")).collect()
    assert [tuple(r) for r in found] == [(3, 1, 1), (None, 1, 2)]


def test_history_is_read_once_and_spread(spark):
    """Two copies of the steps and a join for names, in as few tasks as packed sizes asked for, held ten times the rows in a task."""
    ddl = "contract_id int, version int, " + evolution.FIELDS
    row = lambda c, v, f, top: (c, v, f, "number", False, None, top, None, None, None)
    fields = spark.createDataFrame([row(c, v, "x", float(v // 2)) for c in range(40) for v in range(4)] + [row(1, 0, "y", None), row(1, 2, "y", None)], ddl)
    history = evolution.field_history(fields, fields.select("contract_id", "version"))
    got = sorted((r["contract_id"], r["version"], r["field_name"], r["change_type"]) for r in history.collect())
    assert got == sorted([(c, 2, "x", "RANGE_WIDENING") for c in range(40)] + [(1, 1, "y", "FIELD_REMOVED_OPTIONAL"), (1, 2, "y", "FIELD_ADDED_OPTIONAL"), (1, 3, "y", "FIELD_REMOVED_OPTIONAL")])
    assert history.rdd.getNumPartitions() >= evolution.TASKS
