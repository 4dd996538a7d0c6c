"""Mergeable profiles: parts add up to the whole, estimates near exact ones, days kept and replaced, drift."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import sketches

SCHEMA = "day string, x double, k long, s string, f float, a array<int>, e string"


def rows(n=40000):
    rng = random.Random(9)
    return [(f"2024-01-0{i % 5 + 1}", rng.choice([None, float("nan"), 0.0, -0.0]) if i % 20 == 0 else rng.lognormvariate(0, 1), rng.randrange(9000), f"u{i // 2}", rng.choice([1.5, 2.5]), [i % 7], None) for i in range(n)]


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5)


COLUMNS = ["x", "k", "s", "f", "a", "e"]


def test_parts_add_up(data):
    whole = {r["path"]: r for r in sketches.estimates(sketches.sketched(data, COLUMNS)).collect()}
    parts = sketches.sketched(data, COLUMNS, ["day"])
    assert parts.count() == 5 * len(COLUMNS)
    got = {r["path"]: r for r in sketches.estimates(sketches.merged(parts)).collect()}
    all_rows = rows()
    for i, name in enumerate(COLUMNS, 1):
        values = [r[i] for r in all_rows]
        known = [str(v if v != 0 or name != "x" else 0.0) for v in values if v is not None and not (isinstance(v, float) and math.isnan(v))]
        numbers = np.sort([float(v) for v in values if isinstance(v, (int, float)) and not math.isnan(v)])
        for r in (whole[name], got[name]):
            assert (r["n"], r["nulls"]) == (len(values), len(values) - len(known))
            assert abs(r["distinct_count"] - len(set(known))) <= 0.02 * len(set(known))
            if len(numbers) == 0 or name == "s":
                assert r["minimum"] is r["quantiles"] is None
                continue
            assert (r["minimum"], r["maximum"]) == (numbers[0], numbers[-1])
            for p, q in zip(sketches.PROBABILITIES, r["quantiles"], strict=True):
                low, high = np.searchsorted(numbers, q, "left") / len(numbers), np.searchsorted(numbers, q, "right") / len(numbers)
                assert low - 0.005 <= p <= high + 0.005
        assert whole[name]["distinct_count"] == got[name]["distinct_count"]  # registers don't depend on the parts


def test_empty_tables(spark, data):
    none = spark.createDataFrame([], SCHEMA)
    assert [(r["n"], r["nulls"], r["distinct_count"], r["quantiles"]) for r in sketches.estimates(sketches.sketched(none, COLUMNS)).collect()] == [(0, 0, 0, None)] * len(COLUMNS)
    assert sketches.sketched(none, COLUMNS, ["day"]).count() == 0
    grown = sketches.merged(sketches.sketched(none, COLUMNS).unionByName(sketches.sketched(data, COLUMNS)))
    assert {r["path"]: r["n"] for r in grown.collect()} == dict.fromkeys(COLUMNS, 40000)


def test_days(spark, data, tmp_path):
    folder = f"{tmp_path}/kept"
    assert sketches.days(spark, folder) is None
    for day in ("2024-01-01", "2024-01-02", "2024-01-02", "2024-01-03"):
        sketches.keep_day(sketches.sketched(data.where(F.col("day") == day), ["x", "k"]), folder, day)
    n = lambda *a: {r["path"]: r["n"] for r in sketches.merged(sketches.days(spark, folder, *a)).collect()}
    assert n() == {"x": 24000, "k": 24000} and n("2024-01-02") == {"x": 16000, "k": 16000} and n("2024-01-02", "2024-01-03") == {"x": 8000, "k": 8000}


def test_drift(spark, data):
    base = sketches.sketched(data, ["x", "k", "s", "f"])
    same = sketches.sketched(data.withColumn("s", F.upper("s")), ["x", "k", "s", "f"])
    got = {r["path"]: r for r in sketches.drift(same, base).collect()}
    assert {c: r["status"] for c, r in got.items()} == dict.fromkeys("xksf", "PASS")
    assert all(r["shift"] < 0.03 and r["null_change"] == 0 for r in got.values()) and got["k"]["distinct_ratio"] == 1  # quantile sketches toss coins
    moved = data.select((F.col("x") * 100).alias("x"), (F.col("k") + 1200).alias("k"), F.when(F.col("k") % 2 == 0, F.col("s")).alias("s"), F.lit(1).alias("new"))
    got = {r["path"]: r["status"] for r in sketches.drift(sketches.sketched(moved, ["x", "k", "s", "new"]), base).collect()}
    assert got == {"x": "FAIL", "k": "WARN", "s": "FAIL", "new": "BASELINE_SET", "f": "GONE"}
    assert {r["status"] for r in sketches.drift(base, None).collect()} == {"BASELINE_SET"}
