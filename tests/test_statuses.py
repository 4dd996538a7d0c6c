"""States of watched datasets over micro-batches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.streaming import status
from tessera.streaming.status import latest_statuses, statuses

START = datetime(2024, 1, 1)
DDL = "dataset string, at timestamp, n long, event string, signature string, detail string"


def _run(spark, where, batches, **options):
    for rows in batches:
        at = [(d, START + timedelta(minutes=m) if m is not None else None, i, e, s, t) for i, (d, m, e, s, t) in enumerate(rows)]
        spark.createDataFrame(at, DDL).coalesce(1).write.mode("append").parquet(f"{where}/in")
    stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{where}/out/batch={number}")
    statuses(stream, **options).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{where}/progress").trigger(availableNow=True).start().awaitTermination()
    out = latest_statuses(spark.read.parquet(f"{where}/out")).withColumn("minute", ((F.unix_micros("last_completed_at") - F.unix_micros(F.lit(START))) / 60_000_000).cast("int"))
    return {r["dataset"]: (r["status"], r["busy"], r["validation_count"], r["last_reason"], r["last_error"], r["minute"]) for r in out.collect()}


@pytest.mark.parametrize("cut", [1, 2])
def test_states(spark, tmp_path, cut):
    rows = [
        ("idle", 0, "scan", "s", None), ("idle", 5, "scan", "s", None), ("idle", 6, "scan", None, None), ("stale", 0, "scan", "s", None), ("stale", 9, "scan", "t", None),
        ("busy", 0, "scan", "s", None), ("busy", 11, "start", None, "asked"), ("ok", 1, "start", None, "first"), ("ok", 12, "done", None, None), ("ok", 13, "scan", "s", None),
        ("bad", 1, "start", None, "first"), ("bad", 12, "error", None, "boom"), ("again", 1, "error", None, "boom"), ("again", 2, "start", None, "second"), ("again", 13, "done", None, None), ("again", 14, "scan", "s", None),
        (None, 1, "done", None, None), ("none", None, "done", None, None), ("odd", 1, "nothing", None, None), ("ok", 12, "done", None, None),
    ]
    batches = [rows] if cut == 1 else [[r for r in rows if r[1] is None or r[1] < 10], [r for r in rows if r[1] is not None and r[1] >= 10]]
    got = _run(spark, tmp_path, batches)
    assert got == {
        "idle": ("idle", False, 0, None, None, None), "stale": ("stale", False, 0, "outputs_changed", None, None), "busy": ("validating", True, 0, "asked", None, None),
        "ok": ("watching", False, 2, "first", None, 12), "bad": ("error", False, 0, "first", "boom", 12), "again": ("watching", False, 1, "second", None, 13),
    }


def test_timers(spark, tmp_path):
    """A validation that ends is none, one that another dataset's time or a later event of its own passes is in error."""
    first = [("lost", 0, "start", None, "asked"), ("told", 0, "start", None, "asked"), ("ended", 0, "start", None, "asked"), ("late", 0, "start", None, "asked"), ("fresh", 0, "scan", "s", None)]
    second = [("ended", 20, "done", None, None), ("told", 40, "scan", "s", None), ("late", 50, "done", None, None), ("fresh", 60, "start", None, "asked")]
    got = _run(spark, tmp_path, [first, second], limit=1800)
    error = ("error", False, 0, "asked", "no outcome in time", 30)
    assert got == {"lost": error, "told": error, "ended": ("watching", False, 1, "asked", None, 20), "late": ("watching", False, 1, "asked", "no outcome in time", 50), "fresh": ("validating", True, 0, "asked", None, None)}


@pytest.mark.parametrize("shares", [1, 4])
def test_datasets_that_share_a_state(spark, tmp_path, shares):
    """Each dataset goes its own way; before, each had a call and a state of its own, which took more than its events."""
    rng = random.Random(15)
    rows = [(f"d{rng.randint(1, 25)}", m, rng.choice(["scan", "scan", "start", "done", "error"]), rng.choice(["s", "t", None]), rng.choice(["x", None])) for m in range(300)]
    fresh = lambda: dict.fromkeys(status._NAMES) | {"status": "idle", "validation_count": 0}
    want = {}
    for d, m, event, signature, detail in rows:
        status._step(want.setdefault(d, fresh()), m * 60_000_000, event, signature, detail, 1_800_000_000)
    for s in want.values():
        status._expire(s, 299 * 60_000_000)
    got = _run(spark, tmp_path, [rows[:140], rows[140:]], limit=1800, shares=shares)
    minute = lambda us: None if us is None else us // 60_000_000
    assert got == {d: (s["status"], s["status"] == "validating", s["validation_count"], s["last_reason"], s["last_error"], minute(s["last_completed_us"])) for d, s in want.items()}
