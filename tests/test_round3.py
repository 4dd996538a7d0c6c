"""Corrected readings: depth along a node's own path, prefix joins, missing ends, clauses on groups in streams."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import paths, text
from tessera.operators import evolution, lineage
from tessera.plans.contract import Clause, Contract, FieldRule
from tessera.streaming import watch


def test_depth_counts_along_the_own_path(spark):
    """b is reached by a; that d, a subscriber, reaches it too on a longer way doesn't count."""
    edges = spark.createDataFrame([("S", "a", "r"), ("a", "b", "r"), ("S", "d", "r"), ("d", "x", "r"), ("x", "y", "r"), ("y", "b", "r")], "source string, target string, relationship string")
    reached = lineage.traverse(edges, spark.createDataFrame([("S",)], "start string"), paths=True)
    got = {r["node"]: r["depth"] for r in lineage.contamination_depth(reached, spark.createDataFrame([("d",)], "node string")).collect()}
    assert got == {"a": 1, "b": 2, "d": 1, "x": 2, "y": 3}


@pytest.mark.parametrize("how", ["exact", "below", "either"])
def test_prefix_joins(spark, how):
    rng = random.Random(1)
    names = sorted({".".join(rng.choice(["a", "b", "ab", ""]) for _ in range(rng.randint(1, 4))) for _ in range(60)})
    declared = spark.createDataFrame([(i, n) for i, n in enumerate(names[::2])] + [(99, None)], "id long, field string")
    failing = spark.createDataFrame([(n,) for n in names] + [(None,)], "failing string")
    got = evolution.meeting(declared, failing, how=how)
    want = declared.join(failing, text.path_matches(F.col("failing"), F.col("field"), how))
    assert sorted(map(tuple, got.select("id", "failing").collect())) == sorted(map(tuple, want.select("id", "failing").collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_absent(spark):
    rows = [(["a", "b", None, "z", "z"], ["a", "b", "a"], 3), ([], ["a"], 0), (["a"], None, 1), (["a", "a"], ["a"], 0)]
    df = spark.createDataFrame([r[:2] for r in rows], "w array<string>, t array<string>")
    assert [r[0] for r in df.select(paths.absent(F.col("w"), F.col("t"))).collect()] == [r[2] for r in rows]


def test_sequences_in_closed_form(spark):
    rng = random.Random(2)
    groups = [[1, 2, 3], [2, 1], [1, 1, 3], [1, 2, 2], [1, 3, 3, 4], [2, 3], [0, 1], [1], [1, 2, 3, 4, 4, 6], list(range(1, 2000))] + [[rng.randint(1, 4) for _ in range(4)] for _ in range(60)]
    df = spark.createDataFrame([(g, n) for g, x in enumerate(groups) for n in x], "g int, n int")
    got = {r["g"]: r["broken"] for r in watch.sequences(df, ["g"], "n").collect()}
    assert got == {g: sorted(x) != list(range(1, len(x) + 1)) for g, x in enumerate(groups)}


def test_watch_refuses_clauses_on_groups_and_overwrites_batches(spark, tmp_path):
    c = Contract("t", clauses=[Clause("seq", {"type": "group_monotonic", "group_by": ["g"], "field": "n"})])
    schema = spark.createDataFrame([], "id int").schema
    with pytest.raises(ValueError, match="seq"):
        watch.watch(spark, f"{tmp_path}/in", schema, c, f"{tmp_path}/out", f"{tmp_path}/ckpt")
    spark.createDataFrame([(1,), (None,)], "id int").write.parquet(f"{tmp_path}/in/a")
    c = Contract("t", fields={"id": FieldRule(required=True)})
    for ckpt in ("one", "two"):  # the second stream plays batch 0 again
        watch.watch(spark, f"{tmp_path}/in/a", schema, c, f"{tmp_path}/out", f"{tmp_path}/{ckpt}").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1 and watch.latest_results(spark, f"{tmp_path}/out").first()["batch"] == 0


def test_history_reports_and_failure_modes(spark):
    ddl = "contract_id string, version int, field string, type string, required boolean, minimum double, maximum double, enum array<string>, low double, high double"
    row = lambda c, v, f, kind="string", required=False: (c, v, f, kind, required, None, None, None, None, None)
    fields = spark.createDataFrame([row("a", 1, "x.y"), row("a", 2, "x.y", "integer"), row("a", 2, "z"), row("b", 1, "x"), row("c", 1, "k"), row("c", 3, "k"), row("d", 1, "gone", required=True)], ddl)
    snapshots = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 1), ("c", 2), ("c", 3), ("d", 1), ("d", 2)], "contract_id string, version int")
    history = evolution.field_history(fields, snapshots)
    got = {(r["contract_id"], r["version"], r["field_name"], r["change_type"]) for r in history.collect()}
    assert got == {("a", 2, "x.y", "TYPE_CHANGE"), ("a", 2, "z", "FIELD_ADDED_OPTIONAL"), ("c", 2, "k", "FIELD_REMOVED_OPTIONAL"), ("c", 3, "k", "FIELD_ADDED_OPTIONAL"), ("d", 2, "gone", "FIELD_REMOVED_REQUIRED")}
    reports = {r["contract_id"]: tuple(r)[1:] for r in evolution.history_reports(history, snapshots).collect()}
    assert reports == {"a": ("OK", "breaking", 2, True), "b": ("INSUFFICIENT_SNAPSHOTS", None, 0, False), "c": ("OK", "backward", 1, False), "d": ("OK", "breaking", 1, True)}
    subs = spark.createDataFrame([("a", "p", "x", None), ("a", "q", "z", None), ("b", "p", "x", None), ("d", "p", "gone", "it joins on it"), ("a", "p", "x.y", None)], "contract_id string, subscriber_id string, field string, reason string")
    hops = spark.createDataFrame([("a", "p", 2)], "contract_id string, subscriber_id string, hops int")
    modes = {(r["contract_id"], r["subscriber_id"]): (r["fields"], r["failure_mode"], r["hops"]) for r in evolution.failure_modes(history, snapshots, subs, hops).collect()}
    assert modes == {("a", "p"): ("x,x.y", "Consumer may fail on x, x.y.", 2), ("d", "p"): ("gone", "it joins on it", 0)}
