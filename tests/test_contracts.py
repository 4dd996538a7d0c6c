"""Contract rules on small records, each failing in a known way, and a model of the rules in plain Python."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import paths, text
from tessera.operators import adapter, checks, evolution, ingest, lineage, payloads, profile, reporting, whatif
from tessera.plans.contract import Clause, Contract, FieldRule

SCHEMA = "id string, facts array<struct<text string, confidence double, refs array<string>>>, score int, at string, done string, tags array<string>"
ROWS = [
    ("a", [("x", 0.5, ["e1"]), ("y", 1.5, ["e2", None])], 3, "2024-01-01T00:00:00Z", "2024-01-01T00:00:01Z", ["p"]),
    ("b", [], 9, "2024-01-01", "not a time", []),
    (None, None, None, None, None, None),
    ("d", [(None, -0.5, None)], 2, "2024-02-30T00:00:00Z", "2024-01-01T00:00:00Z", ["q", "r"]),
]


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def failing(df, *clauses, **fields):
    c = Contract("t", fields=fields, clauses=[Clause(f"c{i}", r) for i, r in enumerate(clauses)])
    return {r["check_id"]: r["records_failing"] for r in checks.evaluate(df, c).collect()}


def test_nested_values(records):
    col, _ = paths.values(records.schema, "facts.confidence")
    assert [r[0] for r in records.select(col).collect()] == [[0.5, 1.5], [], [], [-0.5]]
    col, _ = paths.scalars(records.schema, "facts.refs")
    assert [r[0] for r in records.select(col).collect()] == [["e1", "e2"], [], [], []]
    assert paths.values(records.schema, "facts.nothing") is None


def test_field_rules(records):
    got = failing(records, **{"facts.confidence": FieldRule("number", True, minimum=0, maximum=1), "id": FieldRule("string", True, enum=["a", "b"]), "at": FieldRule(format="date-time"), "score": FieldRule("string", pattern="[0-9]"), "none": FieldRule("string", True, minimum=1)})
    assert got["facts.confidence.range"] == 2 and got["facts.confidence.required"] == 1
    assert got["id.required"] == 1 and got["id.enum"] == 1 and got["at.format"] == 1
    assert got["score.type"] == 3 and got["score.pattern"] == 3  # numbers are no text
    assert got["none.required"] == 4 and got["none.range"] == 4


def test_clauses(records):
    got = failing(
        records,
        {"type": "numeric_range", "field": "facts.confidence", "minimum": 0, "maximum": 1}, {"type": "array_min_items", "field": "tags", "minimum": 1}, {"type": "string_length", "field": "tags", "minimum": 2},
        {"type": "temporal_order", "left": "at", "right": "done"}, {"type": "conditional_numeric_range", "field": "score", "maximum": 5, "when": {"field": "tags", "in": ["p", "q"]}},
        {"type": "conditional_pattern", "field": "done", "pattern": "2024", "when": {"field": "id", "equals": "b"}}, {"type": "numeric_range", "field": "absent", "minimum": 0}, {"type": "no_such_rule", "field": "id"},
    )
    assert got == {"c0": 2, "c1": 2, "c2": 3, "c3": 3, "c4": 0, "c5": 1, "c6": 0}


def test_weighted_mean_sum_endpoints_and_groups(spark):
    m = spark.createDataFrame([({"a": (4.0, 1.0), "b": (2.0, 3.0)}, 2.5, 6.0), ({"a": (4.0, None)}, 3.0, 1.0), (None, 1.0, None)], "scores map<string, struct<score double, weight double>>, overall double, total double")
    got = failing(m, {"type": "weighted_mean_equals", "map_field": "scores", "output": "overall", "tolerance": 0.01}, {"type": "sum_equals", "parts": ["overall", "overall"], "output": "total", "tolerance": 0.5})
    assert got == {"c0": 2, "c1": 3}
    g = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 3), ("c", None)], "k string, n int")
    assert failing(g, {"type": "group_monotonic", "group_by": ["k"], "field": "n"}) == {"c0": 1}
    files = spark.createDataFrame([("x/y.py",)], "path string")
    f = spark.createDataFrame([("x/y.py",), ("../y.py",), ("/x/y.py",), (None,)], "p string")
    out = checks.evaluate(f, Contract("t", clauses=[Clause("c", {"type": "repo_path_exists", "field": "p"})]), files)
    assert out.first()["records_failing"] == 3


def test_empty_table_and_empty_contract(spark, records):
    assert failing(records.limit(0), id=FieldRule("string", True, enum=["a"])) == {"id.required": 0, "id.type": 0, "id.enum": 0}
    assert checks.evaluate(records, Contract("t")).count() == 0
    assert checks.summary(checks.evaluate(records, Contract("t"))).first()["overall_status"] == "PASS"


def test_modes_and_summary(spark, records):
    results = checks.evaluate(records, Contract("t", fields={"id": FieldRule(enum=["a"])}))
    assert {r["mode"]: r["blocking"] for r in checks.gates(results).collect()} == {"AUDIT": False, "WARN": False, "ENFORCE": True}
    assert reporting.totals(results).first()["health"] == 0


def test_contract_round_trip(spark, records):
    c = profile.infer_contract(records, "records")
    again = Contract.from_yaml(c.to_yaml())
    assert {n: r.as_dict() for n, r in again.fields.items()} == {n: r.as_dict() for n, r in c.fields.items()}
    assert c.fields["facts.confidence"].maximum == 1.0 and "data_type: float" in c.to_dbt()


def test_formats(spark):
    d = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("2024",), ("01234567-89ab-7def-8123-456789abcdef",), ("",), (None,)], "v string")
    got = [tuple(r) for r in d.select(text.has_format(F.col("v"), "date-time"), text.has_format(F.col("v"), "uuid"), text.has_format(F.col("v"), None)).collect()]
    assert [g[:2] for g in got[:4]] == [(True, False), (False, False), (False, True), (False, False)] and got[4][2]
    assert d.limit(1).select(text.three_part_version(F.lit("2.1")), text.normal_field_path(F.lit("a[0]..b[*].c."))).first()[:] == ("2.1.0", "a.b.c")


def test_drift_and_baseline(spark):
    base = profile.numeric_profile(spark.createDataFrame([(0.0, True), (10.0, False)], "x double, b boolean"), ["x", "b"])
    moved = spark.createDataFrame([(17.0, True)], "x double, b boolean")
    got = {r["path"]: r["status"] for r in profile.drift(profile.numeric_profile(moved, ["x", "b"]), base).collect()}
    assert got == {"x": "WARN", "b": "PASS"}
    assert profile.merged_baseline(base, base.where("path = 'x'")).count() == 2


def test_renames_and_changes(spark):
    old = Contract("c", fields={"user_name": FieldRule("string"), "kept": FieldRule("integer")})
    new = Contract("c", fields={"username": FieldRule("string"), "kept": FieldRule("integer")})
    renames = evolution.detect_renames(old, new)
    assert renames == {"user_name": "username"}
    got = {r["field_name"]: r["change_type"] for r in evolution.classify(evolution.field_table(spark, old), evolution.field_table(spark, new), renames).collect()}
    assert got == {"user_name": "FIELD_RENAME", "kept": "NO_CHANGE"}


def test_enumerations_with_bars(spark):
    c = profile.infer_contract(spark.createDataFrame([("a|b",), ("c",), ("",), (None,)], "s string"), "c")
    assert c.fields["s"].enum == ["", "a|b", "c"]


def test_adapters(records):
    d = adapter.apply_rules(records, [{"type": "numeric_scaling", "field": "facts.confidence", "factor": 10}, {"type": "field_rename", "from": "facts.text", "to": "facts.body"}, {"type": "remove_field", "field": "facts.refs"}, {"type": "default_value", "field": "score", "value": 0}])
    r = d.collect()
    assert r[0]["facts"][1].asDict() == {"confidence": 15.0, "body": "y"} and r[2]["facts"] is None and r[2]["score"] == 0


def _stages(out):
    rows = out.collect()
    return {r["stage"]: r["overall_status"] for r in rows}, {r["verdict"] for r in rows}, {r["attempted"] for r in rows}


def test_what_if(spark, records):
    one = records.where("id = 'a'").select("id", "score", "facts")
    c = Contract("c", fields={"score": FieldRule(None, True, maximum=5), "id": FieldRule("string", enum=["a"]), "facts.confidence": FieldRule("number", maximum=2)}, clauses=[Clause("k", {"type": "string_length", "field": "id", "minimum": 1})])
    simulate = lambda **change: _stages(whatif.what_if(one, c, change))
    ok, bad = "PASS", "FAIL"
    stages = lambda a, b, x: {"baseline": a, "raw": b, "adapted": x}
    assert simulate(change_type="numeric_scale_change", field="score", factor=100) == (stages(ok, bad, ok), {"BREAKING_BUT_ADAPTABLE"}, {True})
    assert simulate(change_type="enum_change", field="id", added_values=["z"]) == (stages(ok, ok, ok), {"FORWARD_COMPATIBLE"}, {False})
    assert simulate(change_type="add_field", field="basis", default_value="x", required=True) == (stages(ok, ok, ok), {"BREAKING_BUT_ADAPTABLE"}, {True})
    assert simulate(change_type="add_field", field="basis", default_value="x") == (stages(ok, ok, ok), {"BACKWARD_COMPATIBLE"}, {False})
    assert simulate(change_type="remove_field", field="score") == (stages(ok, bad, bad), {"BREAKING_REQUIRES_MIGRATION"}, {True})
    assert simulate(change_type="field_rename", **{"from": "id", "to": "key"}) == (stages(ok, bad, ok), {"BREAKING_BUT_ADAPTABLE"}, {True})
    assert simulate(change_type="range_change", field="score", maximum=9) == (stages(ok, ok, ok), {"FORWARD_COMPATIBLE"}, {False})
    assert simulate(change_type="range_change", field="score", maximum=4) == (stages(ok, ok, ok), {"BREAKING_REQUIRES_MIGRATION"}, {True})
    assert simulate(change_type="type_change", field="facts.confidence", to="number")[1] == {"COMPATIBLE"}
    assert _stages(whatif.what_if(records, c, {"change_type": "type_change", "field": "id", "to": "string"}))[1] == {"BREAKING"}


def test_affected_subscribers(spark):
    old, new = Contract("c", fields={"a.b": FieldRule("string"), "k": FieldRule("string")}), Contract("c", fields={"a.b": FieldRule("integer"), "k": FieldRule("string")})
    changes = evolution.classify(evolution.field_table(spark, old), evolution.field_table(spark, new))
    subs = spark.createDataFrame([("x", "a", False), ("x", "a.b", True), ("y", "a", False), ("z", "k", True)], "subscriber_id string, field string, is_breaking boolean")
    assert sorted(tuple(r) for r in whatif.affected(subs, changes).collect()) == [("x", "a.b"), ("y", "a")]


def test_lineage_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(70)], "source long, target long").coalesce(1)
    start = spark.createDataFrame([(0,)], "start long")
    got = {(r["node"], r["hops"]) for r in lineage.traverse(e, start).collect()}
    assert got == {(i, i) for i in range(1, 71)}
    assert lineage.traverse(e, start, max_hops=2).count() == 2


def test_lineage_with_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), (None, "x")], "source string, target string")
    got = {(r["node"], r["hops"]) for r in lineage.traverse(e, spark.createDataFrame([("a",)], "start string")).collect()}
    assert got == {("b", 1), ("c", 2), ("d", 3)}
    g = lineage.contract_graph(spark.createDataFrame([("week1-x", "week2-y"), ("week2-z", "week1-x")], "contract_id string, subscriber_id string"))
    assert g.where("relationship = 'PUBLISHES'").count() == 1


def test_payloads(spark):
    d = spark.createDataFrame([(("a", 3, ["x"]),), (("bb", -1, []),), ((None, 1, ["y"]),)], "r struct<s string, n int, l array<string>>")
    schema = {"required": ["s"], "properties": {"s": {"maxLength": 1}, "n": {"minimum": 0}, "l": {"minItems": 1, "items": {"pattern": "x"}}}}
    assert [r[0] for r in d.select(payloads.schema_error(F.col("r"), "r", schema)).collect()] == [None, "r.s: maxLength", "r.s: required"]
    assert payloads.violation_rate(d.limit(0), F.lit("e")).first()["status"] == "PASS"
    j = spark.createDataFrame([('{"a": 1, "b": "x"}',), ('{"a": 1.5}',), ("broken",)], "j string")
    assert {(r["key"], r["kinds"], r["required"]) for r in ingest.json_types(j, "j").collect()} == {("a", "integer|number", True), ("b", "string", False)}


FAULTS = [("score", 127), ("id", None), ("at", "yesterday"), ("tags", [])]


@pytest.mark.parametrize("column, value", FAULTS)
def test_injected_faults_are_found(spark, column, value):
    healthy = spark.createDataFrame([(f"k{i}", i % 5, "2024-01-01T00:00:00Z", ["t"]) for i in range(20)], "id string, score int, at string, tags array<string>")
    c = Contract("c", fields={"score": FieldRule(maximum=5), "id": FieldRule(required=True), "at": FieldRule(format="date-time")}, clauses=[Clause("t", {"type": "array_min_items", "field": "tags"})])
    assert checks.summary(checks.evaluate(healthy, c)).first()["overall_status"] == "PASS"
    kind = healthy.schema[column].dataType
    broken = ingest.inject(healthy, column, F.array().cast(kind) if value == [] else F.lit(value).cast(kind), F.col("score") == 3)
    assert checks.summary(checks.evaluate(broken, c)).first()["overall_status"] == "FAIL"


def test_streaming_and_sources(spark, tmp_path, records):
    from tessera.sources import records as src
    from tessera.streaming.watch import latest_results, watch

    records.write.parquet(f"{tmp_path}/in")
    q = watch(spark, f"{tmp_path}/in", records.schema, Contract("t", fields={"id": FieldRule(required=True)}), f"{tmp_path}/out", f"{tmp_path}/ckpt")
    q.awaitTermination()
    assert latest_results(spark, f"{tmp_path}/out").select("records_failing").collect()[0][0] == 1
    (tmp_path / "a.jsonl").write_text('# note\n\n{"a": 1}\n{"a": broken\n')
    assert [r["a"] for r in src.read_jsonl(spark, f"{tmp_path}/a.jsonl", "a int", tolerant=True).collect()] == [1]
    assert src.read_jsonl(spark, f"{tmp_path}/missing.jsonl", "a int").count() == 0
    good, bad = src.split_quarantine(records, F.when(F.col("id").isNull(), "no id"))
    assert (good.count(), bad.count()) == (3, 1)
