"""Written specifications of changes, simulations' notes and lineage beyond the direct subscribers."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import whatif
from tessera.plans.contract import Contract, FieldRule

DESCRIPTORS = [("float 0.0-1.0", ("number", 0.0, 1.0)), ("Integer 0 - 100", ("integer", 0.0, 100.0)), ("string", ("string", None, None)), ("-5--1", (None, -5.0, -1.0)), ("interval", (None, None, None)), ("", (None, None, None)), (None, (None, None, None)), ("BOOLEAN or int", ("boolean", None, None))]
FACTORS = [("x -> x * 100", 100.0), ("X->x/4", 0.25), ("x -> x / 0", 1.0), ("x -> x * -2.5", -2.5), ("x + 1", 1.0), ("", 1.0), (None, 1.0)]


def test_words_in_executors_and_on_the_driver(spark):
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(DESCRIPTORS)], "i int, t string").select("i", whatif.descriptor(F.col("t")).alias("d"))
    assert {r["i"]: tuple(r["d"]) for r in d.collect()} == {i: want for i, (_, want) in enumerate(DESCRIPTORS)}
    f = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(FACTORS)], "i int, t string").select("i", whatif.factor(F.col("t")).alias("f"))
    assert {r["i"]: r["f"] for r in f.collect()} == {i: want for i, (_, want) in enumerate(FACTORS)}
    for text, (kind, low, high) in DESCRIPTORS:
        assert whatif._declared(text) == {k: v for k, v in (("type", kind), ("minimum", low), ("maximum", high)) if v is not None}
    for text, want in FACTORS:
        assert whatif.specified({"change_type": "range_change", "sample_transform": text or ""}).get("factor", 1.0) == want


def test_specified():
    got = whatif.specified({"change_type": "FIELD_RENAME", "from_field": "a", "new_field": "b"})
    assert (got["change_type"], got["from"], got["to"]) == ("field_rename", "a", "b")
    got = whatif.specified({"change_type": "type_change", "field": "a", "from": "int", "to": "string up to 5"})
    assert (got["to"], got["original"]) == ("string", "integer")
    assert "to" not in whatif.specified({"change_type": "type_change", "field": "a", "to": "decimal"})
    assert whatif.specified({"change_type": "type_change", "field": "a", "target_type": "decimal"})["field_schema"] == {"type": "decimal"}
    got = whatif.specified({"change_type": "enum_change", "field": "a", "replace_values": ["x"], "sample_new_value": "y", "added_values": ["y", "z"], "enum_values": ["x", "w"]})
    assert (got["replaces"], got["to_values"]) == (["x"], ["x", "w"]) and whatif._in_place(got) == "y"
    assert whatif.specified({"change_type": "add_field", "field": "a", "value": 0})["default_value"] == 0
    own = {"change_type": "numeric_scale_change", "field": "a", "factor": 10, "field_schema": {"maximum": 10.0}}
    assert whatif.specified(own) == own


def test_a_type_from_words_stands_in_only_for_none():
    spec = whatif.specified({"change_type": "range_change", "field": "a", "from": "int", "to": "0-9"})
    assert whatif.hypothetical(Contract("t", fields={"a": FieldRule("number")}), spec).fields["a"] == FieldRule("number", minimum=0.0, maximum=9.0)
    assert whatif.hypothetical(Contract("t"), spec).fields["a"] == FieldRule("integer", minimum=0.0, maximum=9.0)


@pytest.mark.parametrize("spec", [{"change_type": "enum_change", "field": "k", "replace_values": ["a"]}, {"change_type": "type_change", "field": "k", "to": "decimal"}, {"change_type": "range_change", "field": "k"}])
def test_specifications_without_their_values_change_nothing(spark, spec):
    df = spark.createDataFrame([("a",), (None,)], "k string")
    change = whatif.specified(spec)
    assert sorted(whatif.mutate(df, change).collect(), key=str) == sorted(df.collect(), key=str) and whatif.inverse(change) in ([], [{"type": "type_coercion", "field": "k", "to": "string"}])
    out = whatif.what_if(df, Contract("t", fields={"k": FieldRule("string")}), change).collect()
    assert {r["stage"]: r["overall_status"] for r in out} == dict.fromkeys(whatif.STAGES, "PASS") and {r["applied"] for r in out} == {0}


def _notes(df, contract, spec):
    return [r["note"] for r in whatif.notes(df, contract, whatif.specified(spec)).orderBy("place").collect()]


def test_notes(spark):
    df, c = spark.createDataFrame([("a", 0.5), ("b", None)], "k string, v double"), Contract("t", fields={"k": FieldRule("string", enum=["a", "b"]), "v": FieldRule("number", maximum=1)})
    scaled = _notes(df, c, {"change_type": "numeric_scale_change", "field": "v", "sample_transform": "x -> x * 100", "to": "integer 0-100"})
    assert scaled[0] == "v is multiplied by 100.0." and scaled[2:] == ["The adapter brings records back to the contract as it is.", "1 rules undo the change."]
    removed = _notes(df, c, {"change_type": "remove_field", "field": "k"})
    assert removed[0] == "k is taken away." and removed[2] == "The adapter was tried and doesn't repair the records." and len(removed) == 3
    kept = _notes(df, c, {"change_type": "enum_change", "field": "k", "added_values": ["z"]})
    assert kept == ["Records stay as they are; the change is one of the contract alone.", "The comparison of the contracts is forward."]
    empty = _notes(df.limit(0), c, {"change_type": "enum_change", "field": "k", "replace_values": ["a"], "sample_new_value": "z"})
    assert empty[0] == "a of k become z."


def test_one_scan(spark, tmp_path):
    """Stages and the count of rewritten records come from one pass over the records."""
    spark.range(10).selectExpr("id", "id / 10 v").write.parquet(f"{tmp_path}/t")
    out = whatif.what_if(spark.read.parquet(f"{tmp_path}/t"), Contract("t", fields={"v": FieldRule(minimum=0, maximum=1)}), {"change_type": "numeric_scale_change", "field": "v", "factor": 100})
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1 and {r["applied"] for r in out.collect()} == {9}


def test_lineage_beyond_subscribers(spark):
    direct = spark.createDataFrame([("a", "f"), ("b", "g"), ("alone", "f"), (None, "f")], "subscriber_id string, fields string")
    rows = [("a", "SERVICE", "contract_graph", "CONSUMED_BY", 1, []), ("a", "FILE", "lineage_graph", "READS", 3, ["p", "q"]), ("b", "FILE", "lineage_graph", "READS", 0, None), ("far", "FILE", "lineage_graph", "READS", 4, ["a", "p", "q"]), ("far", "FILE", "contract_graph", "READS", 1, []), (None, "FILE", "lineage_graph", "READS", 1, [])]
    entries = spark.createDataFrame(rows, "id string, kind string, source string, relationship string, hops int, via array<string>")
    got = {(r["subscriber_id"], r["source"]): (r["contamination_depth"], r["via"], r["is_direct"]) for r in whatif.enriched(direct, entries).collect()}
    assert got == {("a", "lineage_graph"): (2, ["p", "q"], True), ("b", "lineage_graph"): (0, None, True), ("alone", None): (0, None, True), (None, None): (0, None, True), ("far", "lineage_graph"): (3, ["a", "p", "q"], False), ("far", "contract_graph"): (0, [], False)}
    assert whatif.enriched(direct.limit(0), entries).where("is_direct").isEmpty() and whatif.enriched(direct, entries.limit(0)).count() == 4
