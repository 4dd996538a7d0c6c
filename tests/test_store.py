from datetime import UTC, datetime

import pytest

from tessera.operators import checks, evolution, profile
from tessera.plans import catalogue
from tessera.plans.contract import Contract, FieldRule
from tessera.sources import records, store


def test_snapshots_and_diff(spark, tmp_path):
    folder, now = f"file://{tmp_path}", datetime(2024, 1, 1, tzinfo=UTC)
    a = store.save_contract(spark, Contract("c", fields={"x": FieldRule("integer")}), folder, now=now)
    b = store.save_contract(spark, Contract("c", fields={"x": FieldRule("string")}), folder, now=now)
    assert (a[-21:], b[-24:]) == ("20240101T000000Z.yaml", "20240101T000000Z-01.yaml")
    (_, old), (_, new) = sorted(store.snapshots(spark, folder, "c"), key=lambda s: len(s[0]))
    d = evolution.classify(evolution.field_table(spark, old), evolution.field_table(spark, new))
    assert d.first()["change_type"] == "TYPE_CHANGE" and evolution.verdict(d).first()["verdict"] == "breaking"
    assert evolution.checklist(d.collect())[0] == "Migrate consumers of x: type change"
    assert store.snapshots(spark, folder, "none") == []
    assert store.retained(["3", "1", "2"], 2) == (["2", "3"], ["1"])


def test_baselines(spark, tmp_path):
    path = f"file://{tmp_path}/b"
    for value in (1.0, 2.0):
        store.upsert_baseline(profile.numeric_profile(spark.createDataFrame([(value,)], "x double"), ["x"]), path)
    assert [(r["path"], r["mean"]) for r in store.read_baseline(spark, path).collect()] == [("x", 2.0)]


def test_catalogue_on_events(spark):
    id_of = "550e8400-e29b-41d4-a716-44665544000{}".format
    rows = [(id_of(i), id_of(0), "AgentSession", i, f"2024-01-01T00:00:0{i}Z", "2024-01-01T00:00:05Z", "LoanOpened", "1.0", (id_of(9),)) for i in (1, 2, 3)]
    df = spark.createDataFrame(rows, "event_id string, aggregate_id string, aggregate_type string, sequence_number long, occurred_at string, recorded_at string, event_type string, schema_version string, metadata struct<correlation_id string>")
    c = catalogue.completed(profile.infer_contract(df, "events"), "events")
    assert checks.summary(checks.evaluate(df, c)).first()["overall_status"] == "PASS" and c.fields["sequence_number"].minimum == 1
    broken = df.where("sequence_number <> 2")
    assert {r["check_id"] for r in checks.evaluate(broken, c).where("status = 'FAIL'").collect()} == {"week5.sequence_monotonic_per_aggregate"}
    assert {k: len(catalogue.clauses_for(k)) for k in ("intents", "verdicts", "extractions", "lineage", "events", "traces", "generic")} == {"intents": 5, "verdicts": 8, "extractions": 11, "lineage": 6, "events": 12, "traces": 5, "generic": 0}
    assert all(c.rule["type"] in checks.ON_RECORDS + checks.ON_GROUPS + checks.ON_FILES for k in ("intents", "verdicts", "extractions", "lineage", "events", "traces") for c in catalogue.clauses_for(k))


def test_interrupted_baseline(spark, tmp_path):
    """A run that ended between both renames leaves the old table aside; the next one takes it up."""
    path = tmp_path / "b"
    stats = lambda name: profile.numeric_profile(spark.createDataFrame([(1.0,)], f"{name} double"), [name])
    store.upsert_baseline(stats("x"), f"file://{path}")
    path.rename(tmp_path / "b.old")
    store.upsert_baseline(stats("y"), f"file://{path}")
    assert sorted(r["path"] for r in store.read_baseline(spark, f"file://{path}").collect()) == ["x", "y"]
    assert not (tmp_path / "b.old").exists()


def test_reports_specs_and_latest(spark, tmp_path):
    folder = f"file://{tmp_path}"
    for name, body in (("a.json", '{"generated_at": "2024-01-02T00:00:00Z", "results": [{"status": "PASS"}]}'), ("clean_x.json", '{"results": [{"status": "FAIL"}]}'), ("clean.json", '{"generated_at": "2024-01-03T00:00:00Z", "results": []}'), ("none.json", '{"x": 1}'), ("s.yaml", "change_type: add_field")):
        store.write_text(spark, f"{folder}/{name}", body)
    schema = "generated_at string, results array<struct<status string>>"
    names = lambda **how: sorted(r["file"] for r in records.read_reports(spark, folder, schema, **how).collect())
    assert names() == ["a.json", "clean.json", "clean_x.json"] and names(baseline=True) == ["clean.json"] and names(baseline=True, names=()) == ["clean.json"]
    assert records.latest_file(spark, folder, "generated_at string").where("generated_at IS NULL").count() == 1  # written just now
    assert records.read_spec(spark, f"{folder}/s.yaml") == {"change_type": "add_field"} and records.read_spec(spark, f"{folder}/none.json") == {"x": 1}
    with pytest.raises(FileNotFoundError):
        records.read_spec(spark, f"{folder}/absent.json")
    nested = spark.createDataFrame([(1, (2, [(3, 4)]))], "z int, a struct<y: int, b: array<struct<q: int, c: int>>>")
    records.write_jsonl(nested, f"{folder}/out")
    assert [r[0] for r in spark.read.text(f"{folder}/out").collect()] == ['{"a":{"b":[{"c":4,"q":3}],"y":2},"z":1}']
    records.write_report(spark, spark.createDataFrame([("c", "PASS")], "check_id string, status string"), f"{folder}/r.json", total=1)
    assert records.read_spec(spark, f"{folder}/r.json") == {"total": 1, "results": [{"check_id": "c", "status": "PASS"}]}
