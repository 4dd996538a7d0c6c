from pyspark.sql import functions as F

from tessera.operators import crosschecks as x
from tessera.sources import flatten


def failing(df):
    return {r["check_id"]: r["records_failing"] for r in df.collect()}


def test_kinds():
    assert [x.kind_of(n) for n in ("a/extraction_events", "EVENTS", "my-lineage", "verdict traces", "trace", "intent", "orders")] == ["extractions", "events", "lineage", "verdicts", "traces", "intents", "generic"]


def test_intents(spark):
    files = spark.createDataFrame([("a.py",)], "path string")
    d = spark.createDataFrame([([("a.py", 1, 2, 0.5), ("b.py", 3, 2, 1.5)],), ([],), ([("../a.py", 0, 1, None)],)], "code_refs array<struct<file string, line_start int, line_end int, confidence double>>")
    assert failing(x.intents(d, files)) == {"week1.code_refs_non_empty": 1, "week1.code_ref_line_bounds": 2, "week1.code_ref_confidence_scale": 2, "week1.code_ref_file_present": 2}


def test_verdicts(spark):
    hashes = spark.createDataFrame([("h",)], "sha256 string")
    d = spark.createDataFrame([("h", {"a": (4, 1.0), "b": (2, 3.0)}, 2.5), ("g", {"a": (7, 1.0)}, 7.0), ("h", {"a": (4, -1.0)}, 3.0)], "rubric_id string, scores map<string, struct<score int, weight double>>, overall_score double")
    assert failing(x.verdicts(d, hashes)) == {"week2.score_range_valid": 1, "week2.overall_score_weighted_mean": 1, "week2.rubric_hash_exists": 1}


def test_extractions_and_lineage(spark):
    d = spark.createDataFrame([([("e1",)], [(["e1", "e2", "e2"],), (None,)], "h"), ([], [(["e1"],)], None), (None, None, "g")], "entities array<struct<entity_id string>>, extracted_facts array<struct<entity_refs array<string>>>, extraction_rules_hash string")
    assert failing(x.extractions(d, "h")) == {"week3.entity_refs_exist": 3, "week3.extraction_rules_hash_exists": 1}
    assert {r["status"] for r in x.extractions(d, None).where("check_id like '%hash%'").collect()} == {"ERROR"}
    g = spark.createDataFrame([([("a",), ("b",)], [("a", "b"), ("a", "c"), (None, "d")])], "nodes array<struct<node_id string>>, edges array<struct<source string, target string>>")
    assert failing(x.lineage(g)) == {"week4.edges_reference_nodes": 3}


def test_events(spark):
    t = "2024-01-01T00:00:0{}Z".format
    d = spark.createDataFrame([("a", 1, "X", "1.0", t(0), t(1)), ("a", 2, "X", "2.0", t(2), t(1)), ("b", 2, "Y", "1.0", t(0), None), ("c", None, "X", "1.0", t(0), t(0))], "aggregate_id string, sequence_number long, event_type string, schema_version string, occurred_at string, recorded_at string")
    known = spark.createDataFrame([("X", "1.0")], "event_type string, schema_version string")
    assert failing(x.events(d, known)) == {"week5.recorded_after_occurred": 2, "week5.sequence_monotonic": 2, "week5.payload_matches_schema": 2}
    assert len(failing(x.events(d.limit(0)))) == 2


def test_traces_and_producers(spark):
    d = spark.createDataFrame(
        [
            ("2024-01-01T00:00:00Z", "2024-01-01T00:00:01Z", 1, 2, 3, " LLM ", "0.5", ["p"], '{"doc": 1}', "{}", "n", None),
            ("2024-01-01T00:00:01Z", "2024-01-01T00:00:01Z", 1, 2, 4, "planner", "x", ["q"], "{}", None, "Run", None),
            (None, None, None, 2, 4, None, None, None, "{}", None, "n", "at /q/file"),
            ("2024-01-01", "2024-01-02", 0, 0, 0, "tool", "-1", [], None, None, None, None),
        ],
        "start_time string, end_time string, prompt_tokens long, completion_tokens long, total_tokens long, run_type string, total_cost string, tags array<string>, inputs string, outputs string, name string, error string",
    )
    assert failing(x.traces(d)) == {"traces.end_after_start": 2, "traces.total_tokens_add_up": 2, "traces.run_type_allowed": 2, "traces.total_cost_non_negative": 3}
    rules = {"p": {"tags": ["p"], "paths": ["inputs.doc"], "names": ["run"], "fragments": []}, "q": {"tags": ["q"], "paths": ["outputs.r"], "names": [], "fragments": ["/q/"]}}
    assert [r[0] for r in d.select(x.producer_of(rules, ["q", "p"])).collect()] == ["p", "q", "q", "other"]
    assert failing(x.producers(d, rules, ["q", "p"])) == {"traces.producer_classification.coverage": 1, "traces.p.row_shape": 0, "traces.q.row_shape": 1}


def test_raw_observations(spark):
    lines = ['{"a": [{"b": 1}, {"b": 2.5}], "c": [], "d": {}, "e": null, "f": [1, true, "x"]}', '{"a": [], "c": ["y"], "e": 1, "g": true}']
    obs = flatten.observations(spark.createDataFrame([(s,) for s in lines], "value string"))
    got = {r["path"]: (r["type"], r["seen"], r["observed"], r["nulls"]) for r in flatten.profile(obs).collect()}
    assert got == {"a": ("string", 2, 0, 1), "a.b": ("number", 2, 2, 0), "c": ("string", 2, 1, 1), "e": ("integer", 2, 1, 1), "f": ("string", 1, 3, 0), "g": ("boolean", 1, 1, 0)}
    assert flatten.observations(spark.createDataFrame([], "value string")).agg(F.count("*")).first()[0] == 0
    broken = spark.createDataFrame([(x,) for x in [*lines, '{"a": ', None, "  "]], "value string")
    assert flatten.observations(broken, tolerant=True).count() == obs.count()
