"""Kept vectors, archives, documents, maps of lineage, records from chunks, numbers over a whole table, fixed producers."""

import json
import random
import subprocess

from pyspark.sql import functions as F

from tessera.operators import crosschecks, ingest, lineage, reporting
from tessera.plans import catalogue
from tessera.sources import records, store


def test_centroids_kept(spark, tmp_path):
    path = f"file://{tmp_path}/centroids"
    of = lambda *rows: spark.createDataFrame(list(rows), "lang string, v array<double>")
    drift = lambda d: {r["lang"]: (r["status"], r["drift"]) for r in store.centroid_drift(d, ["lang"], path).collect()}
    assert drift(of()) == {} and not records.exists(spark, path)
    assert drift(of(("a", [1.0, 0.0]), (None, [0.0, 1.0]))) == {"a": ("BASELINE_SET", 0.0), None: ("BASELINE_SET", 0.0)}
    assert drift(of(("a", [3.0, 0.0]), (None, [1.0, 0.0]), ("b", [1.0, 1.0]))) == {"a": ("PASS", 0.0), None: ("FAIL", 1.0), "b": ("BASELINE_SET", 0.0)}
    assert drift(of(("a", [1.0, 1.0]), ("b", [1.0, 0.9]), ("zero", [0.0, 0.0]))) == {"a": ("FAIL", 0.2929), "b": ("PASS", 0.0014), "zero": ("BASELINE_SET", 0.0)}
    assert sorted(map(str, (r["lang"] for r in spark.read.parquet(path).collect()))) == ["None", "a", "b", "zero"]
    (tmp_path / "centroids").rename(tmp_path / "centroids.old")  # a crash between the two renames
    assert drift(of(("a", [1.0, 0.0]))) == {"a": ("PASS", 0.0)}


def test_archive(spark, tmp_path):
    reports, old = tmp_path / "reports", tmp_path / "old"
    (reports / "inner").mkdir(parents=True)
    for n in ("clean.json", "a.json", "b.tar.gz", "plain"):
        (reports / n).write_text(n)
    at, into = f"file://{reports}", f"file://{old}"
    assert store.archive(spark, at, ["clean*"], into) == (["clean.json"], ["a.json", "b.tar.gz", "plain"]) and not old.exists()
    store.archive(spark, at, ["clean*"], into, apply=True)
    for again in range(2):
        (reports / "a.json").write_text(str(again))
        (reports / "plain").write_text(str(again))
        store.archive(spark, at, ["clean*"], into, apply=True)
    names = lambda d: sorted(p.name for p in d.iterdir() if not p.name.startswith("."))
    assert names(reports) == ["clean.json", "inner"] and names(old) == ["a.json", "a__dup.json", "a__dup2.json", "b.tar.gz", "plain", "plain__dup", "plain__dup2"]
    assert (old / "a__dup2.json").read_text() == "1"
    assert store.archive(spark, at, [], apply=True) == ([], ["clean.json"]) and names(reports) == ["inner"]
    assert store.archive(spark, f"file://{tmp_path}/none", []) == ([], [])


def test_documents(spark, tmp_path):
    (tmp_path / "ok.json").write_text(json.dumps({"a": {"b": 1}}, indent=1))
    (tmp_path / "broken.json").write_text('{"a": ')
    (tmp_path / "empty.json").write_text("")
    assert records.read_document(spark, f"file://{tmp_path}/ok.json").first()["a"]["b"] == 1
    assert [records.read_document(spark, f"file://{tmp_path}/{n}.json") for n in ("broken", "empty", "missing")] == [None] * 3


def test_history_since(spark, tmp_path):
    git = lambda *a, **env: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=n@x.org", *a], check=True, capture_output=True, env={"PATH": "/usr/bin:/bin:/usr/local/bin", **env})
    git("init", "-q")
    (tmp_path / "f").write_text("1")
    git("add", "f")
    git("commit", "-qm", "first", GIT_AUTHOR_DATE="2020-01-01T00:00:00Z", GIT_COMMITTER_DATE="2020-01-01T00:00:00Z")
    said = lambda since: [r["message"] for r in lineage.git_history(spark, str(tmp_path), ["f", "none"], since).collect()]
    assert said(None) == ["first"] and said("2019-12-01") == ["first"] and said("2020-02-01") == ["uncommitted"]


def test_maps(spark):
    nodes = spark.createDataFrame([(" a ", "A", None, "p", None), ("a", None, "T", None, "q"), ("b", "", "", None, None), ("", "x", None, None, None), (None, "x", None, None, None), ("c", "C", "T", "", "")], "node_id string, label string, type string, path string, purpose string")
    edges = spark.createDataFrame([("a", " b", None, "0.5"), (" a", "b", "DEPENDS_ON", "7"), ("a", "b", "READS", "x"), ("a", "gone", "READS", "1"), (None, "a", "READS", "1"), ("", "a", "READS", "1"), ("c", "a", "READS", None)], "source string, target string, relationship string, confidence string")
    n, e = lineage.map_view(nodes, edges)
    assert sorted(map(tuple, n.collect())) == [("a", "A", "UNKNOWN", "p", ""), ("b", "b", "UNKNOWN", "", ""), ("c", "C", "T", "", "")]
    assert sorted(map(tuple, e.collect())) == [("a", "b", "DEPENDS_ON", 1.0), ("a", "b", "READS", 0.0), ("c", "a", "READS", 0.0)]
    seen, met = lineage.subgraph(n, e, lambda c: c != "c")
    assert sorted(r["id"] for r in seen.collect()) == ["a", "b"] and met.count() == 2
    seen, met = lineage.subgraph(n, e.limit(0), lambda c: F.lit(True))
    assert seen.isEmpty() and met.isEmpty()


def test_chunks(spark):
    long = "x" * 20
    rows = [("d", i, t) for i, t in enumerate(["short", f" {long}\n", None, "<!-- image -->", "y" * 25] + ["z" * 20] * 3 + ["short"] * 8 + ["w" * 30])] + [("e", 0, "short")]
    r = ingest.chunk_records(spark.createDataFrame(rows, "doc string, i int, t string"), "doc", ["i"], "t", most=3)
    got = {(x["doc"], x["record_no"]): x["facts"] for x in r.collect()}
    assert got == {("d", 1): [long, "y" * 25, "z" * 20], ("d", 2): ["w" * 30]}
    r = ingest.chunk_records(spark.createDataFrame([("d", 0, "<!-- image -->" + "x"), ("d", 1, "<!-- image -->")], "doc string, i int, t string"), "doc", ["i"], "t", least=1)
    assert [x["facts"] for x in r.collect()] == [["<!-- image -->x"]]


def test_topped_up(spark):
    have, more = spark.range(3), spark.range(100, 200)
    ids = lambda d: sorted(r["id"] for r in d.collect())
    assert ids(ingest.topped_up(have, more, ["id"], 5)) == [0, 1, 2, 100, 101]
    assert ids(ingest.topped_up(have, more, ["id"], 2)) == [0, 1, 2]
    assert ids(ingest.topped_up(have.limit(0), more.limit(1), ["id"], 5)) == [100] and ids(ingest.topped_up(have, more.limit(0), ["id"], 5)) == [0, 1, 2]


def test_numbers_over_a_whole_table(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "b", "c"]), i) for i in range(300)]
    out = reporting.numbered_overall(spark.createDataFrame(rows, "k string, i int").repartition(7), [F.desc("k"), F.col("i")], "n").collect()
    want = sorted(rows, key=lambda r: (r[0] is None, [-ord(c) for c in r[0] or ""], r[1]))
    assert [(r["k"], r["i"]) for r in sorted(out, key=lambda r: r["n"])] == want and sorted(r["n"] for r in out) == list(range(1, 301))
    assert reporting.numbered_overall(spark.createDataFrame([], "k string"), [F.col("k")], "n").isEmpty()


def test_fixed_producers(spark):
    cases = [
        (["x", " WEEK3"], '{"command": 1}', None, None, "week3"), (None, '{"command": 1, "doc_id": 2}', None, None, "week5"), ([], '{"tool": {"a": []}}', "execute", None, "week4"), (None, None, " Execute ", "at /week5/", "week3"),
        (None, None, "run", "in Brownfield-Cartographer", "week4"), (None, "no json", "run", None, "other"), (None, '{"command": null}', None, None, "other"), (["week5", "week3"], None, None, None, "week3"),
    ]
    df = spark.createDataFrame([(i, t, x, "{}", n, e) for i, (t, x, n, e, _) in enumerate(cases)], "i int, tags array<string>, inputs string, outputs string, name string, error string")
    rules = catalogue.producer_rules()
    got = {r["i"]: r["who"] for r in df.select("i", crosschecks.producer_of(rules, ["week5", "week4", "week3"]).alias("who")).collect()}
    assert got == {i: c[-1] for i, c in enumerate(cases)}
    failing = {r["check_id"]: r["records_failing"] for r in crosschecks.producers(df).collect()}
    assert failing == {"traces.producer_classification.coverage": 2, "traces.week3.row_shape": 2, "traces.week4.row_shape": 0, "traces.week5.row_shape": 0}


def test_summaries(spark):
    ddl = "i int, check_id string, field_name string, blame array<struct<file_path string, commit_hash string, author string>>, lineage array<string>, affected array<string>"
    rows = [(1, "other", "f", None, None, None), (2, "extracted_facts.confidence.drift", "c", [("a.py", "c1", "me"), ("b.py", "c2", "you")], ["s", "t"], ["s", "t"]), (3, "week3.confidence_unit_scale", None, [], [], []), (4, "week3.confidence_unit_scale", "late", None, None, None)]
    v = spark.createDataFrame(rows, ddl)
    said = lambda d: [r["summary"].split("\n")[1:] for r in reporting.live_summary(d, ["i"]).collect()]
    empty = ["Top cause: unknown", "Commit: unknown", "Author: unknown", "Lineage traversal: week3.confidence_unit_scale", "First downstream hop: none", "Blast radius: none"]
    assert said(v) == [["Failing check: week3.confidence_unit_scale", "Field: ", *empty]]
    assert said(v.where("i < 3")) == [["Failing check: extracted_facts.confidence.drift", "Field: c", "Top cause: a.py", "Commit: c1", "Author: me", "Lineage traversal: extracted_facts.confidence.drift -> s -> t", "First downstream hop: s", "Blast radius: s, t"]]
    assert said(v.where("i = 1"))[0][0] == "Failing check: other" and said(v.limit(0)) == []
