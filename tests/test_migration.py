"""Adapters by pairs of versions against plain Python, record by record."""

import copy
import json
import random

import pytest

from tessera.operators import migration

RULES = [
    {"source_version": "0.8", "target_version": "0.9", "type": "field_rename", "from": "nm", "to": "name", "description": "a"},
    {"source_version": "0.8", "target_version": "0.9", "type": "type_coercion", "field": "n", "target_type": "integer", "description": "b"},
    {"source_version": "0.9", "target_version": "1.0", "type": "numeric_scaling", "field": "facts.conf", "factor": 0.01, "above": 1.0, "description": "c"},
    {"source_version": "0.9", "target_version": "1.0", "type": "field_rename", "from": "facts.txt", "to": "facts.text", "description": "d"},
    {"source_version": "0.9.0", "target_version": "1.0.0", "type": "default_value", "field": "tags", "value": [], "description": "e"},
    {"source_version": "0.9.0", "target_version": "1.0.0", "type": "default_value", "field": "meta.origin", "value": "old", "description": "f"},
    {"source_version": "2.0", "target_version": "1.0", "type": "enum_replace", "field": "name", "replace_values": ["x", "y"], "new_value": "z", "description": "g"},
    {"source_version": "2.0", "target_version": "1.0", "type": "remove_field", "field": "facts.text", "description": "h"},
    {"source_version": "2.0", "target_version": "1.0", "type": "optional_field", "field": "tags", "description": "i"},
    {"source_version": "2.0", "target_version": "1.0", "type": "version_normalize", "field": "build", "segments": 2, "description": "j"},
    {"source_version": "2.0", "target_version": "1.0", "type": "set_value", "field": "meta.origin", "value": "new", "description": "k"},
    {"source_version": "1.0", "target_version": "3.0", "type": "set_value", "field": "name", "value": "never", "description": "l"},
]
SCHEMA = "id int, schema_version string, nm string, name string, n string, facts array<struct<conf: double, txt: string, text: string>>, tags array<string>, meta struct<origin: string, k: int>, build string, `__x.y` int"


def rows():
    rng = random.Random(5)
    pick = lambda *x: rng.choice(x)
    out = []
    for i in range(400):
        facts = pick(None, [], [(pick(None, 0.5, 70.0), pick(None, "t"), pick(None, "u")) for _ in range(3)] + [None])
        out.append((i, pick(None, "", "0.8", "0.9.0", "1.0", "2", "2.0.0.1", "7.1"), pick(None, "a"), pick(None, "x", "q"), pick(None, "12.9", "-3.5", "no", "4"), facts, pick(None, [], ["a"]), pick(None, (None, 1), ("new", 2)), pick(None, "1.2.3", "1..2.", "4"), 1))
    return out + out[:5]


def by_hand(r):
    """The record after its chain, and what each rule changed."""
    r, ops = copy.deepcopy(r), []
    declared = r["schema_version"]
    at = migration.normal_version(declared) if declared is not None else "0.9.0" if any(f and f["conf"] is not None and f["conf"] > 1 for f in r["facts"] or []) else "1.0.0"
    for step in {"0.8.0": ["0.8.0", "0.9.0"], "0.9.0": ["0.9.0"], "2.0.0": ["2.0.0"]}.get(at, []):
        facts = [f for f in r["facts"] or [] if f]
        if step == "0.8.0":
            n = int(r["nm"] is not None and r["name"] is None)
            if n:
                r["name"], r["nm"] = r["nm"], None
            ops.append(("a", n))
            try:
                new = str(int(float(r["n"])))
            except (TypeError, ValueError):
                new = r["n"]
            ops.append(("b", int(new != r["n"])))
            r["n"] = new
        elif step == "0.9.0":
            hot = [f for f in facts if f["conf"] is not None and f["conf"] > 1]
            for f in hot:
                f["conf"] = round(f["conf"] * 0.01, 6)
            move = [f for f in facts if f["txt"] is not None and f["text"] is None]
            for f in move:
                f["text"], f["txt"] = f["txt"], None
            ops += [("c", len(hot)), ("d", len(move)), ("e", int(r["tags"] is None))]
            r["tags"] = r["tags"] if r["tags"] is not None else []
            m = r["meta"] or {"origin": None, "k": None}
            ops.append(("f", int(m["origin"] is None)))
            r["meta"] = {**m, "origin": m["origin"] if m["origin"] is not None else "old"}
        else:
            ops.append(("g", int(r["name"] in ("x", "y"))))
            r["name"] = "z" if r["name"] in ("x", "y") else r["name"]
            ops.append(("h", sum(f["text"] is not None for f in facts)))
            for f in facts:
                f["text"] = None
            ops.append(("i", int(r["tags"] is None)))
            parts = [p for p in (r["build"] or "").split(".") if p]
            ops.append(("j", int(len(parts) > 2)))
            r["build"] = ".".join(parts[:2]) if len(parts) > 2 else r["build"]
            m = r["meta"] or {"origin": None, "k": None}
            ops.append(("k", int(m["origin"] != "new")))
            r["meta"] = {**m, "origin": "new"}
    return at, r, [(d, n) for d, n in ops if n]


@pytest.fixture(scope="module")
def adapted(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    return df, migration.adapt(df, RULES, "1.0", heuristics=[("percent", "exists(facts, f -> f.conf > 1)", "0.9")])


def test_each_record_takes_its_own_chain(adapted):
    df, out = adapted
    assert out.columns == [*df.columns, "adaptation"]
    want = sorted((json.dumps(by_hand(r.asDict(True)), sort_keys=True) for r in df.collect()))
    got = []
    for r in out.collect():
        r = r.asDict(True)
        a = r.pop("adaptation")
        got.append(json.dumps((a["source_version"], r, [(o["description"], o["changed_values"]) for o in a["operations"]]), sort_keys=True))
    assert sorted(got) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("Exchange RoundRobin", "") and "Python" not in plan


def test_outcomes_and_log(adapted):
    df, out = adapted
    hand = [by_hand(r.asDict(True)) for r in df.collect()]
    got = migration.outcomes(out).collect()
    for r in got:
        assert r["attempted"] == (r["source_version"] != "1.0.0") and r["succeeded"] == (r["source_version"] != "7.1.0")
        assert (r["failure_reason"] != "") == (r["source_version"] == "7.1.0") and r["applied"] == r["fallback_succeeded"] == (r["changed"] > 0)
    for v in {h[0] for h in hand}:
        mine = [r for r in got if r["source_version"] == v]
        assert (sum(r["records"] for r in mine), sum(r["changed"] for r in mine)) == (sum(h[0] == v for h in hand), sum(h[0] == v and bool(h[2]) for h in hand))
    log = {(r["source_version"], r["description"]): (r["records"], r["changed_values"]) for r in migration.rule_log(out).collect()}
    want = {}
    for v, _, ops in hand:
        for d, n in ops:
            a, b = want.get((v, d), (0, 0))
            want[(v, d)] = (a + 1, b + n)
    assert log == want


def test_chains_rules_and_empty_tables(spark):
    step = lambda a, b, **k: {"source_version": a, "target_version": b, "type": "set_value", "field": "x", "value": 1, **k}
    rules = [step("1", "2"), step("2", "3"), step("1", "3"), step("3", "1"), step("0", "1"), step("5", "6")]
    assert migration.chains(rules, "3") == {"3.0.0": [], "1.0.0": [("1.0.0", "3.0.0")], "2.0.0": [("2.0.0", "3.0.0")], "0.0.0": [("0.0.0", "1.0.0"), ("1.0.0", "3.0.0")]}
    assert len(migration.rules_for("week5-event-records", [step("1", "2"), step("1.0", "2.0.0", description="again")])) == 3
    empty = spark.createDataFrame([], SCHEMA)
    out = migration.adapt(empty, RULES, "1.0")
    assert out.count() == migration.outcomes(out).count() == 0
    one = migration.majority_version(empty, "1").first()
    assert tuple(one) == ("1.0.0", "unknown", "default_expected_version")
    with pytest.raises(ValueError, match="taken"):
        migration.adapt(spark.createDataFrame([(1,)], "adaptation int"), RULES, "1.0")


def test_majority(spark):
    of = lambda *v: spark.createDataFrame([(x, 5) for x in v], "schema_version string, n int")
    heuristic = [("big", "n > 4", "2.0")]
    assert tuple(migration.majority_version(of("1.0", "2", "2.0.0", None), "1", heuristics=heuristic).first()) == ("2.0.0", "2.0.0", "payload_schema_version")
    assert tuple(migration.majority_version(of("3", "2"), "1").first())[0] == "2.0.0"
    assert tuple(migration.majority_version(of(None, None), "1", heuristics=heuristic).first()) == ("2.0.0", "unknown", "heuristic_big")
