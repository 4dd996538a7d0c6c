"""One-to-one renames of many contracts against the loop over each pair of contracts."""

import difflib
import random

from tessera.operators import evolution, renames
from tessera.plans.contract import Contract, FieldRule

SCHEMA = "contract_id string, field string, type string, format string, pattern string, enum array<string>, position int"


def test_equal_to_the_greedy_loop(spark):
    rng = random.Random(11)
    words = ["user", "name", "id", "total", "amount", "at", "created", "x", "ab", "ba", "customer", "key"]
    name = lambda: rng.choice([".", "_"]).join(rng.choice(words) for _ in range(rng.randint(1, 4)))
    removed, added, want = [], [], set()
    for c in range(120):
        sides = []
        for _ in range(2):
            sides.append({name(): FieldRule(rng.choice(["string", "string", "integer"]), format=rng.choice([None, None, "uuid"]), enum=rng.choice([None, None, ["a", "b"], ["a"]])) for _ in range(rng.randint(0, 12))})
        old, new = (Contract(f"c{c}", fields=s) for s in sides)
        want |= {(f"c{c}", a, b) for a, b in evolution.detect_renames(old, new).items()}
        for i, (n, r) in enumerate(old.fields.items()):
            if n not in new.fields:
                removed += [(f"c{c}", n, r.type, r.format, r.pattern, r.enum, i)] * 2
        for n, r in new.fields.items():
            if n not in old.fields:
                added.append((f"c{c}", n, r.type, r.format, r.pattern, r.enum, None))
    removed.append(("c1", None, "string", None, None, None, 0))
    got = renames.matched(spark.createDataFrame(removed, SCHEMA).repartition(3), spark.createDataFrame(added, SCHEMA).repartition(2)).collect()
    assert len(want) > 60 and len(got) == len(want)
    assert {tuple(r)[:3] for r in got} == want


def test_every_pair_that_scores_is_found(spark):
    """Without a common leaf or token: the rarest characters must meet."""
    rng = random.Random(12)
    names = lambda side: [f"{side}" + "".join(rng.choice("abcd_") for _ in range(rng.randint(1, 14))) for _ in range(120)]
    a, b = names("p"), names("q")
    table = lambda x: spark.createDataFrame([("c", n) for n in x], "contract_id string, field string")
    got = {(r["old_field"], r["new_field"]) for r in renames.scored(table(a), table(b)).collect()}
    assert got == {(x, y) for x in a for y in b if evolution.similarity(x, y) >= evolution.RENAME_LEAST}
    assert renames.matched(spark.createDataFrame([], "contract_id string, field string"), table(b)).count() == 0


def test_ratio_is_the_library_s():
    rng = random.Random(13)
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(0, longest)))
    for letters, longest in (("ab", 12), ("abcd_.1", 30), ("abcdefghij.", 60), ("ab.", 260)):
        for _ in range(1500 if longest < 100 else 60):
            a, b = word(), word()
            assert evolution.matching_ratio(a, b) == difflib.SequenceMatcher(None, a, b).ratio()
            assert evolution.similarity(a, b) <= evolution.similarity_bound(a, b)


def test_rows_and_rounds_agree(spark):
    """Groups matched as rows, by joins, or some by each: the same pairs. Before, all went by joins, in a round for each field."""
    rng = random.Random(14)
    name = lambda: "".join(rng.choice("abc.") for _ in range(rng.randint(1, 6)))
    rows = lambda: [(rng.choice(["p", "q", None]), name(), rng.choice(["s", None]), None, None, rng.choice([None, None, [], ["a", "b"], ["b", "a", "a"]]), rng.choice([None, 1, 2])) for _ in range(60)]
    unique = lambda x: list({r[:2]: r for r in x}.values())
    a, b = (spark.createDataFrame(unique(rows()), SCHEMA) for _ in range(2))
    got = [sorted(map(repr, renames.matched(a, b, direct=n).collect())) for n in (0, 60, 4096)]
    assert len(got[0]) > 20 and got[0] == got[1] == got[2]
