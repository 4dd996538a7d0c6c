"""Packing, spelling variants and lexical search against plain Python, with nulls, empty and long texts, ties, repeats,
empty tables and columns of clashing names."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import lexical_search, packing, spelling

public_tokenizers = pytest.importorskip("public_tokenizers")


def said():
    rng = random.Random(11)
    vocabulary = ["color", "colour", "colours", "collor", "señor", "senor", "Straße", "abcde", "abcdf", "bbcde", "The", "of", "über", "漢字", "x1", "don't", "naïve", "naive", "nave", "aaaaa", "aaaaaa", "aaaa"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 90)))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, " \n"), (None, rows[3][1]), (4, rows[4][1]), (4, rows[4][1]), (203, rows[5][1]), (204, "colour " * 3000 + "\t<|endoftext|>  end"), (205, "a\x00b  c \r\n d e\x1f"), (None, "señor of"), (206, "the abcde"), (207, "the abcde")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(said(), "doc_id long, text string").repartition(3, "text")
    return d.withColumns({c: F.lit("x") for c in ("word", "n", "run", "d", "q", "level", "shard", "rank", "score", "start", "id", "short")})


def test_ids_are_those_of_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, ours, rng = Tokenizer.from_file(path), packing.Encoder(path), random.Random(1)
    alphabet = [*"ab c  \n\t'sé漢12  .!,-　\x85\x1c\x0b\x0c \xa0 ​᠎﻿İß́\x00\x7f", "<|endoftext|>", "'ll", " the"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in ours.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_caches_are_bounded(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts, small = [f"one two w{i} three{i % 7}" for i in range(300)], packing.Encoder(path)
    want = packing.Encoder(path).encode(texts)
    monkeypatch.setattr(packing, "CACHE", 50)
    assert [small.encode([t])[0] for t in texts] == want and max(len(small.parts), len(small.words)) <= 50


def test_best_fit_decreasing():
    """The segment tree takes the same windows as a search through all open ones."""
    rng = random.Random(2)
    for _ in range(200):
        window = rng.choice([1, 7, 32, 100])
        sizes = [rng.randint(1, window) for _ in range(rng.randint(0, 60))]
        left = []
        for s in sorted(sizes, reverse=True):
            fits = [c for c in left if c >= s]
            if fits:
                left.remove(min(fits))
            left.append((min(fits) if fits else window) - s)
        bins = packing.best_fit(sizes, window)
        assert sorted(window - sum(sizes[i] for i in b) for b in bins) == sorted(left)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        packed = packing.fill(bins, sizes, window)
        lengths = [sum(e - b for _, b, e in p) for p in packed]
        assert all(n == window or n & (n - 1) == 0 for n in lengths) and sum(n == window for n in lengths) >= sum(sizes) // window
        parts = collections.defaultdict(list)
        for i, b, e in (x for p in packed for x in p):
            parts[i].append((b, e))
        for i, s in enumerate(sizes):
            ends = sorted(parts[i])
            assert ends[0][0] == 0 and ends[-1][1] == s and all(x[1] == y[0] for x, y in zip(ends, ends[1:], strict=False))


@pytest.mark.parametrize("window, group", [(1024, 4096), (64, 10)])
def test_packing(docs, window, group):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = packing.pack(docs, path, window=window, group=group).collect()
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        s.sort()
        assert all(o == sum(n for _, n in s[:k]) and n > 0 for k, (o, n) in enumerate(s))
        n = sum(n for _, n in s)
        assert n == window or (n < window and n & (n - 1) == 0)
    want = collections.Counter()
    for d, t in said():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.update((d, k, i) for k, i in enumerate(ids))
        assert any(r.doc_id == d and r.doc_tokens == len(ids) for r in rows)
    # every piece is checked against a document of its id whose ids have its checksum
    texts = collections.defaultdict(list)
    for d, t in said():
        texts[d].append([*library.encode(t or "", add_special_tokens=False).ids, 0])
    got = collections.Counter()
    for r in rows:
        ids = next(x for x in texts[r.doc_id] if len(x) == r.doc_tokens and zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32)
        got.update((r.doc_id, r.start + k, i) for k, i in enumerate(ids[r.start : r.start + r.length]))
    assert got == want
    assert packing.pack(docs.limit(0), path).count() == 0


def edit(a, b):
    return any(a == b[:i] + b[i + 1 :] for i in range(len(b))) or any(b == a[:i] + a[i + 1 :] for i in range(len(a))) or (len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1)


def variants(rows, least=3):
    n = collections.Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= least}
    form, near = {}, {}
    for w in n:
        others = [o for o in n if o != w and edit(w, o)]
        near[w] = len(others)
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], near[w], n.get(form[w])))
    return out


def test_spelling(docs, spark):
    got = [tuple(r) for r in spelling.spelling_variants(docs).collect()]
    assert sorted(got, key=repr) == sorted(variants(said()), key=repr) and any(r[1] for r in got)
    assert spelling.spelling_variants(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="factor"):
        spelling.spelling_variants(docs, factor=1)


@pytest.mark.parametrize("group", [256, 2])
def test_spelling_in_dense_vocabularies(spark, group):
    """Few letters, so that most words have many near ones and groups are divided to the last code point; counts in a chain."""
    rng = random.Random(5)
    vocabulary = sorted({"".join(rng.choice("abé") for _ in range(rng.choice([5, 6, 6, 7, 11]))) for _ in range(260)})
    rows = [(k, " ".join([w] * (3 * 2 ** (k % 6)))) for k, w in enumerate(vocabulary)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in spelling.spelling_variants(docs, group=group).collect()]
    assert sorted(got, key=repr) == sorted(variants(rows), key=repr)
    assert max(r[4] for r in got) > 5 and any(r[1] and r[2] != r[1] for r in got)


def test_one_edit():
    rng = random.Random(6)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 6))) for _ in range(2))
        assert spelling.one_edit(a, b) == (a != b and edit(a, b)), (a, b)


def ranked(rows, items, k):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    of = lambda t: term.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    docs = [(d, collections.Counter(of(t))) for d, t in rows if of(t)]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = collections.Counter(t for _, c in docs for t in c)
    out = []
    for i, text in items:
        scores = []
        for d, c in docs:
            m = 50 + 50 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2.0 * n + 2) / (2.0 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(of(text)) if c[t])
            if s > 0:
                scores.append((-s, d is None, d))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(i, r, d, -s) for r, (s, _, d) in enumerate(scores[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("k, block, shard", [(50, 4096, 4096), (3, 2, 5)])
def test_lexical_search(docs, spark, monkeypatch, k, block, shard):
    monkeypatch.setattr(lexical_search, "SHARD_DOCS", shard)
    items = [(1, "the COLOUR of naïve"), (2, "nothing here matches zzz"), (3, None), (4, ""), (None, "漢字 über"), (5, "abcde"), (5, "señor x1 x1"), (6, "don't"), (7, "end endoftext")]
    queries = spark.createDataFrame([*items, items[0]], "item_id long, text string").withColumn("q", F.lit("x"))
    found = lexical_search.rank_documents(docs, queries, k=k, block=block)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == ranked(said(), items, k)
    assert lexical_search.rank_documents(docs.limit(0), queries).count() == 0 and lexical_search.rank_documents(docs, queries.limit(0)).count() == 0


def test_search_in_rounds(spark, monkeypatch):
    """Many small shards: later rounds get floors; ties of equal texts go to the smallest ids."""
    monkeypatch.setattr(lexical_search, "SHARD_DOCS", 2)
    rng = random.Random(8)
    rows = [(1000 - i, " ".join(rng.choice(["a", "b", "c", "dd", "e"]) for _ in range(rng.randint(1, 6)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    index = lexical_search.index_documents(docs, [b"a"])
    assert index.select("level").distinct().count() > 1 and index.agg(F.sum("n_docs")).first()[0] == 300
    items = [(1, "a dd"), (2, "e"), (3, "c c b")]
    found = lexical_search.rank_documents(docs, spark.createDataFrame(items, "item_id long, text string"), k=7)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == ranked(rows, items, 7)


def test_bounds_save_work():
    """The search opens a part of the tree only, and still finds the best."""
    rng = np.random.default_rng(3)
    impacts = rng.integers(1, 1000, 4096)
    tree = lexical_search.MaxTree(np.array([1]), np.array([4096]), np.arange(4096), impacts, 4096)
    opened, push = [], lexical_search.heapq.heappush
    lexical_search.heapq.heappush, kept = (lambda h, x: (opened.append(x), push(h, x))), lexical_search.heapq.heappush
    try:
        found = tree.best(np.array([1]), np.array([2]), 5, 1)
    finally:
        lexical_search.heapq.heappush = kept
    best = np.sort(2 * impacts)[::-1]
    assert [s for s, _ in found[:5]] == best[:5].tolist() and len(found) == (2 * impacts >= best[4]).sum() and len(opened) < 1000
