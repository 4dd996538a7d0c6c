"""Substring deduplication with fixed-block anchors.

Every document is cut into non-overlapping reference blocks of ``(window + 1) // 2`` words, and every rolling
window of that many words, of every document, probes the index of these blocks. Any stretch of ``window`` words
fully holds exactly one reference block of its own document, so a stretch that occurs twice always shows as a
block of its own which some other position hits. Hits are then extended to ``window`` words, and runs of
extended hits to maximal exact repeats, which are removed wherever they occur.

Index and probes meet as packed runs of distinct hashes (see ``lookup``): no pair of occurrences is ever formed,
so a passage of a million copies costs as much as one of two. Probe hashes have 62 bits and only nominate;
extended stretches are compared by 96 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import lookup
from tessera.llm.words import Words, utf8, windows, words

_LOW = np.uint64(3)


def _repeated(w: Words, copies: np.ndarray, at: np.ndarray, back: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Which of the distinct keys occur twice or more in the batch, those of a row of many copies among them."""
    twice = count > 1
    if len(at) and copies.max() > 1:
        twice[back[np.repeat(copies > 1, np.diff(w.bounds))[at]]] = True
    return twice


def _probes(w: Words, copies: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys of all rolling blocks with two flags in the low bits (1: a reference block, 2: twice
    or more in the batch), and for each reference block its position and its index among the keys."""
    at, h = windows(w, block)
    start = np.repeat(w.bounds[:-1], np.diff(w.bounds))[at]
    ref = (at - start) % block == 0
    key = h & ~_LOW
    distinct, back, count = np.unique(key, return_inverse=True, return_counts=True)
    flags = _repeated(w, copies, at, back, count).astype(np.uint64) << np.uint64(1)
    flags[back[ref]] |= np.uint64(1)
    return distinct, flags, at[ref], back[ref]


def _runs(batch: int, keys: np.ndarray, buckets: int, *more: np.ndarray) -> dict[str, list]:
    """A row for each bucket: its run of keys and what goes along with them."""
    stretch = lookup.runs(keys, buckets)
    return {"bucket": list(stretch), "batch": [batch] * len(stretch), "keys": [lookup.pack(keys[s]) for s in stretch.values()], "more": [b"".join(x[s].tobytes() for x in more) for s in stretch.values()]}


_ASK = "bucket int, batch int, keys binary, more binary"
_ANSWER = "batch int, step int, bucket int, bits binary"


def _table(columns: dict[str, list], ddl: str) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
    return pa.table({k: pa.array(columns[k], kinds[kind]) for k, kind in (x.split() for x in ddl.split(", "))})


def _bits(rows: pa.Table, step: int, lengths: dict[int, int]) -> dict[int, np.ndarray]:
    """The answers of one step by bucket."""
    out = {}
    for s, b, bits in zip(*(rows.column(c).to_pylist() for c in ("step", "bucket", "bits")), strict=True):
        if s == step:
            out[b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=lengths[b]).astype(bool)
    return out


def _copies(rows: pa.Table) -> np.ndarray:
    return rows.column("copies").to_numpy()


def dedup_substrings(docs: DataFrame, window: int = 35, doc_id: str = "doc_id", text: str = "text", batch_bytes: int = lookup.BATCH_BYTES) -> DataFrame:
    """Remove every word that a repeated stretch of ``window`` words covers.

    Returns (doc_id, n_words long, n_removed long, kept_text string), a row for each input row; kept words are
    joined by one space. All occurrences of a repeat go, the first included, and repeats are judged on the input.
    Null and empty texts have no words and give an empty text. Null and repeated doc_ids are kept as they are:
    a repeated row repeats its own words. Texts shorter than ``window`` words are never touched. Other columns,
    whatever their names, are ignored. A single text is held by one task as a whole.
    """
    if window < 2:
        raise ValueError("window must be at least 2 words")
    block = (window + 1) // 2
    source, buckets = lookup.batched(docs, doc_id, text, batch_bytes)
    id_type = source.schema["doc_id"].dataType.simpleString()

    def ask_blocks(key, rows):
        distinct, flags, _, _ = _probes(words(*utf8(rows.column("text"))), _copies(rows), block)
        return _table(_runs(key[0].as_py(), distinct | flags, buckets), _ASK)

    def answer_blocks(key, rows):
        """A reference block is hit if its words occur anywhere else; bits go back for each batch's own blocks."""
        runs = [lookup.unpack(x) for x in rows.column("keys").to_pylist()]
        merged = np.concatenate(runs)
        order = np.argsort(merged, kind="stable")
        s = merged[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] ^ s[:-1]) > _LOW
        group = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        hit = (np.diff(np.append(heads, len(s))) > 1) | (np.bitwise_or.reduceat(s & _LOW, heads) >= 2)
        back = np.empty(len(s), bool)
        back[order] = hit[group]
        ends = np.cumsum([len(r) for r in runs])
        bits = [np.packbits(back[e - len(r) : e][(r & np.uint64(1)) > 0]).tobytes() for r, e in zip(runs, ends, strict=True)]
        return _table({"batch": rows.column("batch").to_pylist(), "step": [1] * len(runs), "bucket": [key[0].as_py()] * len(runs), "bits": bits}, _ANSWER)

    def stretches(w: Words, copies: np.ndarray, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Positions of stretches whose own reference block is hit; their distinct 96-bit hashes; index of each."""
        distinct, flags, ref_at, ref_key = _probes(w, copies, block)
        own = (flags & np.uint64(1)) > 0
        hit = np.zeros(len(distinct), bool)
        parts = {b: np.flatnonzero(own[s]) + s.start for b, s in lookup.runs(distinct, buckets).items()}
        for b, bits in _bits(answers, 1, {b: len(p) for b, p in parts.items()}).items():
            hit[parts[b]] = bits
        n = len(w.hashes)
        hit_at = np.zeros(n + block, bool)
        hit_at[ref_at] = hit[ref_key]
        at, h1 = windows(w, window)
        start = np.repeat(w.bounds[:-1], np.diff(w.bounds))[at]
        near = hit_at[at + (start - at) % block]
        at, h1, h2 = at[near], h1[near], windows(w, window, 1)[1][near].astype(np.uint32)
        order = np.lexsort((h2, h1))
        s1, s2 = h1[order], h2[order]
        new = np.ones(len(s1), bool)
        new[1:] = (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])
        index = np.empty(len(at), np.int64)
        index[order] = np.cumsum(new) - 1
        count = np.diff(np.append(np.flatnonzero(new), len(s1)))
        return at, s1[new], s2[new], _repeated(w, copies, at, index, count), index

    def ask_stretches(key, rows, answers):
        """The answers so far travel along, as rows without keys, since the removal needs both."""
        _, h1, h2, twice, _ = stretches(words(*utf8(rows.column("text"))), _copies(rows), answers)
        out = _runs(key[0].as_py(), h1, buckets, h2, twice.astype(np.uint8))
        for b, bits in zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True):
            for column, x in zip(("bucket", "batch", "keys", "more"), (b, key[0].as_py(), b"", bits), strict=True):
                out[column].append(x)
        return _table(out, _ASK)

    def answer_stretches(key, rows):
        asks = rows.to_pylist()
        along = [x for x in asks if not x["keys"]]
        passed = {"batch": [x["batch"] for x in along], "step": [1] * len(along), "bucket": [x["bucket"] for x in along], "bits": [x["more"] for x in along]}
        asks = [x for x in asks if x["keys"]]
        if not asks:
            return _table(passed, _ANSWER)
        runs, more = [lookup.unpack(x["keys"]) for x in asks], [x["more"] for x in asks]
        h1 = np.concatenate(runs)
        h2 = np.concatenate([np.frombuffer(x, np.uint32, len(r)) for x, r in zip(more, runs, strict=True)])
        twice = np.concatenate([np.frombuffer(x, np.uint8, len(r), 4 * len(r)) for x, r in zip(more, runs, strict=True)])
        order = np.lexsort((h2, h1))
        s1, s2 = h1[order], h2[order]
        new = np.ones(len(s1), bool)
        new[1:] = (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])
        heads = np.flatnonzero(new)
        hit = (np.diff(np.append(heads, len(s1))) > 1) | (np.maximum.reduceat(twice[order], heads) > 0)
        back = np.empty(len(s1), bool)
        back[order] = hit[np.cumsum(new) - 1]
        ends = np.cumsum([len(r) for r in runs])
        bits = [np.packbits(back[e - len(r) : e]).tobytes() for r, e in zip(runs, ends, strict=True)]
        answered = {"batch": [x["batch"] for x in asks], "step": [2] * len(runs), "bucket": [key[0].as_py()] * len(runs), "bits": bits}
        return _table({k: answered[k] + passed[k] for k in answered}, _ANSWER)

    def remove(key, rows, answers):
        raw, offsets = utf8(rows.column("text"))
        w = words(raw, offsets, spans=True)
        n = len(w.hashes)
        at, h1, _, _, index = stretches(w, _copies(rows), answers)
        stretch, repeated = lookup.runs(h1, buckets), np.zeros(len(h1), bool)
        for b, bits in _bits(answers, 2, {b: s.stop - s.start for b, s in stretch.items()}).items():
            repeated[stretch[b]] = bits
        edge = np.zeros(n + 1, np.int64)
        begin = at[repeated[index]] if len(at) else at
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        kept = np.flatnonzero(~gone)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(w.bounds))
        first = np.ones(len(kept), bool)
        first[1:] = row[kept[1:]] != row[kept[:-1]]
        out, show = raw.copy(), np.zeros(len(raw) + 1, np.int8)
        np.add.at(show, w.starts[kept], 1)
        np.add.at(show, w.ends[kept], -1)
        mask = np.cumsum(show[:-1], dtype=np.int8) > 0
        glue = w.starts[kept[~first]] - 1
        out[glue], mask[glue] = 0x20, True
        lengths = np.concatenate(([0], np.cumsum(mask)))[offsets]
        n_words = np.diff(w.bounds)
        removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[w.bounds])
        texts = pa.LargeStringArray.from_buffers(len(n_words), pa.py_buffer(lengths.astype(np.int64).tobytes()), pa.py_buffer(out[mask].tobytes()))
        return pa.table({"doc_id": rows.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": texts.cast(pa.string()), "copies": rows.column("copies")})

    first = source.groupBy("batch").applyInArrow(ask_blocks, _ASK).groupBy("bucket").applyInArrow(answer_blocks, _ANSWER)
    asked = source.groupBy("batch").cogroup(first.groupBy("batch")).applyInArrow(ask_stretches, _ASK)
    second = asked.groupBy("bucket").applyInArrow(answer_stretches, _ANSWER)
    return lookup.spread(source.groupBy("batch").cogroup(second.groupBy("batch")).applyInArrow(remove, f"doc_id {id_type}, n_words long, n_removed long, kept_text string, copies long"))


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Whole ``documents``: doc_id, n_words, n_removed and the digest of the kept words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = dedup_substrings(docs, window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
s AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS s FROM p),
hit AS (SELECT r, i FROM s QUALIFY count(*) OVER (PARTITION BY s) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM hit),
kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n
  FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
