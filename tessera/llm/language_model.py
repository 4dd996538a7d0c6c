"""Stupid-backoff language-model scores of every document against the whole corpus.

Counts of word n-grams of order 1 to 3 are tables partitioned by the n-gram's hash. Each batch of documents asks
the tables for its distinct n-grams, adding its own counts, and is answered with the corpus totals, which are joined
to the n-grams of its documents again and summed for each document (see ``lookup``). Nothing is sampled or cut off;
what is moved grows with the distinct n-grams of the batches.

A document is scored by what the rest of the corpus says: its own occurrences are taken off every count first, or
each of its trigrams would vouch for itself. Logarithms are summed as whole millionths, so neither the order of
words nor the partitioning changes a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import lookup
from tessera.llm.words import Words, utf8, windows, words

ALPHA = 0.4
ORDERS = (1, 2, 3)
#: Bits of an n-gram's hash; of 10**13 distinct n-grams, one in 7,000 would meet another.
_KEY_BITS = 56
_MICRO = 1e6
_ASK = "bucket int, order int, batch int, keys binary, counts binary"
_ANSWER = "batch int, order int, bucket int, totals binary"


def _grams(w: Words, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions and keys of a batch's n-grams."""
    at, h = windows(w, order)
    return at, h >> np.uint64(64 - _KEY_BITS)


def _small(counts: np.ndarray) -> bytes:
    """Counts of a byte each; 255 stands for a larger one, given in full behind them."""
    large = counts[counts >= 255].astype(np.uint64)
    return np.uint32(len(counts)).tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes() + large.tobytes()


def _large(blob: bytes) -> np.ndarray:
    n = int(np.frombuffer(blob, np.uint32, 1)[0])
    counts = np.frombuffer(blob, np.uint8, n, 4).astype(np.int64)
    counts[counts == 255] = np.frombuffer(blob, np.uint64, offset=4 + n)
    return counts


def _own(key_index: np.ndarray, doc: np.ndarray, n_keys: int) -> np.ndarray:
    """For each occurrence, how often its own document has the same key."""
    _, back, count = np.unique(doc * max(1, n_keys) + key_index, return_inverse=True, return_counts=True)
    return count[back]


def lm_scores(docs: DataFrame, alpha: float = ALPHA, doc_id: str = "doc_id", text: str = "text", batch_bytes: int = lookup.BATCH_BYTES) -> DataFrame:
    """(doc_id, n_words long, log_score double), a row for each input row.

    ``log_score`` sums, over the words, ln of: count(w1 w2 w3) / count(w1 w2) if the rest of the corpus has the
    trigram, else alpha * count(w2 w3) / count(w2) if it has the bigram, else alpha**2 * count(w3) / all words, where
    the first word starts at the last of these and the second at the second, both without a factor. Counts leave the
    document itself out; a word that no other document has counts 1, and so does an empty rest. Words are as they
    stand (no folding). Null and empty texts have no words and score 0. Repeated rows count as documents of their
    own. Other columns are ignored; an empty table gives no rows.
    """
    source, buckets = lookup.batched(docs, doc_id, text, batch_bytes)
    id_type = source.schema["doc_id"].dataType.simpleString()

    def ask(key, rows):
        w, batch = words(*utf8(rows.column("text"))), key[0].as_py()
        copies = np.repeat(rows.column("copies").to_numpy(), np.diff(w.bounds))
        out = {"bucket": [0], "order": [0], "keys": [b""], "counts": [_small(np.array([copies.sum()]))]}
        for order in ORDERS:
            at, grams = _grams(w, order)
            keys, back, counts = np.unique(grams, return_inverse=True, return_counts=True)
            if len(copies) and copies.max() > 1:
                np.add.at(counts, back, copies[at] - 1)
            for b, s in lookup.runs(keys, buckets, _KEY_BITS).items():
                out["bucket"].append(b)
                out["order"].append(order)
                out["keys"].append(lookup.pack(keys[s]))
                out["counts"].append(_small(counts[s]))
        n = len(out["bucket"])
        return pa.table([pa.array(out["bucket"], pa.int32()), pa.array(out["order"], pa.int32()), pa.array([batch] * n, pa.int32()), pa.array(out["keys"], pa.binary()), pa.array(out["counts"], pa.binary())], ["bucket", "order", "batch", "keys", "counts"])

    def answer(key, rows):
        """Totals over all batches, in the order in which each batch asked; order 0 is the number of words."""
        bucket, order = (x.as_py() for x in key)
        counts = [_large(x) for x in rows.column("counts").to_pylist()]
        if order:
            runs = [lookup.unpack(x) for x in rows.column("keys").to_pylist()]
            _, back = np.unique(np.concatenate(runs), return_inverse=True)
        else:
            back = np.zeros(len(counts), np.int64)
        total = np.zeros(int(back.max()) + 1, np.int64)
        np.add.at(total, back, np.concatenate(counts))
        ends = np.cumsum([len(c) for c in counts])
        totals = [_small(total[back[e - len(c) : e]]) for c, e in zip(counts, ends, strict=True)]
        n = len(totals)
        return pa.table([rows.column("batch"), pa.array([order] * n, pa.int32()), pa.array([bucket] * n, pa.int32()), pa.array(totals, pa.binary())], ["batch", "order", "bucket", "totals"])

    def score(key, rows, answers):
        w = words(*utf8(rows.column("text")))
        n, lengths = len(w.hashes), np.diff(w.bounds)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        got = {(o, b): t for o, b, t in zip(*(answers.column(c).to_pylist() for c in ("order", "bucket", "totals")), strict=True)}
        everything = int(_large(got[0, 0])[0])
        counts = []
        for order in ORDERS:
            at, keys = _grams(w, order)
            distinct, back = np.unique(keys, return_inverse=True)
            total = np.zeros(len(distinct), np.int64)
            for b, s in lookup.runs(distinct, buckets, _KEY_BITS).items():
                total[s] = _large(got[order, b])
            here = np.zeros(n, np.int64)
            here[at] = total[back] - _own(back, doc[at], len(distinct))
            counts.append(here)
        one, two, three = counts
        place = np.arange(n) - w.bounds[:-1][doc] if n else np.zeros(0, np.int64)
        shift = lambda x, k: np.concatenate((np.zeros(min(k, n), np.int64), x[: max(0, n - k)]))
        tri, ctx2 = shift(three, 2), shift(two, 2)
        bi, ctx1 = shift(two, 1), shift(one, 1)
        p = np.maximum(one, 1) / np.maximum(everything - lengths[doc], 1)
        p = np.where(place >= 2, p * alpha * alpha, np.where(place == 1, p * alpha, p))
        has2 = (place >= 1) & (bi > 0)
        second = bi / np.maximum(ctx1, 1)
        p = np.where(has2, np.where(place >= 2, second * alpha, second), p)
        p = np.where((place >= 2) & (tri > 0), tri / np.maximum(ctx2, 1), p)
        micro = np.concatenate(([0], np.cumsum(np.rint(np.log(p) * _MICRO).astype(np.int64))))
        sums = np.diff(micro[w.bounds])
        return pa.table({"doc_id": rows.column("doc_id"), "n_words": pa.array(lengths, pa.int64()), "log_score": pa.array(sums / _MICRO, pa.float64()), "copies": rows.column("copies")})

    answers = source.groupBy("batch").applyInArrow(ask, _ASK).groupBy("bucket", "order").applyInArrow(answer, _ANSWER)
    return lookup.spread(source.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(score, f"doc_id {id_type}, n_words long, log_score double, copies long"))


def op2_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` against all the others."""
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
t AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS w3, w FROM d),
x AS (
  SELECT r, i, w3, CASE WHEN i > 1 THEN w[i - 1] END AS w2, CASE WHEN i > 1 THEN w[i - 1] || ' ' || w3 END AS b,
         CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] END AS b1, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] || ' ' || w3 END AS t FROM t),
y AS (
  SELECT r, i, count(*) OVER () AS everything, count(*) OVER (PARTITION BY r) AS mine,
         count(*) OVER (PARTITION BY w3) - count(*) OVER (PARTITION BY r, w3) AS c1,
         count(*) OVER (PARTITION BY b) - count(*) OVER (PARTITION BY r, b) AS c2,
         count(*) OVER (PARTITION BY t) - count(*) OVER (PARTITION BY r, t) AS c3, w2, b1 FROM x),
u AS (SELECT r, w3 AS k, count(*) AS n FROM x GROUP BY ALL), uu AS (SELECT k, sum(n)::BIGINT AS n FROM u GROUP BY k),
v AS (SELECT r, b AS k, count(*) AS n FROM x WHERE b IS NOT NULL GROUP BY ALL), vv AS (SELECT k, sum(n)::BIGINT AS n FROM v GROUP BY k),
z AS (
  SELECT y.*, uu.n - coalesce(u.n, 0) AS d1, vv.n - coalesce(v.n, 0) AS d2
  FROM y LEFT JOIN uu ON uu.k = w2 LEFT JOIN u ON u.k = w2 AND u.r = y.r LEFT JOIN vv ON vv.k = b1 LEFT JOIN v ON v.k = b1 AND v.r = y.r),
p AS (
  SELECT r, CASE
    WHEN i > 2 AND c3 > 0 THEN c3::DOUBLE / d2
    WHEN i > 2 AND c2 > 0 THEN c2::DOUBLE / d1 * 0.4::DOUBLE
    WHEN i = 2 AND c2 > 0 THEN c2::DOUBLE / d1
    WHEN i > 2 THEN greatest(c1, 1)::DOUBLE / greatest(everything - mine, 1) * 0.4::DOUBLE * 0.4::DOUBLE
    WHEN i = 2 THEN greatest(c1, 1)::DOUBLE / greatest(everything - mine, 1) * 0.4::DOUBLE
    ELSE greatest(c1, 1)::DOUBLE / greatest(everything - mine, 1) END AS p FROM z),
s AS (SELECT r, sum(round(ln(p) * 1000000.0::DOUBLE)::BIGINT)::BIGINT AS s FROM p GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(s.s, 0)::DOUBLE / 1000000.0::DOUBLE AS log_score FROM d LEFT JOIN s ON d.r = s.r
"""
