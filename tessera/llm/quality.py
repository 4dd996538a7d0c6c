"""A byte-level convolutional quality classifier, trained and applied with numpy.

A text is cut into chunks of 256 bytes that overlap by half and cover it whole. Learned filters of five bytes slide
over each chunk and keep their maxima. A dense layer turns these into hidden features, which are max-pooled over all
chunks of the document, and a logistic unit makes one probability of them.

Fitting takes a bounded sample of labelled rows on the driver. Scoring streams Arrow batches through the tasks;
a batch is worked off in slices of whole documents, and long documents in slices of whole chunks. Sums are taken in
one fixed order, so a text's score doesn't depend on the texts beside it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import utf8

WIDTH, HALF = 5, 128
#: Labelled rows that a network is trained on at most.
SAMPLE_ROWS = 3000
_SLICE, _STEP = 1 << 19, 64


@dataclass
class Network:
    filters: np.ndarray  # (WIDTH, 256, n_filters)
    bias: np.ndarray
    dense: np.ndarray  # (n_filters, hidden)
    dense_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.filters, self.bias, self.dense, self.dense_bias, self.out, self.out_bias]


def start(n_filters: int, hidden: int, seed: int) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    filters = draw(WIDTH, 256, n_filters, scale=0.4)
    filters[:, 0] = 0  # padding
    return Network(filters, np.zeros(n_filters, np.float32), draw(n_filters, hidden, scale=0.25), np.zeros(hidden, np.float32), draw(hidden, scale=0.3), np.zeros(1, np.float32))


def _padded(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts padded to whole half chunks, the first half chunk of each, and the real bytes in each half chunk.

    A text is followed by padding that its last filter positions reach into, never by the next text.
    """
    size = np.diff(at)
    halves = -(-(size + WIDTH - 1) // HALF)
    first = np.concatenate(([0], np.cumsum(halves)))
    flat = np.zeros(first[-1] * HALF + WIDTH - 1, np.uint8)
    put = np.arange(at[-1] - at[0]) + np.repeat(first[:-1] * HALF - (at[:-1] - at[0]), size)
    flat[put] = raw[at[0] : at[-1]]
    place = np.arange(first[-1]) - np.repeat(first[:-1], halves)
    filled = np.clip(np.repeat(size, halves) - place * HALF, 0, HALF)
    return flat, first, filled


def _convolve(net: Network, flat: np.ndarray, halves: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Filter responses (half chunk, place, filter) of the given half chunks; those that begin in padding are 0, as of
    padding alone. ``filled``: the real bytes of these half chunks."""
    at = (halves[:, None] * HALF + np.arange(HALF)).ravel()
    total, more = np.empty((2, len(at), net.bias.size), np.float32)
    np.take(net.filters[0], flat[at], axis=0, out=total, mode="clip")
    for j in range(1, WIDTH):
        np.take(net.filters[j], flat[at + j], axis=0, out=more, mode="clip")
        total += more
    total = total.reshape(len(halves), HALF, -1)
    for h in np.flatnonzero(filled < HALF):
        total[h, filled[h] :] = 0
    return total


def _maxima(net: Network, flat: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """The greatest response of each filter in each half chunk, with its bias."""
    out = np.empty((len(filled), net.bias.size), np.float32)
    for h in range(0, len(filled), _STEP):
        some = np.arange(h, min(h + _STEP, len(filled)))
        top = _convolve(net, flat, some, filled[some])
        while top.shape[1] > 1:  # a maximum of halves is quicker than one over an axis
            half = top.shape[1] // 2
            top = np.maximum(top[:, :half], top[:, half:])
        out[some] = top[:, 0] + net.bias
    return out


def _pairs(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks as two adjacent half chunks (twice the same for a text of one), and the first chunk of each text."""
    halves = np.diff(first)
    chunks = np.maximum(1, halves - 1)
    begin = np.concatenate(([0], np.cumsum(chunks)))
    left = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], chunks)
    right = left + np.repeat((halves > 1).astype(np.int64), chunks)
    return left, right, begin


def _weighed(x: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """``x @ weights + bias``, each sum in the order of the features; a matrix product's order varies with the rows."""
    out = np.repeat(bias[None, :], len(x), axis=0)
    for j in range(len(weights)):
        out += x[:, j, None] * weights[j]
    return out


def _probability(net: Network, pooled: np.ndarray) -> np.ndarray:
    logit = _weighed(pooled, net.out[:, None], net.out_bias)[:, 0]
    return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -60, 60)))


def probabilities(net: Network, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The score of each text; memory is bounded by the slice but for one text's own chunks."""
    out, row = np.empty(len(at) - 1), 0
    while row < len(at) - 1:
        last = max(row + 1, int(np.searchsorted(at, at[row] + _SLICE, side="right")) - 1)
        flat, first, filled = _padded(raw, at[row : last + 1])
        maxima = _maxima(net, flat, filled)
        left, right, begin = _pairs(first)
        hidden = np.maximum(0, _weighed(np.maximum(0, np.maximum(maxima[left], maxima[right])), net.dense, net.dense_bias))
        out[row:last] = _probability(net, np.maximum.reduceat(hidden, begin[:-1], axis=0))
        row = last
    return out


def train(texts: list[bytes], labels: list[int], n_filters: int = 24, hidden: int = 16, epochs: int = 12, batch: int = 32, rate: float = 4e-3, seed: int = 7, steps: int = 400) -> Network:
    """Fit by Adam on the logistic loss, both labels weighing the same; small samples are gone over until ``steps``
    updates are made. Of one label only, the score is constant."""
    net = start(n_filters, hidden, seed)
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        net.out[:] = 0
        net.out_bias[:] = 0 if not len(y) else (6 if y[0] else -6)
        return net
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parts()]
    rng, step = np.random.default_rng(seed), 0
    epochs = max(epochs, -(-steps * batch // len(y)))
    for epoch in range(epochs):
        pace = rate * (1 - epoch / epochs) + 2e-4
        order = rng.permutation(len(y))
        for some in range(0, len(order), batch):
            these = order[some : some + batch]
            raw = np.frombuffer(b"".join(texts[i] for i in these), np.uint8)
            at = np.concatenate(([0], np.cumsum([len(texts[i]) for i in these])))
            step += 1
            for p, (m, v), g in zip(net.parts(), moments, _gradient(net, raw, at, y[these], weight[these]), strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def _gradient(net: Network, raw: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    flat, first, filled = _padded(raw, at)
    n_filters, maxima = net.bias.size, _maxima(net, flat, filled)
    left, right, begin = _pairs(first)
    x = np.maximum(0, np.maximum(maxima[left], maxima[right]))
    pre = _weighed(x, net.dense, net.dense_bias)
    pooled, chosen = np.empty((len(y), pre.shape[1]), np.float32), np.empty((len(y), pre.shape[1]), np.int64)
    for i in range(len(y)):
        chosen[i] = pre[begin[i] : begin[i + 1]].argmax(axis=0) + begin[i]
        pooled[i] = np.maximum(0, pre[chosen[i], np.arange(pre.shape[1])])
    d = (weight * (_probability(net, pooled) - y) / len(y)).astype(np.float32)
    d_pooled = d[:, None] * net.out * (pooled > 0)
    d_pre = np.zeros_like(pre)
    np.add.at(d_pre, (chosen, np.broadcast_to(np.arange(pre.shape[1]), chosen.shape)), d_pooled)
    used = np.flatnonzero(d_pre.any(axis=1))  # chunks that any hidden feature was taken from
    chunk, f = np.nonzero((d_top := (d_pre[used] @ net.dense.T) * (x[used] > 0)))
    g, chunk = d_top[chunk, f], used[chunk]
    half = np.where(maxima[left[chunk], f] >= maxima[right[chunk], f], left[chunk], right[chunk])
    halves, back = np.unique(half, return_inverse=True)
    where = np.concatenate([np.zeros((0, n_filters), np.int64), *[_convolve(net, flat, some, filled[some]).argmax(axis=1) for some in (halves[i : i + _STEP] for i in range(0, len(halves), _STEP))]])
    pos = half * HALF + where[back, f]
    d_filters = np.stack([np.bincount(flat[pos + j].astype(np.int64) * n_filters + f, g, 256 * n_filters) for j in range(WIDTH)]).reshape(net.filters.shape).astype(np.float32)
    d_filters[:, 0] = 0
    return [d_filters, np.bincount(f, g, n_filters).astype(np.float32), x.T @ d_pre, d_pre.sum(axis=0), pooled.T @ d, d.sum(keepdims=True)]


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS, **how) -> Network:
    """Train on at most ``rows`` labelled rows that are not held out, those of the smallest hashed ids, whole texts.

    Null labels, ids and texts are left out; a doc_id labelled twice counts twice. Only texts and labels reach the
    network. Without labelled rows of both labels, scores are constant.
    """
    known = labels.select(labels[doc_id].alias("__id"), labels[label].cast("int").alias("__label"))
    known = known.where(F.col("__id").isNotNull() & F.col("__label").isin(0, 1) & ~held_out(F.col("__id")))
    known = known.orderBy(F.xxhash64("__id"), "__id", "__label").limit(rows)
    texts = docs.select(docs[doc_id].alias("__doc"), docs[text].cast("string").alias("__text")).where("__text IS NOT NULL")
    found = texts.join(F.broadcast(known), F.col("__doc") == F.col("__id")).select("__id", "__text", "__label")
    found = found.orderBy(F.xxhash64("__id"), "__id", "__label", F.xxhash64("__text")).limit(rows).collect()
    found.sort(key=lambda r: (str(r["__id"]), r["__text"], r["__label"]))
    return train([r["__text"].encode() for r in found], [r["__label"] for r in found], **how)


def score(docs: DataFrame, net: Network, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] | None = None, into: str = "score") -> DataFrame:
    """(doc_id, score double), a row for each input row; or the columns in ``keep`` and the score under the name ``into``.

    The score is between 0 and 1, higher where label 1 is likelier, from every byte of the text. Null and empty
    texts get the score of a chunk without bytes. Equal texts score the same, whatever rows stand beside them.
    """
    kept = [docs[doc_id].alias("doc_id")] if keep is None else [docs[c] for c in keep]
    names = ["doc_id"] if keep is None else list(keep)
    body = text if text in names and keep is not None else "__text"  # a text that is kept goes through the tasks once
    chosen = docs.select(*kept, *([] if body == text else [docs[text].cast("string").alias("__text")]))
    out = ", ".join(f"`{n}` {chosen.schema[n].dataType.simpleString()}" for n in names) + f", `{into}` double"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = probabilities(net, *utf8(batch.column(body)))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(p, pa.float64())], [*names, into])

    return chosen.mapInArrow(apply, out)


THRESHOLD = 0.7


def op4_quality(spark, sf_dir: str) -> DataFrame:
    """Every text of ``documents``, scored by a network fitted on ``labels.quality``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, net)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
