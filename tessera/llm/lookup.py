"""Counting keys over a whole corpus without moving a row for each occurrence.

Documents are dealt into batches by a hash of their content. Each batch sends every bucket of the key space that it
has keys of one packed, sorted run of its distinct keys; a bucket merges the runs and answers each batch in the order
of its run. A key that millions of documents share thus costs a bucket one entry for each batch, and the answers
return to the batch, which computes its own keys again. Batches and buckets are as many as the data asks for; runs
are never more than the distinct keys of the batches, however many buckets there are. A lost executor costs only the
tasks that it ran, since the same documents always form the same batch. Rows that repeat very often are one row of
so many copies, or all would fall into one batch.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import checkpointed

#: Bytes of text in a batch: what one Python task holds at a time.
BATCH_BYTES = 8 << 20
#: Equal rows beyond which they are held as one.
REPEATS = 64


def batches_for(docs: DataFrame, text: Column, batch_bytes: int = BATCH_BYTES) -> int:
    """How many batches the corpus needs; one scan of the text column."""
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return max(1, math.ceil(total / batch_bytes))


def batched(docs: DataFrame, doc_id: str, text: str, batch_bytes: int = BATCH_BYTES) -> tuple[DataFrame, int]:
    """(batch, doc_id, text, copies) under these very names, and the number of batches; other columns are dropped.

    Rows equal in doc_id and text that occur more than REPEATS times are one row of so many ``copies``; all others
    are rows of one copy. They are found by the hashes of all rows, of which one row is moved for each task.
    """
    t = docs[text].cast("string")
    n = batches_for(docs, t, batch_bytes)
    rows = docs.select(docs[doc_id].alias("doc_id"), t.alias("text"), F.xxhash64(docs[doc_id], t).alias("row"))
    often = checkpointed(rows.groupBy("row").agg(F.count("*").alias("n")).where(F.col("n") > REPEATS).select("row"))
    one = F.lit(1).cast("long").alias("copies")
    if often.isEmpty():
        source = rows.select("doc_id", "text", one)
    else:
        packed = rows.join(often, "row", "left_semi").groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
        source = rows.join(often, "row", "left_anti").select("doc_id", "text", one).unionByName(packed)
    batch = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")
    return source.select(batch.alias("batch"), "doc_id", "text", "copies"), n


def spread(result: DataFrame) -> DataFrame:
    """A row for each of a row's ``copies``, which column goes."""
    return result.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies")


def pack(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences of the fewest bytes that hold them all.

    The low bytes of a difference are noise and stay as they are; the top two are small numbers and get compressed.
    """
    if not len(keys):
        return b""
    gaps = np.diff(keys)
    width = max(2, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 2
    planes = gaps.view(np.uint8).reshape(-1, 8)
    top = zlib.compress(np.ascontiguousarray(planes[:, width - 2 : width].T).tobytes(), 1)
    return struct.pack("<BIQ", width, len(top), int(keys[0])) + top + planes[:, : width - 2].tobytes()


def unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    width, size, first = struct.unpack_from("<BIQ", blob)
    top = np.frombuffer(zlib.decompress(blob[13 : 13 + size]), np.uint8).reshape(2, -1)
    gaps = np.zeros((top.shape[1] + 1, 8), np.uint8)
    gaps[1:, width - 2 : width] = top.T
    gaps[1:, : width - 2] = np.frombuffer(blob, np.uint8, offset=13 + size).reshape(-1, width - 2) if width > 2 else 0
    out = gaps.view(np.uint64).ravel()
    out[0] = first
    return np.cumsum(out, dtype=np.uint64)


def runs(keys: np.ndarray, buckets: int, bits: int = 64) -> dict[int, slice]:
    """The stretch of each bucket that has any of the sorted keys; buckets are equal ranges of keys of so many bits."""
    if not len(keys):
        return {}
    of = (keys >> np.uint64(bits - 32)) * np.uint64(buckets) >> np.uint64(32)
    heads = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    return {b: slice(lo, hi) for b, lo, hi in zip(of[heads].tolist(), heads.tolist(), [*heads[1:].tolist(), len(keys)], strict=True)}


def occurring_elsewhere(rows: DataFrame, buckets: int, keys_of, finish, ddl: str) -> DataFrame:
    """``finish(rows, again)`` for each batch: whether each key of its rows occurs in any other row or once more in its own.

    ``rows`` have a column ``batch`` from 0; ``keys_of`` lists the 64-bit keys of an Arrow table of them, whose last
    bit doesn't count, and ``again`` is in their order.
    """
    last = np.uint64(1)

    def distinct(table: pa.Table):
        return np.unique(keys_of(table) & ~last, return_inverse=True, return_counts=True)

    def ask(key, table):
        keys, _, count = distinct(table)
        flagged, stretch = keys | (count > 1).astype(np.uint64), runs(keys, buckets)
        return pa.table([pa.array(list(stretch), pa.int32()), pa.array([key[0].as_py()] * len(stretch), pa.int32()), pa.array([pack(flagged[s]) for s in stretch.values()], pa.binary())], ["bucket", "batch", "keys"])

    def answer(key, table):
        asked = [unpack(x) for x in table.column("keys").to_pylist()]
        merged = np.concatenate(asked)
        _, back, count = np.unique(merged & ~last, return_inverse=True, return_counts=True)
        again = count > 1
        again[back[(merged & last) > 0]] = True
        ends = np.cumsum([len(r) for r in asked])
        bits = [np.packbits(again[back[e - len(r) : e]]).tobytes() for r, e in zip(asked, ends, strict=True)]
        return pa.table([table.column("batch"), pa.array([key[0].as_py()] * len(asked), pa.int32()), pa.array(bits, pa.binary())], ["batch", "bucket", "bits"])

    def apply(key, table, answers):
        keys, back, _ = distinct(table)
        stretch, again = runs(keys, buckets), np.zeros(len(keys), bool)
        for b, bits in zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True):
            s = stretch[b]
            again[s] = np.unpackbits(np.frombuffer(bits, np.uint8), count=s.stop - s.start)
        return finish(table, again[back])

    answers = rows.groupBy("batch").applyInArrow(ask, "bucket int, batch int, keys binary").groupBy("bucket").applyInArrow(answer, "batch int, bucket int, bits binary")
    return rows.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(apply, ddl)
