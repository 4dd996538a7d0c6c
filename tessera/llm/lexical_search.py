"""Ranked lexical search: max trees over document ranges, searched best first by bounds on whole ranges.

Queries are taken in blocks bounded in bytes, whose terms are shipped to all tasks. One pass over the texts deals
documents, as they come, into shards bounded in bytes and documents, and writes each shard's postings of the block's
terms, the lengths of its documents and their number to the shared folder; the statistics of the corpus are sums over
shards. A shard then gets a tree for each term: its leaves are the term's impacts on documents, a node is the highest
impact in a range of FANOUT nodes below, and nodes without the term aren't stored. The bound of a range for a query is
the sum of its terms' weighted maxima, and at a leaf it is the score. The search opens the range of the highest bound
until it has k documents and no bound reaches the k-th score; ranges of an equal bound are opened too, since they can
hold ties.

Shards are searched in rounds of about FANOUT times as many each, by the number of trailing zeros of a hash. A round
knows the k-th score of those before it, so it opens only ranges that reach this floor, and returns about
k * FANOUT rows for each query, however many shards there are.
"""

from __future__ import annotations

import heapq
import re
import uuid
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import checkpoint_dir, checkpointed
from tessera.llm.words import mix, utf8

#: Maximal runs of letters and digits of ASCII and of anything beyond it, after ASCII letters were lower-cased.
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
FANOUT = 16
#: Text bytes and documents of a shard; text bytes and number of the queries of a block.
SHARD_BYTES, SHARD_DOCS = 8 << 20, 4096
BLOCK_BYTES, BLOCK_QUERIES = 16 << 20, 4096
_INDEX = "shard long, level int, n_docs long, n_terms long, terms array<int>, df array<int>, ids binary, known binary, lengths binary, docs binary, tf binary"


def terms_of(text: bytes) -> list[bytes]:
    """All terms of a text in UTF-8, in order, repeats included."""
    return _TERM.findall(text.lower())


def index_documents(docs: DataFrame, terms: list[bytes], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Shards of documents with the postings of ``terms``, numbered from 1 as given.

    Columns: shard, level (how many of the lowest hexadecimal digits of its hash are zero), n_docs, n_terms (all terms
    of its documents), terms and df (those that it holds and in how many documents), and packed: ids, known (whether
    there is an id), lengths, and the postings by term and document. Documents without a term are left out.
    """
    shipped = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms, 1)})

    def shard(number, ids, known, lengths, hits):
        found = [x for x in hits if len(x[1])]
        of = np.repeat(np.array([i for i, _ in found], np.int64), [len(x) for _, x in found]) if found else np.zeros(0, np.int64)
        keys, tf = np.unique(np.concatenate([x for _, x in found]).astype(np.int64) << 32 | of, return_counts=True) if found else (of, of)
        held, df = np.unique(keys >> 32, return_counts=True)
        key = np.array([TaskContext.get().partitionId() << 32 | number], np.uint64)
        z = int(mix(key)[0])
        level = min(15, ((z & -z).bit_length() - 1) // 4) if z else 15
        packed = [np.array(ids, np.int64), np.array(known, bool), np.array(lengths, np.int64), (keys & 0xFFFFFFFF).astype(np.uint32), tf.astype(np.uint32)]
        row = [[int(key[0])], [level], [len(ids)], [sum(lengths)], [held.astype(np.int32)], [df.astype(np.int32)], *[[x.tobytes()] for x in packed]]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.binary()] * 5]
        names = [c.split()[0] for c in _INDEX.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names)

    def build(batches):
        number, size, ids, known, lengths, hits = 0, 0, [], [], [], []
        get = shipped.value.get
        for batch in batches:
            raw, at = utf8(batch.column("text"))
            for i, d in enumerate(batch.column("doc_id").to_pylist()):
                words = terms_of(raw[at[i] : at[i + 1]].tobytes())
                if not words:
                    continue
                found = np.fromiter(map(get, words, repeat(0)), np.int32, len(words))
                hits.append((len(ids), found[found > 0]))
                ids.append(d or 0)
                known.append(d is not None)
                lengths.append(len(words))
                size += int(at[i + 1] - at[i])
                if size >= SHARD_BYTES or len(ids) >= SHARD_DOCS:
                    yield shard(number, ids, known, lengths, hits)
                    number, size, ids, known, lengths, hits = number + 1, 0, [], [], [], []
        if ids:
            yield shard(number, ids, known, lengths, hits)

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(build, _INDEX)


class MaxTree:
    """Trees of all terms of a shard; ``best`` searches them for a query's terms at once."""

    def __init__(self, terms: np.ndarray, df: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_docs: int):
        self.terms, self.n_docs, self.keys, self.blocks, self.nodes = terms, n_docs, [], [], [n_docs]
        term, node, value = np.repeat(np.arange(len(terms)), df), docs.astype(np.int64), impacts
        while True:
            above = -(-self.nodes[-1] // FANOUT)
            key = term * above + node // FANOUT
            head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            block = np.zeros((len(head), FANOUT), np.int64)
            block[np.repeat(np.arange(len(head)), np.diff(np.append(head, len(key)))), node % FANOUT] = value
            self.keys.append(key[head])
            self.blocks.append(block)
            self.nodes.append(above)
            if above == 1:
                return
            term, node, value = term[head], node[head] // FANOUT, block.max(axis=1)

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: int) -> list[tuple[int, int]]:
        """(score, document) of the k best with a score of ``floor`` or above, and of all that equal the k-th."""
        at = np.searchsorted(self.terms, terms)
        there = at < len(self.terms)
        there[there] = self.terms[at[there]] == terms[there]
        at, weights, floor = at[there], weights[there], max(1, floor)
        found, heap = [], [(-np.iinfo(np.int64).max, len(self.keys), 0)] if len(at) else []
        while heap and -heap[0][0] >= floor:
            bound, level, node = heapq.heappop(heap)
            if level == 0:
                found.append((-bound, node))
                if len(found) == k:
                    floor = max(floor, -bound)
                continue
            keys, wanted = self.keys[level - 1], at * self.nodes[level] + node
            row = np.searchsorted(keys, wanted)
            hit = row < len(keys)
            hit[hit] = keys[row[hit]] == wanted[hit]
            bounds = weights[hit] @ self.blocks[level - 1][row[hit]]
            for child in np.flatnonzero(bounds >= floor).tolist():
                heapq.heappush(heap, (-int(bounds[child]), level - 1, node * FANOUT + child))
        return found


def _weights(df: dict[int, int], n: int) -> dict[int, int]:
    return {t: int(np.floor(1000 * np.log((2.0 * n + 2) / (2.0 * d + 1)))) for t, d in df.items()}


def _search_block(docs: DataFrame, texts: list[bytes], k: int, doc_id: str, text: str, path: str) -> DataFrame:
    """(q, doc_id, score, rank) of a block of queries, written to the shared folder."""
    spark = docs.sparkSession
    asked = [sorted(set(terms_of(t))) for t in texts]
    number = {t: i for i, t in enumerate(sorted({t for q in asked for t in q}), 1)}
    index_documents(docs, list(number), doc_id, text).write.partitionBy("level").parquet(path)
    index = spark.read.schema(_INDEX).parquet(path)
    n, total = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    spread = index.select(F.explode(F.arrays_zip("terms", "df")).alias("p")).groupBy("p.terms").agg(F.sum("p.df").alias("df"))
    weight = _weights({r.terms: r.df for r in spread.toLocalIterator()}, n or 0)
    queries = []
    for q in asked:
        held = np.array([number[t] for t in q if weight.get(number[t], 0) > 0], np.int64)
        queries.append((held, np.array([weight[t] for t in held.tolist()], np.int64)))
    best, order = None, Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    for level in sorted((r.level for r in index.select("level").distinct().collect()), reverse=True):
        floors = dict(best.where(F.col("rank") == k).select("q", "score").collect()) if best is not None else {}
        shipped = spark.sparkContext.broadcast((queries, floors, n, total))

        def search(batches):
            queries, floors, n, total = shipped.value
            for batch in batches:
                for r in batch.to_pylist():
                    ids, known, lengths = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["known"], bool), np.frombuffer(r["lengths"], np.int64)
                    of, tf, df = np.frombuffer(r["docs"], np.uint32), np.frombuffer(r["tf"], np.uint32).astype(np.int64), np.array(r["df"], np.int64)
                    m = 50 + 50 * lengths * n // total
                    tree = MaxTree(np.array(r["terms"], np.int64), df, of, 1_000_000_000 * tf // (1000 * tf + 20 * m[of]), len(ids))
                    out = []
                    for q, (held, w) in enumerate(queries):
                        found = [(-s, not known[d], int(ids[d]), q) for s, d in tree.best(held, w, k, floors.get(q, 1))]
                        out += heapq.nsmallest(k, found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x[3] for x in out], pa.int32()), pa.array([None if x[1] else x[2] for x in out], pa.int64()), pa.array([-x[0] for x in out], pa.int64())], ["q", "doc_id", "score"]
                    )

        found = index.where(F.col("level") == level).drop("level").mapInArrow(search, "q int, doc_id long, score long")
        found = found if best is None else found.unionByName(best.drop("rank"))
        best = checkpointed(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    return best if best is not None else spark.createDataFrame([], "q int, doc_id long, score long, rank int")


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text", query_id: str = "item_id", query: str = "text", block: int = BLOCK_QUERIES) -> DataFrame:
    """The k highest-scoring documents of each query: (query_id, rank int from 1, doc_id long, score long).

    Terms are maximal runs of ASCII letters and digits and of all code points beyond ASCII; A-Z are lower-cased. A
    term of df out of N documents that hold any weighs w = floor(1000 * ln((2N + 2) / (2df + 1))); a document of n of
    all L terms scores, over the query's distinct terms, the sum of w * ((10**9 * tf) div (1000 * tf + 20 * m)), where
    m = 50 + (50 * n * N) div L, in 64-bit integers. Only scores above 0 are returned; equal ones go by ascending
    doc_id, missing ids last. Rows of ``docs`` that repeat rank each; rows of ``queries`` equal in id and text are one
    query, rows equal in the id alone are ranked apart. Null and empty texts have no terms: such documents are never
    found and count nowhere, such queries find nothing. Other columns are ignored; empty tables give no rows.

    ``docs`` is read once for each block of queries. Shards follow the order in which its partitions give their
    rows, so a table that isn't read from files should be written first.
    """
    spark = docs.sparkSession
    asked = queries.select(queries[query_id].alias("id"), queries[query].cast("string").alias("text")).where("text IS NOT NULL").distinct()
    longest = asked.agg(F.max(F.octet_length("text"))).first()[0] or 1
    block, last = max(1, min(block, BLOCK_BYTES // longest)), None
    out = spark.createDataFrame([], asked.select("id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).schema)
    key = [F.col("id").asc_nulls_first(), F.col("text")]
    while True:
        page = asked
        if last is not None:
            same = F.col("id").eqNullSafe(F.lit(last[0]))
            page = asked.where((same & (F.col("text") > F.lit(last[1]))) | (F.col("id").isNotNull() if last[0] is None else F.col("id") > F.lit(last[0])))
        part = page.orderBy(*key).limit(block).collect()
        if not part:
            break
        last = (part[-1].id, part[-1].text)
        path = f"{checkpoint_dir(spark)}/lexical-{uuid.uuid4().hex}"
        best = _search_block(docs, [r.text.encode() for r in part], k, doc_id, text, path)
        names = spark.createDataFrame([(q, r.id) for q, r in enumerate(part)], page.select(F.lit(0).alias("q"), "id").schema)
        out = out.unionByName(best.join(F.broadcast(names), "q").select("id", "rank", "doc_id", "score"))
        if len(part) < block:
            break
    return out.withColumnRenamed("id", query_id)


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    """Each ``benchmark`` item against all ``documents``: its 50 best."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return rank_documents(docs, items)


OP13_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL),
d AS (SELECT r, doc_id, terms, len(terms)::BIGINT AS n FROM t WHERE len(terms) > 0),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM d),
b AS (SELECT row_number() OVER () AS q, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
i AS (SELECT q, item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM b),
p AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, c GROUP BY term),
s AS (
  SELECT q, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))))::BIGINT AS score
  FROM i JOIN p USING (term) JOIN w USING (term), c GROUP BY ALL),
k AS (SELECT item_id, doc_id, score, (row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50
"""
