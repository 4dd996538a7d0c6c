"""Exact top-k inner-product search by distributed histogram selection.

Vectors are turned into integers, so scores are exact. Queries are taken in blocks bounded in bytes, which are shipped
to all tasks and scored against every candidate. In a first pass each task finds its k-th highest score of a query: the
highest of these is a floor that the k-th score of all can't lie below. Further passes count the scores above it in a
histogram for each query; the counts are summed over all tasks, the bin that holds the k-th highest score is located,
and the pass is repeated within that bin until it is a single value or leaves few rows above its floor. A last pass
keeps what reaches the floor and ties go to the smaller id. A task never keeps more than k of a query's rows, as no
other row of its can be among the k best, so a vector that half of the table repeats costs k rows for each task.

The work is that of all queries times all candidates, done by tasks over the candidates; the driver holds a block's
vectors and three numbers for each of its queries. A block of 32 MB is 65,536 queries of 64 dimensions, so what is done
one after another is a few hundred passes for a billion vectors of which every hundredth is a query.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import checkpoint_dir

#: Bytes of query vectors shipped at a time, queries among them at most, and queries and candidates scored at a time.
BLOCK_BYTES, QUERY_BLOCK, TILE = 32 << 20, 1 << 16, (512, 2048)
BINS = 512
#: Rows above the floor, as a multiple of k, at which histograms are fine enough.
SLACK = 8


def _integers(column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """All scaled components one after another, and how many each row has."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    return np.floor(flat * scale), np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v array<double>) of rows that take part: no null, NaN or infinite component, no null id."""
    v = vectors[embedding].cast("array<double>")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vectors.select(vectors[vec_id].cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)


def _dots(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products: in float64 where no sum can pass 2**53, else in 64-bit integers."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if bound < 2**53:
        return (q @ c.T).astype(np.int64)
    return q.astype(np.int64) @ c.astype(np.int64).T


def search(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, vec_id: str = "vec_id", embedding: str = "embedding", block: int = QUERY_BLOCK, bins: int = BINS) -> DataFrame:
    """The k highest scores of each query row against all other rows.

    Returns (query_id long, rank int from 1, vec_id long, score long); fewer than k rows where there are fewer
    candidates. A component x counts as floor(scale * x); a score is the inner product. ``is_query`` is a condition
    on the columns of ``vectors``. Null vectors, vectors that hold null or non-finite components and rows without
    id take no part. Ids name rows: a row is not a candidate for queries of its own id, and a query row that occurs
    twice is answered once; repeated candidates count each. Only vectors of equal length are compared. Ties go to the
    smaller vec_id. Products must fit 64-bit integers. Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, embedding)
    queries = usable(vectors.where(is_query), vec_id, embedding).distinct()
    path = f"{checkpoint_dir(spark)}/topk-{uuid.uuid4().hex}"
    schema = T.StructType.fromDDL("query_id long, rank int, vec_id long, score long")
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    longest = queries.agg(F.max(F.size("v"))).first()[0] or 1
    block = max(1, min(block, BLOCK_BYTES // (8 * longest)))
    key, last = F.struct("vec_id", "v"), None
    while True:
        page = queries if last is None else queries.where(key > F.struct(F.lit(last[0]).cast("long"), F.array(*[F.lit(float(x)) for x in last[1]]).cast("array<double>")))
        part = page.orderBy(key).limit(block).toArrow()
        if not part.num_rows:
            break
        last = (part.column("vec_id")[-1].as_py(), part.column("v")[-1].as_py())
        found, shipped = _search_block(rows, part, k, scale, bins)
        found.write.mode("append").parquet(path)
        for b in shipped:
            b.destroy()
        if part.num_rows < block:
            break
    return spark.read.schema(schema).parquet(path)


def _in_order(q: np.ndarray, *by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by q and then by the keys given, and each element's place within its q."""
    order = np.lexsort((*reversed(by), q))
    return order, np.arange(len(q)) - np.searchsorted(q[order], q[order])


def _search_block(rows: DataFrame, part: pa.Table, k: int, scale: float, bins: int) -> tuple[DataFrame, list[Broadcast]]:
    """The best of a block of queries, and the broadcasts that it needs until it is written."""
    spark, n = rows.sparkSession, part.num_rows
    ids = part.column("vec_id").to_numpy()
    flat, lengths = _integers(part.column("v").combine_chunks(), scale)
    begin = np.concatenate(([0], np.cumsum(lengths)))
    groups = {}
    for d in np.unique(lengths).tolist():
        members = np.flatnonzero(lengths == d)
        groups[d] = (members, flat[begin[members][:, None] + np.arange(d)].reshape(len(members), d))
    block = spark.sparkContext.broadcast((ids, groups))

    def scored(batches):
        """(query numbers, candidate ids, scores, whether others than the query) in tiles, by vector length."""
        ids, groups = block.value
        for batch in batches:
            flat, size = _integers(batch.column("v"), scale)
            begin = np.concatenate(([0], np.cumsum(size)))[:-1]
            cand = batch.column("vec_id").to_numpy(zero_copy_only=False)
            for d, (members, q) in groups.items():
                of = np.flatnonzero(size == d)
                for at in range(0, len(of), TILE[1]):
                    these = of[at : at + TILE[1]]
                    c = flat[begin[these][:, None] + np.arange(d)].reshape(len(these), d)
                    for x in range(0, len(members), TILE[0]):
                        some = members[x : x + TILE[0]]
                        yield some, cand[these], _dots(q[x : x + TILE[0]], c), ids[some][:, None] != cand[these][None, :]

    def floors(batches):
        """Each query's k-th highest score in this task (null: fewer rows) and its highest."""
        top, least = np.full((len(block.value[0]), k), np.iinfo(np.int64).min), np.iinfo(np.int64).min
        seen = np.zeros(len(top), np.int64)
        for some, _, s, other in scored(batches):
            seen[some] += other.sum(axis=1)
            s = np.where(other, s, least)
            better = np.concatenate((top[some], np.partition(s, -k, axis=1)[:, -k:] if s.shape[1] > k else s), axis=1)
            top[some] = np.partition(better, -k, axis=1)[:, -k:]
        q = np.flatnonzero(seen)
        floor = pa.array(top[q].min(axis=1) if len(q) else q, pa.int64(), mask=seen[q] < k)
        low = pa.array(np.where(top[q] == least, np.iinfo(np.int64).max, top[q]).min(axis=1) if len(q) else q, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), floor, low, pa.array(top[q].max(axis=1) if len(q) else q, pa.int64())], ["q", "floor", "low", "high"])

    spans = rows.mapInArrow(floors, "q long, floor long, low long, high long")
    spans = spans.groupBy("q").agg(F.coalesce(F.max("floor"), F.min("low")).alias("low"), F.max("high").alias("high")).toArrow()
    low, high, above = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.zeros(n, np.int64)
    low[spans.column("q").to_numpy()], high[spans.column("q").to_numpy()] = spans.column("low").to_numpy(), spans.column("high").to_numpy()
    todo, used = high > low, [block]
    while todo.any():
        width = np.maximum(1, -(-(high - low + 1) // bins))
        now = spark.sparkContext.broadcast((low, high, width, todo, k - above))
        used.append(now)

        def counts(batches):
            low, high, width, todo, _ = now.value
            keys, total = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for some, _, s, other in scored(batches):
                row, col = np.nonzero(other & (s >= low[some][:, None]) & (s <= high[some][:, None]) & todo[some][:, None])
                q = some[row]
                found = np.concatenate((keys, q * bins + (s[row, col] - low[q]) // width[q]))
                keys, back = np.unique(found, return_inverse=True)
                total = np.bincount(back, np.concatenate((total, np.ones(len(q), np.int64))), len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys // bins), pa.array(keys % bins), pa.array(total)], ["q", "bin", "n"])

        def kth(batches):
            """Of each query of a part, whose bins are in order from the highest: the bin with the k-th score."""
            need = now.value[4]
            if not (found := list(batches)):
                return
            table = pa.Table.from_batches(found)
            q, b, n = (table.column(c).to_numpy() for c in ("q", "bin", "n"))
            order, place = _in_order(q, -b)
            q, b, n = q[order], b[order], n[order]
            upto = np.cumsum(n)
            upto -= (upto - n)[np.arange(len(q)) - place]
            hit = (upto >= need[q]) & (upto - n < need[q])
            yield pa.RecordBatch.from_arrays([pa.array(q[hit]), pa.array(b[hit]), pa.array(n[hit]), pa.array(upto[hit])], ["q", "bin", "n", "upto"])

        total = rows.mapInArrow(counts, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        hits = total.repartition("q").mapInArrow(kth, "q long, bin long, n long, upto long").toArrow()
        q, b, n_bin, upto = (hits.column(c).to_numpy() for c in ("q", "bin", "n", "upto"))
        missed = todo.copy()  # fewer than k candidates: all of them
        missed[q] = False
        todo[missed] = False
        edge, in_all = low[q] + b * width[q], above[q] + upto
        low[q], high[q] = edge, np.minimum(high[q], edge + width[q] - 1)
        done = (width[q] == 1) | (in_all <= SLACK * k)
        todo[q[done]] = False
        above[q[~done]] = (in_all - n_bin)[~done]
    floor_of = spark.sparkContext.broadcast(low)
    used.append(floor_of)

    def best(batches):
        """The k best of each query in this task, from the rows that reach the query's floor."""
        floor, keep = floor_of.value, (np.zeros(0, np.int64),) * 3
        for some, cand, s, other in scored(batches):
            row, col = np.nonzero(other & (s >= floor[some][:, None]))
            keep = tuple(np.concatenate(x) for x in zip(keep, (some[row], s[row, col], cand[col]), strict=True))
            order, place = _in_order(keep[0], -keep[1], keep[2])
            keep = tuple(x[order][place < k] for x in keep)
        yield pa.RecordBatch.from_arrays([pa.array(block.value[0][keep[0]]), pa.array(keep[0]), pa.array(keep[2]), pa.array(keep[1])], ["query_id", "q", "vec_id", "score"])

    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    out = rows.mapInArrow(best, "query_id long, q long, vec_id long, score long").withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), used


def op9_exact_topk(spark, sf_dir: str) -> DataFrame:
    """Every row of ``embeddings`` whose vec_id is divisible by 100 against all rows."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, F.col("vec_id") % 100 == 0)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
