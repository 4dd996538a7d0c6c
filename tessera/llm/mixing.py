"""Mixing sources to target weights by systematic sampling.

A source's target is its share of the word budget; each of its documents expects ``target / source_size`` copies.
Within a source, documents stand in order of size, expected copies are summed from the front, one random offset
is added, and a document is emitted once for each integer that its stretch of the sum crosses. Ordering by size
makes the sample follow the size distribution, so taken words stay within about one document of the target.

The running sum needs ranks within sources, of which one may hold most rows: rows are range-partitioned by source
and size, counted for each partition and source, and numbered within partitions, so no task sees a whole source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import checkpointed

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of whitespace words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _unit(key: Column) -> Column:
    """A number in [0, 1) from 32 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: Sequence[float], budget: float, cap: float, seed: str) -> DataFrame:
    """(source, size, weight, target, offset, rate) from (source, size), a row for each source.

    Sources in code point order, null last, take the weights in turn. No target is above ``cap`` times its size;
    what is cut off goes to the others by weight, until none is above, which ends at one common level of
    target per weight. A source without words has target and rate 0. The window without partitions runs over
    sources, not documents.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights))) + 1)
    s = sizes.withColumn("weight", pick).withColumn("most", F.col("size") * F.lit(float(cap)))
    by_level = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = s.withColumn("left", F.sum("size").over(everything) * F.lit(float(budget)) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    s = s.withColumn("open", F.sum("weight").over(rest)).withColumn("place", F.row_number().over(by_level))
    s = s.withColumn("stop", F.min(F.when(F.col("most") * F.col("open") > F.col("left") * F.col("weight"), F.struct("place", "left", "open"))).over(everything))
    target = F.when(F.col("stop").isNull() | (F.col("place") < F.col("stop.place")), F.col("most")).otherwise(F.col("weight") * F.col("stop.left") / F.col("stop.open"))
    s = s.withColumn("target", target).withColumn("offset", _unit(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("source"), F.lit("\x00null")))))
    rate = F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(F.lit(0.0))
    return s.select("source", "size", "weight", "target", "offset", rate.alias("rate"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0, seed: str = "mix", doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """How often the mix takes each document.

    Returns (doc_id, source, size long, source_size long, target double, copies long, taken long), a row for each
    input row. Null and empty texts have size 0 and take nothing, though they may be copied. Null sources form one
    source, the last. A document is copied at most ``ceil(cap)`` times. The same rows and seed give the same mix in
    any order and partitioning; rows that repeat a doc_id, size and source are told apart arbitrarily, which no
    output shows. An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[source].cast("string").alias("source"), n_words(docs[text]).alias("size"))
    rows = rows.withColumn("tie", F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long"))
    keys = [F.col("source"), F.col("size"), F.col("tie"), F.col("doc_id"), F.monotonically_increasing_id()]
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(rows.repartitionByRange(spread, *keys).withColumn("part", F.spark_partition_id()))
    by_part = dealt.groupBy("source", "part").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_part.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    targets = source_targets(by_part.groupBy("source").agg(F.sum("words").alias("size")), weights, budget, cap, seed)
    t = targets.select(F.col("source").alias("s"), F.col("size").alias("source_size"), "target", "offset", "rate")
    starts = starts.join(t, F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), F.col("part").alias("p"), "start", "source_size", "target", "offset", "rate")
    within = Window.partitionBy("part", "source").orderBy("size", "tie", "doc_id")
    ranked = dealt.withColumn("k", F.row_number().over(within))
    ranked = ranked.join(starts, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    k = (F.col("start") + F.col("k")).cast("double")
    copies = F.floor(F.col("offset") + k * F.col("rate")) - F.floor(F.col("offset") + (k - 1) * F.col("rate"))
    ranked = ranked.withColumn("copies", copies.cast("long"))
    return ranked.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit_copies(docs: DataFrame, mixed: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as ``mixed`` takes it, with a column ``copy`` from 1.

    Rows that repeat doc_id, source and size are matched one to one; nulls match nulls. Rows that the mix takes no
    copy of, those of an empty table among them, are left out. Other columns stay, but a column ``copy`` is replaced.
    """
    names = [c for c in docs.columns if c != "copy"]
    sized = docs.select(*[docs[c] for c in names], n_words(docs[text]).alias("__size"))
    nth = lambda d, *c: d.withColumn("__nth", F.row_number().over(Window.partitionBy(*c).orderBy(F.lit(1))))
    left = nth(sized, sized[doc_id], sized[source], sized["__size"])
    right = nth(mixed.where("copies > 0"), "doc_id", "source", "size").select(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("size").alias("__z"), F.col("__nth").alias("__m"), F.col("copies").alias("__copies"))
    on = left[doc_id].eqNullSafe(right["__d"]) & left[source].eqNullSafe(right["__s"]) & (left["__size"] == right["__z"]) & (left["__nth"] == right["__m"])
    out = left.join(right, on)
    return out.select(*[left[c] for c in names], F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))).alias("copy"))


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` mixed to 150% of their words by the weights 3, 1, 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS tie FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS size FROM rows GROUP BY source),
w AS (SELECT *, ([3.0, 1.0, 2.0])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight, size * 2.0::DOUBLE AS most FROM s),
l AS (
  SELECT *, (sum(size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "left",
         sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open, row_number() OVER o AS place
  FROM w WINDOW o AS (ORDER BY most / weight, source NULLS LAST)),
stop AS (SELECT place, "left", open FROM l WHERE most * open > "left" * weight ORDER BY place LIMIT 1),
t AS (
  SELECT l.source, l.size AS source_size,
         CASE WHEN stop.place IS NULL OR l.place < stop.place THEN l.most ELSE l.weight * stop."left" / stop.open END AS target,
         ('0x' || substr(md5('mix:' || coalesce(l.source, chr(0) || 'null')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS off
  FROM l LEFT JOIN stop ON true),
k AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY size, tie, doc_id))::DOUBLE AS k FROM rows),
c AS (
  SELECT doc_id, size, source_size, target, off, k, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0::DOUBLE END AS rate
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(off + k * rate) - floor(off + (k - 1) * rate)) * size)::BIGINT AS taken FROM c
"""
