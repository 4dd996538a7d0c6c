"""Benchmark decontamination: short test items inside long documents, in DataFrame operations only.

A containment search by MinHash, partitioned by size on both sides. Documents are partitioned by the power of two above
their number of shingles, items by the power of two below theirs. For each pair of partitions, hashes fall into as many
bins as keep a bin's load in the documents at a level chosen for the items; the least shingle of each bin is the sketch
of a document and of an item, so both sides agree on what a minimum is however long the document. A document and an
item that share any minimum are candidates, and loads are such that an item contained to the threshold shares none with
a chance below one in a million. Candidates are verified on the shingles themselves, never on sketches or hashes.

Bins are the top bits of a hash, so the minima of few bins are among those of more. A document thus sends one sketch,
that of the densest load any item asks for, each minimum along with the hash before it in order; whether both are in one
bin tells whether it is a minimum of fewer bins too. Sketches are made inside a document's row. While the items have
at most BROADCAST_ROWS shingles they are broadcast, and only hits and the texts of candidates are shuffled; beyond,
sketches are shuffled by hash, where a shingle that very many documents have is split by adaptive execution.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import checkpointed

MISS = 1e-6
#: Shingles of all items up to which they are broadcast (two longs, an id and for verification five words each, about
#: 100 bytes); beyond, they are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Bits at which every shingle is a minimum of its own bin.
ALL_BITS = 63
SEPARATORS = r"[\x20\x09-\x0D]+"


def word_list(text: Column) -> Column:
    """Lower-cased whitespace words; null and empty texts have none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def _shingles(table: DataFrame, key: str, text: str, k: int, hashed: bool = True) -> DataFrame:
    """(key, h): the k-word shingles in text order, repeats included, hashed or as they stand; fewer words are one."""
    d = table.select(F.col(key), word_list(F.col(text)).alias("__w"))
    if hashed:
        d = d.select(key, F.transform("__w", lambda w: F.xxhash64(w)).alias("__w"))
    n = F.size("__w")
    at = (lambda i: F.xxhash64(*[F.get("__w", i + j) for j in range(k)])) if hashed else (lambda i: F.array_join(F.slice("__w", i + 1, k), " "))
    full = F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), at)
    short = F.xxhash64("__w") if hashed else F.array_join("__w", " ")
    h = F.when(n >= k, full).when(n > 0, F.array(short)).otherwise(F.array().cast("array<long>" if hashed else "array<string>"))
    return d.select(key, h.alias("h"))


def least_load(smallest: int, threshold: float) -> float:
    """Shingles per bin (a power of two) at which an item of so many shingles is missed with a chance below MISS.

    A shared shingle is the least of its bin, at load x, with a chance of (1 - exp(-x)) / x. 0 stands for bins so many
    that each shingle is its own: for items too small for any load.
    """
    shared, load = math.ceil(smallest * threshold), 4.0
    while load >= 2.0**-6:
        if (1 - (1 - math.exp(-load)) / load) ** shared <= MISS:
            return load
        load /= 2
    return 0.0


def shift_for(smallest: int, threshold: float) -> int:
    """Bits of the bin number beyond those of a document's size class, for items of so many shingles or more."""
    load = least_load(smallest, threshold)
    return ALL_BITS if load == 0 else int(math.log2(1 / load))


def _bits(exponent: Column, shift: Column) -> Column:
    """Bits of the bin number for a document of at most 2**exponent shingles."""
    return F.least(F.lit(ALL_BITS), F.greatest(F.lit(1), exponent + shift))


def _opens(h: Column, before: Column, bits: Column) -> Column:
    """Whether a hash is the least of its bin, given the hash before it in order (null: none)."""
    bin_of = lambda x: F.call_function("shiftrightunsigned", x, F.lit(64) - bits)
    return before.isNull() | (bin_of(h) != bin_of(before))


def contained(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs of documents and items that share at least ``percent`` of the item's distinct k-word shingles.

    Returns (doc_id, item_id, item_shingles long, shared long, containment double), a row for each pair. Words are
    lower-cased; an item or text of fewer than k words is one shingle. Null and empty items and texts match nothing,
    and rows with a null id take no part. Rows that share an id are one document (one item) of all their shingles.
    Other columns are ignored. Pairs are missed with a chance below 1e-6; those returned are verified. An empty table
    on either side gives no rows.
    """
    texts = items.select(items[item_id].alias("item_id"), items[item_text].cast("string").alias("t")).where("item_id IS NOT NULL")
    item = checkpointed(_shingles(texts, "item_id", "t", k, hashed=False).select("item_id", F.explode("h").alias("h")).distinct())
    sized = item.groupBy("item_id").agg(F.count("*").alias("item_shingles"))
    largest, n_rows = sized.agg(F.max("item_shingles"), F.sum("item_shingles")).first()
    hint = F.broadcast if (n_rows or 0) <= BROADCAST_ROWS else (lambda d: d)
    shifts = [shift_for(1 << c, percent / 100) for c in range((largest or 1).bit_length())]
    class_of = lambda n: F.length(F.bin(n)) - 1
    pairs = lambda s: F.transform(s, lambda h, i: F.struct(h.alias("h"), F.get(s, i - 1).alias("before")))

    lists = _shingles(texts, "item_id", "t", k).groupBy("item_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("h")))).alias("s")).where(F.size("s") > 0)
    sketch = lists.select("item_id", F.get(F.lit(shifts), class_of(F.size("s").cast("long"))).alias("shift"), F.inline(pairs(F.col("s")))).withColumnRenamed("before", "item_before")

    used = sized.select(class_of(F.col("item_shingles")).alias("c")).distinct().collect()  # at most 64 classes
    densest = F.lit(max([shifts[r["c"]] for r in used], default=1))
    d = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("t")).where("doc_id IS NOT NULL")
    exponent = F.length(F.bin(F.greatest(F.size("h"), F.lit(1)).cast("long") - 1)).cast("int")
    probes = _shingles(d, "doc_id", "t", k).select("doc_id", F.sort_array("h").alias("s"), exponent.alias("exponent"))
    opened = F.filter(pairs(F.col("s")), lambda x: _opens(x["h"], x["before"], _bits(F.col("exponent"), densest)))
    probes = probes.select("doc_id", "exponent", F.inline(opened))
    bits = _bits(F.col("exponent"), F.col("shift"))
    hits = probes.join(hint(sketch), "h").where(_opens(F.col("h"), F.col("before"), bits) & _opens(F.col("h"), F.col("item_before"), bits))
    hits = checkpointed(hits.select("doc_id", "item_id").distinct())

    found = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("t")).join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    shingle = _shingles(found, "doc_id", "t", k, hashed=False).select("doc_id", F.explode(F.array_distinct("h")).alias("h"))
    shared = shingle.join(hint(item), "h").select("doc_id", "item_id", "h").distinct()
    shared = shared.groupBy("doc_id", "item_id").agg(F.count("*").alias("shared")).join(hits, ["doc_id", "item_id"])
    out = shared.join(hint(sized), "item_id").where(F.col("shared") * 100 >= F.col("item_shingles") * percent)
    return out.select("doc_id", "item_id", "item_shingles", "shared", (F.col("shared") / F.col("item_shingles")).alias("containment"))


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` against all ``benchmark`` items, five-word shingles, a containment of 0.8."""
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contained(docs, items)


OP5_SQL = r"""
WITH t AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents
  UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') FROM benchmark),
s AS (
  SELECT DISTINCT side, id, unnest(CASE WHEN w IS NULL OR len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM t WHERE id IS NOT NULL),
n AS (SELECT id, count(*) AS n FROM s WHERE side = 'i' GROUP BY id),
c AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS shared FROM s d JOIN s i ON d.s = i.s AND d.side = 'd' AND i.side = 'i' GROUP BY ALL)
SELECT doc_id, item_id, n AS item_shingles, shared, shared::DOUBLE / n AS containment FROM c JOIN n ON n.id = item_id WHERE shared * 100 >= n * 80
"""
