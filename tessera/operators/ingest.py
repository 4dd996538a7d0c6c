"""Artifacts into canonical records: numbering, batching, timestamps, schema inference and fault injection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "sequence_number") -> DataFrame:
    """Rows numbered from 1 within each stream."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def batched(df: DataFrame, by: list[str], order: list[str], size: int = 8) -> DataFrame:
    """Rows with their batch of ``size`` within each stream, from 0."""
    return numbered(df, by, order, "__n").withColumn("batch", F.floor((F.col("__n") - 1) / size).cast("long")).drop("__n")


def intents_with_refs(intents: DataFrame, traces: DataFrame) -> DataFrame:
    """The newest row of each ``intent_id``, with the distinct references of all its traces in order.

    ``intents``: (intent_id, at, ...); ``traces``: (intent_id, files array<struct<path, ranges array<struct<first, last>>>>),
    whose nested references are taken apart inside their row and grouped before the join.
    """
    newest = intents.withColumn("__r", F.row_number().over(Window.partitionBy("intent_id").orderBy(F.col("at").desc_nulls_last()))).where("__r = 1").drop("__r")
    each = F.flatten(F.transform("files", lambda f: F.transform(f["ranges"], lambda r: F.struct(f["path"].alias("path"), r["first"].alias("first"), r["last"].alias("last")))))
    refs = traces.select("intent_id", F.explode(each).alias("ref")).distinct().groupBy("intent_id").agg(F.array_sort(F.collect_list("ref")).alias("code_refs"))
    out = newest.join(refs, "intent_id", "left")
    return out.withColumn("code_refs", F.coalesce("code_refs", F.array().cast(refs.schema["code_refs"].dataType)))


def facts(blocks: DataFrame, doc: str, order: list[str], text: str, score: str, most: int = 25, least: int = 25) -> DataFrame:
    """(doc, fact_no, text, confidence): the first ``most`` blocks of each document that have ``least`` characters; where
    a document has fewer such, its short ones fill up. Confidences are brought to 0 to 1."""
    trimmed = F.trim(F.col(text))
    b = blocks.where(trimmed != "").withColumn("__short", F.char_length(trimmed) < least)
    b = b.withColumn("fact_no", F.row_number().over(Window.partitionBy(doc).orderBy("__short", *order))).where(F.col("fact_no") <= most)
    return b.select(doc, "fact_no", trimmed.alias("text"), confidence(F.col(score)).alias("confidence"))


def chunk_records(chunks: DataFrame, doc: str, order: list[str], text: str, size: int = 8, most: int = 6, least: int = 20, skip: str = "<!-- image -->") -> DataFrame:
    """(doc, record_no, facts array<string>): a record for each ``size`` chunks in a row of a document that have a fact, numbered from 1.

    A fact is a trimmed chunk of at least ``least`` characters other than ``skip``; the first ``most`` of each record are taken.
    Nulls are no facts but count as chunks. Chunks are numbered by one window for each document.
    """
    b = batched(chunks.select(doc, *order, F.regexp_replace(F.col(text), r"^\s+|\s+$", "").alias("__t")), [doc], order, size)
    b = b.where((F.char_length("__t") >= least) & (F.col("__t") != skip))
    r = b.groupBy(doc, "batch").agg(F.array_sort(F.collect_list(F.struct(*order, "__t"))).alias("__f"))
    r = r.withColumn("record_no", F.row_number().over(Window.partitionBy(doc).orderBy("batch")))
    return r.select(doc, "record_no", F.transform(F.slice("__f", 1, most), lambda f: f["__t"]).alias("facts"))


def topped_up(have: DataFrame, more: DataFrame, order: list[str], target: int = 50) -> DataFrame:
    """``have``, and so many rows of ``more`` in ``order`` as there are missing to ``target``; what there is beyond it stays.

    Both have the same columns. No more than ``target`` rows of ``more`` are numbered, each task passing on its first ones.
    """
    n = have.limit(target).agg(F.count(F.lit(1)).alias("__have"))
    first = more.orderBy(*order).limit(target).withColumn("__n", F.row_number().over(Window.orderBy(*order)))
    return have.unionByName(first.join(n).where(F.col("__have") + F.col("__n") <= target).drop("__n", "__have"))


def markdown_sections(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """(keep..., section_no, title, body, fields): the ``##`` sections of Markdown texts; ``fields`` maps the names of
    ``- **name**: value`` lines to their values, of a name given twice the last."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), F.col(text)), r"\n##[ \t]+"), lambda p: p != "")
    s = df.select(*keep, F.posexplode(F.slice(F.split(F.concat(F.lit("\n"), F.col(text)), r"\n##[ \t]+"), 2, F.greatest(F.size(parts), F.lit(1)))).alias("section_no", "__s"))
    named = r"(?m)^- \*\*([^*\n]+)\*\*:[ \t]*([^\n]*)$"
    names, values = F.regexp_extract_all("__s", F.lit(named), F.lit(1)), F.regexp_extract_all("__s", F.lit(named), F.lit(2))
    entries = F.arrays_zip(names.alias("k"), values.alias("v"))
    last = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.greatest(F.size(names), F.lit(1))), e["k"]))
    return s.select(*keep, F.col("section_no").cast("long").alias("section_no"), F.trim(F.substring_index("__s", "\n", 1)).alias("title"), F.trim(F.regexp_replace("__s", r"^[^\n]*\n?", "")).alias("body"), F.map_from_entries(last).alias("fields"))


def routed(rules: list[tuple[str, str]], *said: Column, other: str = "unknown") -> Column:
    """The service of the first (words, service) of which any column speaks."""
    told = F.lower(F.concat_ws(" ", *said))
    out = F.lit(other)
    for words, service in reversed(rules):
        out = F.when(told.rlike(words), service).otherwise(out)
    return out


def first_timestamp(*candidates: Column) -> Column:
    """The first candidate that is a timestamp."""
    return F.coalesce(*[F.try_to_timestamp(c.cast("string")) for c in candidates])


def confidence(value: Column) -> Column:
    """A confidence on 0 to 1: percentages are divided, the rest is held to the scale."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(value > 1, value / 100).otherwise(value)))


def json_types(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """(by..., key, kinds, required): the types of each top-level key of JSON objects, and whether all of them have it.

    Counts of keys merge in any order, so schemas of any number of records are inferred in one grouping.
    """
    keys = by or []
    obj = df.where(F.json_object_keys(column).isNotNull())
    total = obj.groupBy(*keys).agg(F.count("*").alias("n"))
    each = obj.select(*keys, F.explode(F.json_object_keys(column)).alias("key"), F.col(column).alias("__j"))
    raw = F.from_json("__j", "map<string,string>")[F.col("key")]
    kind = F.when(raw.isNull(), "null").when(raw.rlike(r"^-?\d+$"), "integer").when(raw.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), "number").when(raw.isin("true", "false"), "boolean").when(raw.startswith("{"), "object").when(raw.startswith("["), "array").otherwise("string")
    found = each.select(*keys, "key", kind.alias("kind")).groupBy(*keys, "key").agg(F.concat_ws("|", F.array_sort(F.collect_set("kind"))).alias("kinds"), F.count("*").alias("k"))
    found = found.join(total, keys) if keys else found.crossJoin(total)
    return found.select(*keys, "key", "kinds", (F.col("k") == F.col("n")).alias("required"))


def inject(df: DataFrame, column: str, value: Column, where: Column) -> DataFrame:
    """A fault: ``column`` becomes ``value`` in the rows chosen."""
    return df.withColumn(column, F.when(where, value).otherwise(F.col(column)))
