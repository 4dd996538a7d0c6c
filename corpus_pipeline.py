"""The corpus pipeline: filter, deduplicate, decontaminate, mask secrets and mix, each stage written before the next.

Every stage works on all that its predecessor kept. Stages on word shingles take five words and a similarity of 0.8.
"""

from __future__ import annotations

import uuid
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, minhash, mixing, quality, secrets
from tessera.llm.shared import checkpoint_dir, checkpointed


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network scores at its threshold or above.

    Null and empty texts are scored as texts of no bytes; every row is judged by itself. Without labels of both kinds
    scores are constant. An empty table gives no rows.
    """
    net = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs, net, keep=tuple(docs.columns), into="__quality")
    return scored.where(F.col("__quality") >= quality.THRESHOLD).select(*docs.columns)


def with_key(docs: DataFrame) -> DataFrame:
    """``docs`` and ``__key``, which no two rows share and which is in the order of doc_id, nulls last.

    It is the doc_id where all are known and differ. Else it is (without id, doc_id, number), and the rows without
    one, or with one that repeats, are written with their numbers before use, so that a key stays.
    """
    odd = checkpointed(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("__odd")))
    if odd.isEmpty():
        return docs.withColumn("__key", F.col("doc_id"))
    same = docs["doc_id"].eqNullSafe(odd["__odd"])
    key = lambda number: F.struct(F.col("doc_id").isNull().alias("late"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), number.alias("number"))
    numbered = checkpointed(docs.join(odd, same, "left_semi").withColumn("__key", key(F.monotonically_increasing_id() + 1)))
    return docs.join(odd, same, "left_anti").withColumn("__key", key(F.lit(0).cast("long"))).unionByName(numbered)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest doc_id.

    Every row is a document by its text, rows without doc_id, after all others, and rows that repeat one included;
    which of equal rows stays is left open. Null and empty texts are in no group and stay. An empty table gives none.
    """
    keyed = with_key(docs)
    found = minhash.near_duplicates(keyed, k=5, percent=80, doc_id="__key").where("kept").select(F.col("doc_id").alias("__kept"))
    return keyed.join(found, keyed["__key"] == found["__kept"], "left_semi").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Rows without doc_id, or that repeat one, are examined each by itself. Null and empty texts hold none and stay. An
    empty table gives no rows.
    """
    keyed = with_key(docs)
    hits = decontamination.contained(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=5, percent=80, doc_id="__key")
    return keyed.join(hits.select(F.col("doc_id").alias("__key")).distinct(), "__key", "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked and ``n_chars`` counted anew where there is a text.

    Null and empty texts stay as they are, and so does the ``n_chars`` of null texts. An empty table gives no rows.
    """
    findings = secrets.scan(docs, secrets.train(secrets.rule_findings(spark)))
    masked = secrets.masked(docs, findings)
    return masked.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes: the document's columns and ``copy``, from 1.

    Null sources form one source, the last. Null and empty texts have no words; they are copied at their source's
    rate. Rows that repeat are mixed each. An empty table gives no rows.
    """
    return mixing.emit_copies(docs, mixing.mix_sources(docs))


STAGES = [
    ("quality classifier", quality_filter),
    ("near duplicates", near_dedup),
    ("decontamination", decontaminate),
    ("secrets", mask_secrets),
    ("mixing", mix),
]
#: SQL cannot express the network and the forest; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    where = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{where}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
