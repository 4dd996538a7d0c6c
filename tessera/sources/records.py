"""Record sources and sinks: JSON lines, documents, reports and their latest versions, quarantine and baselines."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

import yaml
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, tolerant: bool = False) -> DataFrame:
    """JSON lines without blank lines and comments; a missing file has no rows.

    A malformed line fails the read, or is dropped if ``tolerant``.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.ltrim(F.col("value")).startswith("#"))
    if not tolerant:
        return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    checked = T.StructType([*schema.fields, T.StructField("__bad", T.StringType())])
    parsed = lines.select(F.from_json("value", checked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("r"))
    return parsed.where("r.__bad IS NULL AND r IS NOT NULL").select("r.*").drop("__bad")


def read_document(spark: SparkSession, path: str) -> DataFrame | None:
    """A JSON file as one record; None if it is missing, empty or no JSON."""
    if not exists(spark, path):
        return None
    r = spark.read.option("multiLine", True).option("columnNameOfCorruptRecord", "__bad").json(path)
    return r if r.columns and "__bad" not in r.columns else None


def read_yaml(spark: SparkSession, path: str) -> Any:
    """Contracts, registries and scenarios; small files, read through Spark's file systems."""
    return yaml.safe_load(spark.read.text(path, wholetext=True).first()[0])


def read_spec(spark: SparkSession, path: str) -> dict:
    """A change specification: JSON by its suffix, else YAML. A missing file is an error."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    text = spark.read.text(path, wholetext=True).first()[0]
    return json.loads(text) if path.lower().endswith(".json") else yaml.safe_load(text)


def read_reports(spark: SparkSession, folder: str, schema: T.StructType | str, baseline: bool = False, names: Sequence[str] = ("clean.json", "clean_run.json")) -> DataFrame:
    """The reports of a folder, those of its JSON files that have ``results``, with their ``file`` name.

    As a baseline, one file is taken: the first of ``names`` that is there, else the least that begins with clean;
    where there is none, all are.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    r = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    r = r.select("*", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file")).where("results IS NOT NULL")
    if not baseline:
        return r
    place = F.coalesce(*[F.when(F.col("file") == n, i) for i, n in enumerate(names)], F.when(F.col("file").startswith("clean"), len(names)))
    chosen = r.agg(F.min(F.when(place.isNotNull(), F.struct(place, "file"))).alias("c")).select(F.col("c.file").alias("__chosen"))
    return r.join(chosen).where(F.col("__chosen").isNull() | (F.col("file") == F.col("__chosen"))).drop("__chosen")


TIMES = ("generated_at", "run_timestamp", "detected_at", "end_time", "start_time")


def latest_file(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """The newest record among a folder's JSON files: by the first of TIMES that it has, else by its file's own time."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    r = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    at = F.coalesce(*[F.try_to_timestamp(F.col(c)) for c in TIMES if c in schema.names], F.col("_metadata.file_modification_time").cast("timestamp"))
    return r.select("*", at.alias("__at"), F.col("_metadata.file_path").alias("__file")).orderBy(F.desc("__at"), "__file").limit(1).drop("__at", "__file")


def _in_key_order(col: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        inner = F.struct(*[_in_key_order(col[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])
        return F.when(col.isNotNull(), inner)
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: _in_key_order(x, kind.elementType))
    return col


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines with sorted keys, those of nested records too."""
    ordered = [_in_key_order(df[f.name], f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)]
    df.select(*ordered).write.mode("append" if append else "overwrite").json(path)


def write_report(spark: SparkSession, results: DataFrame, path: str, **head: Any) -> None:
    """A report of check results, a row for each check, as one indented JSON document."""
    from tessera.sources.store import write_text

    write_text(spark, path, json.dumps({**head, "results": [r.asDict(True) for r in results.collect()]}, indent=2, sort_keys=True, default=str))


def latest(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The newest row of each key, by the first timestamp that a row has."""
    order = F.coalesce(*[F.col(c) for c in by]).desc_nulls_last()
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(order, *[F.col(k) for k in keys]))).where("__r = 1").drop("__r")


def split_quarantine(df: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rows with the error that keeps them out)."""
    marked = df.withColumn("error", error)
    return marked.where("error IS NULL").drop("error"), marked.where("error IS NOT NULL")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
