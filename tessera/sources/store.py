"""Where contracts, their snapshots and numeric baselines are kept: small files, written through Spark's file systems."""

from __future__ import annotations

from datetime import UTC, datetime
from fnmatch import fnmatchcase
from functools import reduce
from itertools import chain, count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.payloads import DRIFT_LIMIT, cosine_distance, drift_status
from tessera.operators.profile import merged_baseline
from tessera.plans.contract import Contract
from tessera.sources.records import exists
from tessera.sources.shared import kept


def write_text(spark: SparkSession, path: str, content: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def listing(spark: SparkSession, folder: str, ending: str = ".yaml") -> list[str]:
    """Names of a folder's files, in order; none of a missing folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().endswith(ending)) if fs.exists(p) else []


def save_contract(spark: SparkSession, contract: Contract, folder: str, scope: str = "", now: datetime | None = None) -> str:
    """Write the contract, its dbt form and a timestamped snapshot; a second one of a second gets -01, -02 and so on.

    Returns the snapshot's path. ``scope`` keeps snapshots of different uses apart.
    """
    write_text(spark, f"{folder}/{contract.id}.yaml", contract.to_yaml())
    write_text(spark, f"{folder}/{contract.id}_dbt.yml", contract.to_dbt())
    stamp = (now or datetime.now(UTC)).strftime("%Y%m%dT%H%M%SZ")
    where = f"{folder}/snapshots{'/' + scope if scope else ''}/{contract.id}"
    taken, name, k = set(listing(spark, where)), f"{stamp}.yaml", 0
    while name in taken:
        k += 1
        name = f"{stamp}-{k:02d}.yaml"
    write_text(spark, f"{where}/{name}", contract.to_yaml())
    return f"{where}/{name}"


def snapshots(spark: SparkSession, folder: str, contract_id: str, scope: str = "", since: str = "") -> list[tuple[str, Contract]]:
    """The contract's snapshots from ``since`` (a timestamp as in their names) on, oldest first."""
    where = f"{folder}/snapshots{'/' + scope if scope else ''}/{contract_id}"
    return [(n, Contract.from_yaml(read_text(spark, f"{where}/{n}"))) for n in listing(spark, where) if n >= since]


def read_baseline(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if exists(spark, path) else None


def _paths(spark: SparkSession, path: str):
    """(file system, function that names ``path`` with an ending)."""
    jvm = spark.sparkContext._jvm
    place = lambda ending="": jvm.org.apache.hadoop.fs.Path(path + ending)
    return place().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def recovered(spark: SparkSession, path: str) -> None:
    """Take up again a table that was set aside as ``.old`` and that nothing replaced."""
    fs, place = _paths(spark, path)
    if not fs.exists(place()) and fs.exists(place(".old")):
        fs.rename(place(".old"), place())


def replace_table(df: DataFrame, path: str) -> None:
    """Write ``df``, which may read the table at ``path``, in its place.

    The new table is written aside and then takes the old one's name, so that a crash leaves one of them whole: the old
    one is set aside as ``.old`` for that moment, and is taken up again by ``recovered`` if nothing replaced it.
    """
    fs, place = _paths(df.sparkSession, path)
    df.write.mode("overwrite").parquet(path + ".new")
    fs.delete(place(".old"), True)
    if fs.exists(place()):
        fs.rename(place(), place(".old"))
    fs.rename(place(".new"), place())
    fs.delete(place(".old"), True)


def upsert_baseline(stats: DataFrame, path: str) -> None:
    """Keep (path, mean, stddev) of each field; new statistics win. A crash leaves the old table or the new one."""
    recovered(stats.sparkSession, path)
    new, old = stats.select("path", "mean", "stddev"), read_baseline(stats.sparkSession, path)
    replace_table(new if old is None else merged_baseline(old, new), path)


def centroid_drift(vectors: DataFrame, by: list[str], path: str, limit: float = DRIFT_LIMIT) -> DataFrame:
    """(by..., status, drift double) of vectors (by..., v), a row for each of them, against those kept at ``path``.

    A vector that has none there yet is BASELINE_SET with a drift of 0, and is kept from now on; others PASS, or FAIL beyond
    ``limit``, and leave what is kept as it is. A drift is the cosine distance in four places; nulls in ``by`` are equal to each
    other. An empty table keeps nothing.
    """
    spark = vectors.sparkSession
    recovered(spark, path)
    now, old = vectors.select(*by, "v"), read_baseline(spark, path)
    if old is None:
        if now.isEmpty():
            return now.select(*by, F.lit("BASELINE_SET").alias("status"), F.lit(0.0).alias("drift"))
        replace_table(now, path)
        return spark.read.parquet(path).select(*by, F.lit("BASELINE_SET").alias("status"), F.lit(0.0).alias("drift"))
    before = old.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("v").alias("__v"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], F.lit(True))
    distance = cosine_distance(F.col("v"), F.col("__v"))
    drift = F.when(F.abs(distance) < 1e-12, 0.0).otherwise(distance)
    told = F.when(F.col("__v").isNull(), "BASELINE_SET").otherwise(drift_status(drift, limit))
    out = kept(now.join(before, same, "left").select(*by, told.alias("status"), F.when(F.col("__v").isNull(), 0.0).otherwise(F.round(drift, 4) + 0.0).alias("drift")))
    new = now.join(before, same, "left_anti")
    if not out.where("status = 'BASELINE_SET'").isEmpty():
        replace_table(old.select(*by, "v").unionByName(new), path)
    return out


def archive(spark: SparkSession, folder: str, keep: list[str], into: str | None = None, apply: bool = False) -> tuple[list[str], list[str]]:
    """(kept, removed) names of a folder's files: those that fit a pattern of ``keep`` stay.

    Nothing is touched unless ``apply``; then the others are deleted, or moved ``into`` another folder, where a name that is
    taken gets ``__dup`` before its suffix, and ``__dup2`` and so on if that is taken as well. Folders inside stay, and a missing
    folder has no files.
    """
    fs, place = _paths(spark, folder)
    if not fs.exists(place()):
        return [], []
    names = sorted(s.getPath().getName() for s in fs.listStatus(place()) if s.isFile())
    stays = [n for n in names if any(fnmatchcase(n, p) for p in keep)]
    goes = [n for n in names if n not in set(stays)]
    target_fs, target = _paths(spark, into) if into else (None, None)
    if apply and into:
        target_fs.mkdirs(target())
    for name in goes if apply else []:
        if not into:
            fs.delete(place(f"/{name}"), False)
            continue
        stem, dot, suffix = name.rpartition(".") if "." in name[1:] else (name, "", "")
        tries = chain([name], (f"{stem}__dup{k if k > 1 else ''}{dot}{suffix}" for k in count(1)))
        free = next(n for n in tries if not target_fs.exists(target(f"/{n}")))
        fs.rename(place(f"/{name}"), target(f"/{free}"))
    return stays, goes


def retained(names: list[str], keep: int) -> tuple[list[str], list[str]]:
    """(kept, to archive) of file names that begin with a timestamp: the newest ``keep`` stay."""
    ordered = sorted(names)
    return ordered[-keep:] if keep else [], ordered[:-keep] if keep else ordered


def latest_by_time(df: DataFrame, *columns: str) -> DataFrame:
    """The newest record by the first timestamp that it has."""
    return df.orderBy(F.coalesce(*[F.col(c) for c in columns]).desc_nulls_last()).limit(1)
