"""Continuous validation: a file stream whose micro-batches are held against a contract as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.checks import evaluate
from tessera.plans.contract import Contract


def watch(spark: SparkSession, path: str, schema: T.StructType, contract: Contract, results: str, checkpoint: str, fmt: str = "parquet", every: str | None = None, files: str | None = None, then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Validate new files of a folder (those whose names fit ``files``); results of each batch are appended with its number.

    A batch that is run again after a failure overwrites its own results. Clauses on groups can't be judged batch by batch,
    since a group may go on in the next one, and are refused: ``sequences`` keeps their state. Without ``every``, what
    is there is worked off and the stream ends.
    """
    groups = [c.id for c in contract.clauses if c.rule.get("type") == "group_monotonic"]
    if groups:
        raise ValueError(f"clauses on groups go on over batches; watch them with sequences(): {', '.join(groups)}")

    def check(batch: DataFrame, number: int) -> None:
        evaluate(batch, contract).write.mode("overwrite").parquet(f"{results}/batch={number}")
        if then is not None:
            then(spark.read.parquet(f"{results}/batch={number}").withColumn("batch", F.lit(number).cast("long")), number)

    reader = spark.readStream.schema(schema).format(fmt)
    stream = (reader.option("pathGlobFilter", files) if files else reader).load(path)
    writer = stream.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def latest_results(spark: SparkSession, results: str) -> DataFrame:
    """Results of all batches with their number, each check of a batch once."""
    return spark.read.parquet(results).withColumn("batch", F.col("batch").cast("long")).dropDuplicates(["batch", "check_id"])


def sequences(stream: DataFrame, keys: list[str], field: str) -> DataFrame:
    """(keys, n, broken): of each group so far, how many numbers came and whether they aren't exactly 1 to n.

    The state of a group is its count, its bounds and one combined hash of its steps, so a group may come in any
    number of batches, and a stream split over files is judged like a whole one. A number stands for the step from the
    number before it, hash against hash; steps that join up leave the two ends alone, so what is due needs no list of
    the numbers. Nulls don't count.
    """
    number = F.col(field).cast("long")
    g = stream.where(number.isNotNull()).groupBy(*keys).agg(F.count(number).alias("n"), F.min(number).alias("low"), F.max(number).alias("high"), F.bit_xor(F.xxhash64(number).bitwiseXOR(F.xxhash64(number - 1))).alias("hash"))
    sound = (F.col("low") == 1) & (F.col("high") == F.col("n"))
    due = F.when(sound, F.xxhash64(F.col("n")).bitwiseXOR(F.xxhash64(F.lit(0).cast("long"))))
    return g.select(*keys, "n", (~F.coalesce(F.col("hash") == due, F.lit(False))).alias("broken"))


def windowed_failures(stream: DataFrame, at: str, fails: Column, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Failing and total records of each window of event time; records later than ``late`` are left out by the watermark."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window)).agg(F.count(F.lit(1)).alias("records"), F.count_if(fails).alias("failing"))
