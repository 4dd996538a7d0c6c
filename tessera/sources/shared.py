"""Tables between steps of iterative queries, in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, a temporary one on a single machine; a cluster must name one
    that all its machines share."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not (sc.master or "").split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(where or f"file://{tempfile.mkdtemp(prefix='tessera-')}")
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """Compute now, keep the rows in the shared folder and cut the lineage."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)
