"""Where intermediate tables go: the folder that spark.checkpoint.dir names, shared by all executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, a temporary one on a single machine; a cluster must name one
    that all its machines share."""
    sc = spark.sparkContext
    where = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if (sc.master or "").split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


def checkpointed(df: DataFrame) -> DataFrame:
    """Compute now, keep the rows in the shared folder and cut the lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
