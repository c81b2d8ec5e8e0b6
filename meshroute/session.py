"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, as in tests, a folder of its own, on a local master only."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="meshroute-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df, computed now and read from the shared folder from here on."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
