"""Where written tables go that later queries of a session read."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which the driver and all executors share. Where none is named a local one is made, under a local master only."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="siftwell-")


def cut(df: DataFrame) -> DataFrame:
    """df computed once and read from the shared folder from then on, in the same partitions."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder(spark))
    return df.checkpoint(eager=True)
