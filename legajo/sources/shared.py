"""Intermediate results on storage that every executor reaches, so that lost executors cost no lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, made the session's checkpoint folder.

    Where the setting is absent a local session gets a folder of its own; on a cluster that raises, since executors
    can't reach another machine's temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    have = spark.sparkContext._jsc.sc().getCheckpointDir()
    if folder:
        if have.isEmpty():
            spark.sparkContext.setCheckpointDir(folder)
        return folder
    if have.isDefined():
        return have.get()
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir names no shared folder")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="legajo-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of a frame, computed once and written to the shared folder; later stages read them there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
