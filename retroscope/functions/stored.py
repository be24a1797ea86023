"""Cutting the lineage of rows that several passes read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or f"file://{tempfile.mkdtemp(prefix='retroscope-')}")
    return sc.getCheckpointDir()


def cut(rows: DataFrame) -> DataFrame:
    """rows, written to the session's checkpoint folder and read from there by every pass; lost executors cost nothing.

    The folder is the one in spark.checkpoint.dir. Where none is set and all runs in one process, one is made.
    """
    _folder(rows.sparkSession)
    return rows.checkpoint()


def place(spark: SparkSession, name: str) -> str:
    """A path in that folder that nothing has used before."""
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"


def columns(rows: DataFrame, name: str) -> DataFrame:
    """rows, written to that folder by column, where narrow rows take less of the disk than with `cut`."""
    to = place(rows.sparkSession, name)
    rows.write.parquet(to)
    return rows.sparkSession.read.schema(rows.schema).parquet(to)
