"""Cutting the lineage of intermediate tables that several branches read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def _folder(df: DataFrame) -> str:
    """The session's checkpoint folder: the one that ``spark.checkpoint.dir`` names.

    A temporary one is set only where that is unset in a local session, as in tests.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def staged(df: DataFrame) -> DataFrame:
    """The rows written once to the session's checkpoint folder, and read from there."""
    _folder(df)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As ``staged``, in compressed columns: for tables as long as the input, of which readers take some columns.

    It stays in the checkpoint folder until that is deleted.
    """
    path = f"{_folder(df)}/{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
