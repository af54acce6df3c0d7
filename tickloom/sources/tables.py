"""Readers of the Parquet tables and of the session's settings."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a directory of Parquet tables (a file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_checkpoints(spark: SparkSession) -> SparkSession:
    """Make sure checkpoint() can be used.

    A cluster names its shared folder in ``spark.checkpoint.dir``, and that is used.  Where neither the setting nor the
    context has one, a session on a single machine (tests) gets a temporary folder and any other an error: executors
    would write where the others can't read.
    """
    ctx = spark.sparkContext
    if ctx._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None) or ctx.getConf().get("spark.checkpoint.dir")
        if not folder and not (ctx.master == "local" or ctx.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        ctx.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "tickloom-checkpoints"))
    return spark


def first_arrivals(df: DataFrame, *ids: str) -> DataFrame:
    """Re-sent rows count once: one row for each id.  Rows without an id are kept as they are."""
    known = df.where(F.concat(*[F.col(i).cast("string") for i in ids]).isNotNull())
    return known.dropDuplicates(list(ids))


def finite(column):
    """The column as double, null where it is null, NaN or infinite."""
    c = column if not isinstance(column, str) else F.col(column)
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)
