"""Intermediate results that are written once, in a folder that all machines share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import weakref
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it. A cluster without that folder
    gets the package by ``--py-files``, as usual."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, one of our own on a session that
    runs in one process, an error on a cluster, whose machines would not see it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


#: What ``stored`` has told.
KEPT: weakref.WeakSet[DataFrame] = weakref.WeakSet()


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there. What has come
    from here is not written again."""
    if df in KEPT:
        return df
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/evwatch-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    KEPT.add(out)
    return out
