"""Cutting lineage in the folder that all executors share.

Iterative operators and operators that scan one intermediate several times write it once. The folder
is the cluster's ``spark.checkpoint.dir``; in a local session where that is unset a new
temporary folder is set, once a session.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the folder for checkpoints, setting a temporary one only where a local session names none. On a cluster a folder of one machine would not do."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = named or tempfile.mkdtemp(prefix="corvane-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return it without its lineage. Survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    For loops: a checkpoint keeps the estimated size of its plan, and over many joins in turn the estimates multiply beyond all bounds; a table has its own.
    """
    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
