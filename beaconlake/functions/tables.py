"""Intermediate tables in the folder that the cluster shares.

Written Parquet cuts a plan's lineage: it survives the loss of any executor and every machine can read it. The folder is that of ``spark.checkpoint.dir``, which a
cluster must name; only where Spark runs in one process a temporary folder of that machine is made.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _local[app]


def kept(df: DataFrame, label: str) -> DataFrame:
    """A scan of the rows, written as a table of the shared folder; it stays there until that folder is cleared."""
    path = f"{shared_folder(df.sparkSession)}/tables/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
