"""Intermediate tables in the folder that the cluster shares.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir``: the committed files survive the loss of any
executor and can be read by all of them. Only where Spark runs in one process (local tests) and the setting is absent, one folder of that
machine is made for the application; a cluster without the setting is an error. A job drops its tables after their last reader (``temporary``);
a table that a returned DataFrame still reads stays until that folder is cleared.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables of this application."""
    configured = spark.conf.get("spark.checkpoint.dir", "") or ""
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _local_roots[app]


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str, paths: list[str] | None = None, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a new Parquet table in the shared folder and return a scan of it; its path is added to ``paths``.

    The shuffle files of the write go as soon as the table is committed, since nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/tables/{label}-{uuid.uuid4().hex}"
    if paths is not None:
        paths.append(path)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, paths: list[str]) -> None:
    """Remove tables that nothing reads any more; the list is empty then."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    paths.clear()


@contextmanager
def temporary(spark: SparkSession) -> Iterator[list[str]]:
    """A list of paths whose tables are removed at the end."""
    paths: list[str] = []
    try:
        yield paths
    finally:
        dropped(spark, paths)
