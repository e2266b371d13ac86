"""Operators leave the session as it was, and keep intermediate tables where they belong."""

import pytest

from beaconlake.llm import queries, scratch


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_settings_stay(spark, name):
    settings = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch", scratch.CLEANUP, "spark.sql.shuffle.partitions"
    before = [spark.conf.get(k, None) for k in settings]
    queries.QUERIES[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    assert [spark.conf.get(k, None) for k in settings] == before


def test_no_local_folder_on_a_cluster(monkeypatch):
    class Context:
        master, applicationId = "yarn", "app"

    class Session:
        sparkContext = Context()

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_root(Session())


def test_tables_are_dropped(spark):
    with scratch.temporary(spark) as paths:
        assert scratch.written(spark.range(3).toDF("a"), "kept", paths).count() == 3
        (path,) = paths
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
