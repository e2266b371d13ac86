"""Sketches of series by device and day: error within the stated bound, and merges of days and devices."""

import datetime

import pytest
from pyspark.sql import functions as F

from beaconlake.operators import metrics


def test_sketches_merge(spark):
    day = F.date_add(F.lit(datetime.date(2024, 1, 1)), (F.col("id") % 5).cast("int"))
    # 6000 series of two devices; each is seen on several days, and half of those of one device are the other's, too
    rows = spark.range(60_000).select(
        F.concat(F.lit("d"), (F.col("id") % 2).cast("string")).alias("device_id"), F.lit("m").alias("metric"), day.alias("day"), F.create_map(F.lit("task"), F.pmod(F.floor(F.col("id") / 2) * 7, F.lit(3000)).cast("string")).alias("attrs")
    )
    sketches = metrics.series_sketches(rows, F.col("day"))
    assert sketches.count() == 10
    exact = {r.device_id: r.series for r in metrics.series_cardinality(rows).collect()}
    for r in metrics.estimate_series(sketches, "device_id").collect():
        assert r.series == pytest.approx(exact[r.device_id], rel=0.05)
    whole = metrics.series_sketches(rows, F.lit(1))  # of all days at once
    assert {r.device_id: r.series for r in metrics.estimate_series(whole, "device_id").collect()} == pytest.approx({r.device_id: r.series for r in metrics.estimate_series(sketches, "device_id").collect()}, rel=0.03)
    both = rows.select("metric", F.to_json(F.map_entries("attrs")).alias("a")).distinct().count()
    assert metrics.estimate_series(sketches).first().series == pytest.approx(both, rel=0.05)
    some = metrics.estimate_series(sketches.filter("day < '2024-01-03'"), "device_id").collect()
    assert len(some) == 2


def test_no_rows(spark):
    none = spark.createDataFrame([], "device_id string, metric string, attrs map<string,string>")
    assert metrics.estimate_series(metrics.series_sketches(none, F.lit(1)), "device_id").count() == 0
