"""Quantiles from stored batches equal a recount of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from cadastrum.operators import quantiles
from cadastrum.operators.histograms import HistogramStore
from cadastrum.operators.quantiles import quantile_table, weighted_medians


@pytest.fixture(scope="module")
def batches(spark):
    chance = random.Random(12)
    rows = []
    for batch in range(4):
        for _ in range(500):
            key = chance.choice(["a", "b", None, "c" if batch == 2 else "a"])
            value = chance.choice([chance.lognormvariate(7, 1), -5.0, 0.0, None, float("nan"), 1000.0])
            rows.append((batch, key, 2017 + min(batch, 2), value, chance.uniform(-10, 10), chance.choice([0.0, 1.0, 2.5, None])))
    return spark.createDataFrame(rows, "batch int, k string, year long, v double, u double, w double").cache()


SPECS = {"v": {"d1": 0.1, "median": 0.5, "d9": 0.9}, "u": {"least": 0.0, "middle": 0.5, "most": 1.0}}


def same(ours, theirs):
    return sorted(map(str, ours.collect())) == sorted(map(str, theirs.select(*ours.columns).collect()))


def test_batches_merge_into_the_whole(spark, batches, tmp_path):
    store = HistogramStore(str(tmp_path / "h"), ("k", "year"), ("v", "u"), by="year")
    for upto in range(4):
        store.append(batches.where(F.col("batch") == upto), upto)
        seen = batches.where(F.col("batch") <= upto)
        assert same(store.quantiles(spark, SPECS), quantile_table(seen, ["k", "year"], SPECS))
    assert store.batches(spark) == [0, 1, 2, 3]


def test_weighted_medians(spark, batches, tmp_path):
    store = HistogramStore(str(tmp_path / "h"), ("k",), ("v", "u"))
    for batch in range(4):
        store.append(batches.where(F.col("batch") == batch), batch, "w")
    assert same(store.weighted_medians(spark, {"v": "a", "u": "b"}), weighted_medians(batches, ["k"], {"v": "a", "u": "b"}, "w"))


def test_a_repeated_batch_replaces_itself(spark, batches, tmp_path):
    store = HistogramStore(str(tmp_path / "h"), ("k", "year"), ("v", "u"), by="year")
    store.append(batches.where("batch = 0"), 7)
    store.append(batches.where("batch < 2"), 7)
    assert same(store.quantiles(spark, SPECS), quantile_table(batches.where("batch < 2"), ["k", "year"], SPECS))


def test_only_folders_of_located_bins_are_read(spark, tmp_path):
    """Of prices spread over many octaves, the median is found in one."""
    df = spark.range(20_000).select(F.lit(2020).alias("year"), F.exp(F.col("id") / 2000).alias("v"))
    store = HistogramStore(str(tmp_path / "h"), ("year",), ("v",), by="year")
    store.append(df, 0)
    assert same(store.quantiles(spark, {"v": {"m": 0.5}}), quantile_table(df, ["year"], {"v": {"m": 0.5}}))
    near = store.near(spark, quantiles.quantile_targets([0.5]))[1]
    every = store.rows(spark, [0])
    assert near.select("folder", "octave").distinct().count() <= 2 and every.select("octave").distinct().count() >= 30
    assert near.count() < 2_000
    plan = near._jdf.queryExecution().executedPlan().toString()
    filters = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "PartitionFilters: [" in filters and "PartitionFilters: []" not in filters


def test_a_batch_without_weights_is_not_seen(spark, batches, tmp_path, monkeypatch):
    """A writer that stops after the values leaves the earlier result."""
    store = HistogramStore(str(tmp_path / "h"), ("k", "year"), ("v", "u"), by="year")
    store.append(batches.where("batch = 0"), 0)
    monkeypatch.setattr(quantiles, "bin_weights", lambda rows: rows.missing)
    with pytest.raises(AttributeError):
        store.append(batches.where("batch = 1"), 1)
    monkeypatch.undo()
    assert same(store.quantiles(spark, SPECS), quantile_table(batches.where("batch = 0"), ["k", "year"], SPECS))


def test_other_columns_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="not the store's"):
        HistogramStore(str(tmp_path), ("k",), ("v",)).quantiles(spark, {"u": {"m": 0.5}})
