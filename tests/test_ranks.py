"""Global positions and numbered pages against plain sorting."""

import random

import pytest
from pyspark.sql import functions as F

from cadastrum.operators.ranks import Zones, with_position


@pytest.fixture(scope="module")
def rows(spark):
    chance = random.Random(9)
    data = [(chance.choice(["a", "a", "a", "b", None]), chance.choice([None, chance.randrange(30), 7]), i) for i in range(3000)]
    return data, spark.createDataFrame(data, "k string, v long, n long").repartition(7).cache()


def test_positions(rows):
    data, df = rows
    found = with_position(df, [F.col("v").desc_nulls_last(), F.col("n")], ["k"]).collect()
    assert len(found) == len(data)
    for key in ("a", "b", None):
        own = sorted((r for r in data if r[0] == key), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        assert [(r.k, r.v, r.n) for r in sorted((r for r in found if r.k == key), key=lambda r: r.position)] == own
        assert sorted(r.position for r in found if r.k == key) == list(range(1, len(own) + 1))


def test_no_window_over_a_group(rows):
    plan = with_position(rows[1], [F.col("v")], ["k"])._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if " Window " in line]
    assert windows and all("__range" in line for line in windows)


def test_pages_by_number(spark, rows, tmp_path):
    data, df = rows
    zones = Zones(str(tmp_path / "z")).write(df, [F.col("v").asc_nulls_last(), F.col("n")], partitions=9)
    expected = sorted(data, key=lambda r: (r[1] is None, r[1] or 0, r[2]))
    assert zones.total(spark) == len(data)
    for offset, limit in ((0, 10), (1234, 50), (2990, 50), (3000, 5), (10**9, 5), (0, 3000), (700, 1)):
        page = zones.page(spark, offset, limit).collect()
        assert [(r.k, r.v, r.n) for r in page] == expected[offset : offset + limit]
        assert [r.position for r in page] == list(range(min(offset, 3000), min(offset + limit, 3000)))
    assert len(zones.zones_of(spark, 1500, 50)) <= 2
    plan = zones.page(spark, 1500, 50)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan


def test_no_rows(spark, tmp_path):
    empty = spark.createDataFrame([], "v long")
    assert with_position(empty, [F.col("v")]).collect() == []
    zones = Zones(str(tmp_path / "z")).write(empty, [F.col("v")])
    assert zones.total(spark) == 0 and zones.page(spark, 0, 5).collect() == []
