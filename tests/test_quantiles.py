"""Order statistics against brute force, and the plan shape."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadastrum.operators import quantiles
from cadastrum.operators.quantiles import (
    quantile_table, weighted_mean_of, weighted_median, weighted_medians, with_table_weight,
)


def brute_weighted_median(pairs):
    kept = sorted((v, w) for v, w in pairs if v is not None and w is not None and w > 0 and not math.isnan(v))
    if not kept:
        return None
    half, upto = sum(w for _, w in kept) / 2, 0
    for value, weight in kept:
        upto += weight
        if upto >= half:
            return value


@pytest.fixture(params=[None, 0, 250], ids=["sorted", "binned", "both"], autouse=True)
def sorted_rows(request, monkeypatch):
    """All groups sorted, all binned, or the larger ones binned."""
    if request.param is not None:
        monkeypatch.setattr(quantiles, "SORTED_ROWS", request.param)
    return request.param


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    data = []
    for key in ("hot", "plain", None, "ties", "negative", "single", "nulls", "narrow", "crowded", "tiny"):
        size = {"hot": 3000, "single": 1, "nulls": 5}.get(key, 200)
        for _ in range(size):
            value = {
                "ties": lambda: float(rng.choice([1, 1, 1, 2])),
                "negative": lambda: rng.uniform(-500, 500),
                "nulls": lambda: None,
                "narrow": lambda: 1_000_000 + rng.random() * 1e-3,
                # Neighbouring doubles, all in one grain but for a far outlier.
                "crowded": lambda: rng.choice([1e9, *(1.0 + i * 2.0**-52 for i in range(300))]),
                "tiny": lambda: rng.choice([-1, 0, 1]) * rng.random() * 1e-300,
            }.get(key, lambda: rng.lognormvariate(7, 1))()
            if key == "hot" and rng.random() < 0.05:
                value = rng.choice([None, float("nan")])
            data.append((key, value, rng.choice([None, -1.0, 0.0, 1.0, 2.0, 7.0])))
    return data


def test_quantiles_match_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "k string, v double, w double")
    table = quantile_table(df, ["k"], {"v": {"d1": 0.1, "median": 0.5, "d9": 0.9}}, {"n": F.count("*")}, None)
    found = {r["k"]: r for r in table.collect()}
    assert set(found) == {r[0] for r in rows}
    for key, row in found.items():
        values = [v for k, v, _ in rows if k == key and v is not None and not math.isnan(v)]
        assert row["n"] == sum(1 for r in rows if r[0] == key)
        for name, p in (("d1", 0.1), ("median", 0.5), ("d9", 0.9)):
            if not values:
                assert row[name] is None
            else:
                assert row[name] == pytest.approx(float(np.quantile(values, p)), rel=1e-12, abs=1e-12)


def test_weighted_median_matches_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "k string, v double, w double")
    table = weighted_median(df, ["k"], "v", "w", "m")
    found = {r["k"]: r["m"] for r in table.collect()}
    for key in {r[0] for r in rows}:
        assert found.get(key) == brute_weighted_median([(v, w) for k, v, w in rows if k == key])


def test_several_columns_in_one_pass(spark, rows):
    df = spark.createDataFrame(rows, "k string, v double, w double").withColumn("u", -F.col("v"))
    both = {r["k"]: (r["m"], r["n"]) for r in weighted_medians(df, ["k"], {"v": "m", "u": "n"}, "w").collect()}
    for key in {r[0] for r in rows}:
        pairs = [(v, w) for k, v, w in rows if k == key]
        expected = brute_weighted_median(pairs), brute_weighted_median([(None if v is None else -v, w) for v, w in pairs])
        assert both.get(key, (None, None)) == expected


def test_without_keys(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 101)], "v double")
    row = quantile_table(df, [], {"v": {"median": 0.5}}, {"n": F.count("*")}).first()
    assert (row["median"], row["n"]) == (50.5, 100)


def test_published_price_quantiles(spark):
    prices = [1000.0, 1200.0, 1500.0, 2000.0, 2500.0, 3000.0]
    df = spark.createDataFrame([(2024, p, 30.0 + 10 * i) for i, p in enumerate(prices)], "year long, price_m2 double, surface_reelle_bati double")
    from cadastrum.plans.sales import national

    row = national(df).first()
    assert (row["d1_price_m2"], row["median_price_m2"], row["d9_price_m2"]) == (1100.0, 1750.0, 2750.0)
    assert (row["median_surface"], row["total_sales_count"]) == (55.0, 6)


def test_weight_choice_and_mean(spark):
    df = spark.createDataFrame(
        [(2018, 10.0, None, 1.0), (2018, None, 5.0, 3.0), (2019, None, 4.0, 1.0), (2020, None, None, 9.0)],
        "year long, tax_households double, population double, v double",
    )
    weighted = with_table_weight(df, ["year"])
    got = {(r["year"], r["v"]): (r["weight"], r["weight_source"]) for r in weighted.collect()}
    assert got[(2018, 1.0)] == (10.0, "tax_households") and got[(2018, 3.0)] == (None, "tax_households")
    assert got[(2019, 1.0)] == (4.0, "population") and got[(2020, 9.0)] == (1.0, None)
    means = dict(weighted.groupBy("year").agg(weighted_mean_of(F.col("v"), F.col("weight")).alias("m")).collect())
    assert means == {2018: 1.0, 2019: 1.0, 2020: 9.0}


def test_no_large_group_is_held_by_one_task(spark, monkeypatch):
    """No percentile buffer; with a group beyond the bound, no window over its rows runs."""
    df = spark.range(1000).select(F.when(F.col("id") < 900, 0).otherwise(F.col("id")).alias("k"), F.rand(1).alias("v"))
    monkeypatch.setattr(quantiles, "SORTED_ROWS", 500)
    table = quantile_table(df, ["k"], {"v": {"m": 0.5}})
    assert "percentile" not in table._jdf.queryExecution().executedPlan().toString()
    large = table.where("k = 0")
    windows = [line for line in large._jdf.queryExecution().executedPlan().toString().splitlines() if " Window " in line]
    # Bins, cells of a bin, values of a cell; the sorted groups' running weight is over (key, column), without the large keys.
    assert windows and all(any(c in line for c in ("__bin", "__cell", "__total", "__upto")) for line in windows)
    assert "LeftAnti" in table._jdf.queryExecution().executedPlan().toString()


def test_small_groups_take_few_shuffles(spark, sorted_rows):
    """The branch of the large groups goes once their keys are counted."""
    if sorted_rows is not None:
        pytest.skip("bound changed")
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.rand(1).alias("v"), F.rand(2).alias("w"))
    table = quantile_table(df, ["k"], {"v": {"m": 0.5, "d": 0.1}, "w": {"n": 0.5}}, {"rows": F.count("*")})
    table.collect()
    plan = table._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    shuffles = [line for line in final.splitlines() if " Exchange " in line and "hashpartitioning" in line]
    assert "isFinalPlan=true" in plan and len(shuffles) <= 4, final


def test_infinities_are_ends(spark):
    df = spark.createDataFrame([(float("-inf"),), (1.0,), (2.0,), (float("inf"),)], "v double")
    row = weighted_median(df, [], "v", F.lit(1.0), "m").first()
    assert row["m"] == 1.0
