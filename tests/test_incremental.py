"""Snapshots and builds of changed years."""

import threading

import pytest
from pyspark.sql import functions as F

from cadastrum.plans import incremental, layers
from cadastrum.registry import standins
from cadastrum.sources import snapshots
from cadastrum.sources.sinks import EmptyOutput

SF_DIR = "/root/testdata/sf0.001"


def years(spark, *rows):
    return spark.createDataFrame(list(rows), "year long, v string")


def content(snapshot, spark):
    return sorted((r.year, r.v) for r in snapshot.read(spark).collect())


def test_a_year_is_replaced_and_others_stay(spark, tmp_path):
    path = str(tmp_path / "t")
    assert snapshots.current(spark, path).version == 0
    snapshots.publish(years(spark, (2019, "a"), (2020, "b")), path, {2019: "x", 2020: "y"})
    first = snapshots.current(spark, path)
    snapshots.publish(years(spark, (2020, "c"), (2020, "d"), (2021, "not asked for")), path, {2020: "z"})
    second = snapshots.current(spark, path)
    assert content(first, spark) == [(2019, "a"), (2020, "b")]  # a reader keeps the version it resolved
    assert content(second, spark) == [(2019, "a"), (2020, "c"), (2020, "d")]
    assert {y: (v.version, v.rows, v.fingerprint) for y, v in second.years.items()} == {2019: (1, 1, "x"), 2020: (2, 2, "z")}
    assert content(snapshots.forget(spark, path, [2020]), spark) == [(2020, "c"), (2020, "d")]


def test_a_writer_that_stops_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshots.publish(years(spark, (2019, "a"), (2020, "b")), path, {2019: "x", 2020: "y"})
    failing = years(spark, (2019, "new"), (2020, "new")).repartition(2, "year").withColumn(
        "v", F.when(F.col("year") == 2020, F.raise_error(F.lit("stopped"))).otherwise(F.col("v"))
    )
    with pytest.raises(Exception, match="stopped"):
        snapshots.publish(failing, path, {2019: "x2", 2020: "y2"})
    # Stopped after the data and before the pointer: files of a version nobody points to.
    years(spark, (2019, "half")).write.mode("overwrite").partitionBy("year").parquet(f"{path}/data/version=2")
    assert content(snapshots.current(spark, path), spark) == [(2019, "a"), (2020, "b")]
    snapshots.publish(years(spark, (2020, "c")), path, {2020: "y3"})
    assert content(snapshots.current(spark, path), spark) == [(2019, "a"), (2020, "c")]


def test_no_rows_are_refused_before_the_pointer(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshots.publish(years(spark, (2019, "a")), path, {2019: "x"})
    with pytest.raises(EmptyOutput):
        snapshots.publish(years(spark).where("false"), path, {2019: "y"})
    assert snapshots.current(spark, path).version == 1


def test_second_writer_of_a_version_fails(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshots.publish(years(spark, (2019, "a")), path, {2019: "x"})
    with pytest.raises(Exception, match="(?i)already exists"):
        snapshots._point(spark, snapshots.Snapshot(path, 1, {}))


def test_only_changed_years_are_built(spark, tmp_path):
    sales, local = standins.sales(spark, SF_DIR), standins.income_silver(spark, SF_DIR)
    inputs = {"sales_bronze": str(tmp_path / "sales"), "income_silver": str(tmp_path / "income")}
    later = (F.col("year") == 2017) & (F.col("surface_reelle_bati") > 25)
    sales.where(~later).write.partitionBy("year").parquet(inputs["sales_bronze"])
    local.write.partitionBy("year").parquet(inputs["income_silver"])
    base = str(tmp_path / "built")
    first = incremental.build(spark, inputs, base)
    assert all(len(found) > 3 for found in first.values())
    assert not any(incremental.build(spark, inputs, base).values())
    sales.where(later).write.mode("append").partitionBy("year").parquet(inputs["sales_bronze"])
    built = incremental.build(spark, inputs, base)
    assert built == {layer.name: ([] if layer.name.startswith("income") else [2017]) for layer in incremental.LAYERS}

    whole = layers.build_all(sales, local, str(tmp_path / "whole"), list(range(2000, 2040)))
    for layer in incremental.LAYERS:
        ours = snapshots.current(spark, f"{base}/{layer.name}").read(spark)
        theirs = spark.read.parquet(whole[layer.name]).withColumn("year", F.col("year").cast("long")).select(*ours.columns)
        assert ours.exceptAll(theirs).count() == 0 and theirs.exceptAll(ours).count() == 0, layer.name


def test_years_that_leave_the_input_leave_the_layers(spark, tmp_path):
    layer = incremental.Layer("t", ("raw",), lambda rows: rows)
    for folder, rows in (("a", [(2019, "a"), (2020, "b")]), ("b", [(2020, "b")])):
        years(spark, *rows).write.partitionBy("year").parquet(str(tmp_path / folder))
    base = str(tmp_path / "built")
    assert incremental.build(spark, {"raw": str(tmp_path / "a")}, base, (layer,)) == {"t": [2019, 2020]}
    incremental.build(spark, {"raw": str(tmp_path / "b")}, base, (layer,))
    assert list(snapshots.current(spark, f"{base}/t").years) == [2020]


def test_independent_layers_are_built_side_by_side(spark, tmp_path):
    together = threading.Barrier(2, timeout=60)

    def meet(rows):
        together.wait()
        return rows

    years(spark, (2019, "a")).write.partitionBy("year").parquet(str(tmp_path / "raw"))
    pair = (incremental.Layer("t", ("raw",), meet), incremental.Layer("u", ("raw",), meet), incremental.Layer("v", ("t", "u"), lambda t, u: t.union(u)))
    base = str(tmp_path / "built")
    assert incremental.build(spark, {"raw": str(tmp_path / "raw")}, base, pair) == {"t": [2019], "u": [2019], "v": [2019]}
    assert content(snapshots.current(spark, f"{base}/v"), spark) == [(2019, "a"), (2019, "a")]
