"""Sales fixtures: headers, codes, French numbers, filters, documents, stream parity."""

import json

import pytest
from pyspark.sql import functions as F

from cadastrum.functions import fold_header
from cadastrum.plans import sales
from cadastrum.registry import standins
from cadastrum.session import scratch_path
from cadastrum.sources import readers, sinks
from cadastrum.streaming.sales_stream import read_latest_totals, run_funnel_stream, run_silver_stream

LEGACY = {
    "Nature mutation": "Vente", "Type local": "Maison", "Valeur fonciere": "123456,78", "Surface reelle bati": "95",
    "Nombre pieces principales": "5", "Surface terrain": "250", "Code departement": "33", "Code commune": "063",
    "Commune": "Bordeaux",
}


def frame(spark, *rows):
    names = list(rows[0])
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"`{n}` string" for n in names))


def test_legacy_headers_become_canonical(spark):
    row = sales.to_bronze(frame(spark, LEGACY), 2018).first()
    assert row["code_commune"] == "33063" and row["nom_commune"] == "Bordeaux"
    assert row["valeur_fonciere"] == "123456,78"
    assert row["latitude"] == "" and row["longitude"] == "" and row["year"] == 2018


def test_header_folding():
    assert fold_header(" Valeur foncière ") == "valeur_fonciere"
    assert fold_header("Œuvre d'art") == "uvre_d_art"
    assert fold_header("cœur") == "c_ur" and fold_header("cœur", keep_unmapped_as="") == "cur"
    assert fold_header("Libellé", fold_accents=False) == "libell"


def test_overseas_code_repair_keeps_its_six_characters(spark):
    row = sales.to_bronze(frame(spark, {**LEGACY, "Code departement": "971", "Code commune": "105"})).first()
    assert row["code_commune"] == "971105"


def test_silver_row(spark):
    bronze = frame(
        spark,
        {"nature_mutation": "Vente", "type_local": "Appartement", "valeur_fonciere": "200000,50",
         "surface_reelle_bati": "50,0", "nombre_pieces_principales": "2", "surface_terrain": "",
         "code_departement": "75", "code_commune": "75101", "nom_commune": "Paris"},
    ).withColumn("year", F.lit(2020))
    row = sales.to_silver(bronze).first()
    assert row["valeur_fonciere"] == 200000.50 and row["surface_reelle_bati"] == 50.0
    assert row["price_m2"] == pytest.approx(4000.01) and row["year"] == 2020
    assert row["surface_terrain"] is None and row["longitude"] is None


def test_funnel_counts_the_first_failing_rule(spark):
    base = {"nature_mutation": "Vente", "type_local": "Maison", "valeur_fonciere": "100000",
            "surface_reelle_bati": "100", "code_departement": "01", "code_commune": "01001", "nom_commune": "X"}
    bronze = frame(
        spark, base, {**base, "nature_mutation": "Echange", "type_local": "Local"}, {**base, "type_local": "Local"},
        {**base, "valeur_fonciere": "s"}, {**base, "surface_reelle_bati": "0"}, {**base, "code_departement": " "},
        {**base, "valeur_fonciere": "29 999,99"}, {**base, "valeur_fonciere": "30000"},
        {**base, "valeur_fonciere": "5000000"}, {**base, "surface_reelle_bati": "8,9"},
    ).withColumn("year", F.lit(2020))
    row = sales.quality_funnel(bronze, ["year"]).first()
    assert row.asDict() == {
        "year": 2020, "rows_read": 10, "filtered_non_sales": 1, "filtered_non_residential": 1,
        "filtered_invalid_values": 3, "filtered_outliers": 2, "rows_kept": 3,
    }
    assert sales.to_silver(bronze).count() == 3


def test_department_groups_keep_nulls(spark):
    silver = spark.createDataFrame(
        [("01", 100.0, 2020), (None, 300.0, 2020), (None, 400.0, 2020)], "code_departement string, price_m2 double, year long"
    )
    rows = {r["department_code"]: r for r in sales.by_department(silver).collect()}
    assert rows[None]["sales_count"] == 2 and rows[None]["median_price_m2"] == 350.0


@pytest.mark.parametrize("sep", [",", ";", "|", "\t"])
def test_delimiters_and_gzip(spark, sep):
    path = scratch_path(spark, "delimited")
    rows = spark.createDataFrame([("1", ""), ("é", "x y")], "col1 string, col2 string")
    rows.coalesce(1).write.options(header=True, sep=sep, compression="gzip", emptyValue="").csv(path)
    assert readers.detect_delimiter(spark, path) == sep
    read = readers.read_gzip(spark, path, partitions=2)
    assert sorted(map(tuple, read.collect())) == [("1", ""), ("é", "x y")]


def test_byte_order_mark_is_dropped(spark, tmp_path):
    path = tmp_path / "bom.csv"
    path.write_bytes("﻿col1,col2\n1,2\n".encode())
    read = readers.read_delimited(spark, str(path))
    assert read.columns == ["col1", "col2"] and tuple(read.first()) == ("1", "2")


def test_year_overwrite_is_dynamic_and_refuses_empty(spark):
    path = scratch_path(spark, "years")
    rows = spark.createDataFrame([(1, 2020), (2, 2021)], "v long, year long")
    assert sinks.write_years(rows, path) == 2
    sinks.write_years(rows.where("year = 2021").withColumn("v", F.lit(9).cast("long")), path)
    assert sorted(map(tuple, readers.read_years(spark, path).select("v", "year").collect())) == [(1, 2020), (9, 2021)]
    with pytest.raises(sinks.EmptyOutput):
        sinks.write_years(rows.where("v > 100"), path)
    assert readers.read_years(spark, path).count() == 2


def test_summary_document(spark):
    silver = spark.createDataFrame(
        [("01", "Maison", 1000.0, 50.0, 2020), ("02", "Appartement", 2000.0, 60.0, 2020)],
        "code_departement string, type_local string, price_m2 double, surface_reelle_bati double, year long",
    )
    document = json.loads(sales.summary_documents(silver, "file", "now").first()["document"])
    assert document["total_sales_count"] == 2 and document["median_price_m2"] == 1500.0
    assert document["sales_count_by_department"] == {"01": 1, "02": 1}
    assert document["median_price_m2_by_property_type"] == {"Appartement": 2000.0, "Maison": 1000.0}
    assert document["filters"]["outliers"]["price_m2_max"] == 50000
    assert [d["department_code"] for d in document["departments"]] == ["01", "02"]


def test_nulls_and_nan_stay_in_documents(spark):
    df = spark.createDataFrame([(float("nan"), None)], "a double, b string").withColumn(
        "t", F.lit("2024-01-02 03:04:05").cast("timestamp_ntz")
    )
    assert json.loads(sinks.as_document(df).first()["document"]) == {"a": None, "b": None, "t": "2024-01-02T03:04:05"}


def test_camel_case_summaries_read_alike(spark, tmp_path):
    path = tmp_path / "summary.json"
    path.write_text(json.dumps({"year": 2020, "totalSalesCount": 5, "salesCountByDepartment": {"01": 5}}))
    row = sales.read_summaries(spark, str(path)).first()
    assert row["total_sales_count"] == 5 and row["sales_count_by_department"] == {"01": 5}
    assert row["median_price_m2"] is None and row["generated_at"] == "" and row["median_price_m2_by_department"] == {}


def test_stream_equals_batch(spark):
    source = scratch_path(spark, "stream-in")
    rows = standins.sales(spark, "/root/testdata/sf0.001")
    rows.repartition(5).write.parquet(source)
    target = run_silver_stream(spark, source, scratch_path(spark, "stream-out"), max_files=2)
    batch = sales.to_silver(rows)
    streamed = readers.read_years(spark, target).select(*batch.columns)
    assert streamed.count() == batch.count()
    assert streamed.exceptAll(batch).isEmpty()
    target = run_funnel_stream(spark, source, scratch_path(spark, "funnel"), max_files=2)
    funnel = read_latest_totals(spark, target)
    assert sorted(map(tuple, funnel.collect())) == sorted(map(tuple, sales.quality_funnel(rows, ["year"]).collect()))


def test_filters_reach_the_scan_and_columns_are_pruned(spark):
    path = scratch_path(spark, "bronze-typed")
    standins.sales(spark, "/root/testdata/sf0.001").write.parquet(path)
    plan = sales.by_property_type(sales.to_silver(spark.read.parquet(path)))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(valeur_fonciere,0.0)" in text and "surface_terrain" not in text
    assert "PythonUDF" not in text and "ArrowEval" not in text


def test_stream_files_follow_rows_and_not_tasks(spark, monkeypatch):
    """A file per year where rows are few, however many tasks read them; equal rows otherwise."""
    from cadastrum.registry import sales as queries

    raw = standins.raw_sales(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(queries.standins, "raw_sales", lambda *_: raw.repartition(40))
    written = spark.read.parquet(queries._bronze_files(spark, "/root/testdata/sf0.001"))
    assert len(written.inputFiles()) == written.select("part").distinct().count()
    assert written.drop("part").exceptAll(sales.to_bronze(raw, F.col("year"))).isEmpty() and written.count() == raw.count()


def test_funnel_state_has_few_partitions(spark, tmp_path):
    rows = spark.createDataFrame([("Vente", 2020), ("Echange", 2021)], "nature_mutation string, year long")
    full = rows.withColumns({n: F.lit("") for n in ("type_local", "valeur_fonciere", "surface_reelle_bati", "code_departement")})
    full.write.parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    target = run_funnel_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), checkpoint=str(tmp_path / "check"))
    assert len([p for p in (tmp_path / "check" / "state" / "0").iterdir() if p.name.isdigit()]) <= 2 < int(before)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert read_latest_totals(spark, target).agg(F.sum("rows_read")).first()[0] == 2
