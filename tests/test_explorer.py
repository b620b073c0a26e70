"""Explorer fixtures: pages, gates, warnings, typed filters and sorting, text."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from cadastrum import catalogue as cat
from cadastrum.functions import display_date, display_number, french_number, preview_label, preview_value, repair_text
from cadastrum.operators.filters import any_column_contains, matches, where_matches
from cadastrum.operators.shape import dense_years, promote_header, two_maps_to_rows
from cadastrum.plans import explorer, income, publish
from cadastrum.schemas import INCOME_GOLD, conform
from cadastrum.session import scratch_path


@pytest.fixture(scope="module")
def gold(spark):
    rows = [(f"7510{i}", name, "commune", 2023, 1000.0 * i) for i, name in enumerate(["Paris 1", "Paris 2", None, "Lyon", "paris 4"])]
    rows.append(("75200", "Paris 9", "commune", 2023, None))
    rows.append(("75201", "Paris 8", "commune", 2018, 5.0))
    df = spark.createDataFrame(rows, "geography_code string, geography_name string, geography_level string, year long, median_income double")
    df = df.withColumns({"indicator_source": F.lit(cat.OFFICIAL), "is_official": F.lit(True)})
    return conform(df, INCOME_GOLD)


def test_page_search_sort_and_count(gold):
    request = explorer.PageRequest(2023, "median_income", search="Paris", sort_by="geography_name", limit=2)
    page = explorer.page(gold, request)
    assert page.columns == [*explorer.FIXED_COLUMNS, "indicator_value"]
    assert [r["geography_name"] for r in page.collect()] == ["Paris 1", "Paris 2"]
    assert explorer.filtered_count(gold, request).first()[0] == 3
    wild = explorer.PageRequest(2023, "median_income", search="p_r%1")
    assert explorer.filtered_count(gold, wild).first()[0] == 1
    slash = explorer.PageRequest(2023, "median_income", search="\\")
    assert explorer.filtered_count(gold, slash).first()[0] == 0


def test_nulls_come_last_in_both_directions(gold):
    for descending in (False, True):
        request = explorer.PageRequest(2023, "median_income", sort_by="geography_name", descending=descending)
        assert explorer.page(gold, request).collect()[-1]["geography_name"] is None


def test_page_uses_top_k(gold):
    plan = explorer.page(gold, explorer.PageRequest(2023, "median_income"))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_limits_and_sort_whitelist(gold):
    assert [explorer.page_limit(v) for v in (None, 0, 20.9, 500, float("nan"))] == [50, 1, 20, 200, 50]
    assert [explorer.page_offset(v) for v in (None, -5, 40.2)] == [0, 0, 40]
    with pytest.raises(ValueError, match="Unsupported sort column"):
        explorer.page(gold, explorer.PageRequest(2023, "median_income", sort_by="year; DROP"))


def test_gate_options_and_warnings(spark, gold):
    table = income.availability(gold)
    options = explorer.indicator_options(table)
    assert [(r["year"], r["indicator"]) for r in options.orderBy("year", "position").collect()] == [
        (2018, "median_income"), (2023, "median_income"),
    ]
    result = explorer.query_page(gold, table, explorer.PageRequest(2023, "median_income", limit=3))
    assert result.rows.count() == 3 and result.total.first()[0] == 5 and (result.limit, result.offset) == (3, 0)
    (warning,) = [r["warnings"] for r in result.warnings.collect()]
    assert warning == [explorer.BREAK_WARNING, "La couverture publiée pour revenu médian est partielle (83.3 %)."]
    for request in (explorer.PageRequest(2022, "median_income"), explorer.PageRequest(2023, "d1_income"), explorer.PageRequest(2023, "median_income", "department")):
        with pytest.raises(explorer.NotAvailable):
            explorer.query_page(gold, table, request)


def test_trend_skips_the_unpublished_year(gold):
    got = {(r["year"]): r["value"] for r in explorer.trend_series(gold, [2017, 2018, 2022, 2023], ["median_income"]).collect()}
    assert got == {2017: None, 2018: 5.0, 2023: 2000.0}


@pytest.fixture(scope="module")
def cells(spark):
    rows = [("Beta", "20", "2024-02-10", "Oui"), ("Alpha", "10", "05/01/2024", "0"), ("Gamma", "30,5", "2024-03-15", "?"), ("élan", "x", "", None)]
    return spark.createDataFrame(rows, "name string, amount string, created string, flag string")


def names(df):
    return {r["name"] for r in df.collect()}


def test_typed_filters(cells):
    assert names(cells.where(matches("amount", "number-range", minimum="15"))) == {"Beta", "Gamma"}
    assert names(cells.where(matches("amount", "number-range"))) == {"Beta", "Alpha", "Gamma", "élan"}
    assert names(cells.where(matches("amount", "number-range", minimum="abc"))) == {"Beta", "Alpha", "Gamma"}
    assert names(cells.where(matches("created", "date-range", start="2024-02-01"))) == {"Beta", "Gamma"}
    assert names(cells.where(matches("created", "date-range", end="31/01/2024"))) == {"Alpha"}
    assert names(cells.where(matches("flag", "boolean-select", boolean="true"))) == {"Beta"}
    assert names(cells.where(matches("flag", "boolean-select", boolean="false"))) == {"Alpha"}
    assert len(names(cells.where(matches("flag", "boolean-select")))) == 4
    assert names(cells.where(matches("name", "text", text=" LPH "))) == {"Alpha"}
    assert names(cells.where(any_column_contains(["name", "amount"], "0"))) == {"Beta", "Alpha", "Gamma"}


def test_typed_filters_reach_the_scan(spark):
    path = scratch_path(spark, "typed")
    rows = spark.sql(
        "SELECT CAST(id AS DOUBLE) AS amount, CAST(id AS INT) AS whole, date_add(DATE'2024-01-01', CAST(id AS INT)) AS day,"
        " id % 2 = 0 AS even FROM range(100) UNION ALL SELECT double('NaN'), NULL, NULL, NULL"
    )
    rows.write.parquet(path)
    table = spark.read.parquet(path)

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    numbers = where_matches(table, "amount", "number-range", minimum="10,5", maximum="20")
    assert "GreaterThanOrEqual(amount,10.5)" in plan(numbers) and "LessThanOrEqual(amount,20.0)" in plan(numbers)
    assert sorted(r.amount for r in numbers.collect()) == [float(i) for i in range(11, 21)]
    days = where_matches(table, "day", "date-range", start="03/01/2024", end="2024-01-05")
    assert "GreaterThanOrEqual(day,2024-01-03)" in plan(days) and "LessThanOrEqual(day,2024-01-05)" in plan(days)
    assert days.count() == 3
    assert where_matches(table, "amount", "number-range", minimum="abc").count() == 100
    assert where_matches(table, "amount", "number-range").count() == 101
    assert where_matches(table, "whole", "number-range", maximum="9").count() == 10
    assert where_matches(table, "even", "boolean-select", boolean="true").count() == 50
    assert where_matches(table, "even", "boolean-select").count() == 101


def test_pages_behind_a_row(spark):
    rows = [(f"{i:05d}", f"n{i // 3}" if i % 7 else None, "commune", 2018, float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "geography_code string, geography_name string, geography_level string, year long, median_income double")
    gold = conform(df.withColumns({"indicator_source": F.lit(cat.OFFICIAL), "is_official": F.lit(True)}), INCOME_GOLD)
    for by, down in (("geography_name", False), ("geography_name", True), ("geography_code", True)):
        request = explorer.PageRequest(2018, "median_income", limit=7, sort_by=by, descending=down)
        everything = [r["geography_code"] for r in explorer.page(gold, replace(request, limit=200)).collect()]
        seen, page = [], explorer.page(gold, request).collect()
        while page:
            seen += [r["geography_code"] for r in page]
            page = explorer.page_after(gold, request, page[-1][by], page[-1]["geography_code"]).collect()
        assert seen == everything


def test_typed_sort(cells):
    def order(*key):
        return [r["name"] for r in cells.orderBy(explorer.typed_order(*key)).collect()]

    assert order("amount", "number") == ["élan", "Alpha", "Beta", "Gamma"]
    assert order("amount", "number", True)[0] == "Gamma"
    assert order("name", "text") == ["Alpha", "Beta", "élan", "Gamma"]
    assert order("created", "date")[:2] == ["élan", "Alpha"]


def test_display(spark):
    df = spark.createDataFrame([(1234567.891, "2024-02-10", "10/02/2024", "soon")], "n double, iso string, fr string, other string")
    row = df.select(display_number(F.col("n")).alias("n"), *[display_date(F.col(c)).alias(c) for c in ("iso", "fr", "other")]).first()
    assert tuple(row) == ("1 234 567,89", "10-02-2024", "10-02-2024", "soon")


def test_numbers(spark):
    texts = ["12 345,60", "1 000", "s", "S", "", "1d", "NaN", "-3.5", "1,2,3", "1e3", None, ".5", "Infinity"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(french_number("t")).collect()]
    assert got == [12345.6, 1000.0, None, None, None, None, None, -3.5, None, 1000.0, None, 0.5, None]


def test_text_repair(spark):
    df = spark.createDataFrame([("Ã©tÃ© â€™ Ã ", "Terrains a batir, DEPARTEMENT et departements", "annee_x")], "a string, b string, c string")
    row = df.select(repair_text("a"), preview_value("b"), preview_value("c"), preview_label(F.lit("code_departement"), F.lit(" "))).first()
    assert tuple(row) == ("été ’ à", "terrains à bâtir, département et départements", "annee_x", "code département")


def test_promote_header_names(spark):
    grid = spark.createDataFrame(
        [("t", 0, ["Titre"]), ("t", 1, ["", "Nom", "Nom"]), ("t", 2, ["CODGEO ", "", ""]), ("t", 3, ["01", "a"]), ("t", 4, [" ", "b"]), ("t", 5, ["codgeo", "c", "d", "e"])],
        "table_id string, row_idx long, cells array<string>",
    )
    got = [r["record"] for r in promote_header(grid).orderBy("row_idx").collect()]
    assert got == [{"codgeo": "01", "nom": "a", "nom_2": ""}, {"codgeo": "codgeo", "nom": "c", "nom_2": "d"}]


def test_small_shapes(spark):
    years = spark.createDataFrame([(2018,), (2021,)], "year long")
    assert [tuple(r) for r in dense_years(years).orderBy("year").collect()] == [(2018, False), (2019, True), (2020, True), (2021, False)]
    maps = spark.sql("SELECT map('b', 2L) c, map('a', 1.5D, 'b', CAST(NULL AS DOUBLE)) m")
    rows = maps.select(F.inline(two_maps_to_rows(F.col("c"), F.col("m")))).collect()
    assert [tuple(r) for r in rows] == [("a", 0, 1.5), ("b", 2, None)]
    constant = publish.minmax_scale(spark.createDataFrame([(1.0,), (1.0,), (None,)], "v double"), "v")
    assert sorted(r["segment"] for r in constant.collect()) == ["constant", "constant", "missing"]


def test_preview_document(spark):
    import json

    df = spark.createDataFrame([(2, 2023, "b", float("nan")), (1, 2021, "a", 1.0)], "id long, year long, nom string, v double")
    document = json.loads(publish.preview_document(df, "income", "data/", ["id"], [2021, 2023]).first()["document"])
    assert document["rows"] == 2 and document["columns_count"] == 4 and document["last_update"] is None
    assert document["columns"][2] == {"key": "nom", "label": "nom", "type": "text"}
    assert [r["v"] for r in document["records"]] == [1.0, None]
    assert [r["year"] for r in publish.available_years(df).collect()] == [2021, 2023]
