"""Income fixtures: detection, merges, pivots, masking, derivation, summaries."""

import json
from copy import deepcopy

import pytest
from pyspark.sql import functions as F

from cadastrum import catalogue as cat
from cadastrum.plans import income, publish
from cadastrum.plans.checks import catalogue_violations
from cadastrum.schemas import INCOME_GOLD, INCOME_SILVER, INDICATORS, conform
from cadastrum.sources.buckets import read_buckets
from cadastrum.sources.readers import read_harmonised_years

SILVER = "commune_code string, commune_name string, department_code string, geography_level string, year long, " + ", ".join(
    f"{c} double" for c in INDICATORS
)


def silver(spark, *rows):
    names = ["commune_code", "commune_name", "department_code", "geography_level", "year", *INDICATORS]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SILVER)


def commune(code, year, **values):
    return {"commune_code": code, "commune_name": "Nom", "department_code": code[:2], "geography_level": "commune",
            "year": year, **values}


def department(code, year, **values):
    return {"commune_code": "", "commune_name": "", "department_code": code, "geography_level": "department",
            "year": year, **values}


def test_level_inference(spark):
    communes = spark.createDataFrame([("t", "01001", "x")], "t string, codgeo string, libgeo string")
    assert income.infer_level(communes, ["t"], "codgeo", None).first()["geography_level"] == "commune"
    departments = spark.createDataFrame([("t", "01")], "t string, coddep string")
    assert income.infer_level(departments, ["t"], None, "coddep").first()["geography_level"] == "department"
    short = spark.createDataFrame([("t", "01"), ("t", "2A")], "t string, codgeo string")
    assert income.infer_level(short, ["t"], "codgeo", None).first()["geography_level"] == "department"
    assert income.infer_level(communes.withColumn("codgeo", F.lit("")), ["t"], "codgeo", None).first()[1] is None


def test_detection_order():
    found = income.detect_columns(["q218", "med18", "tp6018", "nbmen18", "nbpersmenfisc17", "libgeo", "codgeo"])
    assert found["median_income"] == "med18" and found["poverty_rate"] == "tp6018"
    assert found["tax_households"] == "nbmen18" and found["population"] == "nbpersmenfisc17"
    assert income.pick_column(["taux_pauvrete", "pauvrete"], ("^tp$", "pauvrete")) == "pauvrete"


def test_two_table_history(spark):
    names = ["CODGEO", "LIBGEO", "NBMEN18", "NBPERS18", "Q218", "D118", "D918", "TP6018", "table_id"]
    rows = [
        ("01001", "A", "10", "20", "22000", "11000", "40000", "", "disp_com"),
        ("01002", "B", "s", "30", "24 000", "12000", "41000", "", "disp_com"),
        ("01001", "A", "", "", "", "", "", "14,5", "disp_pauvres_com"),
        ("01002", "B", "", "", "", "", "", "10,2", "disp_pauvres_com"),
        ("01002", "B", "", "", "", "", "", "99,9", "disp_pauvres_com"),
    ]
    bronze = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], ", ".join(f"`{n}` string" for n in names) + ", pos int")
    got = {r["commune_code"]: r for r in income.historical_silver(bronze, 2018, "pos").collect()}
    assert set(got) == {"01001", "01002"}
    assert got["01001"]["department_code"] == "01" and got["01001"]["poverty_rate"] == 14.5
    assert got["01002"]["median_income"] == 24000.0 and got["01002"]["poverty_rate"] == 10.2
    assert got["01002"]["d5_income"] == 24000.0 and got["01002"]["tax_households"] is None
    with pytest.raises(ValueError):
        income.historical_silver(bronze.drop("table_id"), 2018, "pos")


def test_long_observations(spark):
    rows = [("MED_SL", "01001", "COM", "2023", "22000"), ("PR_MD60", "01001", "COM", "2023", "14.2"),
            ("MED_SL", "01", "DEP", "2023", "25000"), ("D1_SL", "01", "DEP", "2023", "14000"),
            ("MED_SL", "01001", "COM", "2023", "1"), ("MED_SL", "9", "REG", "2023", "5")]
    bronze = spark.createDataFrame(
        [(*r, i) for i, r in enumerate(rows)],
        "FILOSOFI_MEASURE string, GEO string, GEO_OBJECT string, TIME_PERIOD string, OBS_VALUE string, pos int",
    )
    got = {r["geography_level"]: r for r in income.long_silver(bronze, 2023, "pos").collect()}
    assert set(got) == {"commune", "department"}
    assert got["commune"]["department_code"] == "01" and got["commune"]["median_income"] == 22000.0
    assert got["commune"]["poverty_rate"] == 14.2 and got["commune"]["d5_income"] == 22000.0
    assert got["department"]["median_income"] == 25000.0 and got["department"]["d1_income"] == 14000.0
    with pytest.raises(ValueError, match="obs_value"):
        income.long_silver(bronze.drop("OBS_VALUE"), 2023, "pos")


def test_legacy_levels(spark):
    bronze = spark.createDataFrame(
        [("01001", "22000", "commune"), ("", "1", "commune"), ("75056", "30000", "unknown")],
        "CODGEO string, MED17 string, geography_level string",
    )
    got = income.legacy_silver(bronze, 2017)
    assert {r["commune_code"] for r in got.collect()} == {"01001", "75056"}
    assert income.legacy_silver(bronze.where("CODGEO = 'none'"), 2017).count() == 0
    with pytest.raises(Exception, match="no commune code"):
        income.legacy_silver(bronze.withColumnRenamed("CODGEO", "other"), 2017)
    with pytest.raises(Exception, match="no commune code"):
        income.legacy_silver(bronze.withColumnRenamed("CODGEO", "CODDEP"), 2017).collect()


def test_each_legacy_part_fills_d5_by_itself(spark):
    bronze = spark.createDataFrame(
        [("01001", "10", "9", "commune"), ("75056", "20", "", "unknown")],
        "CODGEO string, MED17 string, D517 string, geography_level string",
    )
    got = {r["commune_code"]: r["d5_income"] for r in income.legacy_silver(bronze, 2017).collect()}
    assert got == {"01001": 9.0, "75056": 20.0}


def test_unlisted_year_is_an_error(spark):
    with pytest.raises(Exception, match="2016"):
        income.harmonise(silver(spark, commune("01001", 2018), commune("01001", 2016))).collect()


def test_unpublished_columns_are_masked(spark):
    values = {name: 10.0 for name in INDICATORS}
    gold = {r["year"]: r for r in income.harmonise(silver(spark, commune("01001", 2017, **values), commune("01001", 2023, **values))).collect()}
    assert gold[2017]["d2_income"] is None and gold[2017]["d8_income"] is None and gold[2017]["geography_name"] is None
    assert gold[2017]["d1_income"] == 10.0 and gold[2017]["is_official"] is True
    assert gold[2017]["comparable_with_previous_years"] is False
    assert gold[2023]["tax_households"] is None and gold[2023]["d5_income"] is None
    assert gold[2023]["comparable_with_previous_years"] is False and gold[2023]["methodology_version"] == "filosofi_v2"


def test_comparability_by_year(spark):
    rows = [commune("01001", y) for y in (2017, 2018, 2023)] + [department("01", 2018)]
    got = {(r["geography_level"], r["year"]): r["comparable_with_previous_years"] for r in income.harmonise(silver(spark, *rows)).collect()}
    assert got == {("commune", 2017): False, ("commune", 2018): True, ("commune", 2023): False, ("department", 2018): False}


def test_derived_and_official_departments(spark):
    rows = [
        commune("01001", 2018, median_income=22000.0, tax_households=10.0, poverty_rate=10.0, d5_income=1.0),
        commune("01002", 2018, median_income=24000.0, tax_households=20.0, poverty_rate=16.0, d5_income=1.0),
        commune("97105", 2018, median_income=100.0, tax_households=1.0),
        commune("01001", 2023, median_income=5.0), department("01", 2023, median_income=7.0, d5_income=7.0),
    ]
    got = {(r["geography_code"], r["year"]): r for r in income.departments(income.harmonise(silver(spark, *rows))).collect()}
    assert set(got) == {("01", 2018), ("971", 2018), ("01", 2023)}
    derived = got[("01", 2018)]
    assert derived["indicator_source"] == "derived_from_communes" and derived["is_official"] is False
    assert derived["median_income"] == 24000.0 and derived["poverty_rate"] == pytest.approx(14.0)
    assert derived["tax_households"] == 20.0 and derived["d5_income"] is None
    assert got[("971", 2018)]["poverty_rate"] is None
    official = got[("01", 2023)]
    assert official["indicator_source"] == "official_insee" and official["median_income"] == 7.0
    assert official["d5_income"] is None


def gold_rows(spark, *rows):
    return conform(spark.createDataFrame(list(rows), "geography_code string, year long, geography_level string, d1_income double, d9_income double"), INCOME_GOLD)


def test_decile_fallback_to_departments(spark):
    communes = gold_rows(spark, ("01001", 2018, "commune", None, None))
    departments = gold_rows(spark, ("01", 2018, "department", 14000.0, 42000.0), ("02", 2018, "department", 12000.0, 38000.0))
    row = income.decile_summary(communes, departments).first()
    assert (row["d1_income"], row["d5_income"], row["d9_income"]) == (12000.0, None, 38000.0)


def test_availability_and_documents(spark):
    values = {name: 10.0 for name in INDICATORS}
    rows = [commune("01001", 2017, **values), commune("01002", 2017, median_income=1.0), commune("01001", 2023, median_income=5.0),
            commune("01001", 2018, **values), department("01", 2017, **values)]
    gold = income.harmonise(silver(spark, *rows))
    everything = gold.where("geography_level = 'commune'").unionByName(income.departments(gold))
    table = income.availability(everything)
    got = {(r["year"], r["level"], r["indicator"]): r for r in table.collect()}
    assert len(got) == 6 * 3 * 13
    assert got[(2017, "commune", "median_income")]["coverage"] == 1.0
    assert got[(2017, "commune", "d1_income")]["coverage"] == 0.5
    assert not got[(2017, "commune", "d2_income")]["available"]
    assert got[(2023, "commune", "median_income")]["available"] and not got[(2023, "commune", "d1_income")]["available"]
    assert got[(2018, "department_derived", "median_income")]["official"] is False
    assert got[(2018, "commune", "median_income")]["comparable_with_previous_years"]
    assert not got[(2018, "commune", "d2_income")]["comparable_with_previous_years"]
    nested = json.loads(income.availability_document(table).first()["document"])
    assert nested["2017"]["commune"]["d1_income"]["coverage"] == 0.5
    missing = publish.missing_years(spark, gold)
    metadata = json.loads(income.metadata_document(gold, missing, {"commune_all_years": "x"}, "now").first()["document"])
    assert metadata["available_years"] == [2017, 2018, 2023] and 2022 in metadata["missing_years"]
    assert [b["year"] for b in metadata["methodology_breaks"]] == [2023]


def test_summary_collection(spark):
    rows = [commune("01001", 2017, median_income=20000.0, poverty_rate=12.0, tax_households=3.0), commune("01001", 2023, median_income=9.0)]
    gold = income.harmonise(silver(spark, *rows))
    communes = gold.where("geography_level = 'commune'")
    collection = income.summary_collection(income.summary_table(communes, income.departments(gold), "now"), "now").first()
    assert collection["available_years"] == [2017, 2023] and collection["latest_year"] == 2023
    first = collection["summaries_by_year"]["2017"]
    assert first["national_median_income"] == 20000.0 and first["poverty_rate_summary"]["mean"] == 12.0
    assert first["median_income_by_department"] == {"01": 20000.0}
    assert collection["summaries_by_year"]["2023"]["poverty_rate_summary"] is None


def test_gold_types_are_stable_and_keys_unique(spark):
    gold = income.harmonise(silver(spark, commune("01001", 2018), commune("01001", 2023)))
    assert [f.dataType for f in gold.schema] == [f.dataType for f in INCOME_GOLD]
    assert income.key_duplicates(gold, ["geography_code", "year"]).isEmpty()


def test_commune_year_join_keeps_both_sides(spark):
    sales = spark.createDataFrame(
        [("01001", "A", "01", 2018, 3, 2000.0, 50.0), (None, "N", None, 2018, 1, 1.0, 1.0)],
        "commune_code string, commune_name string, department_code string, year long, sales_count long, median_price_m2 double, median_surface double",
    )
    gold = income.harmonise(silver(spark, commune("01001", 2018, median_income=20000.0), commune("97105", 2018, median_income=0.0)))
    got = {r["commune_code"]: r for r in publish.commune_year(sales, gold).collect()}
    assert got["01001"]["price_income_ratio"] == 0.1 and got["01001"]["commune_name"] == "A"
    assert got["97105"]["department_code"] == "971" and got["97105"]["dvf_sales_count"] is None
    assert got[None]["filosofi_median_income"] is None


def test_stored_commune_layers_join_without_a_shuffle(spark, tmp_path):
    """Null codes and years on either side, codes of one side only; a second session would find the files by their path."""
    sales = spark.createDataFrame(
        [(code, "A", "01", year, n, 2000.0 + n, 50.0) for n, (code, year) in enumerate(
            [("01001", 2018), ("01001", 2019), ("02002", 2018), (None, 2018), (None, 2019), ("03003", None), (None, None)])],
        "commune_code string, commune_name string, department_code string, year long, sales_count long, median_price_m2 double, median_surface double",
    )
    gold = income.harmonise(silver(
        spark, commune("01001", 2018, median_income=20000.0), commune("97105", 2018, median_income=0.0), commune("02002", 2019)))
    blank = gold.where("geography_code = '97105'").withColumn("geography_code", F.lit(None).cast("string"))
    gold = gold.unionByName(blank).unionByName(blank.withColumn("year", F.lit(None).cast("long")))
    expected = sorted(map(repr, publish.commune_year(sales, gold).collect()))

    stored = publish.store_commune_layers(sales, gold, str(tmp_path), "layers_test", buckets=4)
    joined = publish.commune_year_of_buckets(*stored)
    assert sorted(map(repr, joined.collect())) == expected
    plan = joined._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("SortMergeJoin") == 2 and plan.count("Bucketed: true") >= 2
    assert plan.count("Exchange hashpartitioning") == 2  # the rows without a whole key
    again = read_buckets(
        spark, "layers_again", f"{tmp_path}/sales", stored[0].schema, ["commune_code", "year"], 4)
    assert sorted(map(repr, publish.commune_year_of_buckets(again, stored[1]).collect())) == expected
    for name in ("layers_test_sales", "layers_test_income", "layers_again"):
        spark.sql(f"DROP TABLE {name}")


def test_partitions_without_canonical_columns_are_skipped(spark, tmp_path):
    gold = income.harmonise(silver(spark, commune("01001", 2018), commune("01001", 2019)))
    gold.where("year = 2018").drop("year").write.parquet(f"{tmp_path}/year=2018")
    gold.where("year = 2019").drop("year", "poverty_rate").write.parquet(f"{tmp_path}/year=2019")
    assert [r["year"] for r in read_harmonised_years(spark, str(tmp_path), INCOME_GOLD).collect()] == [2018]


def broken(spark, **changes):
    document = deepcopy(cat.INCOME_CATALOGUE)
    document.update(changes)
    document = {k: v for k, v in document.items() if v is not ...}
    return {(r["rule"], r["detail"]) for r in catalogue_violations(cat.catalogue_documents(spark, document)).collect()}


def test_catalogue_rules(spark):
    ok = {"enabled": True, "source_type": "x"}
    assert broken(spark) == set()
    assert broken(spark, dataset="other") == {("dataset_name", "other")}
    assert broken(spark, years=[1]) == {("redundant_years", "")}
    assert broken(spark, default_year=...) == {("default_year_missing", "")}
    assert broken(spark, default_year="soon") == {("default_year_not_integer", "")}
    assert broken(spark, default_year=1999) == {("default_year_absent", "1999")}
    assert broken(spark, known_missing_years=2022) == {("missing_years_not_list", "")}
    assert broken(spark, known_missing_years=["x"]) == {("missing_year_not_integer", "")}
    assert broken(spark, known_missing_years=[2022, 2022]) == {("missing_year_duplicate", "")}
    assert broken(spark, known_missing_years=[2018]) == {("missing_year_available", "2018")}
    assert broken(spark, sources={}) == {("sources_empty", ""), ("default_year_absent", "2023")}
    assert broken(spark, sources={"2023": ok, "x": ok}) == {("source_year_not_integer", "x")}
    assert broken(spark, sources={"2023": ok, " 2023": ok}) == {("source_year_duplicate", "2023")}
    assert broken(spark, sources={"2023": ok, "2019": []}) == {("source_not_object", "2019")}
    assert broken(spark, sources={"2023": ok, "2019": {}}) == {("enabled_missing", "2019")}
    assert broken(spark, sources={"2023": ok, "2019": {"enabled": "yes"}}) == {("enabled_not_boolean", "2019")}
    assert broken(spark, sources={"2023": ok, "2019": {"enabled": True}}) == {("source_type_missing", "2019")}
    assert broken(spark, sources={"2023": {"enabled": False}}) == {("default_year_disabled", "2023")}


def test_standard_schema_is_complete(spark):
    rows = income.standard_rows(spark.createDataFrame([("01001",)], "codgeo string"), "commune", 2020)
    assert set(INCOME_SILVER.fieldNames()) <= set(rows.columns)
    with pytest.raises(ValueError):
        income.standard_rows(spark.createDataFrame([("x",)], "other string"), "commune", 2020)


def test_pivot_and_availability_hash_their_rows(spark):
    long = spark.createDataFrame(
        [("MED_SL", "01001", "COM", "2023", "1", 1)],
        "FILOSOFI_MEASURE string, GEO string, GEO_OBJECT string, TIME_PERIOD string, OBS_VALUE string, pos int",
    )
    gold = income.harmonise(silver(spark, commune("01001", 2018)))
    for df in (income.long_silver(long, 2023, "pos"), income.availability(gold)):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in text and "SortAggregate" not in text


def test_income_documents_in_camel_case(spark, tmp_path):
    one = {"communesCovered": 3, "nationalMedianIncome": 9.5, "decileSummary": {"d1Income": 1.0, "d9_income": 2.0}, "notes": ["a"]}
    (tmp_path / "s.json").write_text(json.dumps({"latestYear": 2023, "summariesByYear": {"2023": one, "x": {}, "2021": {}}}))
    got = {r["year"]: r for r in income.read_summaries(spark, str(tmp_path / "s.json")).collect()}
    assert set(got) == {2021, 2023} and got[2023]["communes_covered"] == 3 and got[2023]["collection_latest_year"] == 2023
    assert got[2023]["decile_summary"]["d1_income"] == 1.0 and got[2023]["decile_summary"]["d9_income"] == 2.0
    assert got[2021]["notes"] == [] and got[2021]["source"] == "INSEE FiLoSoFi" and got[2021]["median_income_by_department"] == {}
    entry = {"available": True, "coverage": 0.5, "indicatorSource": "x", "comparableWithPreviousYears": True}
    (tmp_path / "a.json").write_text(json.dumps({"2018": {"commune": {"median_income": entry}}}))
    row = income.read_availability(spark, str(tmp_path / "a.json")).first()
    assert tuple(row) == (2018, "commune", "median_income", True, 0.5, False, "x", True)
    (tmp_path / "m.json").write_text(json.dumps({"availableYears": [2018], "missing_years": [2022], "methodologyBreaks": [
        {"year": 2023, "label": "l", "comparableToPreviousYear": True}]}))
    read = income.read_metadata(spark, str(tmp_path / "m.json")).first()
    assert read["available_years"] == [2018] and read["missing_years"] == [2022]
    assert read["methodology_breaks"][0]["comparable_to_previous_year"] is True
