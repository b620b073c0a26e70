"""Local income: source tables -> standard rows -> harmonised gold -> summaries."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastrum import catalogue as cat
from cadastrum.functions import blank_to_null, department_of, fold_header, french_number, round_even
from cadastrum.operators.quantiles import weighted_mean_of, weighted_medians, with_table_weight
from cadastrum.operators.shape import first_per_key, map_by_key, measure_pivot
from cadastrum.schemas import INCOME_GOLD, INDICATORS, conform, require_columns
from cadastrum.sources.readers import BROKEN, camel, either_case_columns, either_case_schema, read_either_case
from cadastrum.sources.records import json_documents
from cadastrum.sources.sinks import as_document


# --- source rows ------------------------------------------------------------


# Marks of a level in a file name, first hit wins.
LEVEL_MARKS = (
    ("commune", ("_com", "commune")),
    ("department", ("_dep", "departement")),
    ("region", ("_reg", "region")),
)


def level_of_file(name: Column) -> Column:
    lowered = F.lower(name)
    level = F.lit("unknown")
    for found, marks in reversed(LEVEL_MARKS):
        hit = reduce(Column.__or__, [F.contains(lowered, F.lit(mark)) for mark in marks])
        level = F.when(hit, found).otherwise(level)
    return level


def add_file_lineage(rows: DataFrame, source_file: Column, year: int, source_type: str, table_id: str) -> DataFrame:
    """Provenance columns; level and role follow from the name of each row's own file."""
    base_name = F.lower(F.element_at(F.split(source_file, "/"), -1))
    return rows.withColumns(
        {
            "source_file": source_file,
            "extracted_file": source_file,
            "year": F.lit(year).cast("long"),
            "source_type": F.lit(source_type),
            "table_id": F.lit(table_id),
            "geography_level": level_of_file(source_file),
            "file_role": F.when(F.startswith(base_name, F.lit("meta_")), "metadata").otherwise("data"),
        }
    )


def add_lineage(rows: DataFrame, source_file: str, year: int, source_type: str, table_id: str) -> DataFrame:
    """``add_file_lineage`` for rows of one named file."""
    return add_file_lineage(rows, F.lit(source_file), year, source_type, table_id)


def fold_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[fold_header(name, keep_unmapped_as="") for name in df.columns])


def pick_column(columns: list[str], patterns: tuple[str, ...]) -> str | None:
    """Column named exactly like a pattern, else the first hit in pattern order."""
    literal = next((c for c in columns if c in patterns), None)
    return literal or next((c for p in patterns for c in columns if re.search(p, c)), None)


def detect_columns(columns: list[str]) -> dict[str, str | None]:
    return {name: pick_column(columns, patterns) for name, patterns in cat.COLUMN_PATTERNS.items()}


def _upper_text(column: str | None) -> Column:
    return F.upper(F.trim(F.coalesce(F.col(column).cast("string"), F.lit("")))) if column else F.lit("")


def standard_rows(source: DataFrame, level: str, year: Column | int) -> DataFrame:
    """One source table in the standard columns, whatever its year's column names.

    ``source`` has folded headers. Rows without a code for the level are dropped.
    """
    found = detect_columns(source.columns)
    if level == "commune" and found["commune_code"] is None:
        raise ValueError(f"no commune code among columns: {', '.join(source.columns)}")
    code = _upper_text(found["commune_code"])
    department = _upper_text(found["department_code"])
    if level == "department":
        department = department if found["department_code"] else code
        code = F.lit("")
    else:
        department = F.when(department == "", department_of(code)).otherwise(department)
    name = F.trim(F.coalesce(F.col(found["commune_name"]).cast("string"), F.lit(""))) if found["commune_name"] else F.lit("")
    numbers = {
        column: french_number(found[column]) if found[column] else F.lit(None).cast("double") for column in INDICATORS
    }
    extra = [
        c for c in ("source_file", "extracted_file", "source_type", "table_id", "file_role", "__part") if c in source.columns
    ]
    rows = source.select(
        code.alias("commune_code"),
        name.alias("commune_name"),
        department.alias("department_code"),
        *[column.alias(key) for key, column in numbers.items()],
        (F.lit(year) if isinstance(year, int) else year).cast("long").alias("year"),
        F.lit(level).alias("geography_level"),
        *extra,
    )
    return fill_all_null_median(rows.where(F.col("commune_code" if level == "commune" else "department_code") != ""))


def fill_all_null_median(rows: DataFrame) -> DataFrame:
    """Where no row of a year's table has d5 but some have a median, d5 is the median.

    A column ``__part`` tells tables of one year apart.
    """
    by = [c for c in ("year", "__part") if c in rows.columns]
    flags = rows.groupBy(*by).agg(((F.count("d5_income") == 0) & (F.count("median_income") > 0)).alias("__fill"))
    filled = F.when(F.col("__fill"), F.col("median_income")).otherwise(F.col("d5_income"))
    columns = rows.columns
    # One flag row per year and part.
    return rows.join(flags, by).withColumn("d5_income", filled).select(*columns)


def infer_level(rows: DataFrame, by: list[str], code: str | None, department: str | None) -> DataFrame:
    """Level per table from its codes: long codes are communes, short ones departments."""
    commune = blank_to_null(F.col(code), upper=True) if code else F.lit(None).cast("string")
    owner = blank_to_null(F.col(department), upper=True) if department else F.lit(None).cast("string")
    facts = rows.groupBy(*by).agg(
        F.bool_or((F.length(commune) >= 5) | commune.rlike("^(97|98)[0-9]{2,}$")).alias("long_code"),
        F.bool_and(F.length(commune) <= 3).alias("short_codes"),
        (F.count(owner) > 0).alias("has_department"),
    )
    level = (
        F.when(F.col("long_code"), "commune")
        .when(F.col("short_codes"), "department")
        .when(F.col("has_department"), "department")
    )
    return facts.select(*by, level.alias("geography_level"))


def legacy_silver(bronze: DataFrame, year: int) -> DataFrame:
    """Rows labelled by level; tables of unknown level are placed by their codes.

    The known communes, the known departments and the placed rows are parts of their own:
    each decides for itself whether d5 is filled from the median. Rows that cannot be placed
    are left out. Lazy: the level of the unknown part is a joined row.
    """
    bronze = fold_columns(bronze)
    if "geography_level" not in bronze.columns:
        bronze = bronze.withColumn("geography_level", F.lit("commune"))
    found = detect_columns(bronze.columns)
    if found["commune_code"] is None and found["department_code"] is None:
        raise ValueError(f"no commune code among columns: {', '.join(bronze.columns)}")
    known = F.coalesce(F.col("geography_level").isin("commune", "department"), F.lit(False))
    parted = bronze.withColumn("__part", F.when(known, F.col("geography_level")).otherwise("placed"))
    placed = infer_level(
        parted.where(F.col("__part") == "placed"), ["__part"], found["commune_code"], found["department_code"]
    ).withColumnRenamed("geography_level", "__placed")
    # One row, for the one part without a level.
    labelled = parted.join(F.broadcast(placed), "__part", "left").withColumn(
        "geography_level", F.coalesce("__placed", F.when(known, F.col("geography_level")))
    ).drop("__placed")
    department_rows = F.col("geography_level") == "department"
    if found["commune_code"] is None:
        # Without the column no row is placed as a commune; one that says it is cannot be read.
        refused = F.raise_error(F.lit(f"no commune code among columns: {', '.join(bronze.columns)}")).cast("boolean")
        parts = [labelled.where(F.when(F.col("geography_level") == "commune", refused).otherwise(department_rows))]
        return standard_rows(parts[0].drop("geography_level"), "department", year).drop("__part")
    parts = [
        standard_rows(labelled.where(F.col("geography_level") == level).drop("geography_level"), level, year)
        for level in ("commune", "department")
    ]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).drop("__part")


def fill_from(
    rows: DataFrame, side: DataFrame, keys: list[str], column: str, side_column: str, order: list[str]
) -> DataFrame:
    """Fill nulls of ``column`` from the first side row per key in source order."""
    first = first_per_key(side.select(*dict.fromkeys([*keys, side_column, *order])), keys, order)
    first = first.select(*keys, F.col(side_column).alias("__side"))
    return rows.join(first, keys, "left").withColumn(column, F.coalesce(column, "__side")).drop("__side")


def historical_silver(bronze: DataFrame, year: int, order: str) -> DataFrame:
    """Main workbook rows; the poverty rate may come from a second workbook.

    ``order`` names the source-order column that decides between duplicates.
    """
    require_columns(bronze, ["table_id"], "historical income table")
    folded = fold_columns(bronze)
    main = folded.where(F.col("table_id") == "disp_com")
    if main.isEmpty():
        raise ValueError("historical income table has no DISP_COM rows")
    rows = standard_rows(main, "commune", year)
    found = detect_columns(folded.columns)
    if found["commune_code"] and found["poverty_rate"]:
        poor = folded.where(F.col("table_id") == "disp_pauvres_com").select(
            _upper_text(found["commune_code"]).alias("commune_code"),
            french_number(found["poverty_rate"]).alias("rate"),
            F.col(order).alias("__order"),
        )
        rows = fill_from(rows, poor.where("commune_code <> ''"), ["commune_code"], "poverty_rate", "rate", ["__order"])
    return rows.withColumns({"source_generation": F.lit("historical"), "dispositif": F.lit("filosofi")})


def long_silver(bronze: DataFrame, year: int, order: str) -> DataFrame:
    """Long observations -> one row per commune or department and period."""
    bronze = fold_columns(bronze)
    require_columns(
        bronze, ["filosofi_measure", "geo", "geo_object", "time_period", "obs_value"], "long income table"
    )
    wanted = bronze.where(F.col("geo_object").isin("COM", "DEP"))
    wide = measure_pivot(
        wanted, ["geo", "geo_object", "time_period"], "filosofi_measure", "obs_value", order, cat.MEASURES
    )
    commune = F.col("geo_object") == "COM"
    numbers = {name: F.col(name) for name in cat.MEASURES.values()}
    return wide.select(
        F.when(commune, F.col("geo")).otherwise("").alias("commune_code"),
        F.lit("").alias("commune_name"),
        F.when(commune, department_of("geo")).otherwise(F.col("geo")).alias("department_code"),
        *[
            numbers.get(name, numbers["median_income"] if name == "d5_income" else F.lit(None).cast("double")).alias(name)
            for name in INDICATORS
        ],
        F.coalesce(F.col("time_period").try_cast("long"), F.lit(year)).cast("long").alias("year"),
        F.when(commune, "commune").otherwise("department").alias("geography_level"),
        F.lit("filosofi2").alias("source_generation"),
        F.lit("filosofi2").alias("dispositif"),
        "geo_object",
    )


def silver_counts(silver: DataFrame, by: list[str]) -> DataFrame:
    return silver.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.countDistinct(blank_to_null("commune_code")).alias("communes"),
        F.countDistinct(blank_to_null("department_code")).alias("departments"),
    )


def source_profile(long: DataFrame) -> DataFrame:
    """Row count and the distinct objects and measures of a long source table, whose columns must be complete."""
    require_columns(long, cat.LONG_SOURCE_COLUMNS, "long income source")
    return long.agg(
        F.count("*").alias("row_count"),
        F.array_sort(F.collect_set(blank_to_null("GEO_OBJECT"))).alias("geo_objects"),
        F.array_sort(F.collect_set(blank_to_null("FILOSOFI_MEASURE"))).alias("measures"),
    )


# --- harmonised gold --------------------------------------------------------


def mask_unpublished(rows: DataFrame, mapping: dict | None = None) -> DataFrame:
    """Null every indicator (and name) whose source column the year does not publish."""
    published = F.broadcast(cat.published_columns(rows.sparkSession, mapping))
    masked = rows.join(published, "year", "left")
    names = [c for c in (*INDICATORS, "geography_name") if c in rows.columns]
    columns = {name: F.when(F.array_contains("published", name), F.col(name)) for name in names}
    return masked.withColumns(columns).select(*rows.columns)


def add_provenance(rows: DataFrame, catalogue: dict | None = None) -> DataFrame:
    """Provenance columns from the catalogue; a row of a year it does not list is an error."""
    years = F.broadcast(cat.source_years(rows.sparkSession, catalogue).withColumn("__listed", F.lit(True)))
    derived = F.col("indicator_source") == cat.DERIVED
    joined = rows.join(years, "year", "left")
    unlisted = F.raise_error(F.format_string("year %s is not in the source catalogue", "year")).cast("long")
    return joined.withColumns(
        {
            "year": F.when(F.col("__listed"), F.col("year")).otherwise(unlisted),
            "source_generation": F.when(derived, "historical").otherwise(F.col("source_generation")),
            "is_official": ~derived,
            "methodology_version": F.when(derived, "derived_from_filosofi_v1")
            .when(F.col("dispositif") == "filosofi2", "filosofi_v2")
            .otherwise("filosofi_v1"),
            "comparable_with_previous_years": ~derived
            & ~F.col("methodological_break")
            & (F.col("dispositif") != "filosofi2")
            & (F.col("geography_level") == "commune")
            & F.col("comparable"),
        }
    ).drop("comparable", "secondary_comparable", "methodological_break", "break_label", "__listed")


def harmonise(silver: DataFrame, catalogue: dict | None = None, mapping: dict | None = None) -> DataFrame:
    """Official gold rows of both levels; rows without a code are dropped."""
    if "geography_level" not in silver.columns:
        raise ValueError("income rows must carry geography_level")
    commune = F.col("geography_level") == "commune"
    coded = silver.where(F.col("geography_level").isin("commune", "department")).select(
        F.when(commune, blank_to_null("commune_code")).otherwise(blank_to_null("department_code")).alias("geography_code"),
        F.when(commune, blank_to_null("commune_name")).alias("geography_name"),
        "geography_level",
        "year",
        F.lit(cat.OFFICIAL).alias("indicator_source"),
        *INDICATORS,
    )
    rows = mask_unpublished(coded.where("geography_code is not null"), mapping)
    return conform(add_provenance(rows, catalogue), INCOME_GOLD)


def derive_departments(communes: DataFrame, catalogue: dict | None = None) -> DataFrame:
    """Department rows from gold communes: weighted medians, poverty as weighted mean.

    All indicators take one pass.
    """
    coded = communes.withColumn("department_code", department_of("geography_code"))
    weighted = with_table_weight(coded, ["year"]).where(F.col("department_code").isNotNull())
    keys = ["department_code", "year"]
    wide = weighted_medians(weighted, keys, {name: name for name in INDICATORS if name != "poverty_rate"}, "weight")
    poverty = weighted.groupBy(*keys).agg(weighted_mean_of(F.col("poverty_rate"), F.col("weight")).alias("poverty_rate"))
    rows = poverty.join(wide, keys, "left").withColumns(
        {
            "geography_code": F.col("department_code"),
            "geography_level": F.lit("department"),
            "indicator_source": F.lit(cat.DERIVED),
        }
    )
    return conform(add_provenance(rows, catalogue), INCOME_GOLD)


def departments(gold: DataFrame, catalogue: dict | None = None) -> DataFrame:
    """Official department rows where a year has any, else rows derived from communes."""
    official = gold.where(F.col("geography_level") == "department")
    years = official.select("year").distinct()
    # At most one row per catalogue year.
    lacking = gold.where(F.col("geography_level") == "commune").join(F.broadcast(years), "year", "left_anti")
    return official.unionByName(derive_departments(lacking, catalogue))


# --- summaries --------------------------------------------------------------


def decile_summary(communes: DataFrame, department_rows: DataFrame) -> DataFrame:
    """National d1, d5, d9 per year; a decile no commune has comes from departments."""
    deciles = ["d1_income", "d5_income", "d9_income"]

    def medians(rows: DataFrame, suffix: str) -> DataFrame:
        weighted = with_table_weight(rows, ["year"])
        present = weighted.groupBy("year").agg(*[(F.count(name) > 0).alias(f"any_{name}_{suffix}") for name in deciles])
        found = weighted_medians(weighted, ["year"], {name: f"{name}_{suffix}" for name in deciles}, "weight")
        return present.join(found, "year", "left")

    both = medians(communes, "commune").join(medians(department_rows, "department"), "year", "left")
    values = [
        F.when(F.col(f"any_{name}_commune"), F.col(f"{name}_commune")).otherwise(F.col(f"{name}_department"))
        for name in deciles
    ]
    return both.select("year", *[round_even(value, 2).alias(name) for name, value in zip(deciles, values, strict=True)])


def year_summary(communes: DataFrame, department_rows: DataFrame) -> DataFrame:
    """Coverage, national weighted median income and poverty per year."""
    weighted = with_table_weight(communes, ["year"])
    counts = weighted.groupBy("year").agg(
        F.countDistinct("geography_code").alias("communes_covered"),
        round_even(weighted_mean_of(F.col("poverty_rate"), F.col("weight")), 2).alias("poverty_mean"),
    )
    covered = department_rows.groupBy("year").agg(
        F.countDistinct("geography_code").alias("departments_covered"),
        F.max("indicator_source").alias("department_indicator_source"),
        F.max("dispositif").alias("dispositif"),
    )
    medians = weighted_medians(weighted, ["year"], {"median_income": "income", "poverty_rate": "poverty"}, "weight")
    return (
        counts.join(covered, "year", "left")
        .join(medians, "year", "left")
        .select(
            "year",
            "communes_covered",
            F.coalesce("departments_covered", F.lit(0)).cast("long").alias("departments_covered"),
            "department_indicator_source",
            "dispositif",
            round_even("income", 2).alias("national_median_income"),
            "poverty_mean",
            round_even("poverty", 2).alias("poverty_median"),
        )
    )


# Fixed notes of the yearly summary document.
SUMMARY_NOTES = (
    "FiLoSoFi is annual data and should be joined to DVF using commune_code and year.",
    "Columns with no published source value remain null in the harmonized gold layer.",
    "Department series are split between official INSEE outputs and derived commune aggregations.",
    "FiLoSoFi 2 starts in 2023 and introduces a methodological break.",
)


def summary_table(communes: DataFrame, department_rows: DataFrame, generated_at: str) -> DataFrame:
    """One nested summary row per year, with department maps sorted by code."""
    deciles = [name for name in INDICATORS if name.startswith("d")]
    entry = F.struct(
        "geography_code",
        round_even("median_income", 2).alias("median_income"),
        F.struct(*[round_even(name, 2).alias(name) for name in deciles]).alias("deciles"),
    )
    # About a hundred departments per year.
    maps = (
        department_rows.where(F.col("geography_code").isNotNull())
        .groupBy("year")
        .agg(F.array_sort(F.collect_list(entry)).alias("rows"))
        .select(
            "year",
            map_by_key("rows", "geography_code", "median_income").alias("median_income_by_department"),
            map_by_key("rows", "geography_code", "deciles").alias("department_deciles_by_department"),
        )
    )
    summary = year_summary(communes, department_rows)
    poverty = F.when(
        F.col("poverty_mean").isNotNull(),
        F.struct(F.col("poverty_mean").alias("mean"), F.col("poverty_median").alias("median")),
    )
    return (
        summary.join(decile_summary(communes, department_rows), "year", "left")
        .join(maps, "year", "left")
        .select(
            "year",
            F.lit("INSEE FiLoSoFi").alias("source"),
            F.lit(generated_at).alias("generated_at"),
            F.array("year").alias("available_years"),
            F.col("year").alias("latest_year"),
            "dispositif",
            "communes_covered",
            "departments_covered",
            "department_indicator_source",
            "national_median_income",
            "median_income_by_department",
            "department_deciles_by_department",
            F.struct("d1_income", "d5_income", "d9_income").alias("decile_summary"),
            poverty.alias("poverty_rate_summary"),
            F.array(*map(F.lit, SUMMARY_NOTES)).alias("notes"),
        )
    )


def summary_collection(summaries: DataFrame, generated_at: str) -> DataFrame:
    """All yearly summaries in one row: years, latest year, map year -> summary."""
    body = F.struct(*[c for c in summaries.columns if c != "year"])
    entries = F.array_sort(
        F.collect_list(F.struct(F.col("year").cast("string").alias("key"), body.alias("value"))),
        lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0),
    )
    return summaries.agg(
        F.array_sort(F.collect_set("year")).alias("available_years"),
        F.max("year").alias("latest_year"),
        F.map_from_entries(entries).alias("summaries_by_year"),
    ).select(
        F.lit("INSEE FiLoSoFi").alias("source"),
        F.lit(generated_at).alias("generated_at"),
        "available_years",
        "latest_year",
        "summaries_by_year",
    )


def methodology_breaks(spark: SparkSession, catalogue: dict | None = None) -> DataFrame:
    years = cat.source_years(spark, catalogue).where("methodological_break")
    return years.select("year", F.col("break_label").alias("label"), F.lit(False).alias("comparable_to_previous_year"))


def metadata_document(gold: DataFrame, missing: DataFrame, paths: dict[str, str], generated_at: str) -> DataFrame:
    """Available and missing years, methodology breaks and data set paths, as JSON."""
    spark = gold.sparkSession
    breaks = methodology_breaks(spark).agg(
        F.array_sort(F.collect_list(F.struct("year", "label", "comparable_to_previous_year")))
    )
    row = gold.agg(F.array_sort(F.collect_set("year")).alias("available_years")).select(
        F.lit("INSEE FiLoSoFi").alias("source"),
        F.lit(generated_at).alias("generated_at"),
        "available_years",
        missing.agg(F.array_sort(F.collect_set("year"))).scalar().alias("missing_years"),
        breaks.scalar().alias("methodology_breaks"),
        F.struct(*[F.lit(path).alias(name) for name, path in paths.items()]).alias("datasets"),
    )
    return as_document(row)


# --- availability -----------------------------------------------------------


def level_key() -> Column:
    return F.when(F.col("geography_level") == "commune", "commune").otherwise(
        F.when(F.col("indicator_source") == cat.DERIVED, "department_derived").otherwise("department_official")
    )


def availability(gold: DataFrame, catalogue: dict | None = None) -> DataFrame:
    """Per configured year, level and indicator: coverage, source, comparability.

    Years and levels without rows are listed as unavailable.
    """
    spark = gold.sparkSession
    coverage = gold.groupBy("year", level_key().alias("level")).agg(
        F.max("is_official").alias("official"),
        F.bool_or(F.col("indicator_source") == cat.OFFICIAL).alias("any_official"),
        F.bool_or(F.col("indicator_source") == cat.DERIVED).alias("any_derived"),
        *[round_even(F.count(name) / F.count("*"), 4).alias(name) for name in INDICATORS],
    )
    # Flags have a fixed width, so the rows are hashed; a text would have them sorted.
    source = F.when(F.col("any_official"), cat.OFFICIAL).when(F.col("any_derived"), cat.DERIVED)
    coverage = coverage.withColumn("indicator_source", source)
    measured = coverage.unpivot(["year", "level", "official", "indicator_source"], list(INDICATORS), "indicator", "share")
    years = cat.source_years(spark, catalogue, enabled_only=True)
    frame = years.withColumn("level", F.explode(F.array(*map(F.lit, cat.LEVELS)))).withColumn(
        "indicator", F.explode(F.array(*map(F.lit, INDICATORS)))
    )
    available = F.coalesce(F.col("share") > 0, F.lit(False))
    kept = F.when(F.col("indicator").isin(*cat.SECONDARY_DECILES), F.col("secondary_comparable")).otherwise(
        F.col("comparable")
    )
    comparable = available & (F.col("level") == "commune") & ~F.col("methodological_break") & kept
    return frame.join(measured, ["year", "level", "indicator"], "left").select(
        "year",
        "level",
        "indicator",
        available.alias("available"),
        F.coalesce("share", F.lit(0.0)).alias("coverage"),
        F.coalesce("official", F.lit(False)).alias("official"),
        F.coalesce("indicator_source", F.lit("")).alias("indicator_source"),
        comparable.alias("comparable_with_previous_years"),
    )


def availability_document(rows: DataFrame) -> DataFrame:
    """Nested JSON: year -> level -> indicator -> entry."""
    entry = F.struct("available", "coverage", "official", "indicator_source", "comparable_with_previous_years")
    by_level = rows.groupBy("year", "level").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("indicator").alias("k"), entry.alias("v"))))).alias(
            "v"
        )
    )
    by_year = by_level.groupBy("year").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("level").alias("k"), "v"))).alias("v")
    )
    return by_year.agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("year").cast("string").alias("k"), "v"))).alias("years")
    ).select(F.to_json("years", {"ignoreNullFields": "false"}).alias("document"))


_SUMMARY_FIELDS = {
    "source": ("string", "INSEE FiLoSoFi"),
    "generated_at": ("string", ""),
    "available_years": ("array<double>", None),
    "latest_year": ("double", None),
}
_DECILES = "struct<d1_income:double,d5_income:double,d9_income:double,d1Income:double,d5Income:double,d9Income:double>"
_ONE_SUMMARY = _SUMMARY_FIELDS | {
    "dispositif": ("string", None),
    "department_indicator_source": ("string", None),
    "communes_covered": ("long", 0),
    "departments_covered": ("long", 0),
    "national_median_income": ("double", None),
    "median_income_by_department": ("map<string,double>", None),
    "decile_summary": (_DECILES, None),
    "poverty_rate_summary": ("struct<mean:double,median:double>", None),
    "notes": ("array<string>", None),
}


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """One row per year of an income summary collection, in either key style.

    Absent values take their defaults; entries whose key is no year are skipped. A document or an entry that
    cannot be read is a row with ``readable`` false.
    """
    collection = read_either_case(spark, path, _SUMMARY_FIELDS | {"summaries_by_year": ("map<string,string>", None)})
    entries = collection.select(
        F.col("latest_year").cast("long").alias("collection_latest_year"), "readable",
        F.explode_outer("summaries_by_year").alias("key", "text"),
    )
    schema = f"{either_case_schema(_ONE_SUMMARY)}, {BROKEN} string"
    parsed = entries.select(
        "collection_latest_year", "readable", F.col("key").try_cast("double").cast("long").alias("year"),
        F.from_json("text", schema, {"columnNameOfCorruptRecord": BROKEN}).alias("one"),
    ).where("year IS NOT NULL OR NOT readable").withColumn("readable", F.col("readable") & F.col(f"one.{BROKEN}").isNull())
    deciles = F.struct(*[
        F.coalesce(F.col(f"decile_summary.{camel(name)}"), F.col(f"decile_summary.{name}")).alias(name)
        for name in ("d1_income", "d5_income", "d9_income")
    ])
    filled = parsed.select("collection_latest_year", "year", "readable", *either_case_columns(_ONE_SUMMARY, "one")).withColumns({
        "latest_year": F.col("latest_year").cast("long"),
        "available_years": F.col("available_years").cast("array<bigint>"),
        "median_income_by_department": F.coalesce("median_income_by_department", F.create_map().cast("map<string,double>")),
        "decile_summary": deciles,
        "notes": F.coalesce("notes", F.array().cast("array<string>")),
    })
    given = ("collection_latest_year", "year", "readable")
    return filled.select(*[F.col(c) if c in given else F.when(F.col("readable"), F.col(c)).alias(c) for c in filled.columns])


def read_availability(spark: SparkSession, path: str) -> DataFrame:
    """Rows of availability documents, entries in either key style."""
    fields = {
        "available": ("boolean", False), "coverage": ("double", 0.0), "official": ("boolean", False),
        "indicator_source": ("string", ""), "comparable_with_previous_years": ("boolean", False),
    }
    kind = f"map<string,map<string,map<string,struct<{either_case_schema(fields, ':')}>>>>"
    years = json_documents(spark, path).select(F.explode(F.from_json("text", kind)).alias("year", "levels"))
    levels = years.select("year", F.explode("levels").alias("level", "indicators"))
    rows = levels.select("year", "level", F.explode("indicators").alias("indicator", "one"))
    return rows.select(F.col("year").cast("long").alias("year"), "level", "indicator", *either_case_columns(fields, "one"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Metadata documents in either key style."""
    broken = "array<struct<year:bigint,label:string,comparable_to_previous_year:boolean,comparableToPreviousYear:boolean>>"
    read = read_either_case(spark, path, {
        "source": ("string", "INSEE FiLoSoFi"), "generated_at": ("string", ""), "available_years": ("array<bigint>", None),
        "missing_years": ("array<bigint>", None), "methodology_breaks": (broken, None), "datasets": ("map<string,string>", None),
    })
    return read.withColumn("methodology_breaks", F.transform("methodology_breaks", lambda b: F.struct(
        b["year"].alias("year"), b["label"].alias("label"),
        F.coalesce(b["comparableToPreviousYear"], b["comparable_to_previous_year"], F.lit(False)).alias("comparable_to_previous_year"),
    )))


def key_duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > 1)
