"""Tables and documents built across both sources for publication."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastrum import catalogue as cat
from cadastrum.column_labels import FILTER_KINDS
from cadastrum.functions import department_of, preview_label, ratio
from cadastrum.schemas import INDICATORS
from cadastrum.session import materialise, small_table
from cadastrum.sources.buckets import write_buckets
from cadastrum.sources.sinks import as_document

PREVIEW_ROWS = 500
DEFAULT_FOCUS = "75"
COMMUNE_BUCKETS = 64
PUBLISHED_INCOME = INDICATORS


def _commune_sides(sales: DataFrame, income: DataFrame) -> tuple[DataFrame, DataFrame]:
    left = sales.select(
        F.col("commune_code").alias("s_code"),
        F.col("year").alias("s_year"),
        F.col("commune_name").alias("s_name"),
        F.col("department_code").alias("s_department"),
        F.col("sales_count").alias("dvf_sales_count"),
        F.col("median_price_m2").alias("dvf_median_price_m2"),
        F.col("median_surface").alias("dvf_median_surface"),
    )
    right = income.select(
        F.col("geography_code").alias("i_code"),
        F.col("year").alias("i_year"),
        F.col("geography_name").alias("i_name"),
        department_of("geography_code").alias("i_department"),
        *[F.col(name).alias(f"filosofi_{name}") for name in PUBLISHED_INCOME],
    )
    return left, right


def _commune_columns(matched: DataFrame) -> DataFrame:
    """Columns of the joined sides; shared ones take the sales value first."""
    return matched.select(
        F.coalesce("s_code", "i_code").alias("commune_code"),
        F.coalesce("s_year", "i_year").alias("year"),
        "dvf_sales_count",
        "dvf_median_price_m2",
        "dvf_median_surface",
        *[f"filosofi_{name}" for name in PUBLISHED_INCOME],
        F.coalesce("s_name", "i_name").alias("commune_name"),
        F.coalesce("s_department", "i_department").alias("department_code"),
        ratio("dvf_median_price_m2", "filosofi_median_income").alias("price_income_ratio"),
    )


def commune_year(sales: DataFrame, income: DataFrame) -> DataFrame:
    """Full outer join of both commune tables on (commune_code, year).

    Null-safe, like the published join. Shared columns take the sales value
    first. Both inputs hold one row per commune and year (name variants aside).
    """
    left, right = _commune_sides(sales, income)
    same = F.col("s_code").eqNullSafe(F.col("i_code")) & F.col("s_year").eqNullSafe(F.col("i_year"))
    return _commune_columns(left.join(right, same, "full_outer"))


def store_commune_layers(
    sales: DataFrame, income: DataFrame, base: str, prefix: str, buckets: int = COMMUNE_BUCKETS
) -> tuple[DataFrame, DataFrame]:
    """Both commune tables, bucketed by code and year under ``base``, as tables named ``prefix`` and their source."""
    return (
        write_buckets(sales, f"{prefix}_sales", f"{base}/sales", ["commune_code", "year"], buckets),
        write_buckets(income, f"{prefix}_income", f"{base}/income", ["geography_code", "year"], buckets),
    )


def commune_year_of_buckets(sales: DataFrame, income: DataFrame) -> DataFrame:
    """``commune_year`` of layers stored by ``store_commune_layers``, which are not shuffled again.

    A null-safe comparison hides the key from the buckets, so rows with whole keys join by plain
    equality; the others, one per year or code, join null-safe by themselves.
    """
    left, right = _commune_sides(sales, income)
    whole_left = F.col("s_code").isNotNull() & F.col("s_year").isNotNull()
    whole_right = F.col("i_code").isNotNull() & F.col("i_year").isNotNull()
    whole = left.where(whole_left).join(
        right.where(whole_right), (F.col("s_code") == F.col("i_code")) & (F.col("s_year") == F.col("i_year")), "full_outer"
    )
    same = F.col("s_code").eqNullSafe(F.col("i_code")) & F.col("s_year").eqNullSafe(F.col("i_year"))
    others = left.where(~whole_left).join(right.where(~whole_right), same, "full_outer")
    return _commune_columns(whole.unionByName(others))


def focus_department(departments: DataFrame, by: list[str], default: str | None = DEFAULT_FOCUS) -> DataFrame:
    """The preferred department if present, else the one with most sales (lowest code on ties)."""
    preferred = F.col("department_code") == default if default else F.lit(False)
    # Among equal counts the code that sorts first wins.
    best = departments.groupBy(*by, preferred.alias("preferred"), "sales_count").agg(
        F.min("department_code").alias("department_code")
    )
    return best.groupBy(*by).agg(
        F.max_by("department_code", F.struct("preferred", "sales_count")).alias("department_code")
    )


def minmax_scale(df: DataFrame, value: str) -> DataFrame:
    """Value on a 0-1 scale over the table, and its colour segment.

    The two bounds are a scalar subquery, so rows are not moved.
    """
    low = df.agg(F.min(value)).scalar()
    span = df.agg(F.max(value) - F.min(value)).scalar()
    scaled = df.withColumn("__span", span).withColumn("scaled", F.try_divide(F.col(value) - low, F.col("__span")))
    segment = (
        F.when(F.col(value).isNull(), "missing")
        .when(F.col("__span") == 0, "constant")
        .when(F.col("scaled") < 0.5, "lower")
        .otherwise("upper")
    )
    return scaled.withColumn("segment", segment).drop("__span")


def values_on_geographies(areas: DataFrame, departments: DataFrame) -> DataFrame:
    """Every map area per year with its median and count; unmatched areas stay."""
    years = departments.select("year").distinct().agg(F.array_sort(F.collect_set("year"))).scalar()
    spine = areas.withColumn("year", F.explode(years))
    values = departments.select(
        F.col("department_code").alias("code"), "year", F.col("median_price_m2").alias("value"), "sales_count"
    )
    return spine.join(values, ["code", "year"], "left").select(
        "code", "name", "year", "value", F.coalesce("sales_count", F.lit(0)).cast("long").alias("sales_count")
    )


def polygon_bounds(features: DataFrame, coordinates: str = "coordinates") -> DataFrame:
    """Bounding box and its centre per feature.

    ``coordinates`` holds polygons of rings of (longitude, latitude) points; a
    plain polygon is a list of one. All of a feature is in its row: no shuffle.
    """
    points = F.flatten(F.flatten(F.col(coordinates)))
    west = F.array_min(F.transform(points, lambda p: p[0]))
    east = F.array_max(F.transform(points, lambda p: p[0]))
    south = F.array_min(F.transform(points, lambda p: p[1]))
    north = F.array_max(F.transform(points, lambda p: p[1]))
    rest = [name for name in features.columns if name != coordinates]
    return features.select(
        *rest,
        west.alias("min_longitude"), east.alias("max_longitude"),
        south.alias("min_latitude"), north.alias("max_latitude"),
        ((west + east) / 2).alias("centre_longitude"), ((south + north) / 2).alias("centre_latitude"),
    )


def align_series(income: DataFrame, prices: DataFrame) -> DataFrame:
    """Two long yearly series sets on the union of their years, whole numbers.

    Inputs have (year, series, value). Price series without any value are
    dropped; income series stay. Inputs hold a few rows per year.
    """
    years = income.select("year").union(prices.select("year")).distinct()
    listed = years.agg(F.array_sort(F.collect_set("year"))).scalar()
    kept = prices.groupBy("series").agg(F.count("value").alias("n")).where("n > 0").select("series")
    names = income.select("series").distinct().union(kept)
    spine = names.withColumn("year", F.explode(listed))
    points = income.select("series", "year", "value").union(prices.select("series", "year", "value"))
    return spine.join(points, ["series", "year"], "left").select("series", "year", F.round("value", 0).alias("value"))


def available_years(df: DataFrame) -> DataFrame:
    """Distinct integer years, sorted."""
    return df.select(F.col("year").try_cast("long").alias("year")).where("year is not null").distinct().orderBy("year")


def missing_years(spark: SparkSession, present: DataFrame, catalogue: dict | None = None) -> DataFrame:
    """Known missing years and configured years without data."""
    catalogue = catalogue or cat.INCOME_CATALOGUE
    known = small_table(spark, [(int(y),) for y in catalogue["known_missing_years"]], "year long")
    configured = small_table(spark, [(y,) for y in cat.configured_years(catalogue)], "year long")
    absent = configured.join(present.select("year").distinct(), "year", "left_anti")
    return known.union(absent).distinct().orderBy("year")


def latest_year(df: DataFrame, by: list[str], flag: str) -> DataFrame:
    """Latest year flagged available, else the latest listed year."""
    return df.groupBy(*by).agg(
        F.coalesce(F.max(F.when(F.col(flag), F.col("year"))), F.max("year")).alias("latest_year")
    )


def column_kinds(df: DataFrame) -> list[tuple[str, str, str]]:
    """(key, label, number/text) per column of a preview."""
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")
    return [
        (name, name.replace("_", " "), "number" if kind in numeric or kind.startswith("decimal") else "text")
        for name, kind in df.dtypes
    ]


def preview(df: DataFrame, order: list[str], columns: list[str] | None = None, rows: int = PREVIEW_ROWS) -> DataFrame:
    """First rows in a stable order; of the asked columns only those present."""
    shown = [c for c in (columns or df.columns) if c in df.columns]
    return df.orderBy(*order).limit(rows).select(*shown)


def preview_document(df: DataFrame, dataset_id: str, location: str, order: list[str], years: list[int] | None) -> DataFrame:
    """One JSON document: counts of the whole table and its first rows.

    ``years`` are the configured years; without them the table's own years are listed.
    """
    from cadastrum.sources.sinks import json_safe

    first = json_safe(preview(df, order)).agg(
        F.collect_list(F.struct(*df.columns)).alias("records")  # at most PREVIEW_ROWS
    )
    columns = F.array(
        *[
            F.struct(F.lit(key).alias("key"), F.lit(label).alias("label"), F.lit(kind).alias("type"))
            for key, label, kind in column_kinds(df)
        ]
    )
    if years is None:
        listed = df.agg(F.array_sort(F.collect_set(F.col("year").cast("long")))).scalar()  # one entry per year
    else:
        listed = F.array(*[F.lit(int(y)).cast("long") for y in years])
    row = first.select(
        F.lit(dataset_id).alias("dataset_id"),
        F.lit(location).alias("source_file_location"),
        df.agg(F.count("*")).scalar().alias("rows"),
        F.lit(len(df.columns)).alias("columns_count"),
        listed.alias("available_years"),
        F.lit(None).cast("string").alias("last_update"),
        columns.alias("columns"),
        "records",
    )
    return as_document(row)


def _rows_by_footer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for content in batch.column("content"):
            try:
                found.append(pq.read_metadata(pa.BufferReader(content.as_buffer())).num_rows)
            except (pa.ArrowException, OSError):
                found.append(None)
        yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(found, type=pa.int64())], names=["file", "own"])


def file_facts(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, rows) of every file of a Parquet folder; ``rows`` is null for a file that cannot be read.

    Files are listed without being opened and counted by their footers; no column is read. Only
    files that gave no count, empty or broken ones, are opened whole to tell which.
    """

    def named(column: str) -> Column:
        return F.regexp_replace(column, "^file:/+", "file:///")

    files = spark.read.format("binaryFile").load(path)
    listed = files.select(named("path").alias("file"), F.col("length").alias("bytes"))
    try:
        table = spark.read.option("ignoreCorruptFiles", True).parquet(path)
        counted = table.groupBy(named("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"))
    except AnalysisException as error:
        if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":  # not one footer could be read
            raise
        return listed.withColumn("rows", F.lit(None).cast("long"))
    facts = materialise(listed.join(counted, "file", "left"), "file-facts")
    doubtful = files.select(named("path").alias("file"), "content").join(facts.where("rows IS NULL").select("file"), "file", "left_semi")
    opened = doubtful.mapInArrow(_rows_by_footer, "file string, own long")
    return facts.join(opened, "file", "left").select("file", "bytes", F.coalesce("rows", "own").alias("rows"))


def dataset_catalogue(spark: SparkSession, datasets: dict[str, tuple[str, str]]) -> DataFrame:
    """One row per dataset (label and Parquet folder): rows, columns, years, files that cannot be read.

    A dataset stays in the catalogue whatever happened to its files: without a folder or a readable file its facts are
    null. Rows come from footers, years from folder names where the year is a folder.
    """
    rows = []
    for name, (label, path) in datasets.items():
        facts: tuple = (None, None, None, None)
        broken = None
        try:
            files = file_facts(spark, path)
            total, broken = files.agg(F.sum("rows"), F.count_if(F.col("rows").isNull())).first()
            if total is not None:
                table = spark.read.option("ignoreCorruptFiles", True).parquet(path)
                low, high = table.agg(F.min("year"), F.max("year")).first() if "year" in table.columns else (None, None)
                facts = (total, len(table.columns), low, high)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
        rows.append((name, label, *facts, broken))
    return small_table(
        spark, rows, "id string, label string, rows bigint, columns int, first_year bigint, last_year bigint, unreadable_files bigint"
    )


# Fixed texts of the schema report.
_MIXED = "2017 and 2023 are official department series; 2018-2021 are derived from commune rows."
_SECONDARY = "These indicators are absent in 2017 and structurally unpublished for commune rows in 2023."
REPORT_STATUS = {
    "no_label": ("missing_in_source", "Department labels are not kept in the current harmonized pipeline."),
    "mixed": ("mixed_official_and_derived", _MIXED),
    "unpublished": (
        "not_published",
        "No explicit D5 column is published in the configured FiLoSoFi sources; the harmonized layer keeps it null.",
    ),
    "secondary": ("partially_available", _SECONDARY),
    "labels": ("partial_labels", "Commune labels are available in 2018-2021 only in the current source set."),
    "break": ("methodological_break_2023", "Indicator exists across vintages but 2023 belongs to FiLoSoFi 2."),
    "stable": ("stable", "Indicator is present in the configured historical vintages when published."),
}


def _report_case(part: int) -> Column:
    column, level = F.col("canonical_column"), F.col("geography_level")
    d5 = column == "d5_income"
    at_department = level == "department"

    def text(kind: str) -> Column:
        return F.lit(REPORT_STATUS[kind][part])

    return (
        F.when(at_department & (column == "geography_name"), text("no_label"))
        .when(at_department & column.isin(*INDICATORS) & ~d5, text("mixed"))
        .when(d5, text("unpublished"))
        .when(column.isin(*cat.SECONDARY_DECILES), text("secondary"))
        .when(column == "geography_name", text("labels"))
        .when(column.isin("median_income", "d1_income", "d9_income", "poverty_rate"), text("break"))
        .otherwise(text("stable"))
    )


def schema_report(income: DataFrame, years: list[int], mapping: dict | None = None) -> DataFrame:
    """Level x canonical column, with the source column of each year the table holds.

    ``years`` fixes the output columns (one per catalogue year).
    """
    spark = SparkSession.active()
    present = income.select("year").distinct()
    columns = ["geography_code", "geography_name", *INDICATORS]
    frame = present.withColumn("geography_level", F.explode(F.array(F.lit("commune"), F.lit("department"))))
    frame = frame.withColumn("canonical_column", F.explode(F.array(*map(F.lit, columns))))
    sources = F.broadcast(cat.source_column_names(spark, mapping))
    wide = (
        frame.join(sources, ["canonical_column", "year"], "left")
        .groupBy("canonical_column", "geography_level")
        .pivot("year", years)
        .agg(F.first("source_column"))
    )
    return wide.select(
        "canonical_column",
        "geography_level",
        _report_case(0).alias("status"),
        _report_case(1).alias("notes"),
        *[F.coalesce(F.col(f"`{y}`"), F.lit("")).alias(f"{y}_column") for y in years],
    )


def column_catalogue(df: DataFrame, known: dict[str, tuple[str, str]]) -> DataFrame:
    """Label, type and filter kind of every column, and how many cells are filled.

    Known columns take their fixed label and type; others are inferred.
    """
    rows = []
    for position, (key, label, kind) in enumerate(column_kinds(df), start=1):
        label, kind = known.get(key, (label, kind))
        rows.append((position, key, label, kind, FILTER_KINDS[kind]))
    described = small_table(
        df.sparkSession, rows, "position int, key string, label string, type string, filter_kind string"
    ).withColumn("label", preview_label(F.col("key"), F.col("label")))
    filled = df.agg(*[F.count(name).alias(name) for name in df.columns]).unpivot([], df.columns, "key", "filled")
    return filled.join(F.broadcast(described), "key").select(
        "position", "key", "label", "type", "filter_kind", "filled"
    )
