"""Property sales: raw text -> canonical rows -> priced sales -> indicators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastrum.catalogue import SALES_YEARS
from cadastrum.functions import fold_header, french_number, full_commune_code, ratio
from cadastrum.operators.quantiles import quantile_table
from cadastrum.operators.shape import map_by_key
from cadastrum.schemas import SALES_COLUMNS, SALES_NUMBERS, SALES_TEXT
from cadastrum.sources.readers import read_either_case
from cadastrum.sources.sinks import as_document

# Fixed values of the sales rules.
SALE = "Vente"
PROPERTY_TYPES = ("Appartement", "Maison")
PRICE_M2_RANGE = (300, 50_000)
SURFACE_RANGE = (9, 1_000)

# Folded source headers that stand for a canonical column; the first found wins.
HEADER_ALIASES = {
    "code_departement": ("code_departement", "departement", "code_dep"),
    "nom_commune": ("nom_commune", "commune"),
}

FUNNEL_STAGES = ("filtered_non_sales", "filtered_non_residential", "filtered_invalid_values", "filtered_outliers")


def canonical_columns(raw: DataFrame) -> DataFrame:
    """The eleven canonical text columns, whatever header family the file uses."""
    by_folded = {fold_header(name): name for name in raw.columns}
    picked = []
    for canonical in SALES_COLUMNS:
        hits = [by_folded[alias] for alias in HEADER_ALIASES.get(canonical, (canonical,)) if alias in by_folded]
        source = F.coalesce(F.col(f"`{hits[0]}`").cast("string"), F.lit("")) if hits else F.lit("")
        picked.append(source.alias(canonical))
    return raw.select(*picked, *[name for name in ("year",) if name in raw.columns])


def to_bronze(raw: DataFrame, year: Column | int | None = None) -> DataFrame:
    bronze = canonical_columns(raw)
    bronze = bronze.withColumns(
        {
            "code_departement": F.trim("code_departement"),
            "code_commune": full_commune_code("code_commune", "code_departement"),
            "nom_commune": F.trim("nom_commune"),
        }
    )
    if year is not None:
        bronze = bronze.withColumn("year", F.lit(year).cast("long") if isinstance(year, int) else year.cast("long"))
    return bronze


def _typed(bronze: DataFrame) -> DataFrame:
    """Numbers parsed, absent columns added, price per square metre computed."""
    absent = {name: F.lit("") for name in SALES_TEXT if name not in bronze.columns}
    absent |= {name: F.lit(None).cast("double") for name in SALES_NUMBERS if name not in bronze.columns}
    kinds = dict(bronze.dtypes)
    parsed = {
        name: french_number(name) if kinds[name] == "string" else F.col(name).cast("double")
        for name in SALES_NUMBERS
        if name in kinds
    }
    typed = bronze.withColumns({**absent, **parsed})
    return typed.withColumn("price_m2", ratio("valeur_fonciere", "surface_reelle_bati"))


def _rules() -> list[Column]:
    """The four keeping rules in order. Plain conjuncts, so Catalyst can push each down."""

    def text(name: str) -> Column:
        return F.trim(F.coalesce(F.col(name), F.lit("")))

    return [
        text("nature_mutation") == SALE,
        text("type_local").isin(*PROPERTY_TYPES),
        (F.col("valeur_fonciere") > 0) & (F.col("surface_reelle_bati") > 0) & (text("code_departement") != ""),
        F.col("surface_reelle_bati").between(*SURFACE_RANGE) & F.col("price_m2").between(*PRICE_M2_RANGE),
    ]


def _stage() -> Column:
    """Name of the first rule a row fails, else null."""
    first, *later = zip(FUNNEL_STAGES, _rules(), strict=True)

    def failed(rule: Column) -> Column:
        return ~F.coalesce(rule, F.lit(False))

    stage = F.when(failed(first[1]), first[0])
    for name, rule in later:
        stage = stage.when(failed(rule), name)
    return stage


def to_silver(bronze: DataFrame) -> DataFrame:
    """Residential sales with a plausible price. One narrow pass; also runs on a stream."""
    kept = _typed(bronze).where(reduce(Column.__and__, _rules()))
    return kept.select(*SALES_COLUMNS, F.col("year").cast("long").alias("year"), "price_m2")


def quality_funnel(bronze: DataFrame, by: list[str]) -> DataFrame:
    """Rows read, rows lost at each first failing rule, rows kept; one pass."""
    staged = _typed(bronze).select(*by, _stage().alias("stage"))
    return staged.groupBy(*by).agg(
        F.count("*").alias("rows_read"),
        *[F.count_if(F.col("stage") == name).alias(name) for name in FUNNEL_STAGES],
        F.count_if(F.col("stage").isNull()).alias("rows_kept"),
    )


def national(silver: DataFrame) -> DataFrame:
    return quantile_table(
        silver,
        ["year"],
        {
            "price_m2": {"median_price_m2": 0.5, "d1_price_m2": 0.1, "d9_price_m2": 0.9},
            "surface_reelle_bati": {"median_surface": 0.5},
        },
        {"total_sales_count": F.count("*")},
    )


def by_department(silver: DataFrame) -> DataFrame:
    table = quantile_table(
        silver,
        ["code_departement", "year"],
        {"price_m2": {"median_price_m2": 0.5}},
        {"sales_count": F.count("*")},
    )
    return table.withColumnRenamed("code_departement", "department_code")


def by_property_type(silver: DataFrame) -> DataFrame:
    table = quantile_table(
        silver,
        ["type_local", "year"],
        {"price_m2": {"median_price_m2": 0.5}},
    )
    return table.withColumnRenamed("type_local", "property_type")


def by_commune(silver: DataFrame) -> DataFrame:
    """Per commune code, name and department, so name variants stay apart."""
    table = quantile_table(
        silver,
        ["code_commune", "nom_commune", "code_departement", "year"],
        {"price_m2": {"median_price_m2": 0.5}, "surface_reelle_bati": {"median_surface": 0.5}},
        {"sales_count": F.count("*")},
    )
    return table.withColumnsRenamed(
        {"code_commune": "commune_code", "nom_commune": "commune_name", "code_departement": "department_code"}
    )


def published_trend(national_rows: DataFrame) -> DataFrame:
    """Yearly price points; years without a positive median are left out."""
    rows = national_rows.where(F.col("median_price_m2") > 0)
    for name in ("d1_price_m2", "d9_price_m2"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("double"))
    return rows.select("year", "median_price_m2", "d1_price_m2", "d9_price_m2").orderBy("year")


def headline_metrics(national_rows: DataFrame, departments: DataFrame) -> DataFrame:
    """Four headline figures per year in long form."""
    covered = departments.groupBy("year").agg(F.countDistinct("department_code").alias("departments_covered"))
    wide = national_rows.join(covered, "year").select(
        "year",
        F.col("median_price_m2").alias("median-price"),
        F.col("total_sales_count").cast("double").alias("transactions"),
        F.col("median_surface").alias("median-surface"),
        F.col("departments_covered").cast("double").alias("departments-covered"),
    )
    return wide.unpivot(["year"], [c for c in wide.columns if c != "year"], "metric", "value")


def by_levels(silver: DataFrame) -> DataFrame:
    """The statistics of the nation, the departments and the property types in one pass: (year, level, code, ...)."""
    levels = F.array(*[
        F.struct(F.lit(level).alias("level"), code.cast("string").alias("code"))
        for level, code in (("nation", F.lit(None)), ("department", F.col("code_departement")), ("type", F.col("type_local")))
    ])
    rows = silver.select("year", "price_m2", "surface_reelle_bati", F.inline(levels))
    return quantile_table(
        rows,
        ["year", "level", "code"],
        {
            "price_m2": {"median_price_m2": 0.5, "d1_price_m2": 0.1, "d9_price_m2": 0.9},
            "surface_reelle_bati": {"median_surface": 0.5},
        },
        {"sales_count": F.count("*")},
    )


def summary_table(silver: DataFrame, source_file: str, generated_at: str) -> DataFrame:
    """One nested summary row per year: filters, totals, maps, department list."""

    def national(name: str) -> Column:
        return F.max(F.when(F.col("level") == "nation", F.col(name)))

    def listed(level: str, *fields: Column | str) -> Column:
        """The rows of a level sorted by code; about a hundred at most."""
        return F.array_sort(F.collect_list(F.when(F.col("level") == level, F.struct(*fields))))

    years = by_levels(silver).groupBy("year").agg(
        national("sales_count").alias("total_sales_count"),
        *[national(name).alias(name) for name in ("median_price_m2", "d1_price_m2", "d9_price_m2", "median_surface")],
        listed("department", F.col("code").alias("department_code"), "year", "sales_count", "median_price_m2").alias("departments"),
        listed("type", F.col("code").alias("property_type"), "median_price_m2").alias("types"),
    )
    maps = {
        "sales_count_by_department": map_by_key("departments", "department_code", "sales_count"),
        "median_price_m2_by_department": map_by_key("departments", "department_code", "median_price_m2"),
        "median_price_m2_by_property_type": map_by_key("types", "property_type", "median_price_m2"),
    }
    outliers = F.struct(
        F.lit(PRICE_M2_RANGE[0]).alias("price_m2_min"),
        F.lit(PRICE_M2_RANGE[1]).alias("price_m2_max"),
        F.lit(SURFACE_RANGE[0]).alias("surface_min"),
        F.lit(SURFACE_RANGE[1]).alias("surface_max"),
    )
    filters = F.struct(
        F.lit(SALE).alias("nature_mutation"),
        F.array(*map(F.lit, PROPERTY_TYPES)).alias("property_types"),
        outliers.alias("outliers"),
    )
    return (
        years.withColumns(maps)
        .select(
            "year",
            F.array(*[F.lit(y) for y in SALES_YEARS]).alias("available_years"),
            F.lit(generated_at).alias("generated_at"),
            F.lit(source_file).alias("source_file"),
            filters.alias("filters"),
            "total_sales_count",
            "median_price_m2",
            "d1_price_m2",
            "d9_price_m2",
            "median_surface",
            "sales_count_by_department",
            "median_price_m2_by_department",
            "median_price_m2_by_property_type",
            "departments",
        )
    )


def summary_documents(silver: DataFrame, source_file: str, generated_at: str) -> DataFrame:
    return as_document(summary_table(silver, source_file, generated_at))


_FILTERS = (
    "struct<nature_mutation:string,property_types:array<string>,"
    "outliers:struct<price_m2_min:double,price_m2_max:double,surface_min:double,surface_max:double>>"
)


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Sales summary documents in either key style, indented or not; absent values take their defaults.

    A document that cannot be read is a row with ``readable`` false and nothing else.
    """
    renamed = {
        "median_price_m2": "median_price_per_square_meter",
        "median_price_m2_by_department": "median_price_per_square_meter_by_department",
        "median_price_m2_by_property_type": "median_price_per_square_meter_by_property_type",
    }
    numbers, counts = "map<string,double>", "map<string,bigint>"
    fields = {
        "year": ("long", None),
        "available_years": ("array<long>", None),
        "generated_at": ("string", ""),
        "source_file": ("string", ""),
        "filters": (_FILTERS, None),
        "total_sales_count": ("long", 0),
        "median_surface": ("double", None),
        "sales_count_by_department": (counts, None),
    }
    for snake, long_name in renamed.items():
        kind = numbers if snake.endswith(("department", "type")) else "double"
        fields |= {snake: (kind, None), long_name: (kind, None)}
    read = read_either_case(spark, path, fields)
    for snake, long_name in renamed.items():
        kind = dict(read.dtypes)[snake]
        found = [F.col(long_name), F.col(snake), *([F.when(F.col("readable"), F.create_map().cast(kind))] if kind.startswith("map") else [])]
        read = read.withColumn(snake, F.coalesce(*found)).drop(long_name)
    none = F.when(F.col("readable"), F.create_map().cast(counts))
    return read.withColumn("sales_count_by_department", F.coalesce("sales_count_by_department", none))
