"""Layer builds: each layer is written once and read by everything after it.

All years go through one job per layer (the year is a grouping column and the
partition folder), instead of one process per year.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastrum import catalogue as cat
from cadastrum.plans import income, sales
from cadastrum.plans import publish as tables
from cadastrum.session import materialise
from cadastrum.sources.sinks import EmptyOutput, as_document, write_csv_report, write_documents, write_years


def income_layers(gold: DataFrame, label: str = "income") -> tuple[DataFrame, DataFrame]:
    """Gold communes and departments (official, else derived), both materialised."""
    gold = materialise(gold, f"{label}-gold")
    departments = materialise(income.departments(gold), f"{label}-departments")
    return gold.where(F.col("geography_level") == "commune"), departments


def publishable_year(years: DataFrame, pipeline_modes: dict[int, str] | None = None) -> int | None:
    """Latest processed year that is built in full (not only to bronze)."""
    partial = [year for year, mode in (pipeline_modes or {}).items() if mode != "full_pipeline"]
    return years.where(~F.col("year").isin(partial)).agg(F.max("year")).first()[0]


def publish(
    spark: SparkSession, paths: dict[str, str], base: str, generated_at: str, pipeline_modes: dict[int, str] | None = None
) -> dict[str, str]:
    """Summary documents, availability, metadata, schema report and previews of built tables.

    Sales documents show the latest processed year; income documents all years. Nothing
    publishable is an error.
    """
    target = {
        name: f"{base}/{name}"
        for name in ("sales_summary", "income_summaries", "income_availability", "income_metadata", "schema_report",
                     "sales_preview", "income_preview")
    }

    def table(name: str) -> DataFrame:
        return spark.read.parquet(paths[name]).withColumn("year", F.col("year").cast("long"))

    sold, gold, departments = table("sales_silver"), table("income_gold"), table("income_departments")
    year = publishable_year(sold, pipeline_modes)
    if year is None:
        raise EmptyOutput("no processed year to publish")
    latest = sold.where(F.col("year") == year)
    communes = gold.where(F.col("geography_level") == "commune")
    everything = communes.unionByName(departments)

    summaries = income.summary_table(communes, departments, generated_at)
    missing = tables.missing_years(spark, gold)
    locations = {name: paths[name] for name in ("income_gold", "income_departments")}
    years = sorted(cat.configured_years())
    documents = {
        "sales_summary": sales.summary_documents(latest, paths["sales_silver"], generated_at),
        "income_summaries": as_document(income.summary_collection(summaries, generated_at)),
        "income_availability": income.availability_document(income.availability(everything)),
        "income_metadata": income.metadata_document(gold, missing, locations, generated_at),
        "sales_preview": tables.preview_document(
            latest, "dvf", paths["sales_silver"], ["code_commune", "valeur_fonciere", "price_m2"], list(cat.SALES_YEARS)
        ),
        "income_preview": tables.preview_document(
            gold, "filosofi", paths["income_gold"], ["year", "geography_level", "geography_code"], None
        ),
    }
    for name, document in documents.items():
        write_documents(document, target[name])
    write_csv_report(tables.schema_report(gold, years), target["schema_report"])
    return target


def build_all(bronze: DataFrame, income_silver: DataFrame, base: str, configured_years: list[int]) -> dict[str, str]:
    """Every table of both sources for all configured years that have data.

    Configured years without rows are skipped; building nothing at all is an error.
    """
    spark = bronze.sparkSession
    paths = {
        name: f"{base}/{name}"
        for name in (
            "sales_silver", "sales_national", "sales_by_department", "sales_by_property_type", "sales_by_commune",
            "income_gold", "income_departments", "commune_year",
        )
    }
    kept = sales.to_silver(bronze).where(F.col("year").isin([int(y) for y in configured_years]))
    write_years(kept, paths["sales_silver"])
    silver = spark.read.parquet(paths["sales_silver"])
    silver = silver.withColumn("year", F.col("year").cast("long"))
    write_years(sales.national(silver), paths["sales_national"], rebalance=True)
    write_years(sales.by_department(silver), paths["sales_by_department"], rebalance=True)
    write_years(sales.by_property_type(silver), paths["sales_by_property_type"], rebalance=True)
    write_years(sales.by_commune(silver), paths["sales_by_commune"], rebalance=True)

    write_years(income.harmonise(income_silver), paths["income_gold"], rebalance=True)
    gold = spark.read.parquet(paths["income_gold"]).withColumn("year", F.col("year").cast("long"))
    write_years(income.departments(gold), paths["income_departments"], rebalance=True)

    communes = spark.read.parquet(paths["sales_by_commune"]).withColumn("year", F.col("year").cast("long"))
    joined = tables.commune_year(communes, gold.where(F.col("geography_level") == "commune"))
    joined.write.mode("overwrite").parquet(paths["commune_year"])
    return paths
