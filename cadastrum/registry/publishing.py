"""Cross-source tables, catalogues, documents and whole builds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastrum import catalogue as cat
from cadastrum.column_labels import FILTER_KINDS, INCOME_LABELS, RESULT_LABELS, SALES_LABELS
from cadastrum.plans import explorer, income, incremental, layers, publish
from cadastrum.plans import sales as sales_plan
from cadastrum.plans.checks import catalogue_violations
from cadastrum.registry import standins
from cadastrum.registry.base import query, table
from cadastrum.registry.income import (
    AVAILABILITY_SQL,
    DECILE_SQL,
    DEPARTMENTS_SQL,
    GOLD_SQL,
    GOLD_VIEWS,
    SUMMARY_SQL,
    all_gold,
    gold,
)
from cadastrum.registry.income import layers as income_layers
from cadastrum.registry.sales import _DEPARTMENT_SQL, _NATIONAL_SQL, COMMUNE_SQL, silver
from cadastrum.registry.standins import INCOME_SQL, SALES_SQL, SILVER_SQL, with_views
from cadastrum.schemas import INDICATORS, SALES_COLUMNS
from cadastrum.session import materialise, scratch_path, small_table
from cadastrum.sources import readers, sinks, snapshots

_COMMUNE_YEAR_SQL = f"""
commune_year AS (
  SELECT coalesce(s.commune_code, i.geography_code) AS commune_code, coalesce(s.year, i.year) AS year,
         sales_count AS dvf_sales_count, median_price_m2 AS dvf_median_price_m2, median_surface AS dvf_median_surface,
         {", ".join(f"{c} AS filosofi_{c}" for c in publish.PUBLISHED_INCOME)},
         coalesce(s.commune_name, i.geography_name) AS commune_name,
         coalesce(s.department_code, substr(i.geography_code, 1, 2)) AS department_code,
         median_price_m2 / nullif(median_income, 0) AS price_income_ratio
  FROM sales_communes s FULL JOIN communes i ON s.commune_code = i.geography_code AND s.year = i.year)"""
_BOTH = (SALES_SQL, SILVER_SQL, COMMUNE_SQL, INCOME_SQL, GOLD_SQL)


@query("commune_year", with_views("SELECT * FROM commune_year", *_BOTH, _COMMUNE_YEAR_SQL))
def commune_year(spark, sf_dir):
    communes = gold(spark, sf_dir).where(F.col("geography_level") == "commune")
    return publish.commune_year(sales_plan.by_commune(silver(spark, sf_dir)), communes)


@query("commune_year_of_buckets", with_views("SELECT * FROM commune_year", *_BOTH, _COMMUNE_YEAR_SQL))
def commune_year_of_buckets(spark, sf_dir):
    """The same rows from layers stored in buckets by code and year."""
    path = scratch_path(spark, "buckets")
    communes = gold(spark, sf_dir).where(F.col("geography_level") == "commune")
    stored = publish.store_commune_layers(
        sales_plan.by_commune(silver(spark, sf_dir)), communes, path, path.rsplit("/", 1)[1].replace("-", "_")
    )
    return publish.commune_year_of_buckets(*stored)


@query(
    "align_series",
    with_views(
        """, points AS (
             SELECT 'median_income' AS series, year, avg(median_income) AS value FROM communes GROUP BY year
             UNION ALL SELECT 'd1_price_m2', year, CASE WHEN year > 2018 THEN d1_price_m2 END FROM national
             UNION ALL SELECT 'd9_price_m2', year, d9_price_m2 FROM national),
           y AS (SELECT DISTINCT year FROM points)
           SELECT s.series AS series, CAST(y.year AS BIGINT) AS year, round(value, 0) AS value
           FROM (SELECT DISTINCT series FROM points) s CROSS JOIN y
           LEFT JOIN points p ON p.series = s.series AND p.year = y.year""",
        SALES_SQL, SILVER_SQL, _NATIONAL_SQL, INCOME_SQL, GOLD_SQL,
    ),
)
def align_series(spark, sf_dir):
    """Income and price series on common years; one price series has no value and goes."""
    communes = gold(spark, sf_dir).where(F.col("geography_level") == "commune")
    series = explorer.trend(communes, ["median_income"]).select(
        F.lit("median_income").alias("series"), "year", F.col("median_income").alias("value")
    )
    national = sales_plan.national(silver(spark, sf_dir)).select(
        "year",
        F.when(F.col("year") > 2018, F.col("d1_price_m2")).alias("d1_price_m2"),
        F.lit(None).cast("double").alias("median_price_m2"),
        "d9_price_m2",
    )
    prices = national.unpivot(["year"], ["d1_price_m2", "median_price_m2", "d9_price_m2"], "series", "value")
    return publish.align_series(series, prices)


@query("available_years", with_views("SELECT DISTINCT year FROM income_silver", INCOME_SQL))
def available_years(spark, sf_dir):
    return publish.available_years(standins.income_silver(spark, sf_dir))


@query(
    "missing_years",
    with_views(
        """SELECT CAST(year AS BIGINT) AS year FROM (
             SELECT 2022 AS year UNION SELECT year FROM catalogue
               WHERE year NOT IN (SELECT year FROM income_silver WHERE year NOT IN (2019, 2021)))""",
        INCOME_SQL, GOLD_SQL,
    ),
)
def missing_years(spark, sf_dir):
    present = standins.income_silver(spark, sf_dir).where(~F.col("year").isin(2019, 2021))
    return publish.missing_years(spark, present)


@query(
    "preview",
    "SELECT o_orderkey, o_totalprice, o_orderdate FROM orders ORDER BY o_orderkey LIMIT 500",
)
def preview(spark, sf_dir):
    """The first 500 rows; of the asked columns only those present."""
    wanted = ["o_orderkey", "id_mutation", "o_totalprice", "o_orderdate"]
    return publish.preview(table(spark, sf_dir, "orders"), ["o_orderkey"], wanted)


_LINEITEM = (
    ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
    ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
    ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz"),
)


@query(
    "describe_columns",
    " UNION ALL ".join(
        f"SELECT {i} AS position, '{name}' AS column_name, '{kind}' AS column_type, count({name}) AS filled FROM lineitem"
        for i, (name, kind) in enumerate(_LINEITEM, start=1)
    ),
)
def describe_columns(spark, sf_dir):
    """Names and types of a table's columns and how many cells are filled."""
    lines = table(spark, sf_dir, "lineitem")
    filled = lines.agg(*[F.count(c).alias(c) for c in lines.columns]).unpivot([], lines.columns, "column_name", "filled")
    return filled.join(F.broadcast(readers.describe(lines)), "column_name")


_INCOME_SHOWN = {
    name: INCOME_LABELS[name]
    for name in ("year", "geography_level", "commune_code", "department_code", "commune_name", *INDICATORS)
}
_RESULT_NAMES = {
    "geographyCode": "geography_code", "geographyName": "geography_name", "indicatorValue": "median_income",
    "indicatorSource": "indicator_source", "isOfficial": "is_official", "methodologyVersion": "methodology_version",
    "comparableWithPreviousYears": "comparable_with_previous_years",
}
_CATALOGUE_TYPES = [
    (i, name, *SALES_LABELS[name])
    for i, name in enumerate((*SALES_COLUMNS, "year", "price_m2"), start=1)
]


@query(
    "column_catalogue",
    with_views(
        " UNION ALL ".join(
            f"""SELECT {i} AS position, '{name}' AS key, '{label}' AS label, '{kind}' AS type,
                '{"number-range" if kind == "number" else "text"}' AS filter_kind, count({name}) AS filled FROM silver"""
            for i, name, label, kind in _CATALOGUE_TYPES
        ),
        SALES_SQL, SILVER_SQL,
    ),
)
def column_catalogue(spark, sf_dir):
    return publish.column_catalogue(silver(spark, sf_dir), SALES_LABELS)


def _catalogue_sql(view: str, columns, names: dict[str, str] | None = None) -> str:
    return " UNION ALL ".join(
        f"""SELECT {i} AS position, '{name}' AS key, '{label}' AS label, '{kind}' AS type,
            '{FILTER_KINDS[kind]}' AS filter_kind, count({(names or {}).get(name, name)}) AS filled FROM {view}"""
        for i, (name, (label, kind)) in enumerate(columns.items(), start=1)
    )


@query("income_column_catalogue", with_views(_catalogue_sql("income_silver", _INCOME_SHOWN), INCOME_SQL))
def income_column_catalogue(spark, sf_dir):
    return publish.column_catalogue(standins.income_silver(spark, sf_dir).select(*_INCOME_SHOWN), INCOME_LABELS)


@query("result_column_catalogue", with_views(_catalogue_sql("communes", RESULT_LABELS, _RESULT_NAMES), INCOME_SQL, GOLD_SQL))
def result_column_catalogue(spark, sf_dir):
    """The columns of explorer results, over all communes and years."""
    communes = gold(spark, sf_dir).where(F.col("geography_level") == "commune")
    shown = communes.select(*[F.col(source).alias(name) for name, source in _RESULT_NAMES.items()])
    return publish.column_catalogue(shown, RESULT_LABELS)


@query(
    "dataset_catalogue",
    with_views(
        """SELECT 'sales' AS id, 'Transactions immobilières' AS label, count(*) AS rows, 13 AS columns,
                  min(year) AS first_year, max(year) AS last_year, CAST(0 AS BIGINT) AS unreadable_files FROM silver
           UNION ALL SELECT 'income', 'Revenus et pauvreté', count(*), 18, min(year), max(year), 2 FROM income_silver
           UNION ALL SELECT 'broken', 'Illisible', NULL, NULL, NULL, NULL, 1
           UNION ALL SELECT 'absent', 'Non disponible', NULL, NULL, NULL, NULL, NULL""",
        SALES_SQL, SILVER_SQL, INCOME_SQL,
    ),
)
def dataset_catalogue(spark, sf_dir):
    """Stored tables: a whole one, one with two files cut short among its own, one with such files alone, one without a folder."""
    base = scratch_path(spark, "catalogue")
    silver(spark, sf_dir).write.partitionBy("year").parquet(f"{base}/sales")
    standins.income_silver(spark, sf_dir).write.partitionBy("year").parquet(f"{base}/income")
    no_footer = spark.range(1).select(F.lit("PAR1 cut short").alias("value"))
    for target in ("income/year=2018", "income/year=2019", "broken/year=2018"):
        no_footer.coalesce(1).write.mode("append").text(f"{base}/{target}")
    return publish.dataset_catalogue(
        spark,
        {
            "sales": ("Transactions immobilières", f"{base}/sales"),
            "income": ("Revenus et pauvreté", f"{base}/income"),
            "broken": ("Illisible", f"{base}/broken"),
            "absent": ("Non disponible", f"{base}/absent"),
        },
    )


_REPORT_YEARS = (2017, 2018, 2019, 2020, 2021, 2023)


def _report_sql() -> str:
    rows = []
    for level in ("commune", "department"):
        for column in ("geography_code", "geography_name", *INDICATORS):
            if level == "department" and column == "geography_name":
                kind = "no_label"
            elif level == "department" and column in INDICATORS and column != "d5_income":
                kind = "mixed"
            elif column == "d5_income":
                kind = "unpublished"
            elif column in cat.SECONDARY_DECILES:
                kind = "secondary"
            elif column == "geography_name":
                kind = "labels"
            elif column in ("median_income", "d1_income", "d9_income", "poverty_rate"):
                kind = "break"
            else:
                kind = "stable"
            sources = ", ".join(
                f"(SELECT coalesce(max('{cat.PUBLISHED_COLUMNS[column].get(y, '')}'), '') FROM income_silver WHERE year = {y})"
                for y in _REPORT_YEARS
            )
            rows.append(f"('{column}', '{level}', '{publish.REPORT_STATUS[kind][0]}', '{publish.REPORT_STATUS[kind][1]}', {sources})")
    names = "canonical_column, geography_level, status, notes, " + ", ".join(f'"{y}_column"' for y in _REPORT_YEARS)
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS t({names})"


@query("schema_report", with_views(_report_sql(), INCOME_SQL))
def schema_report(spark, sf_dir):
    """The report over the loaded table's years, written as CSV and read back."""
    path = scratch_path(spark, "schema-report")
    report = publish.schema_report(standins.income_silver(spark, sf_dir), list(_REPORT_YEARS))
    sinks.write_csv_report(report, path)
    return readers.read_delimited(spark, path, sep=",")


@query(
    "summary_collection",
    with_views(
        f"""SELECT year, (SELECT CAST(max(year) AS BIGINT) FROM year_summary) AS latest_year,
                  (SELECT string_agg(CAST(year AS VARCHAR), ',' ORDER BY year) FROM year_summary) AS available_years,
                  communes_covered, departments_covered, department_indicator_source, national_median_income,
                  poverty_mean, poverty_median, d1_income, d5_income, d9_income, '{"|".join(income.SUMMARY_NOTES)}' AS notes
           FROM year_summary JOIN decile_summary USING (year)""",
        INCOME_SQL, GOLD_SQL, DEPARTMENTS_SQL, DECILE_SQL, SUMMARY_SQL,
    ),
)
def summary_collection(spark, sf_dir):
    """All yearly summary documents in one JSON text, read back as rows."""
    entry = _collection(spark, sf_dir)
    return entry.select(
        F.col("key").cast("long").alias("year"), "latest_year", "available_years",
        "value.communes_covered", "value.departments_covered", "value.department_indicator_source",
        "value.national_median_income",
        F.col("value.poverty_rate_summary.mean").alias("poverty_mean"),
        F.col("value.poverty_rate_summary.median").alias("poverty_median"),
        "value.decile_summary.d1_income", "value.decile_summary.d5_income", "value.decile_summary.d9_income",
        F.array_join("value.notes", "|").alias("notes"),
    )


def _written_collection(spark, sf_dir) -> tuple[str, DataFrame]:
    summaries = income.summary_table(*income_layers(spark, sf_dir), "2024-01-01T00:00:00+00:00")
    collection = income.summary_collection(summaries, "2024-01-01T00:00:00+00:00")
    path = scratch_path(spark, "summaries")
    sinks.write_documents(sinks.as_document(collection), path)
    return path, collection


def _collection(spark, sf_dir) -> DataFrame:
    path, collection = _written_collection(spark, sf_dir)
    read = spark.read.schema(collection.schema).json(path)
    years = F.array_join(F.transform("available_years", lambda y: y.cast("string")), ",")
    return read.select(years.alias("available_years"), F.col("latest_year"), F.explode("summaries_by_year"))


_DECILE_COLUMNS = [c for c in INDICATORS if c.startswith("d")]


@query(
    "summary_department_maps",
    with_views(
        "SELECT year, geography_code AS department_code, "
        + ", ".join(f"round_even({c} * 100, 0) / 100 AS {c}" for c in ("median_income", *_DECILE_COLUMNS))
        + " FROM departments",
        INCOME_SQL, GOLD_SQL, DEPARTMENTS_SQL,
    ),
)
def summary_department_maps(spark, sf_dir):
    """The department maps of the summary documents, as rows."""
    entry = _collection(spark, sf_dir).select(
        F.col("key").cast("long").alias("year"), "value.median_income_by_department", "value.department_deciles_by_department"
    )
    rows = entry.select("year", "median_income_by_department", F.explode("department_deciles_by_department").alias("code", "deciles"))
    return rows.select(
        "year", F.col("code").alias("department_code"),
        F.expr("median_income_by_department[code]").alias("median_income"), "deciles.*",
    )


@query(
    "income_json_scan",
    with_views(
        """SELECT year, (SELECT CAST(max(year) AS BIGINT) FROM year_summary) AS latest_year, communes_covered, departments_covered,
                  department_indicator_source, national_median_income, poverty_mean, poverty_median, d1_income, d9_income,
                  departments
           FROM year_summary JOIN decile_summary USING (year)
           JOIN (SELECT year, count(*) AS departments FROM departments GROUP BY year) USING (year)""",
        INCOME_SQL, GOLD_SQL, DEPARTMENTS_SQL, DECILE_SQL, SUMMARY_SQL,
    ),
)
def income_json_scan(spark, sf_dir):
    """The summary document, with camelCase keys in place of snake_case ones, read by the reader of both."""
    path, _ = _written_collection(spark, sf_dir)
    camel = scratch_path(spark, "summaries-camel")
    text = F.col("value")
    for name in ("summaries_by_year", "communes_covered", "national_median_income", "decile_summary", "d1_income", "latest_year"):
        text = F.replace(text, F.lit(f'"{name}"'), F.lit(f'"{readers.camel(name)}"'))
    spark.read.text(path).select(text.alias("value")).write.text(camel)
    read = income.read_summaries(spark, camel)
    return read.select(
        "year", F.col("collection_latest_year").alias("latest_year"), "communes_covered", "departments_covered",
        "department_indicator_source", "national_median_income",
        F.col("poverty_rate_summary.mean").alias("poverty_mean"), F.col("poverty_rate_summary.median").alias("poverty_median"),
        "decile_summary.d1_income", "decile_summary.d9_income",
        F.size("median_income_by_department").cast("long").alias("departments"),
    )


@query("availability_document", with_views("SELECT * FROM availability", *GOLD_VIEWS, AVAILABILITY_SQL))
def availability_document(spark, sf_dir):
    """The nested availability document, written and read back as rows."""
    path = scratch_path(spark, "availability")
    sinks.write_documents(income.availability_document(income.availability(all_gold(spark, sf_dir))), path)
    return income.read_availability(spark, path)


@query(
    "preview_document",
    """SELECT 'orders' AS dataset_id, (SELECT count(*) FROM orders) AS rows, 3 AS columns_count,
              '2021,2024' AS available_years, 'number,number,text' AS types, o_orderkey, o_totalprice,
              strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate
       FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 500)""",
)
def preview_document(spark, sf_dir):
    """A preview document taken apart again: counts of the whole table, typed columns, first records."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    document = publish.preview_document(rows, "orders", "orders.parquet", ["o_orderkey"], [2021, 2024])
    kind = (
        "struct<dataset_id:string,rows:bigint,columns_count:int,available_years:array<string>,"
        "columns:array<struct<type:string>>,records:array<struct<o_orderkey:bigint,o_totalprice:double,o_orderdate:string>>>"
    )
    parsed = document.select(F.from_json("document", kind).alias("d"))
    return parsed.select(
        "d.dataset_id", "d.rows", "d.columns_count", F.array_join("d.available_years", ",").alias("available_years"),
        F.array_join("d.columns.type", ",").alias("types"), F.inline("d.records"),
    )


_PUBLISHED_SQL = """
SELECT 'sales_summary' AS name, CAST(year AS BIGINT) AS latest_year, total_sales_count AS entries, median_price_m2 AS value
  FROM national WHERE year = (SELECT max(year) FROM national)
UNION ALL SELECT 'income_summaries', CAST(max(year) AS BIGINT), count(*), arg_max(national_median_income, year) FROM year_summary
UNION ALL SELECT 'income_availability', CAST(max(year) AS BIGINT), count(*), NULL FROM availability WHERE available
UNION ALL SELECT 'income_metadata', CAST(max(year) AS BIGINT), count(DISTINCT year), NULL FROM gold
UNION ALL SELECT 'sales_preview', 2024, count(*), NULL FROM silver WHERE year = (SELECT max(year) FROM silver)
UNION ALL SELECT 'income_preview', CAST(max(year) AS BIGINT), count(*), NULL FROM gold
UNION ALL SELECT 'schema_report', NULL, (SELECT 2 * 2 + 2 * count(DISTINCT indicator) FROM availability), NULL"""


@query(
    "publish_latest",
    with_views(
        _PUBLISHED_SQL, SALES_SQL, SILVER_SQL, _NATIONAL_SQL, INCOME_SQL, GOLD_SQL, DEPARTMENTS_SQL, DECILE_SQL, SUMMARY_SQL,
        AVAILABILITY_SQL,
    ),
)
def publish_latest(spark, sf_dir):
    """The whole build and its publication; one row read from each published document."""
    base = scratch_path(spark, "publication")
    paths = layers.build_all(
        standins.sales(spark, sf_dir), standins.income_silver(spark, sf_dir), f"{base}/tables", list(cat.SALES_YEARS)
    )
    target = layers.publish(spark, paths, f"{base}/published", "2024-01-01T00:00:00+00:00")
    nothing = F.lit(None).cast("double")

    def row(name: str, rows: DataFrame, latest, entries, value=nothing) -> DataFrame:
        return rows.agg(latest.cast("long").alias("latest_year"), entries.cast("long").alias("entries"), value.alias("value")).select(
            F.lit(name).alias("name"), "latest_year", "entries", "value"
        )

    def preview_row(name: str) -> DataFrame:
        read = readers.read_documents(spark, target[name], "rows long, available_years array<long>")
        return row(name, read, F.max(F.array_max("available_years")), F.max("rows"))

    sold = sales_plan.read_summaries(spark, target["sales_summary"])
    summaries = income.read_summaries(spark, target["income_summaries"])
    offered = income.read_availability(spark, target["income_availability"]).where("available")
    metadata = income.read_metadata(spark, target["income_metadata"])
    report = readers.read_delimited(spark, target["schema_report"], sep=",")
    last = F.col("year") == F.col("collection_latest_year")
    parts = [
        row("sales_summary", sold, F.max("year"), F.max("total_sales_count"), F.max("median_price_m2")),
        row("income_summaries", summaries, F.max("collection_latest_year"), F.count("*"), F.max(F.when(last, F.col("national_median_income")))),
        row("income_availability", offered, F.max("year"), F.count("*")),
        row("income_metadata", metadata, F.max(F.array_max("available_years")), F.max(F.size("available_years"))),
        preview_row("sales_preview"),
        preview_row("income_preview"),
        row("schema_report", report, F.lit(None), F.count("*")),
    ]
    return reduce(DataFrame.union, parts)


@query(
    "income_metadata",
    with_views(
        """SELECT string_agg(DISTINCT CAST(year AS VARCHAR), ',' ORDER BY CAST(year AS VARCHAR)) AS available_years,
                  (SELECT string_agg(CAST(year AS VARCHAR), ',' ORDER BY year) FROM (
                     SELECT 2022 AS year UNION SELECT year FROM catalogue
                     WHERE year NOT IN (SELECT year FROM gold WHERE year <> 2021))) AS missing_years,
                  (SELECT string_agg(CAST(year AS VARCHAR), ',' ORDER BY year) FROM catalogue WHERE methodological_break)
                    AS break_years,
                  'gold/commune_all_years.parquet' AS commune_path
           FROM gold WHERE year <> 2021""",
        *GOLD_VIEWS,
    ),
)
def income_metadata(spark, sf_dir):
    """Metadata document of a gold table that lacks one configured year, read back."""
    rows = materialise(gold(spark, sf_dir).where(F.col("year") != 2021), "metadata-gold")
    document = income.metadata_document(
        rows, publish.missing_years(spark, rows), {"commune_all_years": "gold/commune_all_years.parquet"}, ""
    )
    parsed = document.select(
        F.from_json(
            "document",
            "available_years array<string>, missing_years array<string>,"
            " methodology_breaks array<struct<year:string>>, datasets struct<commune_all_years:string>",
        ).alias("d")
    )
    return parsed.select(
        F.array_join("d.available_years", ",").alias("available_years"),
        F.array_join("d.missing_years", ",").alias("missing_years"),
        F.array_join("d.methodology_breaks.year", ",").alias("break_years"),
        F.col("d.datasets.commune_all_years").alias("commune_path"),
    )


_VIOLATIONS_SQL = """
WITH s AS (SELECT o_custkey, year(o_orderdate) AS year, count(*) AS n, min(o_orderstatus) AS status
           FROM orders GROUP BY ALL),
c AS (SELECT c_custkey, c_mktsegment, min(year) AS lo, max(year) AS hi, arg_max(n, year) AS n
      FROM customer JOIN s ON o_custkey = c_custkey GROUP BY ALL)
SELECT c_custkey AS catalogue_id, 'dataset_name' AS rule, 'BUILDING' AS detail FROM c WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT o_custkey, 'enabled_missing', CAST(year AS VARCHAR) FROM s JOIN c ON o_custkey = c_custkey WHERE s.n = 1
UNION ALL SELECT o_custkey, 'source_type_missing', CAST(year AS VARCHAR) FROM s JOIN c ON o_custkey = c_custkey
  WHERE s.n % 2 = 0 AND status = 'F'
UNION ALL SELECT c_custkey, 'default_year_disabled', CAST(hi AS VARCHAR) FROM c WHERE n % 2 = 1
UNION ALL SELECT c_custkey, 'missing_year_available', CAST(lo AS VARCHAR) FROM c WHERE c_custkey % 3 = 0"""


@query("catalogue_violations", _VIOLATIONS_SQL)
def catalogue_violations_query(spark, sf_dir):
    """One catalogue document per customer, its sources being the years with orders."""
    years = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey", F.year("o_orderdate").cast("long").alias("year"))
        .agg(F.count("*").alias("n"), F.min("o_orderstatus").alias("status"))
    )
    source = F.struct(
        F.when(F.col("n") > 1, F.col("n") % 2 == 0).alias("enabled"),
        F.when(F.col("status") == "F", " ").otherwise(F.col("status")).alias("source_type"),
    )
    # At most one entry per calendar year and customer.
    documents = years.groupBy("o_custkey").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("year").cast("string"), source))).alias("sources"),
        F.min("year").alias("first"),
        F.max("year").alias("default_year"),
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    joined = documents.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    dataset = F.when(F.col("c_mktsegment") == "BUILDING", "BUILDING").otherwise("filosofi")
    missing = F.array(F.when(F.col("c_custkey") % 3 == 0, F.col("first")).otherwise(F.lit(1990)))
    body = F.struct(dataset.alias("dataset"), "default_year", missing.alias("known_missing_years"), "sources")
    return catalogue_violations(joined.select(F.col("c_custkey").alias("catalogue_id"), F.to_json(body).alias("document")))


_BUILT = {
    "sales_silver": ("silver", ""),
    "sales_by_commune": ("sales_communes", ""),
    "income_gold": ("gold", ""),
    "income_departments": ("departments", ""),
    "commune_year": ("commune_year", ""),
}


@query(
    "build_all_years",
    with_views(
        " UNION ALL ".join(
            f"SELECT '{name}' AS name, CAST(year AS BIGINT) AS year, count(*) AS rows FROM {view} GROUP BY year"
            for name, (view, _) in _BUILT.items()
        ).replace("FROM silver", "FROM (SELECT * FROM silver)"),
        SALES_SQL, SILVER_SQL, COMMUNE_SQL, INCOME_SQL, GOLD_SQL, DEPARTMENTS_SQL, _COMMUNE_YEAR_SQL,
    ),
)
def build_all_years(spark, sf_dir):
    """The whole build over all years; rows per written table and year."""
    paths = layers.build_all(
        standins.sales(spark, sf_dir),
        standins.income_silver(spark, sf_dir),
        scratch_path(spark, "build"),
        list(cat.SALES_YEARS),
    )
    counts = [
        spark.read.parquet(paths[name])
        .groupBy(F.col("year").cast("long").alias("year"))
        .agg(F.count("*").alias("rows"))
        .select(F.lit(name).alias("name"), "year", "rows")
        for name in _BUILT
    ]
    return reduce(DataFrame.union, counts)


_CHANGED = 2019
_LAYER_VIEWS = {
    "sales_silver": "silver", "sales_national": "national", "sales_by_department": "by_department",
    "sales_by_commune": "sales_communes", "income_gold": "gold", "income_departments": "departments", "commune_year": "commune_year",
}


@query(
    "incremental_build",
    with_views(
        " UNION ALL ".join(
            f"""SELECT '{name}' AS layer, CAST(year AS BIGINT) AS year, count(*) AS rows,
                       CAST({1 if name.startswith("income") else f"CASE WHEN year = {_CHANGED} THEN 2 ELSE 1 END"} AS BIGINT) AS version
                FROM {view} GROUP BY year"""
            for name, view in _LAYER_VIEWS.items()
        ),
        SALES_SQL, SILVER_SQL, _NATIONAL_SQL, _DEPARTMENT_SQL, COMMUNE_SQL, INCOME_SQL, GOLD_SQL, DEPARTMENTS_SQL, _COMMUNE_YEAR_SQL,
    ),
)
def incremental_build(spark, sf_dir):
    """A build, more files in one year, a second build: rows and version of each layer's years."""
    base = scratch_path(spark, "incremental")
    inputs = {"sales_bronze": f"{base}/sales", "income_silver": f"{base}/income"}
    rows = standins.sales(spark, sf_dir)
    late = F.coalesce((F.col("year") == _CHANGED) & (F.col("type_local") == "Maison"), F.lit(False))
    standins.income_silver(spark, sf_dir).write.partitionBy("year").parquet(inputs["income_silver"])
    for part in (~late, late):
        rows.where(part).write.mode("append").partitionBy("year").parquet(inputs["sales_bronze"])
        incremental.build(spark, inputs, f"{base}/built")
    found = [
        (name, year, entry.rows, entry.version)
        for name in _LAYER_VIEWS
        for year, entry in snapshots.current(spark, f"{base}/built/{name}").years.items()
    ]
    return small_table(spark, found, "layer string, year bigint, rows bigint, version bigint")
