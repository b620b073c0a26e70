"""Sales queries: scans of written text, filters, exact medians, documents, stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastrum import catalogue as cat
from cadastrum.functions import french_number, full_commune_code, round_even
from cadastrum.operators.quantiles import quantile_table
from cadastrum.operators.shape import two_maps_to_rows
from cadastrum.plans import sales as plan
from cadastrum.registry import standins
from cadastrum.registry.base import query, table
from cadastrum.registry.standins import BRONZE_SQL, SALES_SQL, SILVER_SQL, with_views
from cadastrum.schemas import SALES_COLUMNS
from cadastrum.session import scratch_path
from cadastrum.sources import readers, sinks
from cadastrum.streaming.sales_stream import price_store, read_latest_totals, run_funnel_stream, run_price_stream, run_silver_stream

_R2 = "round_even({0} * 100, 0) / 100"
_COLUMNS = ", ".join(SALES_COLUMNS)


def _median(column: str, p: str = "0.5") -> str:
    return _R2.format(f"quantile_cont({column}, {p})")


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.to_silver(standins.sales(spark, sf_dir))


def _national(spark, sf_dir):
    return plan.national(silver(spark, sf_dir))


def _written_text(spark: SparkSession, sf_dir: str, label: str, sep: str, **options) -> str:
    path = scratch_path(spark, label)
    standins.raw_sales(spark, sf_dir).write.options(header=True, sep=sep, **options).csv(path)
    return path


_BRONZE_CHECK = with_views(f"SELECT {_COLUMNS}, CAST(year AS BIGINT) AS year FROM bronze", SALES_SQL, BRONZE_SQL)


@query("csv_scan", _BRONZE_CHECK)
def csv_scan(spark, sf_dir):
    path = _written_text(spark, sf_dir, "raw-text", "|")
    raw = readers.read_delimited(spark, path)
    return plan.to_bronze(raw, F.col("year"))


@query("gzip_scan", _BRONZE_CHECK)
def gzip_scan(spark, sf_dir):
    path = _written_text(spark, sf_dir, "raw-gzip", ";", compression="gzip")
    raw = readers.read_gzip(spark, path, sep=";")
    return plan.to_bronze(raw, F.col("year"))


@query("sniffed_scan", _BRONZE_CHECK)
def sniffed_scan(spark, sf_dir):
    """All sales in one folder: plain and gzip files, some of either named like the other."""
    path = scratch_path(spark, "raw-sniffed")
    rows = standins.raw_sales(spark, sf_dir).withColumn("set", F.pmod(F.xxhash64("Commune", "Valeur foncière"), F.lit(4)))
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for number, (compression, name) in enumerate((("none", "csv"), ("gzip", "csv.gz"), ("none", "csv.gz"), ("gzip", "csv"))):
        part = rows.where(F.col("set") == number).drop("set")
        part.write.options(header=True, sep=";", compression=compression).csv(f"{path}-written/{number}")
        files = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(hadoop(path))
        for at, status in enumerate(files.globStatus(hadoop(f"{path}-written/{number}/part-*"))):
            files.rename(status.getPath(), hadoop(f"{path}/{number}-{at}.{name}"))
    return plan.to_bronze(readers.read_sniffed(spark, path), F.col("year"))


_QUOTED_NAME = """nom_commune || ' ' || chr(10) || '"' || nature_mutation || '"|' || type_local AS nom_commune"""


@query(
    "quoted_csv_scan",
    with_views(
        f"""SELECT {_COLUMNS.replace("nom_commune", _QUOTED_NAME)}, CAST(year AS BIGINT) AS year FROM bronze""",
        SALES_SQL, BRONZE_SQL,
    ),
)
def quoted_csv_scan(spark, sf_dir):
    """All sales, every name with a line break, quotes and delimiters inside quotes; files are read in byte ranges."""
    path = scratch_path(spark, "raw-quoted")
    name = F.concat("Commune", F.lit('\n"'), "`Nature mutation`", F.lit('"|'), "`Type local`")
    rows = standins.raw_sales(spark, sf_dir).withColumn("Commune", name)
    rows.write.options(header=True, sep="|", escape='"').csv(path)
    return plan.to_bronze(readers.read_delimited(spark, path, sep="|", multi_line=True), F.col("year"))


@query(
    "delimiter_profile",
    with_views(
        """SELECT sep AS file, sep AS delimiter, lines FROM (SELECT count(*) AS lines FROM sales),
           (VALUES (','), (';'), ('|'), ('tab')) AS t(sep)
           UNION ALL SELECT 'mixed', '|', count(*) + 1 FROM nation
           UNION ALL SELECT 'blank', ',', 0""",
        SALES_SQL,
    ),
)
def delimiter_profile(spark, sf_dir):
    """One text set per delimiter, holding all sales; one whose header decides; one of blank lines."""
    base = scratch_path(spark, "delimiters")
    names = ["nature_mutation", "type_local", "code_departement", "code_commune", "nom_commune"]
    rows = standins.sales(spark, sf_dir).select(*names, F.coalesce("valeur_fonciere", F.lit(0)).cast("string"))

    def written(lines: DataFrame, name: str) -> None:
        lines.select("value", F.lit(name).alias("set")).write.mode("append").partitionBy("set").text(base)

    for name, sep in ((",", ","), (";", ";"), ("|", "|"), ("tab", "\t")):
        written(rows.select(F.concat_ws(sep, *[F.col(c) for c in rows.columns]).alias("value")), name)
    nations = table(spark, sf_dir, "nation")
    odd = F.when(F.col("n_nationkey") % 2 == 0, F.concat("n_name", F.lit(";x"))).otherwise(F.col("n_name"))
    header = spark.range(1).select(F.lit(-1).alias("at"), F.lit("a|b;c").alias("value"))
    mixed = header.union(nations.select("n_nationkey", odd)).coalesce(1).sortWithinPartitions("at")
    written(mixed, "mixed")
    written(spark.range(3).select(F.lit("  ").alias("value")), "blank")

    lines = readers.text_lines(spark, base).withColumn("set", F.regexp_extract("file", "/set=([^/]*)/", 1))
    lines = lines.withColumn("set", F.url_decode("set"))
    profile = readers.delimiter_profile(lines, ["set"])
    chosen = readers.choose_delimiter(profile, readers.first_lines(lines, ["set"], "place"), ["set"])
    counted = profile.groupBy("set").agg(F.max("total").alias("lines"))
    shown = F.when(F.col("delimiter") == "\t", "tab").otherwise(F.col("delimiter"))
    return chosen.join(counted, "set", "left").select(
        F.col("set").alias("file"), shown.alias("delimiter"), F.coalesce("lines", F.lit(0)).cast("long").alias("lines")
    )


@query("parquet_project", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_quantity >= 30")
def parquet_project(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.where(F.col("l_quantity") >= 30).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query(
    "alias_project",
    with_views(
        "SELECT code_departement, nom_commune, type_local, longitude, count(*) AS rows FROM bronze GROUP BY ALL",
        SALES_SQL, BRONZE_SQL,
    ),
)
def alias_project(spark, sf_dir):
    bronze = plan.to_bronze(standins.raw_sales(spark, sf_dir))
    return bronze.groupBy("code_departement", "nom_commune", "type_local", "longitude").agg(F.count("*").alias("rows"))


@query(
    "code_repair",
    """SELECT p_partkey, CASE WHEN length(code) BETWEEN 1 AND 3 THEN dep || lpad(code, 3, '0') ELSE code END AS code
       FROM (SELECT p_partkey, trim(CAST(p_partkey AS VARCHAR)) AS code,
                    lpad(CAST(p_size AS VARCHAR), 2, '0') AS dep FROM part)""",
)
def code_repair(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    commune = F.concat(F.lit(" "), F.col("p_partkey").cast("string"))
    department = F.concat(F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit(" "))
    return part.select("p_partkey", full_commune_code(commune, department).alias("code"))


@query(
    "fr_number",
    """SELECT l_orderkey, l_linenumber,
              CASE WHEN l_tax = 0 THEN NULL WHEN l_discount >= 0.1 THEN NULL
                   WHEN l_returnflag = 'N' THEN NULL ELSE l_extendedprice END AS amount FROM lineitem""",
)
def fr_number(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    grouped = F.translate(F.format_number("l_extendedprice", 2), ",.", " ,")
    text = (
        F.when(F.col("l_tax") == 0, "s")
        .when(F.col("l_discount") >= 0.1, "")
        .when(F.col("l_returnflag") == "N", F.concat(grouped, F.lit("d")))
        .otherwise(grouped)
    )
    return lines.select("l_orderkey", "l_linenumber", french_number(text).alias("amount"))


@query(
    "ratio",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_tax = 0 THEN NULL ELSE l_extendedprice / l_tax END AS ratio
       FROM lineitem""",
)
def ratio(spark, sf_dir):
    from cadastrum.functions import ratio as quotient

    lines = table(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", quotient("l_extendedprice", "l_tax").alias("ratio"))


_SILVER_CHECK = with_views(
    f"SELECT {_COLUMNS}, CAST(year AS BIGINT) AS year, price_m2 FROM silver", SALES_SQL, SILVER_SQL
)


@query("sales_silver", _SILVER_CHECK)
def sales_silver(spark, sf_dir):
    return silver(spark, sf_dir)


@query("sales_silver_write", _SILVER_CHECK)
def sales_silver_write(spark, sf_dir):
    """Silver written by year (twice: a year overwritten stays single) and read back."""
    path = scratch_path(spark, "sales-silver")
    rows = silver(spark, sf_dir)
    sinks.write_years(rows, path)
    sinks.write_years(rows.where(F.col("year") >= 2021), path)
    return readers.read_years(spark, path).select(*rows.columns)


_FILE_ROWS = 4 << 20  # rows of a file that the streams read, about
_ROW_GROUP = 16 << 20  # bytes, so that several tasks share a file
_ORDER_YEARS = 7


def _bronze_files(spark, sf_dir) -> str:
    """Bronze rows in a folder per year; their number, not that of cores or tasks, decides how many files there are."""
    source = scratch_path(spark, "stream-source")
    bronze = plan.to_bronze(standins.raw_sales(spark, sf_dir), F.col("year"))
    slots = table(spark, sf_dir, "lineitem").count() // (_FILE_ROWS * _ORDER_YEARS) + 1
    slot = F.pmod(F.xxhash64(*bronze.columns), F.lit(slots))
    placed = bronze.withColumns({"part": F.col("year"), "slot": slot}).repartition("part", "slot").drop("slot")
    placed.write.option("parquet.block.size", _ROW_GROUP).partitionBy("part").parquet(source)
    return source


@query("stream_sales_silver", _SILVER_CHECK)
def stream_sales_silver(spark, sf_dir):
    """Bronze text rows in several files, run through the stream."""
    target = run_silver_stream(spark, _bronze_files(spark, sf_dir), scratch_path(spark, "stream-silver"), max_files=2)
    return readers.read_years(spark, target).select(*SALES_COLUMNS, "year", "price_m2")


_FUNNEL_CHECK = with_views(
        """SELECT CAST(year AS BIGINT) AS year, count(*) AS rows_read,
             count(*) FILTER (stage = 1) AS filtered_non_sales, count(*) FILTER (stage = 2) AS filtered_non_residential,
             count(*) FILTER (stage = 3) AS filtered_invalid_values, count(*) FILTER (stage = 4) AS filtered_outliers,
             count(*) FILTER (stage = 5) AS rows_kept
           FROM (SELECT year, CASE WHEN nature_mutation <> 'Vente' THEN 1
               WHEN type_local NOT IN ('Maison', 'Appartement') THEN 2
               WHEN valeur_fonciere IS NULL OR code_departement = '' THEN 3
               WHEN valeur_fonciere / surface_reelle_bati NOT BETWEEN 300 AND 50000
                    OR surface_reelle_bati NOT BETWEEN 9 AND 1000 THEN 4 ELSE 5 END AS stage FROM sales)
           GROUP BY year""",
        SALES_SQL,
    )


@query("quality_funnel", _FUNNEL_CHECK)
def quality_funnel(spark, sf_dir):
    return plan.quality_funnel(standins.sales(spark, sf_dir), ["year"])


@query("stream_quality_funnel", _FUNNEL_CHECK)
def stream_quality_funnel(spark, sf_dir):
    """The funnel as running totals of a stream of the same rows in several micro-batches."""
    target = run_funnel_stream(spark, _bronze_files(spark, sf_dir), scratch_path(spark, "stream-funnel"), max_files=2)
    return read_latest_totals(spark, target)


_NATIONAL_SQL = f"""
national AS (
  SELECT CAST(year AS BIGINT) AS year, count(*) AS total_sales_count, {_median("price_m2")} AS median_price_m2,
         {_median("price_m2", "0.1")} AS d1_price_m2, {_median("price_m2", "0.9")} AS d9_price_m2,
         {_median("surface_reelle_bati")} AS median_surface
  FROM silver GROUP BY year)"""


@query("sales_national", with_views("SELECT * FROM national", SALES_SQL, SILVER_SQL, _NATIONAL_SQL))
def sales_national(spark, sf_dir):
    return _national(spark, sf_dir)


_DEPARTMENT_SQL = f"""
by_department AS (
  SELECT code_departement AS department_code, CAST(year AS BIGINT) AS year, count(*) AS sales_count,
         {_median("price_m2")} AS median_price_m2
  FROM silver GROUP BY ALL)"""


@query("sales_by_department", with_views("SELECT * FROM by_department", SALES_SQL, SILVER_SQL, _DEPARTMENT_SQL))
def sales_by_department(spark, sf_dir):
    return plan.by_department(silver(spark, sf_dir))


_TYPE_SQL = f"""
by_type AS (
  SELECT type_local AS property_type, CAST(year AS BIGINT) AS year, {_median("price_m2")} AS median_price_m2
  FROM silver GROUP BY ALL)"""


_PRICE_SPECS = {"price_m2": {"d1_price_m2": 0.1, "median_price_m2": 0.5, "d9_price_m2": 0.9}}
_PRICES_SQL = with_views(
    f"""SELECT code_departement, CAST(year AS BIGINT) AS year, {_median("price_m2", "0.1")} AS d1_price_m2,
               {_median("price_m2")} AS median_price_m2, {_median("price_m2", "0.9")} AS d9_price_m2
        FROM silver GROUP BY code_departement, year""",
    SALES_SQL, SILVER_SQL,
)


@query("merged_quantiles", _PRICES_SQL)
def merged_quantiles(spark, sf_dir):
    """Prices by department and year from three stored batches: the early years, then a year in two parts."""
    store = price_store(scratch_path(spark, "price-store"))
    rows = silver(spark, sf_dir)
    last = F.col("year") >= 2019
    for batch, part in enumerate((~last, last & (F.col("type_local") == "Maison"), last & (F.col("type_local") != "Maison"))):
        store.append(rows.where(part), batch)
    return store.quantiles(spark, _PRICE_SPECS)


@query("stream_quantiles", _PRICES_SQL)
def stream_quantiles(spark, sf_dir):
    """The same from a stream of files, a batch per few files."""
    store = price_store(scratch_path(spark, "stream-prices"))
    run_price_stream(spark, _bronze_files(spark, sf_dir), store, max_files=2)
    return store.quantiles(spark, _PRICE_SPECS)


@query("sales_by_property_type", with_views("SELECT * FROM by_type", SALES_SQL, SILVER_SQL, _TYPE_SQL))
def sales_by_property_type(spark, sf_dir):
    return plan.by_property_type(silver(spark, sf_dir))


COMMUNE_SQL = f"""
sales_communes AS (
  SELECT code_commune AS commune_code, nom_commune AS commune_name, code_departement AS department_code,
         CAST(year AS BIGINT) AS year, count(*) AS sales_count, {_median("price_m2")} AS median_price_m2,
         {_median("surface_reelle_bati")} AS median_surface
  FROM silver GROUP BY ALL)"""


@query("sales_by_commune", with_views("SELECT * FROM sales_communes", SALES_SQL, SILVER_SQL, COMMUNE_SQL))
def sales_by_commune(spark, sf_dir):
    return plan.by_commune(silver(spark, sf_dir))


@query(
    "quantiles",
    f"""SELECT l_returnflag, l_linestatus, count(*) AS rows, {_median("l_extendedprice / l_quantity", "0.1")} AS d1,
               {_median("l_extendedprice / l_quantity")} AS median, {_median("l_extendedprice / l_quantity", "0.9")} AS d9
        FROM lineitem GROUP BY ALL""",
)
def quantiles(spark, sf_dir):
    """The binned plan, which never holds a group in one task."""
    priced = table(spark, sf_dir, "lineitem").withColumn("unit", F.col("l_extendedprice") / F.col("l_quantity"))
    return quantile_table(
        priced,
        ["l_returnflag", "l_linestatus"],
        {"unit": {"d1": 0.1, "median": 0.5, "d9": 0.9}},
        {"rows": F.count("*")},
    )


@query(
    "tolerant_year_union",
    with_views(
        """SELECT year, total_sales_count, median_price_m2, CASE WHEN year >= 2019 THEN d1_price_m2 END AS d1_price_m2
           FROM national WHERE year <> 2020""",
        SALES_SQL, SILVER_SQL, _NATIONAL_SQL,
    ),
)
def tolerant_year_union(spark, sf_dir):
    """Year folders where one year is absent and early years lack a column."""
    base = scratch_path(spark, "national-years")
    rows = _national(spark, sf_dir)
    sinks.write_years(rows.where((F.col("year") >= 2019) & (F.col("year") != 2020)), base)
    early = rows.where(F.col("year") < 2019).drop("d1_price_m2", "d9_price_m2")
    sinks.write_years(early, base)
    columns = ["total_sales_count", "median_price_m2", "d1_price_m2"]
    return readers.read_years(spark, base, columns, years=list(range(2014, 2025))).select("year", *columns)


@query(
    "sales_trend",
    with_views(
        "SELECT year, median_price_m2, d1_price_m2, d9_price_m2 FROM national WHERE median_price_m2 > 0",
        SALES_SQL, SILVER_SQL, _NATIONAL_SQL,
    ),
)
def sales_trend(spark, sf_dir):
    return plan.published_trend(_national(spark, sf_dir))


@query(
    "headline_kpis",
    with_views(
        """, c AS (SELECT year, count(DISTINCT department_code) AS covered FROM by_department GROUP BY year)
           SELECT year, 'median-price' AS metric, median_price_m2 AS value FROM national
           UNION ALL SELECT year, 'transactions', CAST(total_sales_count AS DOUBLE) FROM national
           UNION ALL SELECT year, 'median-surface', median_surface FROM national
           UNION ALL SELECT year, 'departments-covered', CAST(covered AS DOUBLE) FROM c""",
        SALES_SQL, SILVER_SQL, _NATIONAL_SQL, _DEPARTMENT_SQL,
    ),
)
def headline_kpis(spark, sf_dir):
    rows = silver(spark, sf_dir)
    return plan.headline_metrics(plan.national(rows), plan.by_department(rows))


def _documents(spark, sf_dir):
    return plan.summary_documents(silver(spark, sf_dir), "silver/sales", "2024-01-01T00:00:00+00:00")


_YEARS = ", ".join(map(str, cat.SALES_YEARS))
_DOCUMENT_SQL = with_views(
    f"""SELECT CAST(to_json({{
          year: n.year, available_years: [{_YEARS}], generated_at: '2024-01-01T00:00:00+00:00', source_file: 'silver/sales',
          filters: {{nature_mutation: 'Vente', property_types: ['Appartement', 'Maison'],
            outliers: {{price_m2_min: 300, price_m2_max: 50000, surface_min: 9, surface_max: 1000}}}},
          total_sales_count: total_sales_count, median_price_m2: n.median_price_m2, d1_price_m2: d1_price_m2,
          d9_price_m2: d9_price_m2, median_surface: median_surface, sales_count_by_department: counts,
          median_price_m2_by_department: medians, median_price_m2_by_property_type: types,
          departments: departments}}) AS VARCHAR) AS document
        FROM national n
        JOIN (SELECT year, map_from_entries(list((department_code, sales_count) ORDER BY department_code)) AS counts,
                     map_from_entries(list((department_code, median_price_m2) ORDER BY department_code)) AS medians,
                     list({{department_code: department_code, year: year, sales_count: sales_count,
                            median_price_m2: median_price_m2}} ORDER BY department_code) AS departments
              FROM by_department GROUP BY year) d ON d.year = n.year
        JOIN (SELECT year, map_from_entries(list((property_type, median_price_m2) ORDER BY property_type)) AS types
              FROM by_type GROUP BY year) t ON t.year = n.year""",
    SALES_SQL, SILVER_SQL, _NATIONAL_SQL, _DEPARTMENT_SQL, _TYPE_SQL,
)


@query("sales_summary_doc", _DOCUMENT_SQL)
def sales_summary_doc(spark, sf_dir):
    return _documents(spark, sf_dir)


@query("summary_json", _DOCUMENT_SQL)
def summary_json(spark, sf_dir):
    """The documents written as JSON lines and read back as text."""
    path = scratch_path(spark, "summary-json")
    sinks.write_documents(_documents(spark, sf_dir), path)
    return spark.read.text(path).withColumnRenamed("value", "document")


@query(
    "summary_json_scan",
    with_views(
        """SELECT d.year AS year, department_code, d.sales_count AS sales_count, d.median_price_m2 AS median_price_m2,
                  total_sales_count, n.median_price_m2 AS national_median, median_surface
           FROM by_department d JOIN national n ON d.year = n.year""",
        SALES_SQL, SILVER_SQL, _NATIONAL_SQL, _DEPARTMENT_SQL,
    ),
)
def summary_json_scan(spark, sf_dir):
    path = scratch_path(spark, "summary-scan")
    sinks.write_documents(_documents(spark, sf_dir), path)
    summaries = plan.read_summaries(spark, path)
    rows = F.inline(two_maps_to_rows(F.col("sales_count_by_department"), F.col("median_price_m2_by_department")))
    return summaries.select(
        "year", "total_sales_count", F.col("median_price_m2").alias("national_median"), "median_surface", rows
    ).select(
        "year", "department_code", "sales_count", "median_price_m2", "total_sales_count", "national_median",
        "median_surface",
    )


@query(
    "summary_layouts",
    with_views(
        """, counted AS (SELECT year, count(*) AS departments FROM by_department GROUP BY year),
           layouts AS (SELECT unnest([1, 2, 3]) AS layout)
           SELECT n.year AS year, total_sales_count, n.median_price_m2 AS median_price_m2, departments, TRUE AS readable
           FROM national n JOIN counted USING (year) CROSS JOIN layouts
           UNION ALL SELECT NULL, NULL, NULL, NULL, FALSE FROM national""",
        SALES_SQL, SILVER_SQL, _NATIONAL_SQL, _DEPARTMENT_SQL,
    ),
)
def summary_layouts(spark, sf_dir):
    """The summary documents on one line, indented, indented with camelCase keys, and cut off: all read alike but the last."""
    base = scratch_path(spark, "summary-layouts")
    sinks.write_documents(_documents(spark, sf_dir), f"{base}/line")
    line = F.col("value")
    indented = F.regexp_replace(line, r"([,{\[])", "$1\n  ")
    camel = indented
    for name in ("total_sales_count", "sales_count_by_department", "median_price_m2_by_department"):
        camel = F.replace(camel, F.lit(f'"{name}"'), F.lit(f'"{readers.camel(name).replace("PriceM2", "PricePerSquareMeter")}"'))
    cut = F.substring(indented, F.lit(1), (F.length(indented) / 2).cast("int"))
    documents = spark.read.text(f"{base}/line")
    for name, text in (("indented", indented), ("camel", camel), ("cut", cut)):
        documents.select(text.alias("value")).write.text(f"{base}/{name}")
    return plan.read_summaries(spark, f"{base}/*").select(
        "year", "total_sales_count", "median_price_m2",
        F.when(F.col("readable"), F.size("sales_count_by_department")).cast("long").alias("departments"), "readable",
    )


@query(
    "map_union_rows",
    with_views(
        """SELECT year, department_code, CASE WHEN sales_count >= 100 THEN sales_count ELSE 0 END AS sales_count,
                  CASE WHEN median_price_m2 < 1600 THEN median_price_m2 END AS median_price_m2
           FROM by_department WHERE sales_count >= 100 OR median_price_m2 < 1600""",
        SALES_SQL, SILVER_SQL, _DEPARTMENT_SQL,
    ),
)
def map_union_rows(spark, sf_dir):
    """Counts and medians as two maps with different keys, turned back into rows."""
    rows = plan.by_department(silver(spark, sf_dir))
    counts = F.when(F.col("sales_count") >= 100, F.struct("department_code", "sales_count"))
    medians = F.when(F.col("median_price_m2") < 1600, F.struct("department_code", "median_price_m2"))
    maps = rows.groupBy("year").agg(
        F.map_from_entries(F.collect_list(counts)).alias("counts"),
        F.map_from_entries(F.collect_list(medians)).alias("medians"),
    )
    return maps.select("year", F.inline(two_maps_to_rows(F.col("counts"), F.col("medians"))))


@query(
    "summary_maps",
    with_views(
        """SELECT year, department_code AS key, sales_count AS value,
                  row_number() OVER (PARTITION BY year ORDER BY department_code) AS position FROM by_department""",
        SALES_SQL, SILVER_SQL, _DEPARTMENT_SQL,
    ),
)
def summary_maps(spark, sf_dir):
    """Rows -> sorted map -> rows, keeping the key order."""
    summary = plan.summary_table(silver(spark, sf_dir), "silver/sales", "")
    entries = F.posexplode(F.map_entries("sales_count_by_department")).alias("at", "entry")
    return summary.select("year", entries).select(
        "year", F.col("entry.key").alias("key"), F.col("entry.value").alias("value"),
        (F.col("at") + 1).cast("long").alias("position"),
    )


@query(
    "focus_pick",
    with_views(
        """SELECT year, coalesce(max(CASE WHEN department_code = '07' THEN department_code END),
                     arg_max(department_code, sales_count * 1000 - CAST(department_code AS INTEGER))) AS department_code,
                  arg_max(department_code, sales_count * 1000 - CAST(department_code AS INTEGER)) AS top_department
           FROM by_department GROUP BY year""",
        SALES_SQL, SILVER_SQL, _DEPARTMENT_SQL,
    ),
)
def focus_pick(spark, sf_dir):
    from cadastrum.plans.publish import focus_department

    rows = plan.by_department(silver(spark, sf_dir))
    preferred = focus_department(rows, ["year"], default="07")
    top = focus_department(rows, ["year"], default=None).withColumnRenamed("department_code", "top_department")
    return preferred.join(top, "year")


@query(
    "minmax_scale",
    with_views(
        """, r AS (SELECT *, min(median_price_m2) OVER () AS lo, max(median_price_m2) OVER () AS hi FROM by_department)
           SELECT department_code, year, median_price_m2,
                  CASE WHEN hi = lo THEN NULL ELSE round_even((median_price_m2 - lo) / (hi - lo) * 1000000, 0) / 1000000 END
                    AS scaled,
                  CASE WHEN median_price_m2 IS NULL THEN 'missing' WHEN hi = lo THEN 'constant'
                       WHEN (median_price_m2 - lo) / (hi - lo) < 0.5 THEN 'lower' ELSE 'upper' END AS segment
           FROM r""",
        SALES_SQL, SILVER_SQL, _DEPARTMENT_SQL,
    ),
)
def minmax_scale(spark, sf_dir):
    from cadastrum.plans.publish import minmax_scale as scale

    rows = plan.by_department(silver(spark, sf_dir))
    scaled = scale(rows, "median_price_m2")
    return scaled.select(
        "department_code", "year", "median_price_m2", round_even("scaled", 6).alias("scaled"), "segment"
    )


@query(
    "geo_lookup",
    with_views(
        """SELECT lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS code, n_name AS name, CAST(y.year AS BIGINT) AS year,
                  median_price_m2 AS value, coalesce(sales_count, 0) AS sales_count
           FROM nation CROSS JOIN (SELECT DISTINCT year FROM by_department) y
           LEFT JOIN by_department d ON d.department_code = lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AND d.year = y.year""",
        SALES_SQL, SILVER_SQL, _DEPARTMENT_SQL,
    ),
)
def geo_lookup(spark, sf_dir):
    from cadastrum.plans.publish import values_on_geographies

    rows = plan.by_department(silver(spark, sf_dir))
    code = F.lpad(F.col("n_nationkey").cast("string"), 2, "0")
    areas = table(spark, sf_dir, "nation").select(code.alias("code"), F.col("n_name").alias("name"))
    return values_on_geographies(areas, rows)
