"""Queries of the column functions and of header and text handling."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastrum.functions import (
    blank_to_null,
    department_of,
    display_boolean,
    display_date,
    display_number,
    display_text,
    fold_snake,
    like_any,
    preview_value,
)
from cadastrum.operators.filters import any_column_contains, matches, where_matches
from cadastrum.operators.shape import first_per_key, promote_header
from cadastrum.plans import publish
from cadastrum.registry.base import query, table
from cadastrum.schemas import INCOME_GOLD, INDICATORS, conform
from cadastrum.session import scratch_path
from cadastrum.sources import readers
from cadastrum.text_constants import MOJIBAKE, PHRASES, UNACCENTED_WORDS


@query(
    "fold_snake",
    """SELECT doc_id, trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', '_', 'g'), '_') AS folded
       FROM documents""",
)
def fold_snake_query(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fold_snake("text").alias("folded"))


# Documents are damaged on both sides in the same way before the repair.
_DAMAGE = (("é", "Ã©"), ("è", "Ã¨"), ("ê", "Ãª"), ("ç", "Ã§"), (" la ", " numero fonciere "), (" the ", " Annee bati "))


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _repair_sql() -> str:
    text = "text"
    for plain, damaged in _DAMAGE:
        text = f"replace({text}, {_sql_text(plain)}, {_sql_text(damaged)})"
    for damaged, plain in MOJIBAKE:
        text = f"replace({text}, {_sql_text(damaged)}, {_sql_text(plain)})"
    for word, accented in (*UNACCENTED_WORDS, *PHRASES):
        text = f"regexp_replace({text}, '\\b{word}\\b', {_sql_text(accented)}, 'gi')"
    return f"SELECT doc_id, {text} AS repaired FROM documents"


@query("text_repair", _repair_sql())
def text_repair(spark, sf_dir):
    damaged = F.col("text")
    for plain, broken in _DAMAGE:
        damaged = F.replace(damaged, F.lit(plain), F.lit(broken))
    return table(spark, sf_dir, "documents").select("doc_id", preview_value(damaged).alias("repaired"))


@query(
    "text_normalise",
    """SELECT doc_id, nullif(trim(source), '') AS source, nullif(upper(trim(CASE WHEN lang = 'fr' THEN '  ' ELSE lang END)), '')
         AS lang FROM documents""",
)
def text_normalise(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    lang = F.when(F.col("lang") == "fr", "  ").otherwise(F.concat(F.lit(" "), F.col("lang")))
    return documents.select(
        "doc_id", blank_to_null(F.col("source")).alias("source"), blank_to_null(lang, upper=True).alias("lang")
    )


@query(
    "department_code",
    """SELECT code, CASE WHEN code LIKE '97%' OR code LIKE '98%' THEN substr(code, 1, 3) ELSE substr(code, 1, 2) END
         AS department, count(*) AS rows
       FROM (SELECT lpad(CAST(o_custkey * 61 % 100000 AS VARCHAR), 5, '0') AS code FROM orders) GROUP BY ALL""",
)
def department_code(spark, sf_dir):
    code = F.lpad((F.col("o_custkey") * 61 % 100000).cast("string"), 5, "0").alias("code")
    coded = table(spark, sf_dir, "orders").select(code)
    return coded.groupBy("code", department_of("code").alias("department")).agg(F.count("*").alias("rows"))


@query(
    "conform_schema",
    "SELECT CAST(c_custkey AS VARCHAR) AS geography_code, nullif(trim(c_name), '') AS geography_name, "
    "CAST(NULL AS VARCHAR) AS geography_level, CAST(c_nationkey AS BIGINT) AS year, CAST(NULL AS VARCHAR) AS dispositif, "
    "CAST(NULL AS VARCHAR) AS source_generation, CAST(NULL AS VARCHAR) AS indicator_source, "
    "c_acctbal > 0 AS is_official, CAST(NULL AS VARCHAR) AS methodology_version, "
    "CAST(NULL AS BOOLEAN) AS comparable_with_previous_years, c_acctbal AS median_income, "
    + ", ".join(f"CAST(NULL AS DOUBLE) AS {name}" for name in INDICATORS[1:])
    + " FROM customer",
)
def conform_schema(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_acctbal").cast("string").alias("median_income"),
        F.concat(F.lit(" "), "c_name").alias("geography_name"),
        F.col("c_custkey").alias("geography_code"),
        F.col("c_nationkey").cast("string").alias("year"),
        (F.col("c_acctbal") > 0).alias("is_official"),
        F.col("c_mktsegment").alias("dropped"),
    )
    return conform(customers, INCOME_GOLD)


_LINEAGE_NAMES = {"F": "meta_Disp_COM", "O": "disp_dep", "P": "FR_region"}


@query(
    "lineage_level",
    """SELECT CASE WHEN o_orderstatus = 'F' THEN 'meta_Disp_COM.csv' WHEN o_orderstatus = 'O' THEN 'disp_dep.csv'
                   WHEN o_orderstatus = 'P' THEN 'FR_region.csv' ELSE 'rest.csv' END AS source_file,
              CASE WHEN o_orderstatus = 'F' THEN 'commune' WHEN o_orderstatus = 'O' THEN 'department'
                   WHEN o_orderstatus = 'P' THEN 'region' ELSE 'unknown' END AS geography_level,
              CASE WHEN o_orderstatus = 'F' THEN 'metadata' ELSE 'data' END AS file_role,
              count(*) AS rows
       FROM orders GROUP BY ALL""",
)
def lineage_level(spark, sf_dir):
    """Orders of every status written under four file names; level and role come from the file read."""
    from cadastrum.plans.income import add_file_lineage

    name = F.lit("rest")
    for status, file in _LINEAGE_NAMES.items():
        name = F.when(F.col("o_orderstatus") == status, file).otherwise(name)
    base = scratch_path(spark, "lineage")
    # One folder per file name; the folder takes the role of the file.
    table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("value"), name.alias("file")).write.partitionBy(
        "file"
    ).text(base)
    lines = spark.read.text(base).select(
        "value", F.concat(F.regexp_extract(F.col("_metadata.file_path"), "/file=([^/]*)/", 1), F.lit(".csv")).alias("read_from")
    )
    rows = add_file_lineage(lines, F.col("read_from"), 2018, "data_gouv", "disp_com")
    return rows.groupBy("source_file", "geography_level", "file_role").agg(F.count("*").alias("rows"))


_DISPLAY_NUMBER = (
    "replace(replace(regexp_replace(regexp_replace(format('{:,.2f}', l_extendedprice), '0+$', ''), '[.]$', ''),"
    " ',', chr(8239)), '.', ',')"
)


@query(
    "display_format",
    f"""SELECT l_orderkey, l_linenumber, {_DISPLAY_NUMBER} AS price,
               CASE WHEN l_tax = 0 THEN '—' WHEN l_tax > 0.04 THEN 'Oui' ELSE 'Non' END AS taxed,
               strftime(l_shipdate, '%d-%m-%Y') AS iso_day,
               CASE WHEN l_returnflag = 'N' THEN '—' ELSE strftime(l_shipdate, '%d-%m-%Y') END AS french_day,
               CASE WHEN l_linestatus = 'O' THEN '—' ELSE l_linestatus END AS status
        FROM lineitem""",
)
def display_format(spark, sf_dir):
    french_day = F.when(F.col("l_returnflag") != "N", F.date_format("l_shipdate", "dd/MM/yyyy"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        display_number(F.col("l_extendedprice")).alias("price"),
        display_boolean(F.when(F.col("l_tax") > 0, F.col("l_tax") > 0.04)).alias("taxed"),
        display_date(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("iso_day"),
        display_date(french_day).alias("french_day"),
        display_text(F.when(F.col("l_linestatus") == "O", "").otherwise(F.col("l_linestatus"))).alias("status"),
    )


@query(
    "search_like",
    r"""SELECT p_partkey, p_name, p_type FROM part
        WHERE lower(coalesce(p_name, '')) LIKE lower('%S_all%') OR lower(coalesce(p_type, '')) LIKE lower('%S_all%')""",
)
def search_like(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.where(like_any(["p_name", "p_type"], " S_all ")).select("p_partkey", "p_name", "p_type")


@query(
    "typed_filters",
    """SELECT o_orderkey, o_totalprice, o_orderstatus, day FROM (
         SELECT *, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%d/%m/%Y')
                        WHEN o_orderstatus = 'P' THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day
         FROM orders)
       WHERE o_totalprice BETWEEN 1500.5 AND 300000 AND o_orderstatus <> 'P'
         AND o_orderdate >= TIMESTAMP '1996-02-01' AND o_orderdate <= TIMESTAMP '2000-12-31'
         AND contains(lower(o_orderpriority), 'high') AND o_custkey % 2 = 0""",
)
def typed_filters(spark, sf_dir):
    day = (
        F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "dd/MM/yyyy"))
        .when(F.col("o_orderstatus") == "P", "unknown")
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    )
    orders = table(spark, sf_dir, "orders").withColumn("day", day)
    orders = orders.withColumn("even", F.when(F.col("o_custkey") % 2 == 0, "Oui").otherwise("faux"))
    orders = orders.withColumn("price_text", F.translate(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), ".", ","))
    typed = where_matches(orders, "o_totalprice", "number-range", minimum="1500,5")
    typed = where_matches(typed, "o_orderdate", "date-range", start="01/02/1996")
    return typed.where(
        matches("price_text", "number-range", maximum="300000")
        & matches("day", "date-range", end="31/12/2000")
        & matches("even", "boolean-select", boolean="true")
        & matches("o_orderpriority", "text", text=" HIGH ")
    ).select("o_orderkey", "o_totalprice", "o_orderstatus", "day")


@query(
    "any_column_search",
    """SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE contains(CAST(s_suppkey AS VARCHAR), '12')
         OR contains(lower(s_name), '12') OR contains(CAST(s_nationkey AS VARCHAR), '12')""",
)
def any_column_search(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return suppliers.where(any_column_contains(suppliers.columns, "12"))


@query(
    "first_per_key",
    """SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus FROM orders
       QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""",
)
def first_per_key_query(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate")
    return first_per_key(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(
    "left_enrich",
    """, side AS (SELECT l_orderkey, l_discount AS rate FROM lineitem
                  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) = 1)
       SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END, rate) AS value
       FROM o LEFT JOIN side ON o_orderkey = l_orderkey""".replace(", side", "WITH o AS (SELECT * FROM orders), side", 1),
)
def left_enrich(spark, sf_dir):
    """Fill a value from the first row per key of a second table."""
    from cadastrum.plans.income import fill_from

    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("value")
    )
    side = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_discount").alias("rate"),
        "l_linenumber", "l_partkey", "l_suppkey",
    )
    return fill_from(orders, side, ["o_orderkey"], "value", "rate", ["l_linenumber", "l_partkey", "l_suppkey"])


_GRID_SQL = """
WITH data AS (
  SELECT o_orderpriority AS table_id, o_orderkey + 10 AS row_idx,
         CASE WHEN o_orderstatus = 'P' THEN ' ' ELSE CAST(o_custkey AS VARCHAR) END AS code,
         CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS amount, o_orderstatus AS status FROM orders)
SELECT table_id, row_idx, code AS codgeo, amount AS med18, CASE WHEN status = 'O' THEN '' ELSE status END AS med18_2,
       CASE WHEN status = 'O' THEN '' ELSE 'x' END AS libelle, '' AS column_5
FROM data WHERE trim(code) <> ''"""


@query("promote_header", _GRID_SQL)
def promote_header_query(spark, sf_dir):
    """Five sheets with a title row, a label row, a header row and data rows."""
    orders = table(spark, sf_dir, "orders")
    code = F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_custkey").cast("string"))
    amount = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    short = F.array(code, amount)
    full = F.array(code, amount, F.col("o_orderstatus"), F.lit("x"), F.lit(""), F.lit("cut off"))
    data = orders.select(
        F.col("o_orderpriority").alias("table_id"), (F.col("o_orderkey") + 10).alias("row_idx"),
        F.when(F.col("o_orderstatus") == "O", short).otherwise(full).alias("cells"),
    )

    def sheet_row(index: int, *cells: str):
        return F.struct(F.lit(index).cast("long").alias("row_idx"), F.array(*map(F.lit, cells)).alias("cells"))

    top = F.array(
        sheet_row(1, "Titre"),
        sheet_row(2, "Code", "Médiane", "Médiane", "Libelle", ""),
        sheet_row(3, "CODGEO", "MED18", "med18 ", "", ""),
    )
    head = data.select("table_id").distinct().select("table_id", F.inline(top))
    records = promote_header(head.unionByName(data))
    names = ["codgeo", "med18", "med18_2", "libelle", "column_5"]
    return records.select("table_id", "row_idx", *[F.col("record")[name].alias(name) for name in names])


@query(
    "union_by_name",
    """SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS balance FROM customer
       UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier""",
)
def union_by_name(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("key")
    )
    return customers.unionByName(suppliers, allowMissingColumns=True)


@query(
    "polygon_bbox",
    """SELECT c_custkey AS feature, CASE WHEN c_acctbal < 5000 THEN w ELSE least(w, w - 3) END AS min_longitude, e AS max_longitude,
              CASE WHEN c_acctbal < 5000 THEN s ELSE least(s, s - 2) END AS min_latitude, n AS max_latitude,
              (CASE WHEN c_acctbal < 5000 THEN w ELSE w - 3 END + e) / 2 AS centre_longitude,
              (CASE WHEN c_acctbal < 5000 THEN s ELSE s - 2 END + n) / 2 AS centre_latitude
       FROM (SELECT c_custkey, c_acctbal, CAST(c_nationkey AS DOUBLE) AS w, c_nationkey + c_acctbal / 1000 + 1 AS e,
                    CAST(c_custkey AS DOUBLE) AS s, CAST(c_custkey + 2.5 AS DOUBLE) AS n FROM customer WHERE c_acctbal >= 0
             UNION ALL SELECT c_custkey, c_acctbal, c_nationkey + c_acctbal / 1000 + 1, CAST(c_nationkey AS DOUBLE) + 1,
                    c_custkey, CAST(c_custkey + 2.5 AS DOUBLE) FROM customer WHERE c_acctbal < 0)""",
)
def polygon_bbox(spark, sf_dir):
    """One box-shaped feature per customer; rich ones have a second, shifted polygon."""
    nation, key = F.col("c_nationkey").cast("double"), F.col("c_custkey").cast("double")
    far = F.col("c_nationkey") + F.col("c_acctbal") / 1000 + 1
    west, east = F.when(F.col("c_acctbal") >= 0, nation).otherwise(far), F.when(F.col("c_acctbal") >= 0, far).otherwise(nation + 1)
    south, north = key, key + 2.5

    def ring(dx: float, dy: float):
        corners = ((west, south), (east, south), (east, north), (west, north), (west, south))
        return F.array(*[F.array(x - dx, y - dy) for x, y in corners])

    one = F.array(F.array(ring(0, 0)))
    two = F.array(F.array(ring(0, 0)), F.array(ring(3, 2)))
    features = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("feature"), F.when(F.col("c_acctbal") < 5000, one).otherwise(two).alias("coordinates")
    )
    return publish.polygon_bounds(features)


@query(
    "dense_years",
    """, present AS (SELECT DISTINCT year(o_orderdate) AS year FROM orders WHERE year(o_orderdate) NOT IN (1997, 1999))
       SELECT year, year NOT IN (SELECT year FROM present) AS missing
       FROM (SELECT unnest(range((SELECT min(year) FROM present), (SELECT max(year) FROM present) + 1)) AS year)""".replace(
        ", present", "WITH present", 1
    ),
)
def dense_years_query(spark, sf_dir):
    from cadastrum.operators.shape import dense_years

    years = table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("long").alias("year"))
    return dense_years(years.where(~F.col("year").isin(1997, 1999)))


@query(
    "latest_year",
    """SELECT o_custkey, coalesce(max(CASE WHEN o_orderstatus = 'F' THEN year(o_orderdate) END), max(year(o_orderdate)))
         AS latest_year FROM orders GROUP BY o_custkey""",
)
def latest_year(spark, sf_dir):
    years = table(spark, sf_dir, "orders").select(
        "o_custkey", F.year("o_orderdate").cast("long").alias("year"), (F.col("o_orderstatus") == "F").alias("available")
    )
    return publish.latest_year(years, ["o_custkey"], "available")
