"""Sales and income tables derived from the given test tables.

Each view exists twice: as a DataFrame and as the SQL text of the same rows.
Only narrow projections, equi-joins on keys and map-side combinable aggregates
are used, so the views grow with the tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastrum.functions import department_of
from cadastrum.registry.base import table
from cadastrum.schemas import INDICATORS

# Order years 1995-2001 stand for 2017-2023.
YEAR_SHIFT = 22


def _year(column: str):
    return (F.year(column) + YEAR_SHIFT).cast("long")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Property sales with typed numbers: order lines located by their supplier."""
    lines = table(spark, sf_dir, "lineitem")
    suppliers = table(spark, sf_dir, "supplier")
    department = F.when(F.col("s_nationkey") == 24, "").otherwise(F.lpad(F.col("s_nationkey").cast("string"), 2, "0"))
    return lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.when(F.col("l_linestatus") == "F", "Vente").otherwise("Echange").alias("nature_mutation"),
        F.when(F.col("l_returnflag") == "A", "Appartement")
        .when(F.col("l_returnflag") == "R", "Maison")
        .otherwise("Dépendance")
        .alias("type_local"),
        F.when(F.col("l_discount") < 0.1, F.col("l_extendedprice")).alias("valeur_fonciere"),
        F.col("l_quantity").alias("surface_reelle_bati"),
        F.col("l_linenumber").cast("double").alias("nombre_pieces_principales"),
        F.when(F.col("l_tax") > 0, F.rint(F.col("l_tax") * 100)).alias("surface_terrain"),
        F.lit(None).cast("double").alias("longitude"),
        F.lit(None).cast("double").alias("latitude"),
        department.alias("code_departement"),
        F.concat(department, F.lpad((F.col("s_suppkey") % 100).cast("string"), 3, "0")).alias("code_commune"),
        F.col("s_name").alias("nom_commune"),
        _year("l_shipdate").alias("year"),
    )


SALES_SQL = f"""
sales AS (
  SELECT CASE WHEN l_linestatus = 'F' THEN 'Vente' ELSE 'Echange' END AS nature_mutation,
         CASE l_returnflag WHEN 'A' THEN 'Appartement' WHEN 'R' THEN 'Maison' ELSE 'Dépendance' END AS type_local,
         CASE WHEN l_discount < 0.1 THEN l_extendedprice END AS valeur_fonciere,
         l_quantity AS surface_reelle_bati,
         CAST(l_linenumber AS DOUBLE) AS nombre_pieces_principales,
         CASE WHEN l_tax > 0 THEN round_even(l_tax * 100, 0) END AS surface_terrain,
         CAST(NULL AS DOUBLE) AS longitude, CAST(NULL AS DOUBLE) AS latitude,
         department AS code_departement,
         department || lpad(CAST(s_suppkey % 100 AS VARCHAR), 3, '0') AS code_commune,
         s_name AS nom_commune,
         year(l_shipdate) + {YEAR_SHIFT} AS year
  FROM lineitem
  JOIN (SELECT *, CASE WHEN s_nationkey = 24 THEN '' ELSE lpad(CAST(s_nationkey AS VARCHAR), 2, '0') END AS department
        FROM supplier) ON l_suppkey = s_suppkey)"""

SILVER_SQL = """
silver AS (
  SELECT *, valeur_fonciere / surface_reelle_bati AS price_m2 FROM sales
  WHERE trim(nature_mutation) = 'Vente' AND trim(type_local) IN ('Maison', 'Appartement')
    AND valeur_fonciere > 0 AND surface_reelle_bati > 0 AND trim(code_departement) <> ''
    AND valeur_fonciere / surface_reelle_bati BETWEEN 300 AND 50000 AND surface_reelle_bati BETWEEN 9 AND 1000)"""


def french(column: str):
    """Two-decimal French number text, blank when null."""
    text = F.translate(F.col(column).cast("decimal(18,2)").cast("string"), ".", ",")
    return F.coalesce(text, F.lit(""))


def raw_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sales as a legacy text file would give them: French headers and numbers."""
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    rows = sales(spark, sf_dir).withColumnRenamed("nom_commune", "s_name")
    short = F.substring("code_commune", -3, 3)
    return rows.select(
        F.col("nature_mutation").alias("Nature mutation"),
        F.col("type_local").alias("Type local"),
        french("valeur_fonciere").alias("Valeur foncière"),
        french("surface_reelle_bati").alias("Surface réelle bâti"),
        french("nombre_pieces_principales").alias("Nombre pièces principales"),
        french("surface_terrain").alias("Surface terrain"),
        F.col("code_departement").alias("Département"),
        F.concat(F.lit(" "), F.regexp_replace(short, "^0+(?=.)", "")).alias("Code commune"),
        F.concat(F.lit(" "), F.col("s_name"), F.lit(" ")).alias("Commune"),
        "year",
    )


_FR = "coalesce(replace(CAST(CAST({0} AS DECIMAL(18,2)) AS VARCHAR), '.', ','), '')"
BRONZE_SQL = f"""
bronze AS (
  SELECT nature_mutation, type_local,
         {_FR.format("valeur_fonciere")} AS valeur_fonciere,
         {_FR.format("surface_reelle_bati")} AS surface_reelle_bati,
         {_FR.format("nombre_pieces_principales")} AS nombre_pieces_principales,
         {_FR.format("surface_terrain")} AS surface_terrain,
         '' AS longitude, '' AS latitude, code_departement, code_commune, nom_commune, year
  FROM sales)"""


def _income_rows(groups: DataFrame) -> DataFrame:
    """Indicator values of the grouped orders; some are missing for some years."""
    year, low, high = F.col("year"), F.col("low"), F.col("high")

    def step(k: int):
        return F.floor(low + (high - low) * F.lit(k) / F.lit(10)).cast("double")

    values = {f"d{k}_income": step(k) for k in range(1, 10) if k != 5}
    values["d1_income"] = F.when(year != 2019, step(1))
    values["d9_income"] = F.when((year != 2017) | (F.col("geography_level") == "department"), step(9))
    values["median_income"] = F.floor((low + high) / 2).cast("double")
    values["d5_income"] = F.when(year != 2018, values["median_income"])
    values["poverty_rate"] = F.when(
        F.col("n") > 1, F.floor(F.lit(1000.0) * F.col("f") / F.col("n")).cast("double") / 10
    )
    values["tax_households"] = F.when(year < 2021, F.col("n").cast("double"))
    values["population"] = F.when(year < 2023, (F.col("n") + F.col("k")).cast("double"))
    return groups.select(
        "commune_code", "commune_name", "department_code", "geography_level",
        *[values[name].alias(name) for name in INDICATORS], "year",
    )


def income_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local income rows: orders by commune for all years, by department for two."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    year = _year("o_orderdate")
    placed = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias("department_code"),
        F.lpad((F.col("c_custkey") % 100).cast("string"), 3, "0").alias("number"),
        F.when(year == 2022, 2023).otherwise(year).cast("long").alias("year"),
        "o_totalprice", "o_orderstatus", "o_custkey",
    )

    def grouped(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys, "year").agg(
            F.count("*").alias("n"),
            F.min("o_totalprice").alias("low"),
            F.max("o_totalprice").alias("high"),
            F.count_if(F.col("o_orderstatus") == "F").alias("f"),
            F.sum(F.col("o_custkey") % 5).alias("k"),
        )

    communes = grouped(placed, "department_code", "number").select(
        F.concat("department_code", "number").alias("commune_code"),
        F.when(F.col("number").endswith("7"), "").otherwise(F.concat(F.lit("Commune "), "number")).alias("commune_name"),
        "department_code", F.lit("commune").alias("geography_level"), "year", "n", "low", "high", "f", "k",
    )
    departments = grouped(placed.where(F.col("year").isin(2017, 2023)), "department_code").select(
        F.lit("").alias("commune_code"), F.lit("").alias("commune_name"),
        "department_code", F.lit("department").alias("geography_level"), "year", "n", "low", "high", "f", "k",
    )
    return _income_rows(communes.unionByName(departments))


def _income_sql() -> str:
    def step(k: int) -> str:
        return f"floor(low + (high - low) * {k} / 10)"

    values = {f"d{k}_income": step(k) for k in range(1, 10) if k != 5}
    values["d1_income"] = f"CASE WHEN year <> 2019 THEN {step(1)} END"
    values["d9_income"] = f"CASE WHEN year <> 2017 OR geography_level = 'department' THEN {step(9)} END"
    values["median_income"] = "floor((low + high) / 2)"
    values["d5_income"] = "CASE WHEN year <> 2018 THEN floor((low + high) / 2) END"
    values["poverty_rate"] = "CASE WHEN n > 1 THEN floor(CAST(1000 AS DOUBLE) * f / n) / 10 END"
    values["tax_households"] = "CASE WHEN year < 2021 THEN CAST(n AS DOUBLE) END"
    values["population"] = "CASE WHEN year < 2023 THEN CAST(n + k AS DOUBLE) END"
    columns = ", ".join(f"{values[name]} AS {name}" for name in INDICATORS)
    return f"""
placed AS (
  SELECT lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS department_code,
         lpad(CAST(c_custkey % 100 AS VARCHAR), 3, '0') AS number,
         CASE WHEN year(o_orderdate) = 2000 THEN 2023 ELSE year(o_orderdate) + {YEAR_SHIFT} END AS year,
         o_totalprice, o_orderstatus, o_custkey
  FROM orders JOIN customer ON o_custkey = c_custkey),
income_groups AS (
  SELECT department_code || number AS commune_code,
         CASE WHEN number LIKE '%7' THEN '' ELSE 'Commune ' || number END AS commune_name,
         department_code, 'commune' AS geography_level, year, count(*) AS n, min(o_totalprice) AS low,
         max(o_totalprice) AS high, count(*) FILTER (o_orderstatus = 'F') AS f, CAST(sum(o_custkey % 5) AS BIGINT) AS k
  FROM placed GROUP BY department_code, number, year
  UNION ALL
  SELECT '', '', department_code, 'department', year, count(*), min(o_totalprice), max(o_totalprice),
         count(*) FILTER (o_orderstatus = 'F'), CAST(sum(o_custkey % 5) AS BIGINT)
  FROM placed WHERE year IN (2017, 2023) GROUP BY department_code, year),
income_silver AS (
  SELECT commune_code, commune_name, department_code, geography_level, {columns}, year FROM income_groups)"""


INCOME_SQL = _income_sql()


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long observations: events as (measure, geography, object, period, text value)."""
    events = table(spark, sf_dir, "events")
    measure = reduce(
        lambda rest, pair: F.when(F.col("event_type") == pair[0], pair[1]).otherwise(rest),
        [("view", "MED_SL"), ("click", "D1_SL"), ("purchase", "D9_SL"), ("signup", "PR_MD60")],
        F.lit("OTHER"),
    )
    user = F.lpad(F.col("user_id").cast("string"), 5, "0")
    hour = F.hour("ts")
    return events.select(
        "event_id",
        measure.alias("FILOSOFI_MEASURE"),
        user.alias("GEO"),
        F.when(hour < 12, "COM").when(hour < 20, "DEP").otherwise("IRIS").alias("GEO_OBJECT"),
        F.when(F.minute("ts") == 0, "n.d.").otherwise(F.date_format("ts", "yyyy")).alias("TIME_PERIOD"),
        F.when(F.col("value") < 1, "s").otherwise(french("value")).alias("OBS_VALUE"),
    )


OBSERVATIONS_SQL = f"""
observations AS (
  SELECT event_id,
         CASE event_type WHEN 'view' THEN 'MED_SL' WHEN 'click' THEN 'D1_SL' WHEN 'purchase' THEN 'D9_SL'
                         WHEN 'signup' THEN 'PR_MD60' ELSE 'OTHER' END AS measure,
         lpad(CAST(user_id AS VARCHAR), 5, '0') AS geo,
         CASE WHEN hour(ts) < 12 THEN 'COM' WHEN hour(ts) < 20 THEN 'DEP' ELSE 'IRIS' END AS geo_object,
         CASE WHEN minute(ts) = 0 THEN 'n.d.' ELSE CAST(year(ts) AS VARCHAR) END AS period,
         CASE WHEN value < 1 THEN 's' ELSE {_FR.format("value")} END AS obs_value
  FROM events)"""


def with_views(body: str, *views: str) -> str:
    """SQL text with the named view definitions in front."""
    return "WITH " + ",".join(views) + "\n" + body
