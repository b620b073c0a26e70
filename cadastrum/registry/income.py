"""Income queries: harmonisation, weighted statistics, derived rows, availability."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastrum import catalogue as cat
from cadastrum.functions import round_even
from cadastrum.operators.quantiles import weighted_mean_of, weighted_median, with_table_weight
from cadastrum.plans import income as plan
from cadastrum.plans.layers import income_layers
from cadastrum.registry import standins
from cadastrum.registry.base import query, table
from cadastrum.registry.standins import INCOME_SQL, OBSERVATIONS_SQL, with_views
from cadastrum.schemas import INCOME_GOLD, INDICATORS
from cadastrum.session import materialise, scratch_path
from cadastrum.sources import readers, sinks

_ALL = ", ".join(INDICATORS)
GOLD_COLUMNS = ", ".join(INCOME_GOLD.fieldNames())


def _published(column: str, value: str) -> str:
    years = ", ".join(str(y) for y in cat.PUBLISHED_COLUMNS[column]) or "NULL"
    return f"CASE WHEN s.year IN ({years}) THEN {value} END AS {column}"


def _catalogue_sql() -> str:
    rows = []
    for year, source in cat.INCOME_CATALOGUE["sources"].items():
        rows.append(
            f"({year}, '{source['dispositif']}', '{source['source_generation']}',"
            f" {source['comparable_with_previous_years']}, {source['secondary_deciles_comparable_with_previous_years']},"
            f" {source.get('methodological_break', False)})"
        )
    names = "year, dispositif, source_generation, comparable, secondary, methodological_break"
    return f"catalogue AS (SELECT * FROM (VALUES {', '.join(rows)}) AS t({names}))"


GOLD_SQL = f"""{_catalogue_sql()},
gold AS (
  SELECT CASE WHEN geography_level = 'commune' THEN commune_code ELSE department_code END AS geography_code,
         CASE WHEN s.year IN (2018, 2019, 2020, 2021) THEN nullif(trim(commune_name), '') END AS geography_name,
         geography_level, s.year AS year, dispositif, source_generation, 'official_insee' AS indicator_source,
         TRUE AS is_official,
         CASE WHEN dispositif = 'filosofi2' THEN 'filosofi_v2' ELSE 'filosofi_v1' END AS methodology_version,
         comparable AND NOT methodological_break AND geography_level = 'commune' AS comparable_with_previous_years,
         {", ".join(_published(c, c) for c in INDICATORS)}
  FROM income_silver s JOIN catalogue USING (year)),
communes AS (SELECT * FROM gold WHERE geography_level = 'commune'),
weights AS (
  SELECT communes.*, substr(geography_code, 1, 2) AS department_code,
         CASE WHEN any_h THEN tax_households WHEN any_p THEN population ELSE 1 END AS weight,
         CASE WHEN any_h THEN 'tax_households' WHEN any_p THEN 'population' END AS weight_source
  FROM communes JOIN (SELECT year, count(tax_households) > 0 AS any_h, count(population) > 0 AS any_p
                      FROM communes GROUP BY year) USING (year)),
commune_long AS (
  UNPIVOT (SELECT year, department_code, weight, {", ".join(f"{c} AS {c}" for c in INDICATORS)} FROM weights)
  ON {_ALL} INTO NAME indicator VALUE value)"""


def _weighted_median_sql(source: str, keys: str, name: str = "value", weight: str = "weight") -> str:
    """SQL text of the weighted median per key over a long table."""
    return f"""SELECT {keys}, min(v) AS {name} FROM (
      SELECT {keys}, value AS v, sum({weight}) OVER (PARTITION BY {keys} ORDER BY value) AS upto,
             sum({weight}) OVER (PARTITION BY {keys}) AS total
      FROM {source} WHERE value IS NOT NULL AND {weight} > 0) WHERE upto >= total / 2 GROUP BY {keys}"""


def _case(indicator: str) -> str:
    return f"max(CASE WHEN indicator = '{indicator}' THEN value END) AS {indicator}"


DEPARTMENTS_SQL = f"""
derived_values AS ({_weighted_median_sql("commune_long", "year, department_code, indicator")}),
derived_poverty AS (
  SELECT year, department_code, sum(poverty_rate * weight) / sum(CASE WHEN poverty_rate IS NOT NULL THEN weight END) AS p
  FROM weights WHERE weight > 0 GROUP BY year, department_code),
derived AS (
  SELECT department_code AS geography_code, CAST(NULL AS VARCHAR) AS geography_name, 'department' AS geography_level, year,
         any_value(dispositif) AS dispositif, 'historical' AS source_generation,
         'derived_from_communes' AS indicator_source, FALSE AS is_official,
         'derived_from_filosofi_v1' AS methodology_version, FALSE AS comparable_with_previous_years,
         {", ".join(_case(c) if c != "poverty_rate" else "any_value(p) AS poverty_rate" for c in INDICATORS)}
  FROM (SELECT DISTINCT year, department_code, dispositif FROM weights)
  LEFT JOIN derived_values USING (year, department_code) LEFT JOIN derived_poverty USING (year, department_code)
  GROUP BY department_code, year),
departments AS (
  SELECT * FROM gold WHERE geography_level = 'department'
  UNION ALL BY NAME SELECT * FROM derived WHERE year NOT IN (SELECT year FROM gold WHERE geography_level = 'department')),
all_gold AS (SELECT * FROM communes UNION ALL BY NAME SELECT * FROM departments)"""


def gold(spark, sf_dir):
    return plan.harmonise(standins.income_silver(spark, sf_dir))


def communes(spark, sf_dir):
    rows = materialise(gold(spark, sf_dir), "income-gold")
    return rows.where(F.col("geography_level") == "commune")


def layers(spark, sf_dir):
    """Gold communes and departments, each written once for the steps after it."""
    return income_layers(gold(spark, sf_dir))


def all_gold(spark, sf_dir):
    commune_rows, department_rows = layers(spark, sf_dir)
    return commune_rows.unionByName(department_rows)


def _rounded(rows, *columns):
    return rows.withColumns({c: round_even(c, 9) for c in columns})


def rounded_sql(names: str) -> str:
    return names.replace("poverty_rate", "round_even(poverty_rate * 1000000000, 0) / 1000000000 AS poverty_rate")


_FR_INDICATORS = ", ".join(INDICATORS)


@query(
    "detect_columns",
    with_views(
        f"""SELECT commune_code, trim(commune_name) AS commune_name, department_code, {_FR_INDICATORS}, year
            FROM income_silver WHERE geography_level = 'commune'""".replace(
            "d5_income", "CASE WHEN year = 2018 THEN median_income ELSE d5_income END AS d5_income"
        ),
        INCOME_SQL,
    ),
)
def detect_columns(spark, sf_dir):
    """Commune rows under their published source names, brought back by detection."""
    raw = _source_named(standins.income_silver(spark, sf_dir).where(F.col("geography_level") == "commune"))
    standard = plan.standard_rows(plan.fold_columns(raw), "commune", F.col("year"))
    return standard.select("commune_code", "commune_name", "department_code", *INDICATORS, "year")


def _source_named(rows):
    """Silver rows under published source names, numbers in French writing."""
    names = {c: cat.PUBLISHED_COLUMNS[c].get(2018, "D518") for c in INDICATORS}
    return rows.select(
        F.col("commune_code").alias("CODGEO"),
        F.concat(F.lit(" "), "commune_name").alias("LIBGEO"),
        *[F.translate(F.col(c).cast("string"), ".", ",").alias(source) for c, source in names.items()],
        "year",
    )


@query(
    "legacy_silver",
    with_views(
        f"""SELECT commune_code, trim(commune_name) AS commune_name, department_code, 'commune' AS geography_level,
                   CAST(2019 AS BIGINT) AS year, {_FR_INDICATORS}
            FROM income_silver WHERE geography_level = 'commune' AND year IN (2018, 2019)""".replace(
            "d5_income", "CASE WHEN year = 2018 THEN median_income ELSE d5_income END AS d5_income"
        ),
        INCOME_SQL,
    ),
)
def legacy_silver(spark, sf_dir):
    """Two tables of one year: one of known level, one placed by its codes and filled by itself."""
    rows = standins.income_silver(spark, sf_dir).where((F.col("geography_level") == "commune") & F.col("year").isin(2018, 2019))
    level = F.when(F.col("year") == 2019, "commune").otherwise("unknown")
    bronze = _source_named(rows).withColumn("geography_level", level).drop("year")
    silver = plan.legacy_silver(bronze, 2019)
    return silver.select("commune_code", "commune_name", "department_code", "geography_level", "year", *INDICATORS)


_MAIN_POVERTY = "CASE WHEN substr(commune_code, 5, 1) IN ('0', '2', '4') THEN NULL ELSE poverty_rate END"


@query(
    "historical_silver",
    with_views(
        f"""SELECT commune_code, department_code, CAST(2018 AS BIGINT) AS year, median_income, d1_income,
                   median_income AS d5_income, coalesce({_MAIN_POVERTY}, poverty_rate * 2) AS poverty_rate,
                   'historical' AS source_generation
            FROM income_silver WHERE geography_level = 'commune' AND year = 2018""",
        INCOME_SQL,
    ),
)
def historical_silver(spark, sf_dir):
    """Two workbook tables; the poverty rate of every other commune comes from the second."""
    rows = standins.income_silver(spark, sf_dir).where((F.col("geography_level") == "commune") & (F.col("year") == 2018))
    main = _source_named(rows.withColumn("poverty_rate", F.expr(_MAIN_POVERTY)))
    poor = _source_named(rows.withColumn("poverty_rate", F.col("poverty_rate") * 2))
    bronze = main.withColumn("table_id", F.lit("disp_com")).union(poor.withColumn("table_id", F.lit("disp_pauvres_com")))
    silver = plan.historical_silver(bronze.withColumn("place", F.col("CODGEO")).drop("year"), 2018, "place")
    return silver.select(
        "commune_code", "department_code", "year", "median_income", "d1_income", "d5_income", "poverty_rate", "source_generation"
    )


@query(
    "infer_level",
    with_views(
        """SELECT year, geography_level AS table_id,
                  CASE WHEN geography_level = 'commune' THEN 'commune' ELSE 'department' END AS geography_level
           FROM income_silver GROUP BY year, geography_level""",
        INCOME_SQL,
    ),
)
def infer_level(spark, sf_dir):
    """Tables whose only code column holds communes, departments or (2023) nothing."""
    rows = standins.income_silver(spark, sf_dir)
    code = F.when(F.col("geography_level") == "commune", F.col("commune_code")).when(
        F.col("year") != 2023, F.col("department_code")
    )
    tables = rows.select("year", F.col("geography_level").alias("table_id"), code.alias("codgeo"), "department_code")
    return plan.infer_level(tables, ["year", "table_id"], "codgeo", "department_code")


@query(
    "all_null_fill",
    with_views(
        """SELECT commune_code, department_code, geography_level, year,
                  CASE WHEN year = 2018 THEN median_income ELSE d5_income END AS d5_income FROM income_silver""",
        INCOME_SQL,
    ),
)
def all_null_fill(spark, sf_dir):
    rows = plan.fill_all_null_median(standins.income_silver(spark, sf_dir))
    return rows.select("commune_code", "department_code", "geography_level", "year", "d5_income")


@query(
    "mask_unpublished",
    with_views(
        f"""SELECT commune_code, department_code, {_published("geography_name", "commune_name")}, s.year AS year,
                   {", ".join(_published(c, c) for c in INDICATORS)} FROM income_silver s""",
        INCOME_SQL,
    ),
)
def mask_unpublished(spark, sf_dir):
    rows = standins.income_silver(spark, sf_dir).withColumnRenamed("commune_name", "geography_name")
    masked = plan.mask_unpublished(rows)
    return masked.select("commune_code", "department_code", "geography_name", "year", *INDICATORS)


_PROVENANCE = (
    "geography_code, geography_level, year, dispositif, source_generation, indicator_source, is_official,"
    " methodology_version, comparable_with_previous_years"
)


@query("provenance_flags", with_views(f"SELECT {_PROVENANCE} FROM all_gold", INCOME_SQL, GOLD_SQL, DEPARTMENTS_SQL))
def provenance_flags(spark, sf_dir):
    return all_gold(spark, sf_dir).select(*[name.strip() for name in _PROVENANCE.split(",")])


@query(
    "multi_year_scan",
    with_views(f"SELECT {GOLD_COLUMNS} FROM gold WHERE year IN (2018, 2023)", INCOME_SQL, GOLD_SQL),
)
def multi_year_scan(spark, sf_dir):
    path = scratch_path(spark, "income-years")
    rows = gold(spark, sf_dir)
    sinks.write_years(rows, path, rebalance=True)
    return readers.read_years(spark, path, years=[2018, 2023, 2030, 2018]).select(*rows.columns)


@query(
    "harmonised_only",
    with_views(f"SELECT {GOLD_COLUMNS} FROM gold WHERE year NOT IN (2019, 2021)", INCOME_SQL, GOLD_SQL),
)
def harmonised_only(spark, sf_dir):
    """Year folders, two of which miss a canonical column and are skipped."""
    path = scratch_path(spark, "income-mixed")
    rows = gold(spark, sf_dir)
    complete = ~F.col("year").isin(2019, 2021)
    sinks.write_years(rows.where(complete), path)
    sinks.write_years(rows.where(~complete).drop("poverty_rate"), path)
    return readers.read_harmonised_years(spark, path, INCOME_GOLD)


@query(
    "series_exclusive",
    with_views(
        """SELECT geography_code, year, 'derived' AS series, median_income FROM derived WHERE year IN (2017, 2018)
           UNION ALL SELECT geography_code, year, 'official', median_income FROM gold
           WHERE geography_level = 'department' AND year = 2023""",
        INCOME_SQL, GOLD_SQL, DEPARTMENTS_SQL,
    ),
)
def series_exclusive(spark, sf_dir):
    """Official rows first; deriving 2017 again replaces its official rows."""
    path = scratch_path(spark, "department-series")
    rows = materialise(gold(spark, sf_dir), "income-gold")
    sinks.write_series(rows.where(F.col("geography_level") == "department"), path, "official")
    again = rows.where((F.col("geography_level") == "commune") & F.col("year").isin(2017, 2018))
    sinks.write_series(plan.derive_departments(again), path, "derived")
    return readers.read_years(spark, path).select("geography_code", "year", "series", "median_income")


_UNIT_LONG = """unit_long AS (
  SELECT l_returnflag, l_linestatus, l_extendedprice / l_quantity AS value,
         CASE WHEN l_tax = 0 THEN NULL WHEN l_discount = 0 THEN -1 ELSE l_quantity END AS weight FROM lineitem)"""


def _unit_prices(spark, sf_dir):
    weight = F.when(F.col("l_tax") == 0, None).when(F.col("l_discount") == 0, -1).otherwise(F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_linestatus", (F.col("l_extendedprice") / F.col("l_quantity")).alias("value"),
        weight.alias("weight"),
    )


@query(
    "weighted_median",
    with_views(_weighted_median_sql("unit_long", "l_returnflag, l_linestatus", "median"), _UNIT_LONG),
)
def weighted_median_query(spark, sf_dir):
    """The binned plan over the whole table."""
    rows = _unit_prices(spark, sf_dir)
    keys = ["l_returnflag", "l_linestatus"]
    return weighted_median(rows, keys, "value", "weight", "median")


@query(
    "weighted_mean",
    with_views(
        """SELECT l_returnflag, l_linestatus, round_even(sum(value * weight) / sum(weight) * 10000, 0) / 10000 AS mean
           FROM unit_long WHERE weight > 0 GROUP BY ALL""",
        _UNIT_LONG,
    ),
)
def weighted_mean(spark, sf_dir):
    mean = weighted_mean_of(F.col("value"), F.col("weight"))
    return _unit_prices(spark, sf_dir).groupBy("l_returnflag", "l_linestatus").agg(round_even(mean, 4).alias("mean"))


@query(
    "weight_choice",
    with_views(
        """SELECT year, weight_source, count(weight) AS weighted_rows, CAST(sum(weight) AS DOUBLE) AS total
           FROM weights GROUP BY ALL""",
        INCOME_SQL, GOLD_SQL,
    ),
)
def weight_choice(spark, sf_dir):
    weighted = with_table_weight(communes(spark, sf_dir), ["year"])
    return weighted.groupBy("year", "weight_source").agg(
        F.count("weight").alias("weighted_rows"), F.sum("weight").alias("total")
    )


@query(
    "derived_departments",
    with_views(f"SELECT {rounded_sql(GOLD_COLUMNS)} FROM derived", INCOME_SQL, GOLD_SQL, DEPARTMENTS_SQL),
)
def derived_departments(spark, sf_dir):
    return _rounded(plan.derive_departments(communes(spark, sf_dir)), "poverty_rate")


_DECILES = ("d1_income", "d5_income", "d9_income")
DECILE_SQL = f"""
department_long AS (
  UNPIVOT (SELECT year, CASE WHEN any_h THEN tax_households WHEN any_p THEN population ELSE 1 END AS weight, d1_income,
                  d5_income, d9_income
           FROM departments JOIN (SELECT year, count(tax_households) > 0 AS any_h, count(population) > 0 AS any_p
                                  FROM departments GROUP BY year) USING (year))
  ON d1_income, d5_income, d9_income INTO NAME indicator VALUE value),
commune_deciles AS ({_weighted_median_sql("commune_long", "year, indicator")}),
department_deciles AS ({_weighted_median_sql("department_long", "year, indicator")}),
any_decile AS (SELECT year, indicator, count(value) AS n FROM commune_long GROUP BY ALL),
decile_summary AS (
  SELECT y.year AS year, {", ".join(
    f'''(SELECT coalesce(max(c.value), max(CASE WHEN coalesce(n, 0) = 0 THEN d.value END))
     FROM (SELECT 1) LEFT JOIN commune_deciles c ON c.year = y.year AND c.indicator = '{c}'
     LEFT JOIN any_decile a ON a.year = y.year AND a.indicator = '{c}'
     LEFT JOIN department_deciles d ON d.year = y.year AND d.indicator = '{c}') AS {c}''' for c in _DECILES)}
  FROM (SELECT DISTINCT year FROM communes) y)"""


@query(
    "decile_fallback",
    with_views("SELECT * FROM decile_summary", INCOME_SQL, GOLD_SQL, DEPARTMENTS_SQL, DECILE_SQL),
)
def decile_fallback(spark, sf_dir):
    return plan.decile_summary(*layers(spark, sf_dir))


SUMMARY_SQL = """
year_summary AS (
  SELECT w.year AS year, count(DISTINCT geography_code) AS communes_covered,
         any_value(departments_covered) AS departments_covered, any_value(source) AS department_indicator_source,
         any_value(dispositif) AS dispositif, any_value(income) AS national_median_income,
         round_even(sum(poverty_rate * weight) / sum(CASE WHEN poverty_rate IS NOT NULL THEN weight END) * 100, 0) / 100
           AS poverty_mean,
         any_value(poverty) AS poverty_median
  FROM weights w
  JOIN (SELECT year, count(DISTINCT geography_code) AS departments_covered, max(indicator_source) AS source
        FROM departments GROUP BY year) d ON w.year = d.year
  LEFT JOIN (SELECT year, value AS income FROM commune_deciles WHERE indicator = 'median_income') i ON i.year = w.year
  LEFT JOIN (SELECT year, value AS poverty FROM commune_deciles WHERE indicator = 'poverty_rate') p ON p.year = w.year
  GROUP BY w.year)"""


@query(
    "income_year_summary",
    with_views("SELECT * FROM year_summary", INCOME_SQL, GOLD_SQL, DEPARTMENTS_SQL, DECILE_SQL, SUMMARY_SQL),
)
def income_year_summary(spark, sf_dir):
    return plan.year_summary(*layers(spark, sf_dir))


def _level_sql() -> str:
    return (
        "CASE WHEN geography_level = 'commune' THEN 'commune' WHEN is_official THEN 'department_official'"
        " ELSE 'department_derived' END"
    )


_SHARES = ", ".join(f"round_even(count({c}) / count(*) * 10000, 0) / 10000 AS {c}" for c in INDICATORS)
_SECONDARY = ", ".join(f"'{c}'" for c in cat.SECONDARY_DECILES)
AVAILABILITY_SQL = f"""
coverage AS (
  UNPIVOT (SELECT year, {_level_sql()} AS level, any_value(is_official) AS official,
                  any_value(indicator_source) AS indicator_source, {_SHARES} FROM all_gold GROUP BY 1, 2)
  ON {_ALL} INTO NAME indicator VALUE share),
availability AS (
  SELECT CAST(c.year AS BIGINT) AS year, l.level AS level, i.indicator AS indicator,
         coalesce(share > 0, FALSE) AS available, coalesce(share, 0) AS coverage, coalesce(official, FALSE) AS official,
         coalesce(indicator_source, '') AS indicator_source,
         coalesce(share > 0, FALSE) AND l.level = 'commune' AND NOT methodological_break
           AND CASE WHEN i.indicator IN ({_SECONDARY}) THEN secondary ELSE comparable END
           AS comparable_with_previous_years
  FROM catalogue c CROSS JOIN (VALUES ('commune'), ('department_official'), ('department_derived')) AS l(level)
  CROSS JOIN (VALUES {", ".join(f"('{c}')" for c in INDICATORS)}) AS i(indicator)
  LEFT JOIN coverage v ON v.year = c.year AND v.level = l.level AND v.indicator = i.indicator)"""
GOLD_VIEWS = (INCOME_SQL, GOLD_SQL, DEPARTMENTS_SQL)


@query("availability", with_views("SELECT * FROM availability", *GOLD_VIEWS, AVAILABILITY_SQL))
def availability(spark, sf_dir):
    return plan.availability(all_gold(spark, sf_dir))


@query(
    "availability_grid",
    with_views(
        f"""SELECT y.year AS year, l.level AS level, i.indicator AS indicator, coalesce(n, 0) AS rows
            FROM (SELECT DISTINCT year FROM all_gold) y
            CROSS JOIN (VALUES ('commune'), ('department_official'), ('department_derived')) AS l(level)
            CROSS JOIN (VALUES {", ".join(f"('{c}')" for c in INDICATORS)}) AS i(indicator)
            LEFT JOIN (SELECT year, {_level_sql()} AS level, count(*) AS n FROM all_gold GROUP BY 1, 2) g
              ON g.year = y.year AND g.level = l.level""",
        *GOLD_VIEWS,
    ),
)
def availability_grid(spark, sf_dir):
    """Every year x level x indicator with the number of rows behind it."""
    rows = all_gold(spark, sf_dir).groupBy("year", plan.level_key().alias("level")).agg(F.count("*").alias("rows"))
    years = rows.select("year").distinct()
    frame = years.withColumn("level", F.explode(F.array(*map(F.lit, cat.LEVELS)))).withColumn(
        "indicator", F.explode(F.array(*map(F.lit, INDICATORS)))
    )
    return frame.join(rows, ["year", "level"], "left").select(
        "year", "level", "indicator", F.coalesce("rows", F.lit(0)).cast("long").alias("rows")
    )


_PIVOT = """
pivoted AS (
  SELECT geo, geo_object, period,
         arg_min(obs_value, event_id) FILTER (measure = 'MED_SL') AS med,
         arg_min(obs_value, event_id) FILTER (measure = 'D1_SL') AS d1,
         arg_min(obs_value, event_id) FILTER (measure = 'D9_SL') AS d9,
         arg_min(obs_value, event_id) FILTER (measure = 'PR_MD60') AS pr
  FROM observations WHERE geo_object IN ('COM', 'DEP') GROUP BY ALL)"""


def _number(column: str) -> str:
    return f"TRY_CAST(replace({column}, ',', '.') AS DOUBLE)"


@query(
    "measure_pivot",
    with_views(
        f"""SELECT CASE WHEN geo_object = 'COM' THEN geo ELSE '' END AS commune_code,
                  CASE WHEN geo_object = 'COM' THEN substr(geo, 1, 2) ELSE geo END AS department_code,
                  CASE WHEN geo_object = 'COM' THEN 'commune' ELSE 'department' END AS geography_level,
                  coalesce(TRY_CAST(period AS BIGINT), 2023) AS year, {_number("med")} AS median_income,
                  {_number("d1")} AS d1_income, CAST(NULL AS DOUBLE) AS d2_income, {_number("med")} AS d5_income,
                  {_number("d9")} AS d9_income, {_number("pr")} AS poverty_rate
           FROM pivoted""",
        OBSERVATIONS_SQL, _PIVOT,
    ),
)
def measure_pivot(spark, sf_dir):
    wide = plan.long_silver(standins.observations(spark, sf_dir), 2023, "event_id")
    return wide.select(
        "commune_code", "department_code", "geography_level", "year", "median_income", "d1_income", "d2_income",
        "d5_income", "d9_income", "poverty_rate",
    )


@query(
    "source_profile",
    with_views(
        """SELECT count(*) AS row_count, string_agg(DISTINCT geo_object, '|' ORDER BY geo_object) AS geo_objects,
                  string_agg(DISTINCT measure, '|' ORDER BY measure) AS measures FROM observations""",
        OBSERVATIONS_SQL,
    ),
)
def source_profile(spark, sf_dir):
    rest = {name: F.lit("") for name in ("UNIT_MEASURE", "CONF_STATUS", "OBS_STATUS", "UNIT_MULT")}
    profile = plan.source_profile(standins.observations(spark, sf_dir).withColumns(rest))
    joined = {name: F.array_join(name, "|") for name in ("geo_objects", "measures")}
    return profile.withColumns(joined)


@query(
    "silver_counts",
    with_views(
        """SELECT year, count(*) AS rows, count(DISTINCT nullif(commune_code, '')) AS communes,
                  count(DISTINCT nullif(department_code, '')) AS departments FROM income_silver GROUP BY year""",
        INCOME_SQL,
    ),
)
def silver_counts(spark, sf_dir):
    return plan.silver_counts(standins.income_silver(spark, sf_dir), ["year"])


@query(
    "key_duplicates",
    "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def key_duplicates(spark, sf_dir):
    return plan.key_duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])
