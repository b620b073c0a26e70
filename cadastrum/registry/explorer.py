"""Explorer queries over the harmonised income rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastrum import catalogue as cat
from cadastrum.functions import round_even
from cadastrum.operators.ranks import Zones, with_position
from cadastrum.operators.search_index import SearchIndex
from cadastrum.operators.shape import unpivot_series
from cadastrum.plans import explorer as plan
from cadastrum.plans import income
from cadastrum.registry import standins
from cadastrum.registry.base import query, table
from cadastrum.registry.income import AVAILABILITY_SQL, GOLD_SQL, GOLD_VIEWS, all_gold, gold
from cadastrum.registry.standins import INCOME_SQL, with_views
from cadastrum.schemas import INDICATORS
from cadastrum.session import scratch_path

_FIXED = ", ".join(plan.FIXED_COLUMNS)
_LABELS = ", ".join(f"('{k}', '{v}', {i})" for i, (k, v) in enumerate(cat.INDICATOR_LABELS.items(), start=1))
LABELS_SQL = f"labels AS (SELECT * FROM (VALUES {_LABELS}) AS t(indicator, label, position))"


def _communes(spark, sf_dir):
    return gold(spark, sf_dir).where(F.col("geography_level") == "commune")


_PAGE = plan.PageRequest(
    2018, "median_income", limit=20, offset=40, sort_by="geography_name", descending=True, search=" COMMUNE 01"
)


@query(
    "explorer_page",
    with_views(
        f"""SELECT {_FIXED}, median_income AS indicator_value FROM communes
            WHERE year = 2018 AND median_income IS NOT NULL
              AND (lower(coalesce(geography_code, '')) LIKE '%commune 01%'
                   OR lower(coalesce(geography_name, '')) LIKE '%commune 01%')
            ORDER BY geography_name DESC NULLS LAST, geography_code LIMIT 20 OFFSET 40""",
        INCOME_SQL, GOLD_SQL,
    ),
)
def explorer_page(spark, sf_dir):
    return plan.page(_communes(spark, sf_dir), _PAGE)


@query(
    "filtered_count",
    with_views(
        """SELECT count(*) AS total_rows FROM communes WHERE year = 2018 AND median_income IS NOT NULL
             AND (lower(geography_code) LIKE '%commune 01%' OR lower(coalesce(geography_name, '')) LIKE '%commune 01%')""",
        INCOME_SQL, GOLD_SQL,
    ),
)
def filtered_count(spark, sf_dir):
    return plan.filtered_count(_communes(spark, sf_dir), _PAGE)


@query(
    "page_window",
    """SELECT o_custkey, total_rows, greatest(1, CAST(ceil(total_rows / 4.0) AS BIGINT)) AS pages,
              least(wanted, greatest(1, CAST(ceil(total_rows / 4.0) AS BIGINT))) AS page
       FROM (SELECT o_custkey, count(*) FILTER (o_orderstatus <> 'F') AS total_rows, CAST(max(o_orderkey % 5) + 1 AS BIGINT) AS wanted
             FROM orders GROUP BY o_custkey)""",
)
def page_window(spark, sf_dir):
    """Page counts of each customer's orders at four rows per page."""
    totals = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count_if(F.col("o_orderstatus") != "F").alias("total_rows"), (F.max(F.col("o_orderkey") % 5) + 1).alias("wanted")
    )
    pages, shown = plan.page_window(F.col("total_rows"), F.lit(4), F.col("wanted"))
    return totals.select("o_custkey", "total_rows", pages.alias("pages"), shown.alias("page"))


@query(
    "income_trend",
    with_views(
        f""", y AS (SELECT unnest([2017, 2018, 2019, 2020, 2021, 2023, 2024]) AS year),
           t AS (SELECT year, avg(median_income) AS median_income, avg(d1_income) AS d1_income, avg(d9_income) AS d9_income
                 FROM communes GROUP BY year),
           w AS (SELECT i.indicator AS indicator, CAST(y.year AS BIGINT) AS year,
                   CASE i.indicator WHEN 'median_income' THEN median_income WHEN 'd1_income' THEN d1_income ELSE d9_income END
                     AS value
                 FROM y CROSS JOIN (VALUES ('median_income'), ('d1_income'), ('d9_income')) AS i(indicator)
                 LEFT JOIN t ON t.year = y.year)
           SELECT indicator, label, year, value FROM w JOIN labels USING (indicator)""",
        INCOME_SQL, GOLD_SQL, LABELS_SQL,
    ),
)
def income_trend(spark, sf_dir):
    years = [2017, 2018, 2019, 2020, 2021, 2022, 2023, 2024, 2018]
    return plan.trend_series(_communes(spark, sf_dir), years)


def _availability(spark, sf_dir):
    return income.availability(all_gold(spark, sf_dir))


@query(
    "indicator_options",
    with_views(
        """SELECT year, level, indicator, label, position, coverage, official, indicator_source,
                  comparable_with_previous_years FROM availability JOIN labels USING (indicator)
           WHERE available AND coverage > 0""",
        *GOLD_VIEWS, AVAILABILITY_SQL, LABELS_SQL,
    ),
)
def indicator_options(spark, sf_dir):
    return plan.indicator_options(_availability(spark, sf_dir))


@query(
    "gated_query",
    with_views(
        f""", long AS (
             SELECT * FROM (
               SELECT geography_code, year, CASE WHEN geography_level = 'commune' THEN 'commune'
                 WHEN is_official THEN 'department_official' ELSE 'department_derived' END AS level,
                 {", ".join(INDICATORS)} FROM all_gold)
             UNPIVOT INCLUDE NULLS (value FOR indicator IN ({", ".join(INDICATORS)})))
           SELECT geography_code, year, level, indicator, round_even(value * 1000000000, 0) / 1000000000 AS value FROM long
           WHERE (year, level, indicator) IN (SELECT (year, level, indicator) FROM availability WHERE available)""",
        *GOLD_VIEWS, AVAILABILITY_SQL,
    ),
)
def gated_query(spark, sf_dir):
    """Every value whose indicator is on offer for its year and level, to nine decimals."""
    rows = all_gold(spark, sf_dir)
    long = rows.select("geography_code", "year", income.level_key().alias("level"), *INDICATORS).unpivot(
        ["geography_code", "year", "level"], list(INDICATORS), "indicator", "value"
    )
    gated = plan.gated_values(long, plan.indicator_options(income.availability(rows)))
    return gated.withColumn("value", round_even("value", 9))


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


@query(
    "method_warnings",
    with_views(
        f""", w AS (SELECT a.year AS year, level, indicator, methodological_break, available, coverage, lower(label) AS label
                    FROM availability a JOIN labels USING (indicator) JOIN catalogue c ON c.year = a.year)
           SELECT year, level, indicator, {_text(plan.BREAK_WARNING)} AS warning FROM w WHERE methodological_break
           UNION ALL SELECT year, level, indicator, {_text(plan.DERIVED_WARNING)} FROM w WHERE level = 'department_derived'
           UNION ALL SELECT year, level, indicator, 'La couverture publiée pour ' || label || ' est partielle ('
             || format('{{:.1f}}', round(coverage * 100, 1)) || ' %).' FROM w WHERE available AND coverage > 0 AND coverage < 1""",
        *GOLD_VIEWS, AVAILABILITY_SQL, LABELS_SQL,
    ),
)
def method_warnings(spark, sf_dir):
    warnings = plan.methodology_warnings(_availability(spark, sf_dir))
    return warnings.select("year", "level", "indicator", F.explode("warnings").alias("warning"))


@query(
    "unpivot_series",
    with_views(
        """, long AS (SELECT * FROM (SELECT commune_code, department_code, year, d1_income, median_income, d9_income
                                     FROM income_silver)
                      UNPIVOT INCLUDE NULLS (value FOR indicator IN (d1_income, median_income, d9_income)))
           SELECT commune_code, department_code, year, indicator, label, value FROM long JOIN labels USING (indicator)""",
        INCOME_SQL, LABELS_SQL,
    ),
)
def unpivot_series_query(spark, sf_dir):
    rows = standins.income_silver(spark, sf_dir)
    return unpivot_series(
        rows, ["commune_code", "department_code", "year"], ["d1_income", "median_income", "d9_income"],
        cat.indicator_labels(spark),
    )


@query(
    "typed_sort",
    """WITH t AS (SELECT lang, text AS word, count(*) AS rows FROM documents GROUP BY ALL),
       n AS (SELECT lang, CAST(n_chars AS VARCHAR) AS word, count(*) AS rows FROM documents GROUP BY ALL)
       SELECT 'text' AS kind, lang, sha256(word) AS cell, rows,
              row_number() OVER (PARTITION BY lang ORDER BY lower(strip_accents(word)) COLLATE fr, word) AS position
       FROM t
       UNION ALL SELECT 'number', lang, sha256(word), rows, row_number() OVER (PARTITION BY lang ORDER BY CAST(word AS DOUBLE) DESC) FROM n""",
)
def typed_sort(spark, sf_dir):
    """Places of the distinct whole texts by French text order, and of the distinct lengths by number, per language."""
    cells = table(spark, sf_dir, "documents").select("lang", "text", F.col("n_chars").cast("string").alias("length"))

    def placed(kind: str, column: str, *order):
        counted = cells.groupBy("lang", F.col(column).alias("word")).agg(F.count("*").alias("rows"))
        ranked = with_position(counted, list(order), ["lang"])
        return ranked.select(F.lit(kind).alias("kind"), "lang", F.sha2("word", 256).alias("cell"), "rows", "position")

    by_text = placed("text", "text", plan.typed_order("word", "text"), F.col("word"))
    return by_text.union(placed("number", "length", plan.typed_order("word", "number", descending=True)))


@query(
    "numbered_page",
    """WITH p AS (SELECT o_orderkey, o_totalprice, o_custkey,
                         row_number() OVER (ORDER BY CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END DESC NULLS LAST, o_orderkey) - 1
                           AS position
                  FROM orders),
            h AS (SELECT count(*) AS n FROM orders)
       SELECT o_orderkey, o_totalprice, o_custkey, position FROM p, h
       WHERE position BETWEEN n // 2 AND n // 2 + 49 OR position >= n - 20""",
)
def numbered_page(spark, sf_dir):
    """A page from the middle of all orders and the last page, by number; nulls stand last, keys break ties."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey", "o_orderstatus")
    price = F.when(F.col("o_orderstatus") == "P", None).otherwise(F.col("o_totalprice"))
    zones = Zones(scratch_path(spark, "zones")).write(orders, [price.desc_nulls_last(), F.col("o_orderkey").asc()], partitions=32)
    total = zones.total(spark)
    pages = zones.page(spark, total // 2, 50).union(zones.page(spark, total - 20, 20))
    return pages.select("o_orderkey", "o_totalprice", "o_custkey", "position").distinct()


_SEARCHES = ("000012", "0_0013", "supplier#0000001", "00%77", "none of them", "7")


@query(
    "indexed_search",
    " UNION ALL ".join(
        f"""SELECT '{text}' AS search, s_suppkey, s_name FROM supplier
            WHERE lower(s_name) LIKE '%{text}%' OR lower(CAST(s_suppkey AS VARCHAR)) LIKE '%{text}%'"""
        for text in _SEARCHES
    ),
)
def indexed_search(spark, sf_dir):
    """Searches over all suppliers by name or key: postings first, then the folders that can match."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.col("s_suppkey").cast("string").alias("key"))
    index = SearchIndex(scratch_path(spark, "search"), ("s_name", "key")).write(rows, [F.col("s_suppkey")], partitions=16)
    found = [index.search(spark, text).select(F.lit(text).alias("search"), "s_suppkey", "s_name") for text in _SEARCHES]
    return reduce(DataFrame.unionAll, found)
