"""Explorer queries: pages, counts, trends, options, gates and warnings."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastrum import catalogue as cat
from cadastrum.functions import like_any
from cadastrum.operators.filters import boolean_of, moment_of, number_of
from cadastrum.schemas import INDICATORS
from cadastrum.session import small_table

# Fixed values of the explorer.
DEFAULT_LIMIT = 50
MAX_LIMIT = 200
UNPUBLISHED_YEAR = 2022
FIXED_COLUMNS = (
    "geography_code",
    "geography_name",
    "geography_level",
    "year",
    "dispositif",
    "source_generation",
    "indicator_source",
    "is_official",
    "methodology_version",
    "comparable_with_previous_years",
)
SORTABLE = ("geography_code", "geography_name", *INDICATORS)
BREAK_WARNING = (
    "À partir de 2023, les données proviennent de Filosofi 2. Elles ne sont pas directement comparables aux"
    " millésimes antérieurs sans précaution."
)
DERIVED_WARNING = (
    "Les données départementales affichées ici sont dérivées des communes et ne constituent pas une série"
    " officielle INSEE."
)


class NotAvailable(ValueError):
    pass


@dataclass(frozen=True)
class PageRequest:
    year: int
    indicator: str
    level: str = "commune"
    department_source: str = "official"
    limit: float | None = None
    offset: float | None = None
    sort_by: str | None = None
    descending: bool = False
    search: str | None = None

    @property
    def level_key(self) -> str:
        if self.level == "commune":
            return "commune"
        return "department_derived" if self.department_source == "derived" else "department_official"


def _usable(value: float | None) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value)


def page_limit(value: float | None) -> int:
    return min(MAX_LIMIT, max(1, math.trunc(value))) if _usable(value) else DEFAULT_LIMIT


def page_offset(value: float | None) -> int:
    return max(0, math.trunc(value)) if _usable(value) else 0


def sort_column(sort_by: str | None, indicator: str) -> str:
    wanted = sort_by or indicator
    if wanted not in SORTABLE:
        raise ValueError(f"Unsupported sort column: {wanted}")
    return wanted


def _selected(gold: DataFrame, request: PageRequest) -> DataFrame:
    if request.indicator not in INDICATORS:
        raise ValueError(f"Unknown indicator: {request.indicator}")
    return gold.where(
        (F.col("year") == int(request.year))
        & F.col(request.indicator).isNotNull()
        & like_any(["geography_code", "geography_name"], request.search)
    )


def page(gold: DataFrame, request: PageRequest) -> DataFrame:
    """One page of a level's table; the code breaks ties so pages are stable."""
    column = F.col(sort_column(request.sort_by, request.indicator))
    first = column.desc_nulls_last() if request.descending else column.asc_nulls_last()
    return (
        _selected(gold, request)
        .orderBy(first, F.col("geography_code").asc_nulls_last())
        .offset(page_offset(request.offset))
        .limit(page_limit(request.limit))
        .select(*FIXED_COLUMNS, F.col(request.indicator).alias("indicator_value"))
    )


def page_after(gold: DataFrame, request: PageRequest, value, code: str) -> DataFrame:
    """The page behind the row with sort ``value`` and ``code``; no rows are skipped one by one.

    For deep pages: the filter reaches the scan and each task keeps one page at most, whatever
    the page's number. Null values stand last in either direction.
    """
    column = F.col(sort_column(request.sort_by, request.indicator))
    later_code = F.col("geography_code") > code
    if value is None:
        behind = column.isNull() & later_code
    else:
        further = column < F.lit(value) if request.descending else column > F.lit(value)
        behind = further | column.isNull() | ((column == F.lit(value)) & later_code)
    return page(gold.where(behind), replace(request, offset=0))


def filtered_count(gold: DataFrame, request: PageRequest) -> DataFrame:
    return _selected(gold, request).agg(F.count("*").alias("total_rows"))


def page_window(total_rows: Column, page_size: Column, wanted: Column) -> tuple[Column, Column]:
    """(number of pages, page shown): at least one page, the page within range."""
    pages = F.greatest(F.lit(1).cast("long"), F.ceil(total_rows / page_size).cast("long"))
    return pages, F.least(wanted.cast("long"), pages)


def trend(gold: DataFrame, indicators: list[str] | None = None, years: list[int] | None = None) -> DataFrame:
    """Average of the indicators per year, for the listed years only."""
    indicators = list(indicators or cat.TREND_INDICATORS)
    rows = gold if years is None else gold.where(F.col("year").isin(list(dict.fromkeys(int(y) for y in years))))
    return rows.where("year is not null").groupBy("year").agg(*[F.avg(c).alias(c) for c in indicators]).orderBy("year")


def trend_series(gold: DataFrame, years: list[int], indicators: list[str] | None = None) -> DataFrame:
    """Long labelled trend over the published years; a year without rows gives nulls."""
    spark = gold.sparkSession
    indicators = list(indicators or cat.TREND_INDICATORS)
    shown = [int(y) for y in dict.fromkeys(years) if y != UNPUBLISHED_YEAR]
    spine = small_table(spark, [(y,) for y in shown], "year long")
    # One row per year on both sides.
    wide = F.broadcast(spine).join(trend(gold, indicators, shown), "year", "left")
    labels = F.broadcast(cat.indicator_labels(spark).select("indicator", "label"))
    return wide.unpivot(["year"], indicators, "indicator", "value").join(labels, "indicator").select(
        "indicator", "label", "year", "value"
    )


def indicator_options(availability: DataFrame) -> DataFrame:
    """Indicators a year and level offer, in display order."""
    labels = F.broadcast(cat.indicator_labels(availability.sparkSession))
    return availability.where(F.col("available") & (F.col("coverage") > 0)).join(labels, "indicator").select(
        "year", "level", "indicator", "label", "position", "coverage", "official", "indicator_source",
        "comparable_with_previous_years",
    )


def gate(availability: DataFrame, request: PageRequest) -> None:
    """Raise unless the year has data and the level offers the indicator. One aggregate row is fetched."""
    wanted = (F.col("level") == request.level_key) & (F.col("indicator") == request.indicator) & (F.col("coverage") > 0)
    facts = availability.where((F.col("year") == int(request.year)) & F.col("available")).agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(wanted).alias("offered")
    ).first()
    if request.year == UNPUBLISHED_YEAR or not facts["entries"]:
        raise NotAvailable(f"year {request.year} is not available")
    if not facts["offered"]:
        raise NotAvailable(f"indicator {request.indicator} is not available for {request.level} in {request.year}")


def gated_values(gold_long: DataFrame, options: DataFrame) -> DataFrame:
    """Long values restricted to what each year and level offers (a few hundred options)."""
    keys = ["year", "level", "indicator"]
    return gold_long.join(F.broadcast(options.select(*keys)), keys, "left_semi")


def methodology_warnings(availability: DataFrame, catalogue: dict | None = None) -> DataFrame:
    """Warnings per year, level and indicator: break, derived series, partial coverage."""
    spark = availability.sparkSession
    years = F.broadcast(cat.source_years(spark, catalogue).select("year", "methodological_break"))
    labels = F.broadcast(cat.indicator_labels(spark).select("indicator", "label"))
    share = F.format_string("%.1f", F.round(F.col("coverage") * 100, 1))
    partial = F.concat(
        F.lit("La couverture publiée pour "), F.lower("label"), F.lit(" est partielle ("), share, F.lit(" %).")
    )
    warnings = F.array(
        F.when(F.col("methodological_break"), BREAK_WARNING),
        F.when(F.col("level") == "department_derived", DERIVED_WARNING),
        F.when(F.col("available") & (F.col("coverage") > 0) & (F.col("coverage") < 1), partial),
    )
    return (
        availability.join(years, "year")
        .join(labels, "indicator")
        .select("year", "level", "indicator", F.array_compact(warnings).alias("warnings"))
    )


@dataclass(frozen=True)
class PageResult:
    rows: DataFrame
    total: DataFrame
    warnings: DataFrame
    limit: int
    offset: int


def query_page(gold: DataFrame, availability: DataFrame, request: PageRequest) -> PageResult:
    """Gate, page, total and warnings of one explorer request (all lazy but the gate)."""
    gate(availability, request)
    if request.level == "commune":
        rows = gold.where(F.col("geography_level") == "commune")
    else:
        source = cat.DERIVED if request.department_source == "derived" else cat.OFFICIAL
        rows = gold.where((F.col("geography_level") == "department") & (F.col("indicator_source") == source))
    warnings = methodology_warnings(availability).where(
        (F.col("year") == request.year)
        & (F.col("level") == request.level_key)
        & (F.col("indicator") == request.indicator)
    )
    return PageResult(
        page(rows, request), filtered_count(rows, request), warnings,
        page_limit(request.limit), page_offset(request.offset),
    )


def typed_order(column: str, kind: str, descending: bool = False) -> Column:
    """Sort key of a table column by its type; unreadable cells sort lowest."""
    cell = F.col(column)
    if kind == "number":
        key = number_of(cell)
    elif kind == "date":
        key = moment_of(cell)
    elif kind == "boolean":
        key = F.coalesce(boolean_of(cell), F.lit(False))
    else:
        # French order that ignores case and accents.
        key = F.collate(F.coalesce(cell.cast("string"), F.lit("")), "fr_CI_AI")
    return key.desc_nulls_last() if descending else key.asc_nulls_first()
