"""Reshaping: maps, pivots, grids with a header row, dense years, first rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastrum.functions.numbers import french_number


def map_by_key(entries: str, key: str, value: str) -> Column:
    """Array of structs -> map, in the array's order."""
    pairs = F.transform(F.col(entries), lambda e: F.struct(e[key].alias("key"), e[value].alias("value")))
    return F.map_from_entries(pairs)


def two_maps_to_rows(counts: Column, medians: Column) -> Column:
    """Rows of two maps keyed alike: count defaults to 0, median to null, keys sorted."""
    keys = F.array_sort(F.array_union(F.map_keys(counts), F.map_keys(medians)))
    return F.transform(
        keys,
        lambda k: F.struct(
            k.alias("department_code"),
            F.coalesce(F.try_element_at(counts, k), F.lit(0)).cast("long").alias("sales_count"),
            F.try_element_at(medians, k).alias("median_price_m2"),
        ),
    )


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of each key in source order; combines before the shuffle.

    Rows with texts are aggregated by sorting, so pass only the columns that are wanted.
    """
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("__first")).select(*keys, "__first.*").select(*df.columns)


def measure_pivot(long: DataFrame, keys: list[str], measure: str, value: str, order: str, measures: dict) -> DataFrame:
    """Long -> wide: the number in the first non-null text in source order, per key and listed measure, renamed.

    Texts are parsed before they are grouped, so the buffers have a fixed width and rows are hashed.
    """

    def first(name: str) -> Column:
        wanted = (F.col(measure) == name) & F.col("__filled")
        return F.min_by("__number", F.when(wanted, F.col(order)))

    parsed = long.withColumns({"__number": french_number(value), "__filled": F.col(value).isNotNull()})
    return parsed.groupBy(*keys).agg(*[first(name).alias(column) for name, column in measures.items()])


def unpivot_series(wide: DataFrame, keys: list[str], columns: list[str], labels: DataFrame | None = None) -> DataFrame:
    """Wide -> long (keys, indicator, value), labelled from a small dimension."""
    long = wide.unpivot(keys, columns, "indicator", "value")
    if labels is None:
        return long
    return long.join(F.broadcast(labels.select("indicator", "label")), "indicator", "left").select(
        *keys, "indicator", "label", "value"
    )


def dense_years(years: DataFrame) -> DataFrame:
    """Every year from the first to the last, with ``missing`` for absent ones."""
    present = years.select(F.col("year").cast("long").alias("year")).where("year is not null").distinct()
    span = present.agg(F.min("year").alias("first"), F.max("year").alias("last")).where("first is not null")
    spine = span.select(F.explode(F.sequence("first", "last")).alias("year"))
    return spine.join(present.withColumn("__found", F.lit(True)), "year", "left").select(
        "year", F.col("__found").isNull().alias("missing")
    )


def folded_cell(column: Column) -> Column:
    """Lower snake case of a header cell; accents are not folded here."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(column, F.lit(""))), "[^a-z0-9]+", "_"), F.lit("_"))


def promote_header(grid: DataFrame, marker: str = "codgeo") -> DataFrame:
    """Sheet grids ``(table_id, row_idx, cells)`` -> one ``record`` map per data row.

    The header is a sheet's first row whose first cell folds to ``marker``; the
    row above gives names for blank header cells. Rows are cut or padded to the
    header's width; rows with a blank first cell are dropped. Sheets may have
    different headers, so a record maps column name to text.
    """
    is_header = folded_cell(F.get("cells", F.lit(0))) == marker
    # Header rows are picked in the scan; the row above is fetched by its place, not by regrouping the sheet.
    header = grid.where(is_header).groupBy("table_id").agg(
        F.min("row_idx").alias("header_idx"), F.min_by("cells", "row_idx").alias("codes")
    )
    above = grid.select("table_id", (F.col("row_idx") + 1).alias("header_idx"), F.col("cells").alias("labels"))
    names = header.join(above, ["table_id", "header_idx"], "left")
    candidate = F.transform(
        "codes",
        lambda code, i: F.coalesce(
            F.nullif(folded_cell(code), F.lit("")),
            F.nullif(folded_cell(F.get(F.col("labels"), i)), F.lit("")),
            F.concat(F.lit("column_"), (i + 1).cast("string")),
        ),
    )
    unique = F.transform(
        "candidates",
        lambda name, i: F.when(
            F.array_position(F.col("candidates"), name) <= i,
            F.concat(
                name,
                F.lit("_"),
                F.size(F.filter(F.slice(F.col("candidates"), 1, i + 1), lambda n: n == name)).cast("string"),
            ),
        ).otherwise(name),
    )
    names = names.withColumn("candidates", candidate).select("table_id", "header_idx", unique.alias("names"))
    rows = grid.join(names, "table_id").where(
        (F.col("row_idx") > F.col("header_idx")) & (F.trim(F.coalesce(F.get("cells", F.lit(0)), F.lit(""))) != "")
    )
    padded = F.transform("names", lambda _, i: F.coalesce(F.get(F.col("cells"), i), F.lit("")))
    return rows.select("table_id", "row_idx", F.map_from_arrays("names", padded).alias("record"))
