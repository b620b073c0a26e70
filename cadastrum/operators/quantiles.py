"""Exact quantiles and weighted medians of groups of any size.

Groups of up to ``SORTED_ROWS`` rows are shuffled once by key and sorted, and a running weight tells
where each wanted position lies. Larger groups, whose keys are few by that very bound, never
meet in one task: a cell number that never decreases with the value cuts each of them twice, into bins,
and each bin into cells. Weights are summed per (group, bin), which combines before the
shuffle; a running sum over a group's bins, then over the found bin's cells, shows where
each wanted position lies. Only the rows of that cell go on, equal values collapsed. Both ways give
the same rows; where a table has no large group, AQE drops that branch once the counts are known.

Cells are relative to the value, so a window holds at most a group's bins (512 for each
factor of e that its values span), a bin's 16 million cells, or the distinct doubles of
one cell, of which there are fewer than a million. All value columns and probabilities take
the same pass and the plan is lazy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastrum.functions.numbers import finite, round_even

BIN_BITS, CELL_BITS = 9, 24  # bins per factor of e and cells per bin, as powers of two
SORTED_ROWS = 1 << 20  # a sorted group holds no more rows, so a table has at most one larger group per million rows

_KEY, _COLUMN, _VALUE, _WEIGHT = "__key", "__column", "__value", "__weight"
_GROUP = [_KEY, _COLUMN]
_Targets = Callable[[Column], Column]


def _cell(value: Column) -> Column:
    """Number of the value's cell; ``ln`` is semi-monotonic, so order is kept.

    The logarithm of a finite double stays within 750 of zero; infinities get ends of their own.
    """
    magnitude = F.least(F.ln(F.abs(value)) + 750.0, F.lit(1500.0))
    return F.when(value == 0, F.lit(0).cast("long")).otherwise(
        (F.signum(value) * F.floor(magnitude * F.lit(float(1 << (BIN_BITS + CELL_BITS))))).cast("long")
    )


def _locate(df: DataFrame, within: list[str], order: str, hits: Column, start: Column) -> DataFrame:
    """Keep rows whose running weight covers a wanted position: (within, order, __from, __hits).

    ``__from`` is the weight before the row. The first and last row also
    catch positions that floating-point sums push past the ends.
    """
    ordered = Window.partitionBy(*within).orderBy(order)
    running = start + F.sum(_WEIGHT).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    kept = [c for c in df.columns if c not in (*within, order, _WEIGHT)]
    summed = df.select(*within, order, *kept, running.alias("__upto"))
    placed = summed.select(
        *within, order, *kept, "__upto", F.lag("__upto").over(ordered).alias("__before"),
        F.lead("__upto").over(ordered).isNull().alias("__last"),
        F.max("__upto").over(Window.partitionBy(*within)).alias("__total"),
    )
    wanted = placed.select(*within, order, "__before", "__upto", "__last", start.alias("__start"), hits.alias("__wanted"))
    covered = F.expr("filter(__wanted, h -> (__before is null or h.at > __before) and (h.at <= __upto or __last))")
    return wanted.select(*within, order, F.coalesce("__before", "__start").alias("__from"), covered.alias("__hits")).where(
        F.size("__hits") > 0
    )


def with_cells(rows: DataFrame) -> DataFrame:
    """Adds the number of each value's cell and bin."""
    rows = rows.withColumn("__cell", _cell(F.col(_VALUE)))
    # An arithmetic shift rounds down, so a bin holds neighbouring cells.
    return rows.withColumn("__bin", F.shiftright("__cell", CELL_BITS))


def bin_weights(rows: DataFrame) -> DataFrame:
    """Weight per group and bin; tables of these merge by adding weights."""
    return rows.groupBy(*_GROUP, "__bin").agg(F.sum(_WEIGHT).alias(_WEIGHT))


def locate_bins(bins: DataFrame, targets: _Targets) -> DataFrame:
    """The bins (``bin_weights``) that hold a group's targets."""
    return _locate(bins, _GROUP, "__bin", targets(F.col("__total")), F.lit(0.0))


def order_statistics_in(in_bins: DataFrame, rows: DataFrame) -> DataFrame:
    """Per key and column, the smallest value whose running weight reaches each target, of groups of any size.

    ``rows`` has a struct key, a column number, a non-null value with its cell and bin, and a positive weight; only
    those in located bins are used. The result has one row per (key, column, target id) with ``value``, ``share``.
    """
    weight = F.sum(_WEIGHT).alias(_WEIGHT)
    bin_keys, cell_keys = [*_GROUP, "__bin"], [*_GROUP, "__bin", "__cell"]
    near = rows.join(in_bins, bin_keys).groupBy(*cell_keys, _VALUE).agg(
        weight, F.first("__from").alias("__from"), F.first("__hits").alias("__hits")
    )
    cells = near.groupBy(*cell_keys).agg(weight, F.first("__from").alias("__from"), F.first("__hits").alias("__hits"))
    in_cells = _locate(cells, bin_keys, "__cell", F.col("__hits"), F.col("__from"))
    last = near.drop("__from", "__hits").join(in_cells, cell_keys)
    exact = _locate(last, cell_keys, _VALUE, F.col("__hits"), F.col("__from"))
    return exact.select(*_GROUP, F.col(_VALUE).alias("value"), F.explode("__hits").alias("hit")).select(
        *_GROUP, "value", F.col("hit.id").alias("id"), F.col("hit.share").alias("share")
    )


def _sorted_statistics(rows: DataFrame, targets: _Targets, wanted: int) -> DataFrame:
    """The same for groups that a task can sort: one shuffle, by key. ``wanted`` is the number of targets."""
    group = Window.partitionBy(*_GROUP)
    upto = group.orderBy(_VALUE).rowsBetween(Window.unboundedPreceding, 0)
    running = rows.repartition(_KEY).select(
        *_GROUP, _VALUE, F.sum(_WEIGHT).over(upto).alias("__upto"), F.sum(_WEIGHT).over(group).alias("__total")
    )
    marked = targets(F.col("__total"))
    least = [
        F.min(F.when(F.col("__upto") >= F.least(marked[i]["at"], F.col("__total")), F.col(_VALUE))).alias(f"__{i}") for i in range(wanted)
    ]
    found = running.groupBy(*_GROUP).agg(*least, F.max("__total").alias("__total"))
    hits = F.array(*[
        F.struct(F.col(f"__{i}").alias("value"), marked[i]["id"].alias("id"), marked[i]["share"].alias("share")) for i in range(wanted)
    ])
    return found.select(*_GROUP, F.inline(hits))


def _order_statistics(rows: DataFrame, sizes: DataFrame, targets: _Targets, wanted: int) -> DataFrame:
    """Each group's order statistics; ``sizes`` has the number of rows ``__rows`` per key."""
    # One key per SORTED_ROWS rows at most.
    large = F.broadcast(sizes.where(F.col("__rows") > SORTED_ROWS).select(_KEY))
    spread = with_cells(rows.join(large, _KEY, "left_semi"))
    return _sorted_statistics(rows.join(large, _KEY, "left_anti"), targets, wanted).unionByName(
        order_statistics_in(locate_bins(bin_weights(spread), targets), spread)
    )


def _target(index: int, at: Column, share: Column) -> Column:
    return F.struct(F.lit(index).alias("id"), at.cast("double").alias("at"), share.cast("double").alias("share"))


def keyed_values(df: DataFrame, keys: list[str], values: list[str], weight: Column) -> DataFrame:
    """One row per value column; only rows with a value and a positive weight."""
    # A struct key compares null-safely in joins, so null keys form groups too.
    key = F.struct(*keys) if keys else F.struct(F.lit(1).alias("__all"))
    each = F.array(*[F.struct(F.lit(i).alias(_COLUMN), finite(v).alias(_VALUE)) for i, v in enumerate(values)])
    long = df.select(key.alias(_KEY), weight.cast("double").alias(_WEIGHT), F.explode(each).alias("__one"))
    return long.select(_KEY, f"__one.{_COLUMN}", f"__one.{_VALUE}", _WEIGHT).where(
        F.col(_VALUE).isNotNull() & (F.col(_WEIGHT) > 0) & ~F.isnan(_WEIGHT)
    )


def quantile_targets(probabilities: list[float]) -> _Targets:
    """Positions on both sides of each probability, with the share of the value there."""

    def targets(total: Column) -> Column:
        wanted = []
        for i, probability in enumerate(probabilities):
            position = F.lit(float(probability)) * (total - 1)
            lower, upper = F.floor(position).cast("double"), F.ceil(position).cast("double")
            exact = lower == upper
            wanted.append(_target(2 * i, lower + 1, F.when(exact, 1.0).otherwise(upper - position)))
            wanted.append(_target(2 * i + 1, upper + 1, F.when(exact, 0.0).otherwise(position - lower)))
        return F.array(*wanted)

    return targets


def probabilities_of(specs: dict[str, dict[str, float]]) -> list[float]:
    return sorted({p for named in specs.values() for p in named.values()})


def quantiles_of_hits(hits: DataFrame, specs: dict[str, dict[str, float]]) -> DataFrame:
    """A row per key from the order statistics at ``quantile_targets``."""
    probabilities = probabilities_of(specs)

    def weighted(column: int, index: int) -> Column:
        chosen = (F.col(_COLUMN) == column) & (F.col("id") == index)
        return F.max(F.when(chosen, F.col("value") * F.col("share")))

    found = []
    for column, named in enumerate(specs.values()):
        for name, probability in named.items():
            i = probabilities.index(probability)
            found.append((weighted(column, 2 * i) + weighted(column, 2 * i + 1)).alias(name))
    return hits.groupBy(_KEY).agg(*found)


def quantile_table(
    df: DataFrame,
    keys: list[str],
    specs: dict[str, dict[str, float]],
    totals: dict[str, Column] | None = None,
    digits: int | None = 2,
) -> DataFrame:
    """Exact linear-interpolated quantiles per group; nulls skipped, empty -> null.

    ``specs`` maps a value column to ``{output name: probability}``; ``totals``
    are further plain aggregates.
    """
    key = F.struct(*keys) if keys else F.struct(F.lit(1).alias("__all"))
    groups = df.groupBy(key.alias(_KEY)).agg(
        *[column.alias(name) for name, column in (totals or {}).items()], F.count("*").alias("__rows")
    )
    probabilities = probabilities_of(specs)
    rows = keyed_values(df, keys, list(specs), F.lit(1.0))
    hits = _order_statistics(rows, groups, quantile_targets(probabilities), 2 * len(probabilities))
    found = groups.join(quantiles_of_hits(hits, specs), _KEY, "left")

    def shown(name: str) -> Column:
        column = F.col(name)
        return (column if digits is None else round_even(column, digits)).alias(name)

    return found.select(
        *[F.col(f"{_KEY}.{k}").alias(k) for k in keys],
        *(totals or {}),
        *[shown(name) for named in specs.values() for name in named],
    )


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: Column | str, name: str) -> DataFrame:
    """Smallest value whose running weight reaches half of the group's weight.

    Only rows with a value and a positive weight count; a group without any has
    no row in the result.
    """
    return weighted_medians(df, keys, {value: name}, weight)


def median_target(total: Column) -> Column:
    return F.array(_target(0, total / 2, F.lit(0.0)))


def medians_of_hits(hits: DataFrame, names: list[str]) -> DataFrame:
    """A row per key from the order statistics at ``median_target``, a column per value column."""
    return hits.groupBy(_KEY).agg(*[F.max(F.when(F.col(_COLUMN) == i, F.col("value"))).alias(name) for i, name in enumerate(names)])


def weighted_medians(df: DataFrame, keys: list[str], names: dict[str, str], weight: Column | str) -> DataFrame:
    """``weighted_median`` of several columns in one pass; a group with any of them has a row."""
    weight = F.col(weight) if isinstance(weight, str) else weight
    rows = keyed_values(df, keys, list(names), weight)
    key = F.struct(*keys) if keys else F.struct(F.lit(1).alias("__all"))
    sizes = df.groupBy(key.alias(_KEY)).agg(F.count("*").alias("__rows"))
    found = medians_of_hits(_order_statistics(rows, sizes, median_target, 1), list(names.values()))
    return found.select(*[F.col(f"{_KEY}.{k}").alias(k) for k in keys], *names.values())


def weighted_mean_of(value: Column, weight: Column) -> Column:
    """Weighted mean aggregate under the same row rules."""
    counted = value.isNotNull() & (weight > 0)
    return F.try_divide(
        F.sum(F.when(counted, value * weight)),
        F.sum(F.when(counted, weight.cast("double"))),
    )


def with_table_weight(df: DataFrame, by: list[str]) -> DataFrame:
    """Add ``weight``: households if the table has any, else population, else 1.

    ``by`` names the columns that tell tables apart (the year).
    """
    flags = df.groupBy(*by).agg(
        (F.count("tax_households") > 0).alias("__by_households"),
        (F.count("population") > 0).alias("__by_population"),
    )
    chosen = (
        F.when(F.col("__by_households"), F.col("tax_households"))
        .when(F.col("__by_population"), F.col("population"))
        .otherwise(F.lit(1.0))
    )
    source = F.when(F.col("__by_households"), "tax_households").when(F.col("__by_population"), "population")
    return (
        df.join(flags, by)
        .withColumn("weight", chosen)
        .withColumn("weight_source", source)
        .drop("__by_households", "__by_population")
    )
