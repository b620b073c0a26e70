"""Typed column filters of the table view, as predicates Catalyst can combine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastrum.functions.display import iso_day
from cadastrum.functions.numbers import plain_number
from cadastrum.functions.text import bound
from cadastrum.text_constants import FALSE_TOKENS, TRUE_TOKENS


def _text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def number_of(column: Column) -> Column:
    """Number in a cell; the first comma counts as decimal point; else null."""
    # A second comma stays and makes the cell unreadable.
    return bound(F.regexp_replace(F.trim(_text(column)), "^([^,]*),", "$1."), plain_number)


def moment_of(column: Column) -> Column:
    """ISO or French (``dd/MM/yyyy``) day or time in a cell; else null."""
    return bound(F.trim(_text(column)), lambda text: iso_day(text).try_cast("timestamp"))


def boolean_of(column: Column) -> Column:
    token = F.lower(F.trim(_text(column)))
    return F.when(token.isin(*TRUE_TOKENS), True).when(token.isin(*FALSE_TOKENS), False)


_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
_MOMENTS = ("date", "timestamp", "timestamp_ntz")


def _typed_within(cell: Column, low: Column | None, high: Column | None) -> Column:
    """Range over a column of the bounds' own type. The bounds are constants, so the scan takes them.

    Without any bound every cell passes; a bound that cannot be read is null and does not limit.
    """
    if low is None and high is None:
        return F.lit(True)
    inside = cell.isNotNull()
    if low is not None:
        inside = inside & (low.isNull() | (cell >= low))
    if high is not None:
        inside = inside & (high.isNull() | (cell <= high))
    return inside


def _number_bound(text: str) -> Column | None:
    return plain_number(F.regexp_replace(F.lit(text.strip()), "^([^,]*),", "$1.")) if text else None


def _moment_bound(text: str, data_type: str) -> Column | None:
    return iso_day(F.lit(text.strip())).try_cast("timestamp").cast(data_type) if text else None


def _within(value: Column, low: Column | None, high: Column | None) -> Column:
    """Range predicate. Without any bound every cell passes, else unreadable ones fail."""
    if low is None and high is None:
        return F.lit(True)

    def inside(cell: Column) -> Column:
        # A bound that cannot be read is null and does not limit.
        at_least = F.lit(True) if low is None else F.coalesce(cell >= low, low.isNull())
        at_most = F.lit(True) if high is None else F.coalesce(cell <= high, high.isNull())
        return cell.isNotNull() & at_least & at_most

    return bound(value, inside)


def matches(
    column: str,
    kind: str,
    *,
    data_type: str = "string",
    minimum: str = "",
    maximum: str = "",
    start: str = "",
    end: str = "",
    boolean: str = "all",
    text: str = "",
) -> Column:
    """Predicate for one column's filter; ``kind`` as in the column catalogue.

    With the column's ``data_type`` numbers, times and booleans are compared as they are;
    only texts are parsed.
    """
    cell = F.col(column)
    if kind == "number-range" and data_type.startswith(_NUMBERS):
        known = _typed_within(cell, _number_bound(minimum), _number_bound(maximum))
        return known & ~F.isnan(cell) if data_type in ("float", "double") and (minimum or maximum) else known
    if kind == "date-range" and data_type in _MOMENTS:
        return _typed_within(cell, _moment_bound(start, data_type), _moment_bound(end, data_type))
    if kind == "boolean-select" and data_type == "boolean":
        return F.lit(True) if boolean == "all" else F.coalesce(cell == F.lit(boolean == "true"), F.lit(False))
    if kind == "number-range":
        low, high = (number_of(F.lit(bound)) if bound else None for bound in (minimum, maximum))
        return _within(number_of(cell), low, high)
    if kind == "date-range":
        low, high = (moment_of(F.lit(bound)) if bound else None for bound in (start, end))
        return _within(moment_of(cell), low, high)
    if kind == "boolean-select":
        if boolean == "all":
            return F.lit(True)
        return F.coalesce(boolean_of(cell) == F.lit(boolean == "true"), F.lit(False))
    return F.contains(F.lower(_text(cell)), F.lower(F.lit(text.strip())))


def where_matches(df: DataFrame, column: str, kind: str, **bounds: str) -> DataFrame:
    """``df`` filtered by one column, compared by the column's own type."""
    return df.where(matches(column, kind, data_type=dict(df.dtypes)[column], **bounds))


def any_column_contains(columns: list[str], query: str) -> Column:
    """Case-blind containment in any column; a blank query keeps all rows."""
    wanted = query.strip().lower()
    if not wanted:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [F.contains(F.lower(_text(F.col(c))), F.lit(wanted)) for c in columns])
