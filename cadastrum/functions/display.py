"""Display text for a French reader."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "—"
GROUP_SEPARATOR = "\u202f"


def display_number(column: Column, digits: int = 2) -> Column:
    """At most ``digits`` decimals, decimal comma, narrow space between thousands."""
    pattern = "#,##0" + ("." + "#" * digits if digits else "")
    text = F.call_function("format_number", F.round(column.cast("double"), digits), F.lit(pattern))
    localised = F.translate(text, ",.", GROUP_SEPARATOR + ",")
    return F.when(column.isNull() | F.isnan(column.cast("double")), MISSING).otherwise(localised)


def display_boolean(column: Column) -> Column:
    return F.when(column, "Oui").when(~column, "Non").otherwise(MISSING)


def iso_day(text: Column) -> Column:
    """``dd/MM/yyyy`` text as ``yyyy-MM-dd``; other text unchanged."""
    parts = F.split(text, "/")
    french = text.rlike("^[0-9]{2}/[0-9]{2}/[0-9]{4}$")
    return F.when(french, F.concat_ws("-", parts[2], parts[1], parts[0])).otherwise(text)


def display_date(column: Column) -> Column:
    """ISO or French day text -> ``dd-MM-yyyy``; other readable dates too, else the text."""
    text = F.trim(F.coalesce(column.cast("string"), F.lit("")))
    shown = F.coalesce(F.date_format(iso_day(text).try_cast("timestamp"), "dd-MM-yyyy"), text)
    return F.when(text == "", MISSING).otherwise(shown)


def display_text(column: Column) -> Column:
    text = column.cast("string")
    return F.when(text.isNull() | (text == ""), MISSING).otherwise(text)
