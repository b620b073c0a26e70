"""Text expressions the operators share. All are built-in functions of Spark."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Runs of anything but ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
# Runs of a-z, 0-9 and everything beyond ASCII, in text whose A-Z are lower-cased.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ASCII_BLANKS = " \t\n\x0b\x0c\r"


def whole_text(text: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else changed; pure ASCII takes the fast function."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def all_words(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def repeat_rows(df, copies: str):
    """Every row as often as its long column ``copies`` says, without an array of more than 65,536 numbers."""
    size = 65536
    return (
        df.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(copies) - 1) / size))))
        .withColumn(
            "_copy",
            F.explode(F.sequence(F.col("_chunk") * size, F.least(F.col("_chunk") * size + size, F.col(copies)) - 1)),
        )
        .drop("_chunk")
    )
