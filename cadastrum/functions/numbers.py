"""Number and code expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters a plain number may hold; a cast alone would also take 1d, NaN, Infinity.
_NUMBER_CHARACTERS = "0123456789.+-eE\t\r\n"


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def finite(column: Column | str) -> Column:
    """Double value with NaN turned into null."""
    value = _col(column).cast("double")
    return F.when(~F.isnan(value), value)


def french_number(column: Column | str) -> Column:
    """``12 345,60`` -> 12345.6; blank, secret (``s``) and unreadable text -> null."""
    return plain_number(F.translate(_col(column).cast("string"), ",\u00a0 ", "."))


def plain_number(text: Column) -> Column:
    """Double value of decimal-point text, else null; no regular expression needed."""
    return F.when(F.translate(text, _NUMBER_CHARACTERS, "") == "", text.try_cast("double"))


def round_even(column: Column | str, digits: int = 2) -> Column:
    """Half-to-even rounding of the scaled double."""
    scale = float(10**digits)
    return F.rint(_col(column) * F.lit(scale)) / F.lit(scale)


def full_commune_code(commune: Column | str, department: Column | str) -> Column:
    """Prefix a commune number of one to three characters with its department."""
    code = F.trim(F.coalesce(_col(commune), F.lit("")))
    owner = F.trim(F.coalesce(_col(department), F.lit("")))
    return F.when(F.length(code).between(1, 3), F.concat(owner, F.lpad(code, 3, "0"))).otherwise(code)


def department_of(commune: Column | str) -> Column:
    """Department part of a commune code: three characters overseas, else two."""
    code = F.upper(F.trim(_col(commune)))
    overseas = (code.startswith("97") | code.startswith("98")) & (F.length(code) >= 3)
    return F.when(code != "", F.when(overseas, F.substring(code, 1, 3)).otherwise(F.substring(code, 1, 2)))


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient, null on a zero denominator."""
    return F.try_divide(_col(numerator).cast("double"), _col(denominator).cast("double"))
