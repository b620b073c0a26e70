"""Canonical schemas. Everything is nullable; types match the published tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DataType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from cadastrum.functions.numbers import finite
from cadastrum.functions.text import blank_to_null


def _struct(columns: dict[str, DataType]) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in columns.items()])


SALES_TEXT = ("nature_mutation", "type_local", "code_departement", "code_commune", "nom_commune")
SALES_NUMBERS = (
    "valeur_fonciere",
    "surface_reelle_bati",
    "nombre_pieces_principales",
    "surface_terrain",
    "longitude",
    "latitude",
)
# The canonical sales columns in their order.
SALES_COLUMNS = (
    "nature_mutation",
    "type_local",
    "valeur_fonciere",
    "surface_reelle_bati",
    "nombre_pieces_principales",
    "surface_terrain",
    "longitude",
    "latitude",
    "code_departement",
    "code_commune",
    "nom_commune",
)

# The income indicators in their published order.
INDICATORS = (
    "median_income",
    "d1_income",
    "d2_income",
    "d3_income",
    "d4_income",
    "d5_income",
    "d6_income",
    "d7_income",
    "d8_income",
    "d9_income",
    "poverty_rate",
    "tax_households",
    "population",
)
INCOME_SILVER = _struct(
    {
        "commune_code": StringType(),
        "commune_name": StringType(),
        "department_code": StringType(),
        **{name: DoubleType() for name in INDICATORS},
        "year": LongType(),
    }
)
INCOME_GOLD = _struct(
    {
        "geography_code": StringType(),
        "geography_name": StringType(),
        "geography_level": StringType(),
        "year": LongType(),
        "dispositif": StringType(),
        "source_generation": StringType(),
        "indicator_source": StringType(),
        "is_official": BooleanType(),
        "methodology_version": StringType(),
        "comparable_with_previous_years": BooleanType(),
        **{name: DoubleType() for name in INDICATORS},
    }
)


def _conformed(df: DataFrame, field: StructField) -> Column:
    if field.name not in df.columns:
        return F.lit(None).cast(field.dataType).alias(field.name)
    column = F.col(field.name)
    if isinstance(field.dataType, StringType):
        column = blank_to_null(column)
    elif isinstance(field.dataType, DoubleType):
        text = isinstance(df.schema[field.name].dataType, StringType)
        column = finite(F.trim(column).try_cast("double")) if text else finite(column)
    elif isinstance(df.schema[field.name].dataType, StringType):
        column = F.trim(column).try_cast(field.dataType)
    else:
        column = column.cast(field.dataType)
    return column.alias(field.name)


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Exactly the schema's columns, in its order and types; absent ones are null."""
    return df.select([_conformed(df, field) for field in schema.fields])


def missing_columns(df: DataFrame, required: list[str] | tuple[str, ...]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: list[str] | tuple[str, ...], what: str) -> DataFrame:
    absent = missing_columns(df, required)
    if absent:
        raise ValueError(f"{what} is missing required columns: {', '.join(absent)}")
    return df
