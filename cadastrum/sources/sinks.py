"""Sinks: yearly Parquet folders, exclusive series, JSON documents, CSV reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, FloatType, TimestampNTZType, TimestampType


class EmptyOutput(RuntimeError):
    pass


def write_years(df: DataFrame, path: str, refuse_empty: bool = True, rebalance: bool = False) -> int:
    """Replace just the year folders present in ``df``; the job commits as a whole.

    Rows are counted while they are written. An empty result replaces nothing
    and is refused. ``rebalance`` evens out file sizes, splitting a huge year.
    """
    seen = Observation(f"written-{uuid.uuid4().hex[:8]}")
    rows = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    if rebalance:
        rows = rows.hint("rebalance", F.col("year"))
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("year")
        .parquet(path)
    )
    written = seen.get["rows"]
    if refuse_empty and written == 0:
        raise EmptyOutput(f"no rows were written to {path}")
    return written


def write_series(df: DataFrame, path: str, series: str) -> int:
    """Store a year's rows as either the official or the derived series.

    ``series`` is a column inside the year folder, not a folder of its own: the
    overwrite of the year therefore removes whichever series was there before.
    """
    return write_years(df.withColumn("series", F.lit(series)), path)


def json_safe(df: DataFrame) -> DataFrame:
    """NaN -> null; dates and times -> ISO text."""
    safe = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, (DoubleType, FloatType)):
            column = F.when(~F.isnan(column), column)
        elif isinstance(field.dataType, DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(field.dataType, (TimestampType, TimestampNTZType)):
            moment = column.cast("timestamp_ntz")
            has_fraction = F.date_format(moment, "SSSSSS") != "000000"
            column = F.when(
                has_fraction, F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
            ).otherwise(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"))
        safe.append(column.alias(field.name))
    return df.select(safe)


def as_document(df: DataFrame) -> DataFrame:
    """Each row as one JSON text; null fields are kept as ``null``."""
    fields = F.struct(*[F.col(name) for name in json_safe(df).columns])
    return json_safe(df).select(F.to_json(fields, {"ignoreNullFields": "false"}).alias("document"))


def write_documents(documents: DataFrame, path: str) -> None:
    documents.select("document").write.mode("overwrite").text(path)


def write_csv_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
