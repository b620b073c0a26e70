"""Stored tables cut into buckets by key: joins on the whole key read them without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def write_buckets(df: DataFrame, table: str, path: str, keys: list[str], buckets: int) -> DataFrame:
    """Store ``df`` under ``path`` as the bucketed ``table``: one file per bucket, sorted by the keys.

    The one shuffle happens here. Tables meant to be joined need the same number of buckets. Rows with null keys
    are stored like all others. An existing table of that name is replaced; its files are those of ``path``.
    """
    rows = df.repartition(buckets, *keys)
    rows.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def read_buckets(spark: SparkSession, table: str, path: str, schema: StructType, keys: list[str], buckets: int) -> DataFrame:
    """The table that another session stored under ``path``; it is named here if this session's catalogue lacks it."""
    if not spark.catalog.tableExists(table):
        columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in schema)
        by = ", ".join(f"`{key}`" for key in keys)
        spark.sql(
            f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
    return spark.table(table)
