"""Yearly tables published all at once.

Data go to a numbered folder, ``data/version=N/year=YYYY``. A version counts once its pointer exists:
one small file, ``pointers/version=N``, that Spark's committer renames into place last. It names the folder of every
year, so a version that replaces one year refers to the folders of earlier versions for the others. Readers resolve
the pointer once and then read only the folders it names: a writer at work, or one that
stopped half-way, changes nothing for them. Two writers of the same number meet at the pointer, where the second
one fails.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cadastrum.session import small_table
from cadastrum.sources.sinks import EmptyOutput

_POINTER = "year bigint, data_version bigint, rows bigint, fingerprint string"


@dataclass(frozen=True)
class Year:
    """Where a year's rows lie, how many there are, and what they were made from."""

    version: int
    rows: int
    fingerprint: str


@dataclass(frozen=True)
class Snapshot:
    path: str
    version: int = 0
    years: dict[int, Year] = field(default_factory=dict)

    def read(self, spark: SparkSession, schema: StructType | None = None) -> DataFrame:
        """The rows of this version, whatever is published meanwhile."""
        folders = [f"{self.path}/data/version={y.version}/year={year}" for year, y in sorted(self.years.items()) if y.rows]
        reader = spark.read.option("basePath", f"{self.path}/data")
        if not folders:
            if schema is None:
                raise EmptyOutput(f"{self.path} has no rows")
            return spark.createDataFrame([], schema)
        reader = reader.schema(schema) if schema else reader.option("mergeSchema", True)
        return reader.parquet(*folders).withColumn("year", F.col("year").cast("long")).drop("version")


def current(spark: SparkSession, path: str) -> Snapshot:
    """The last published version; version 0 without years where there is none."""
    try:
        pointers = spark.read.schema(f"{_POINTER}, version bigint").json(f"{path}/pointers")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return Snapshot(path)
        raise
    # A row per year and version; the folder is a partition, so only the last one's file is read for its rows.
    version = pointers.agg(F.max("version")).first()[0]
    if version is None:
        return Snapshot(path)
    rows = pointers.where(F.col("version") == version).collect()
    return Snapshot(path, version, {r.year: Year(r.data_version, r.rows, r.fingerprint) for r in rows if r.year is not None})


def publish(
    df: DataFrame | None, path: str, fingerprints: dict[int, str], keep: Collection[int] | None = None, refuse_empty: bool = True
) -> Snapshot:
    """Replaces the years of ``fingerprints`` by the rows of ``df`` and gives the new version.

    Other years stay as they are, or only those in ``keep``. No rows at all are refused before the pointer is
    written. A year without rows is remembered with its fingerprint.
    """
    if df is None:
        raise EmptyOutput(f"nothing to publish to {path}")
    spark = df.sparkSession
    before = current(spark, path)
    version = before.version + 1
    target = f"{path}/data/version={version}"
    # A version that was never published may have left files.
    df.where(F.col("year").isin(list(fingerprints))).write.mode("overwrite").option(
        "partitionOverwriteMode", "static"
    ).partitionBy("year").parquet(target)
    try:
        counts = spark.read.parquet(target).groupBy(F.col("year").cast("long").alias("year")).count().collect()
    except AnalysisException as error:  # no file at all
        if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        counts = []
    written = {r["year"]: r["count"] for r in counts}
    if refuse_empty and not sum(written.values()):
        raise EmptyOutput(f"no rows were written to {path}")
    kept = {y: v for y, v in before.years.items() if keep is None or y in keep}
    years = kept | {y: Year(version, written.get(y, 0), print_) for y, print_ in fingerprints.items()}
    return _point(spark, Snapshot(path, version, years))


def forget(spark: SparkSession, path: str, keep: Collection[int]) -> Snapshot:
    """A version without the years that are not in ``keep``."""
    before = current(spark, path)
    years = {y: v for y, v in before.years.items() if y in keep}
    return before if years == before.years else _point(spark, Snapshot(path, before.version + 1, years))


def _point(spark: SparkSession, snapshot: Snapshot) -> Snapshot:
    rows = [(y, v.version, v.rows, v.fingerprint) for y, v in sorted(snapshot.years.items())] or [(None, None, None, None)]
    pointer = small_table(spark, rows, _POINTER).coalesce(1)
    pointer.write.mode("error").json(f"{snapshot.path}/pointers/version={snapshot.version}")
    return snapshot
