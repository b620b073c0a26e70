"""Exact quantiles of rows that arrive in batches, without reading earlier batches again.

Every batch stores its weights per (group, column, bin) and its values, the latter in folders by octave, a run of
neighbouring bins. Weights of all batches add up, so the bins that hold the wanted positions are known from the
small tables alone; only the folders of those bins are read to find the exact values. The result is that of
``quantile_table`` and ``weighted_medians`` over all rows of all batches.

A batch that is written again replaces itself, as a stream does after a failure. Readers see batches whose
weights are complete: these are written after the values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from cadastrum.functions.numbers import round_even
from cadastrum.operators import quantiles as q
from cadastrum.session import materialise

OCTAVE_BITS = 7  # bins per folder, as a power of two: a quarter of a factor of e
_BATCH = StructField("batch", LongType())


@dataclass(frozen=True)
class HistogramStore:
    """Batches of values under ``path``, grouped by ``keys``; ``columns`` are the value columns.

    ``by`` is a key whose values are few (the year): its rows have folders of their own.
    """

    path: str
    keys: tuple[str, ...]
    columns: tuple[str, ...]
    by: str | None = None

    def append(self, df: DataFrame, batch: int, weight: Column | str | None = None) -> None:
        """Adds the rows of a batch; rows without a value or a positive weight do not count."""
        weights = F.lit(1.0) if weight is None else F.col(weight) if isinstance(weight, str) else weight
        rows = q.with_cells(q.keyed_values(df, list(self.keys), list(self.columns), weights))
        folder = F.col(f"{q._KEY}.{self.by}").cast("string") if self.by else F.lit("all")
        octave = F.shiftright("__bin", OCTAVE_BITS).cast("int")
        stored = f"{self.path}/rows/batch={batch}"
        # Equal values meet in their folder, so few files are written to each.
        rows.withColumns({"folder": F.coalesce(folder, F.lit("none")), "octave": octave}).repartition(
            q._COLUMN, "folder", "octave"
        ).write.mode("overwrite").partitionBy(q._COLUMN, "folder", "octave").parquet(stored)
        schema = StructType([*rows.schema, StructField("folder", StringType()), StructField("octave", IntegerType())])
        written = df.sparkSession.read.schema(schema).parquet(stored)
        q.bin_weights(written).write.mode("overwrite").parquet(f"{self.path}/bins/batch={batch}")

    def batches(self, spark: SparkSession) -> list[int]:
        return sorted(r.batch for r in self._bins(spark).select("batch").distinct().collect())

    def _bins(self, spark: SparkSession) -> DataFrame:
        return spark.read.option("basePath", f"{self.path}/bins").parquet(f"{self.path}/bins/batch=*")

    def near(self, spark: SparkSession, targets) -> tuple[DataFrame, DataFrame]:
        """The bins that hold the targets, and the values in the folders of those bins."""
        located = materialise(q.locate_bins(q.bin_weights(self._bins(spark)), targets), "located")
        # Folders of the located bins: a few octaves for each folder and column.
        folder = F.col(f"{q._KEY}.{self.by}").cast("string") if self.by else F.lit("all")
        wanted = located.select(
            F.col(q._COLUMN).alias("column"), F.coalesce(folder, F.lit("none")).alias("folder"),
            F.shiftright("__bin", OCTAVE_BITS).cast("int").alias("octave"),
        ).groupBy("column", "folder").agg(F.sort_array(F.collect_set("octave")).alias("octaves")).collect()
        read = self.rows(spark, self.batches(spark))
        inside = F.lit(False)
        for row in wanted:
            inside |= (F.col(q._COLUMN) == row.column) & (F.col("folder") == row.folder) & F.col("octave").isin(row.octaves)
        return located, read.where(inside)

    def _hits(self, spark: SparkSession, targets) -> DataFrame:
        located, rows = self.near(spark, targets)
        return q.order_statistics_in(located, rows.drop("folder", "octave", "batch"))

    def rows(self, spark: SparkSession, batches: list[int]) -> DataFrame:
        """The stored values of the batches."""
        key = self._bins(spark).schema[q._KEY]
        schema = StructType([
            key, StructField(q._VALUE, DoubleType()), StructField(q._WEIGHT, DoubleType()), StructField("__cell", LongType()),
            StructField("__bin", LongType()), _BATCH, StructField(q._COLUMN, IntegerType()), StructField("folder", StringType()),
            StructField("octave", IntegerType()),
        ])
        paths = [f"{self.path}/rows/batch={batch}" for batch in sorted(batches)]
        return spark.read.schema(schema).option("basePath", f"{self.path}/rows").parquet(*paths)

    def _named(self, found: DataFrame, names: list[Column]) -> DataFrame:
        return found.select(*[F.col(f"{q._KEY}.{k}").alias(k) for k in self.keys], *names)

    def quantiles(self, spark: SparkSession, specs: dict[str, dict[str, float]], digits: int | None = 2) -> DataFrame:
        """Linear-interpolated quantiles per group with a value; ``specs`` as in ``quantile_table``, its columns those of the store."""
        if list(specs) != list(self.columns):
            raise ValueError(f"columns {list(specs)} are not the store's {list(self.columns)}")
        hits = self._hits(spark, q.quantile_targets(q.probabilities_of(specs)))
        found = q.quantiles_of_hits(hits, specs)
        shown = [c if digits is None else round_even(c, digits).alias(c) for named in specs.values() for c in named]
        return self._named(found, shown)

    def weighted_medians(self, spark: SparkSession, names: dict[str, str]) -> DataFrame:
        """As ``quantiles.weighted_medians``; ``names`` maps the store's columns to result names."""
        if list(names) != list(self.columns):
            raise ValueError(f"columns {list(names)} are not the store's {list(self.columns)}")
        found = q.medians_of_hits(self._hits(spark, q.median_target), list(names.values()))
        return self._named(found, list(names.values()))
