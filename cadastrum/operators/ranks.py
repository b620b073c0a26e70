"""Global positions and numbered pages of sorted tables of any size.

Rows are sorted by range, so a table, or a group of it, spreads over tasks. Ids that ascend over the ranges are
stored with the rows; the rows of the ranges before, added up, turn them into positions. No window holds a
group and no task keeps the rows before a page.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadastrum.session import materialise

_RANGE_BITS = 33  # of an ascending id below its range's number


def _placed(df: DataFrame, order: list[Column], partitions: int | None = None) -> DataFrame:
    """``df`` sorted, with an ascending ``__place`` that stays as it is once stored."""
    dealt = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    return dealt.sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id())


def with_position(df: DataFrame, order: list[Column], by: list[str] | None = None, name: str = "position") -> DataFrame:
    """``df`` with each row's place from 1 in its group of ``by``, as ``row_number`` over ``order`` would give it.

    Rows equal in ``by`` and ``order`` take neighbouring places in any order.
    """
    group = F.struct(*by) if by else F.struct(F.lit(1).alias("__all"))
    stored = materialise(_placed(df.withColumn("__group", group), [F.col("__group"), *order]), "placed")
    ranged = stored.withColumn("__range", F.shiftright("__place", _RANGE_BITS))
    counts = ranged.groupBy("__group", "__range").agg(F.min("__place").alias("__first"), F.count("*").alias("__n"))
    # A window over a group's ranges.
    before = Window.partitionBy("__group").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(
        "__group", "__range", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1).alias("__shift")
    )
    return ranged.join(shifts, ["__group", "__range"]).select(
        *df.columns, (F.col("__place") + F.col("__shift")).alias(name)
    )


@dataclass(frozen=True)
class Zones:
    """A sorted table in folders of neighbouring rows, under ``path``, and how many rows each folder has.

    A page by number reads the one or two folders it lies in.
    """

    path: str

    def write(self, df: DataFrame, order: list[Column], partitions: int | None = None) -> Zones:
        rows = _placed(df, order, partitions).withColumn("zone", F.shiftright("__place", _RANGE_BITS))
        # A range is one task, so a folder is one file in order.
        rows = rows.withColumn("place", F.col("__place").bitwiseAND((1 << _RANGE_BITS) - 1)).drop("__place")
        rows.limit(0).write.parquet(f"{self.path}/shape")  # the columns, also of a table without rows
        rows.write.partitionBy("zone").parquet(f"{self.path}/rows")
        counts = self.rows(df.sparkSession).groupBy("zone").agg(F.count("*").alias("rows"))
        counts.coalesce(1).write.parquet(f"{self.path}/counts")
        return self

    def rows(self, spark: SparkSession) -> DataFrame:
        """All rows, with their zone and place in it."""
        return spark.read.schema(spark.read.parquet(f"{self.path}/shape").schema).parquet(f"{self.path}/rows")

    def zones_of(self, spark: SparkSession, offset: int, limit: int) -> dict[int, int]:
        """The zones that hold rows offset to offset + limit, with the number of rows before each."""
        counts = spark.read.parquet(f"{self.path}/counts")
        # A row per folder; only those of the page come to the driver.
        before = F.coalesce(F.sum("rows").over(Window.orderBy("zone").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = counts.select("zone", "rows", before.alias("before"))
        found = placed.where((F.col("before") < offset + limit) & (F.col("before") + F.col("rows") > offset)).collect()
        return {r.zone: r.before for r in found}

    def total(self, spark: SparkSession) -> int:
        return spark.read.parquet(f"{self.path}/counts").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]

    def page(self, spark: SparkSession, offset: int, limit: int) -> DataFrame:
        """The rows from ``offset`` on, in order, with their ``position`` from 0."""
        rows = self.rows(spark)
        inside, position = F.lit(False), F.lit(None).cast("long")
        for zone, before in sorted(self.zones_of(spark, offset, limit).items()):
            places = (F.col("place") >= max(0, offset - before)) & (F.col("place") < offset + limit - before)
            inside |= (F.col("zone") == zone) & places
            position = F.when(F.col("zone") == zone, F.col("place") + before).otherwise(position)
        return rows.where(inside).withColumn("position", position).drop("zone", "place").orderBy("position")
