"""Searches that read postings first and then only the folders that can match.

The table lies in zones, folders of neighbouring rows. For every three characters in a row (trigram) of the lower-cased
search columns the index lists the zones that hold them. A pattern ``%text%`` can only match in zones
that hold all trigrams of its literal parts, so these lists are intersected and the condition itself is checked on the rows of what is
left. Patterns without three literal characters in a row (a short text, ``a%b_c``) say nothing about zones and read all.

The result is that of the condition on the whole table, ``%`` and ``_`` included.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastrum.functions.text import like_any
from cadastrum.operators.ranks import Zones

SHARDS = 64


def pattern_trigrams(query: str) -> list[str]:
    """Trigrams that a text must hold to match ``%query%``."""
    parts = re.split("[%_]", query.strip().lower())
    return sorted({part[i : i + 3] for part in parts for i in range(len(part) - 2)})


def _trigrams(column: str) -> Column:
    text = F.lower(F.coalesce(F.col(column).cast("string"), F.lit("")))
    places = F.sequence(F.lit(1), F.length(text) - 2)
    found = F.transform(places, lambda i: F.substring(text, i, 3))
    return F.when(F.length(text) >= 3, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def _shard(trigram: Column) -> Column:
    return F.pmod(F.xxhash64(trigram), F.lit(SHARDS)).cast("int")


@dataclass(frozen=True)
class SearchIndex:
    """A table in zones under ``path``, searched in ``columns``."""

    path: str
    columns: tuple[str, ...]

    @property
    def zones(self) -> Zones:
        return Zones(f"{self.path}/table")

    def write(self, df: DataFrame, order: list[Column], partitions: int | None = None) -> SearchIndex:
        """Stores ``df`` in order, and its postings. Neighbouring rows that resemble each other make short lists."""
        self.zones.write(df, order, partitions)
        each = [
            self.zones.rows(df.sparkSession).select("zone", F.explode(_trigrams(column)).alias("trigram")) for column in self.columns
        ]
        every = each[0]
        for more in each[1:]:
            every = every.unionAll(more)
        # Repeats go before the shuffle.
        postings = every.distinct().withColumn("shard", _shard(F.col("trigram")))
        postings.repartition("shard").sortWithinPartitions("shard", "trigram").write.partitionBy("shard").parquet(f"{self.path}/postings")
        return self

    def candidates(self, spark: SparkSession, query: str) -> DataFrame | None:
        """The zones (``zone``) that hold all trigrams of the pattern; null where it has none."""
        wanted = pattern_trigrams(query)
        if not wanted:
            return None
        postings = spark.read.schema("zone long, trigram string, shard int").parquet(f"{self.path}/postings")
        asked = F.array(*[F.lit(t) for t in wanted])
        # Constant, so Catalyst folds it and only these folders are read.
        return (
            postings.where(F.col("shard").isin(_shards_of(spark, wanted)) & F.array_contains(asked, F.col("trigram")))
            .groupBy("zone").agg(F.count("*").alias("held")).where(F.col("held") == len(wanted)).select("zone")
        )

    def search(self, spark: SparkSession, query: str) -> DataFrame:
        """The rows any of whose columns is like ``%query%``, case-blind. A blank query gives all rows."""
        rows = self.zones.rows(spark)
        found = self.candidates(spark, query)
        if found is not None:
            # At most a row per folder, which the listing of the table holds too.
            rows = rows.join(F.broadcast(found), "zone", "left_semi")
        return rows.where(like_any(list(self.columns), query)).drop("zone", "place")


def _shards_of(spark: SparkSession, trigrams: list[str]) -> list[int]:
    row = spark.range(1).select(F.array(*[_shard(F.lit(t)) for t in trigrams])).first()
    return sorted(set(row[0]))
