"""Mixing sources to target weights by hash-threshold histograms.

Sizes are summed by source and hash bucket. A running sum over a source's buckets
finds the one in which its budget ends; only that bucket is summed again by finer
buckets, and so on for ``LEVELS`` levels. The result is one threshold per source:
a document is taken if its hash lies below. No rows are sorted, larger budgets take
supersets of smaller ones, and reruns take the same documents.

A budget above a source's own size takes every document once per full size and the
documents below the threshold once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastrum.llm.expressions import SPACED_WORD, repeat_rows
from cadastrum.session import materialise

BUCKET_BITS = 12
LEVELS = 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def mix_hash(*columns: str | Column) -> Column:
    """The leading ``LEVELS * BUCKET_BITS`` bits of a row's hash, as a long."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - LEVELS * BUCKET_BITS)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) with ``target``.

    Sources by code point, null last, take the weights in turn and split ``share`` of all
    sizes; no target exceeds ``most`` times its source, and what is above is shared among
    the others by weight. In the order of cap per weight the capped sources come first, so
    two running sums give the level at which the rest is filled. One row per source
    passes these windows.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double"))
    capped = weighed.withColumn("_cap", F.col("source_size") * most).withColumn("_full_at", F.col("_cap") / F.col("_weight"))
    everything = Window.partitionBy()
    fill = Window.orderBy("_full_at", F.col("source").asc_nulls_last())
    earlier = fill.rowsBetween(Window.unboundedPreceding, -1)
    later = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (
        F.sum("source_size").over(everything) * share - F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0))
    ) / F.sum("_weight").over(later)
    levelled = capped.withColumn("_level", level)
    water = F.max(F.when(F.col("_level") <= F.col("_full_at"), F.col("_level"))).over(everything)
    return levelled.withColumn("_water", water).select(
        "source", "source_size", F.least("_cap", F.coalesce(F.col("_water") * F.col("_weight"), F.col("_cap"))).alias("target")
    )


def mix_plan(rows: DataFrame, **settings) -> DataFrame:
    """One row per source of ``rows`` (source, size, mix_hash): targets, full passes and the hash threshold.

    ``rows`` is read once per level, so it should be a stored narrow table.
    """
    def bucket(level: int) -> Column:
        return F.shiftrightunsigned("mix_hash", (LEVELS - level) * BUCKET_BITS).cast("long")

    first = materialise(
        rows.groupBy("source", bucket(1).alias("bucket")).agg(F.sum("size").alias("size")), "mix-histogram"
    )
    sources = materialise(
        source_targets(first.groupBy("source").agg(F.sum("size").alias("source_size")), **settings)
        .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size")),
        "mix-sources",
    )
    running = Window.partitionBy("source").orderBy("bucket")

    def boundary(histogram: DataFrame, budgets: DataFrame) -> DataFrame:
        """Per source the bucket in which the budget ends, its size, and what is left of the budget before it."""
        summed = histogram.withColumn("upto", F.sum("size").over(running)).alias("h")
        joined = summed.join(budgets.alias("b"), F.col("h.source").eqNullSafe(F.col("b.source")))
        inside = (F.col("upto") > F.col("budget")) & (F.col("upto") - F.col("size") <= F.col("budget"))
        return joined.where(inside).select(
            "h.source", "bucket", "size", (F.col("budget") - (F.col("upto") - F.col("size"))).alias("budget")
        )

    ends = materialise(boundary(first, sources.select("source", "budget")), "mix-boundary")
    for level in range(2, LEVELS + 1):
        inner = rows.alias("r").join(
            ends.alias("e"),
            F.col("r.source").eqNullSafe(F.col("e.source")) & (bucket(level - 1) == F.col("e.bucket")),
            "left_semi",
        )
        finer = inner.groupBy("source", bucket(level).alias("bucket")).agg(F.sum("size").alias("size"))
        ends = materialise(boundary(finer, ends.select("source", "budget")), "mix-boundary")
    # The last bucket is taken whole if that comes nearer to the budget.
    threshold = F.col("bucket") + F.when(F.col("budget") * 2 > F.col("size"), 1).otherwise(0)
    ended = ends.select(F.col("source").alias("_source"), threshold.alias("threshold"))
    planned = sources.join(ended, F.col("source").eqNullSafe(F.col("_source")), "left")
    return materialise(
        planned.select("source", "source_size", "target", F.col("passes").cast("long").alias("passes"),
                       F.coalesce("threshold", F.lit(0).cast("long")).alias("threshold")),
        "mix-plan",
    )


def take(rows: DataFrame, plan: DataFrame, most: int = 2) -> DataFrame:
    """``rows`` (source, mix_hash, ...) with ``source_size``, ``target`` and ``copies``, how often the mix takes each.

    The plan has one row per source; Spark broadcasts it if its stored size is below the
    session's threshold and splits the hot sources of a sort-merge join otherwise.
    """
    copies = F.col("passes") + F.when(F.col("mix_hash") < F.col("threshold"), 1).otherwise(0)
    keyed = plan.withColumnRenamed("source", "_source")
    return (
        rows.join(keyed, rows["source"].eqNullSafe(keyed["_source"]))
        .withColumn("copies", F.least(copies, F.lit(most)).cast("long"))
        .drop("_source", "passes", "threshold")
    )


def mix_rows(rows: DataFrame, **settings) -> DataFrame:
    """``rows`` (source, size, mix_hash, ...; stored) with source_size, target and copies.

    Null is a source of its own. Rows without words have size 0 and are taken like others.
    Rows with one hash (equal key and text) share their fate. An empty table gives no rows.
    """
    return take(rows, mix_plan(rows, **settings))


def mix_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **settings) -> DataFrame:
    """The mixed documents: every row of ``docs`` as often as the mix takes it, its columns unchanged."""
    hashed = mix_hash(key, text)
    rows = materialise(
        docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size"), hashed.alias("mix_hash")),
        "mix-rows",
    )
    plan = mix_plan(rows, **settings)
    inner = docs.select(F.struct(*docs.columns).alias("_row"), F.col(source).alias("source"), hashed.alias("mix_hash"))
    taken = take(inner, plan).where("copies > 0")
    return repeat_rows(taken.select("_row", "copies"), "copies").select("_row.*")
