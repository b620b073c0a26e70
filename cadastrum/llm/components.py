"""Connected components by alternating large-star and small-star steps.

Every step is a minimum per node (combined before the shuffle) and a join back to
the node's links. The hub of a large component has a great share of all links, so
the links of hubs are not dealt by node: the minima of the few nodes that have more than a
fixed share of all link ends go to the links by broadcast, only those of other nodes by a
shuffle. Repeated links go before each join.

Each step is written to the shared checkpoint folder, so the plan stays short
and a lost executor costs one step at most. No edge list reaches the driver,
only its count and checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastrum.session import materialise

HUBS = 4096


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(child, parent))"), F.sum(F.col("child") % 1000003)).first()
    return tuple(row)


def _with_least(rows: DataFrame, links: int) -> DataFrame:
    """``rows`` (node, other) with ``least``, the node's least other one. ``rows`` has up to twice ``links`` rows.

    Fewer than ``HUBS`` nodes can have more than their limit of all rows, whatever ``links`` is.
    """
    ends = rows.groupBy("node").agg(F.min("other").alias("least"), F.count(F.lit(1)).alias("degree"))
    limit = 2 * links / HUBS
    hubs = ends.where(F.col("degree") > limit).select("node", F.col("least").alias("hub_least"))
    marked = rows.join(F.broadcast(hubs), "node", "left")
    usual = marked.where("hub_least IS NULL").drop("hub_least").join(
        ends.where(F.col("degree") <= limit).select("node", "least"), "node"
    )
    return marked.where("hub_least IS NOT NULL").withColumnRenamed("hub_least", "least").unionByName(usual)


def _large_star(edges: DataFrame, links: int) -> DataFrame:
    both = edges.union(edges.select("parent", "child")).toDF("node", "other")
    return _with_least(both, links).where(F.col("other") > F.col("node")).select(
        F.col("other").alias("child"), F.least("node", "least").alias("parent")
    ).distinct()


def _small_star(edges: DataFrame, links: int) -> DataFrame:
    """``edges`` run from the greater to the smaller node; a node keeps its link to the least, the others move there."""
    known = _with_least(edges.toDF("node", "other"), links)
    child = F.when(F.col("other") > F.col("least"), F.col("other")).otherwise(F.col("node"))
    return known.select(child.alias("child"), F.col("least").alias("parent")).distinct()


def connected_components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``links`` (two long columns) that is not itself a root.

    The root is the least node of the component. Self-links, repeated links and
    an empty table are fine; null ends are skipped.
    """
    a, b = links.columns
    edges = materialise(
        links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("child"), F.least(a, b).alias("parent")).distinct(),
        "links",
    )
    before = _signature(edges)
    for _ in range(rounds if before[0] else 0):
        stars = materialise(_large_star(edges, before[0]), "stars")
        edges = materialise(_small_star(stars, before[0]), "links")
        after = _signature(edges)
        if after == before:
            return edges.toDF("node", "root")
        before = after
    if before[0]:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.toDF("node", "root")
