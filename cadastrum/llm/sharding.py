"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a ring of 2^``ring_bits`` cells; a key belongs
to the first point clockwise of its hash. Each shard takes its exact share of the
rows (counts at most one apart). Keys that reach a full shard go on clockwise to the
next shard with room, so only the overflow leaves its home shard.

Loads are counted per arc between two points, and the walk around the ring needs only
these counts: ``n_shards * vnodes`` numbers, whatever the number of rows. A row then
finds its shard from its rank in its arc, which is the rank in its cell plus the
counts of the cells before. Equal rows are collapsed to one with a count before any
window, so a hot key is one row there. Windows hold one cell, about 1 / 65,536 of
the distinct rows with the default bits; raise ``ring_bits`` for more.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadastrum.llm.expressions import repeat_rows
from cadastrum.session import materialise, small_table

MAX_POINTS = 65536


def ring_points(n_shards: int, vnodes: int, ring_bits: int) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise. A shard's points do not depend on the other shards."""

    def cell(shard: int, copy: int) -> int:
        digest = hashlib.blake2b(f"{shard}/{copy}".encode(), digest_size=8).digest()
        return int.from_bytes(digest, "big") >> (64 - ring_bits)

    return sorted((cell(shard, copy), shard) for shard in range(n_shards) for copy in range(vnodes))


def place_overflow(loads: list[int], owners: list[int], n_shards: int) -> list[tuple[int, int, int, int]]:
    """One walk around the ring: (arc, first rank, shard, first slot) of every run of keys.

    ``loads`` are the keys of each arc in ring order, ``owners`` the shard at its end.
    """
    total = sum(loads)
    room = [total // n_shards + (shard < total % n_shards) for shard in range(n_shards)]
    used = [0] * n_shards
    runs = []
    for arc, waiting in enumerate(loads):
        rank, step = 0, arc
        while waiting:
            shard = owners[step % len(owners)]
            taken = min(waiting, room[shard] - used[shard])
            if taken:
                runs.append((arc, rank, shard, used[shard]))
                used[shard] += taken
                rank += taken
                waiting -= taken
            step += 1
    return runs


def assign_shards(
    rows: DataFrame, key: list[str], n_shards: int = 8, vnodes: int = 256, ring_bits: int = 16
) -> DataFrame:
    """``rows`` with ``home_shard``, ``shard`` and ``slot`` (gapless from 0 in each shard).

    ``rows`` should be narrow: a key and what describes it; wide payloads are joined by key
    afterwards. Null keys hash like any value. Equal rows each get a slot of their own.
    Fewer rows than shards leave the last shards empty; an empty table gives no rows. A column
    with a result's name gives way to it.
    """
    if n_shards * vnodes > MAX_POINTS:
        raise ValueError(f"at most {MAX_POINTS} ring points, their loads are summed on the driver")
    spark = rows.sparkSession
    columns = [name for name in rows.columns if name not in ("home_shard", "shard", "slot")]
    points = ring_points(n_shards, vnodes, ring_bits)
    size = 1 << ring_bits
    arcs, before = [], points[-1][0] - size
    for arc, (cell, shard) in enumerate(points):
        if cell > before:
            arcs.append((arc, shard, before + 1, cell))
        before = cell
    cells = small_table(spark, arcs, "_arc int, home_shard int, _first int, _last int").select(
        "_arc", "home_shard", F.posexplode(F.sequence("_first", "_last")).alias("_turn", "_at")
    ).select("_arc", "home_shard", "_turn", F.pmod("_at", F.lit(size)).alias("_cell"))

    stored = materialise(
        rows.select(F.struct(*columns).alias("_row"), F.xxhash64(*key).alias("_position"))
        .groupBy("_row", "_position")
        .agg(F.count(F.lit(1)).alias("_copies"))
        .withColumn("_cell", F.shiftrightunsigned("_position", 64 - ring_bits).cast("int")),
        "shard-keys",
    )
    ahead = Window.partitionBy("_arc").orderBy("_turn").rowsBetween(Window.unboundedPreceding, -1)
    counted = materialise(
        stored.groupBy("_cell").agg(F.sum("_copies").alias("_load")).join(cells, "_cell")
        .withColumn("_cell_start", F.coalesce(F.sum("_load").over(ahead), F.lit(0))),
        "shard-cells",
    )
    loads = [0] * len(points)
    for arc, load in counted.groupBy("_arc").agg(F.sum("_load")).collect():  # one number per ring point
        loads[arc] = load
    runs = small_table(
        spark, place_overflow(loads, [shard for _, shard in points], n_shards),
        "_arc int, first bigint, shard int, slot bigint",
    )
    by_arc = runs.groupBy("_arc").agg(F.sort_array(F.collect_list(F.struct("first", "shard", "slot"))).alias("_runs"))
    # At most one row per ring cell, and per ring point: both are parameters.
    plan = F.broadcast(counted.drop("_load", "_turn").join(F.broadcast(by_arc), "_arc"))

    in_cell = Window.partitionBy("_cell").orderBy("_position", "_row").rowsBetween(Window.unboundedPreceding, -1)
    ranked = stored.withColumn("_ahead", F.coalesce(F.sum("_copies").over(in_cell), F.lit(0))).join(plan, "_cell")
    return (
        repeat_rows(ranked, "_copies")
        .withColumn("_rank", F.col("_cell_start") + F.col("_ahead") + F.col("_copy"))
        .withColumn("_run", F.expr("element_at(filter(_runs, run -> run.first <= _rank), -1)"))
        .select(
            "_row.*",
            "home_shard",
            F.col("_run.shard").alias("shard"),
            (F.col("_run.slot") + F.col("_rank") - F.col("_run.first")).alias("slot"),
        )
    )
