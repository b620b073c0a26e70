"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint of 64 bits is cut into 32 segments of two bits; the vector of the
segments' bit counts (0, 1 or 2 each) is its place in a grid. The Manhattan
distance of two such vectors is a lower bound of the Hamming distance, so texts
within 3 bits lie within Manhattan distance 3, and then one half of the
coordinates (16 of 32) lies within distance 1. The range join therefore
looks, for each half apart, at equal cells and at cells one step apart: a point
stays in its cell and visits the cells one step up. What meets there is verified
on the full fingerprints.

Equal fingerprints are collapsed first (combined before the shuffle), so groups
of exact copies cost one row. A cell gives a spanning forest of its verified
links, not its pairs, which keeps the components whole. Cells of more than
``block`` points are cut into blocks, and every pair of blocks is a group of its
own, so no task holds an unbounded group and no point is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastrum.llm.components import connected_components
from cadastrum.session import materialise

RADIUS = 3
_PAIRS_AT_ONCE = 1 << 21
_SHINGLES_AT_ONCE = 1 << 16


def fingerprint_of(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint as an unsigned number; no words: zero.

    Words are runs of anything but ASCII white space, A-Z in lower case. Fewer
    words than a shingle holds make one shingle of all words.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    last = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    for first in range(0, last, _SHINGLES_AT_ONCE):
        part = words[first : min(first + _SHINGLES_AT_ONCE, last) + shingle - 1]
        grams = zip(*(part[i:] for i in range(min(shingle, len(words))))) if last > 1 or len(words) == shingle else [words]
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(gram), seed) for gram in grams], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > last, bitorder="little").view("<u8")[0])


def simhash(text: str) -> Column:
    """Fingerprints of a text column as signed longs."""

    @F.pandas_udf("long")
    def fingerprints(texts: pd.Series) -> pd.Series:
        values = np.array([fingerprint_of(text) for text in texts], dtype=np.uint64)
        return pd.Series(values.view(np.int64))

    return fingerprints(text)


def hex_digits(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def _grid(points: DataFrame) -> DataFrame:
    """(cell, resident, fp): each point in its cell of either half, and as a visitor one step up in each coordinate."""
    half = "(fp & 4294967295L)", "shiftrightunsigned(fp, 32)"
    rows = []
    for number, bits in enumerate(half):
        counts = f"(({bits} & 1431655765L) + (shiftright({bits}, 1) & 1431655765L))"
        rows.append(
            points.selectExpr("fp", f"{counts} AS own").selectExpr(
                "fp",
                "own",
                "explode(concat(array(own), filter(transform(sequence(0, 15), k ->"
                " CASE WHEN (shiftright(own, 2 * k) & 3) < 2 THEN own + shiftleft(1L, 2 * k) END),"
                " cell -> cell IS NOT NULL))) AS place",
            ).selectExpr(f"place + shiftleft({number}L, 32) AS cell", "place = own AS resident", "fp")
        )
    return rows[0].union(rows[1])


def _forest(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``count`` elements the least one it is linked to over any path."""
    root = np.arange(count)
    while a.size:
        least = np.minimum(root[a], root[b])
        changed = root.copy()
        np.minimum.at(changed, a, least)
        np.minimum.at(changed, b, least)
        np.minimum.at(changed, root[a], least)
        np.minimum.at(changed, root[b], least)
        changed = changed[changed]
        if np.array_equal(changed, root):
            break
        root = changed
    return root


def _cell_links(cells: np.ndarray, resident: np.ndarray, fps: np.ndarray) -> pd.DataFrame:
    """Spanning links of the verified pairs; rows come sorted by cell, residents first."""
    n = len(cells)
    starts = np.flatnonzero(np.concatenate([[True], np.any(cells[1:] != cells[:-1], axis=1)]))
    ends = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    partners = np.where(resident, ends - np.arange(n) - 1, 0)
    edges = np.cumsum(partners)
    out_a, out_b = [], []
    first = 0
    while first < n:
        done = edges[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(edges, done + _PAIRS_AT_ONCE, side="right")))
        counts = partners[first:last]
        total = int(counts.sum())
        if total:
            left = np.repeat(np.arange(first, last), counts)
            right = left + 1 + np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
            near = np.bitwise_count(fps[left] ^ fps[right]) <= RADIUS
            if near.any():
                used, place = np.unique(np.concatenate([left[near], right[near]]), return_inverse=True)
                root = _forest(len(used), place[: near.sum()], place[near.sum() :])
                child = np.flatnonzero(root != np.arange(len(used)))
                out_a.append(fps[used[child]])
                out_b.append(fps[used[root[child]]])
        first = last
    if not out_a:
        return pd.DataFrame({"a": np.array([], dtype=np.int64), "b": np.array([], dtype=np.int64)})
    return pd.DataFrame({"a": np.concatenate(out_a).view(np.int64), "b": np.concatenate(out_b).view(np.int64)})


def _link_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Works through sorted rows; the last, maybe unfinished cell waits for the next batch."""
    rest = None
    for batch in batches:
        if rest is not None:
            batch = pd.concat([rest, batch], ignore_index=True)
        keys = batch[["cell", "one", "two"]].to_numpy()
        open_from = int(np.flatnonzero(np.any(keys != keys[-1], axis=1))[-1]) + 1 if np.any(keys != keys[-1]) else 0
        rest = batch.iloc[open_from:]
        if open_from:
            yield _cell_links(
                keys[:open_from],
                batch["resident"].to_numpy()[:open_from].astype(bool),
                batch["fp"].to_numpy()[:open_from].astype(np.int64).view(np.uint64),
            )
    if rest is not None and len(rest):
        yield _cell_links(
            rest[["cell", "one", "two"]].to_numpy(), rest["resident"].to_numpy().astype(bool),
            rest["fp"].to_numpy().astype(np.int64).view(np.uint64),
        )


def near_links(points: DataFrame, block: int = 4096) -> DataFrame:
    """(a, b): verified links between the distinct fingerprints ``fp`` that span all pairs within 3 bits."""
    rows = _grid(points)
    crowded = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select(
        "cell", F.ceil(F.col("n") / block).cast("int").alias("blocks")
    )
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = (
        rows.join(crowded, "cell", "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("cell", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "resident", "fp")
    )
    return (
        dealt.repartition("cell", "one", "two")
        .sortWithinPartitions("cell", "one", "two", F.col("resident").desc())
        .mapInPandas(_link_batches, "a long, b long")
    )


def near_groups(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """``rows`` with ``component_id``, the least key among all rows reachable over near fingerprints, and ``root``.

    ``rows`` has a long column ``fp`` and is read more than once, so it should be
    a stored table. Null keys are grouped too but never name a group of others;
    a group of null keys alone has a null id. An empty table gives no rows.
    """
    points = materialise(rows.groupBy("fp").agg(F.min(key).alias("least_key")), "fingerprints")
    roots = connected_components(near_links(points.select("fp")))
    rooted = points.join(roots, points["fp"] == roots["node"], "left").select(
        "fp", "least_key", F.coalesce("root", "fp").alias("root")
    )
    ids = rooted.groupBy("root").agg(F.min("least_key").alias("component_id"))
    named = materialise(rooted.join(ids, "root").select("fp", "root", "component_id"), "groups")
    return rows.join(named, "fp")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text_hash, fp, root, component_id) of every row: ``text_hash`` tells rows with one key apart."""
    rows = docs.select(F.col(key), F.xxhash64(text).alias("text_hash"), simhash(text).alias("fp"))
    return near_groups(materialise(rows, "simhash"), key)


def keep_one_per_group(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one of the least key, then the least text hash.

    Rows of null keys stand after all others. Rows that repeat a kept row's key
    and text are copies of it and go.
    """
    found = near_duplicates(docs, key, text)
    best = found.groupBy("root").agg(
        F.min(F.struct(F.col(key).isNull().alias("none"), F.coalesce(key, F.lit(0)).alias("id"), "text_hash")).alias("best")
    )
    kept = materialise(
        best.select(*(F.col(f"best.{name}").alias(f"_kept_{name}") for name in ("none", "id", "text_hash"))), "kept"
    )
    names = kept.columns
    marked = docs.select(
        F.struct(*docs.columns).alias("_row"),
        F.col(key).isNull().alias("_kept_none"),
        F.coalesce(key, F.lit(0)).alias("_kept_id"),
        F.xxhash64(text).alias("_kept_text_hash"),
    )
    return marked.join(kept, names).dropDuplicates(names).select("_row.*")
