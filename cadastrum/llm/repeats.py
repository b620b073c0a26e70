"""Removal of byte strings that occur more than once, by a distributed merge sort of suffixes.

Every byte covered by a string of ``length`` bytes that also starts anywhere else goes; a string of
that length is a window. Suffixes are sampled by content: of the ``reach`` grams at the start of a window the
one with the least hash is its anchor, so equal windows have their anchor at the same place and share
the bytes before it and, for ``length - reach + 1`` bytes at least, after it. Neighbouring windows
share an anchor, so there are few: its entry stands for a range of windows.

1. Anchors whose next bytes have a hash of their own have no equal and are left out (the hash of
   an approximate distinguishing prefix, counted over all texts).
2. The texts that keep anchors are gathered in members. A member sorts its entries by the bytes
   that follow into a run, front-codes it (bytes shared with the entry before, the rest), collapses
   equal entries and deals the run to parts by the hash, in order.
3. A part merges the slices of all runs with a loser tree. Its nodes know how many bytes the loser shares
   with the winner, so known prefixes are never compared again; what comes out is the part's array of
   suffixes with the common prefix of each with the one before.
4. Windows of the same offset are equal if their entries share enough bytes after the anchor, which
   the array tells, and enough before it, told by a second array of the bytes before in reverse.
   Equal windows are counted; the spans they cover go back to the members, which cut the texts.

Equal texts are collapsed at the start and counted, and equal entries in every run, so groups of copies and
passages that many documents share reach a part as one entry per run. Everything compared is bytes;
hashes only leave out what cannot have an equal. Members, runs and parts are bounded by their numbers of entries and
by the longest text; no text is collected anywhere else.

Null texts are empty. Texts shorter than ``length`` keep everything. Repeated rows are copies of one another,
so they go if they are long enough. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastrum.llm.expressions import whole_text
from cadastrum.session import materialise

LENGTH = 200
_PLACE_BITS = 24  # of a place in the bytes that are looked at together
_PIECE = 1 << 22
_MEMBER_ENTRIES, _MEMBER_BYTES = 1 << 14, 1 << 23
_PART_ENTRIES = 100_000
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


@dataclass(frozen=True)
class Sampling:
    """Sizes for windows of ``length`` bytes."""

    length: int

    @property
    def gram(self) -> int:
        return 16 if self.length >= 64 else 8

    @property
    def reach(self) -> int:
        return min(self.length * 4 // 5, self.length - self.gram + 1)

    @property
    def shared(self) -> int:
        """Bytes from the anchor on that equal windows share at least."""
        return self.length - self.reach + 1


@dataclass
class Anchors:
    """An entry per anchor: text, place in it, and the least and greatest offset of the windows it stands for."""

    which: np.ndarray
    place: np.ndarray
    least: np.ndarray
    most: np.ndarray
    hashed: np.ndarray

    @staticmethod
    def joined(parts: list[Anchors]) -> Anchors:
        return Anchors(*(
            np.concatenate([getattr(p, name) for p in parts]) if parts else np.zeros(0, dtype=np.int64)
            for name in ("which", "place", "least", "most", "hashed")
        ))


def _anchors_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: Sampling) -> Anchors:
    """Anchors of the texts data[start:end], all at once. Places count from the text's start."""
    n, length = len(data), sizes.length
    padded = np.concatenate([data, np.zeros(16, dtype=np.uint8)])
    words = np.ndarray((n + 8,), dtype="<u8", buffer=padded, strides=(1,))
    value = words[:n] * _ODD[0]
    value ^= value >> np.uint64(29)
    if sizes.gram == 16:
        value += words[8:] * _ODD[1]
    value *= _ODD[2]
    value >>= np.uint64(_PLACE_BITS)
    value <<= np.uint64(_PLACE_BITS)
    value |= np.arange(n, dtype=np.uint64)
    size = 1
    while 2 * size <= sizes.reach:
        value = np.minimum(value[:-size], value[size:])
        size *= 2
    if size < sizes.reach:
        value = np.minimum(value[: size - sizes.reach], value[sizes.reach - size :])
    counts = np.maximum(ends - starts - length + 1, 0)
    which = np.repeat(np.arange(len(starts)), counts)
    windows = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[which]
    at = (value[windows] & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, dtype=np.int64)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    place = at[first]
    hashed = np.zeros(len(place), dtype=np.uint64)
    for byte in [*range(0, sizes.shared - 7, 8), sizes.shared - 8]:
        hashed = (hashed ^ words[place + byte]) * _ODD[0]
        hashed ^= hashed >> np.uint64(31)
    own = which[first]
    return Anchors(own, place - starts[own], place - windows[last], place - windows[first], hashed.view(np.int64))


def find_anchors(texts: pa.Array, sizes: Sampling) -> Anchors:
    """Anchors of all texts (binary); long texts are looked at in overlapping pieces."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    parts, first = [], 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _PIECE, side="right")) - 1)
        begin, end = int(offsets[first]), int(offsets[last])
        if last - first > 1:
            looked_at = [(begin, offsets[first:last], offsets[first + 1 : last + 1])]
        else:
            looked_at = [
                (at, np.array([at]), np.array([min(end, at + _PIECE + sizes.length - 1)]))
                for at in range(begin, end - sizes.length + 1, _PIECE)
            ]
        for at, starts, ends in looked_at:
            if ends[-1] - at >= sizes.length:
                found = _anchors_of(whole[at : ends[-1]], starts - at, ends - at, sizes)
                found.which += first
                found.place += at - begin if last - first == 1 else 0
                parts.append(found)
        first = last
    return Anchors.joined(parts)


# --- runs ---------------------------------------------------------------------------------------


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are not looked at."""
    low, high = known, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


@dataclass
class Run:
    """A front-coded sorted run: each string shares ``shared`` bytes with the one before."""

    shared: list[int]
    rest: list[bytes]


def merge_runs(runs: list[Run]) -> Iterator[tuple[int, int, bytes]]:
    """(run, bytes shared with the string before, string) in sorted order, equal strings by run.

    A node of the loser tree holds a run and how many bytes its string shares with the last winner
    of the node. Of two strings that share different numbers of bytes with the string put out before, the
    one that shares more is less; only equal numbers make bytes be compared, from there on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    now: list[bytes | None] = [run.rest[0] if run.rest else None for run in runs] + [None] * (size - len(runs))
    next_at, shares = [1] * size, [0] * size
    losers = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's number becomes what it shares with the winner."""
        if now[a] is None or now[b] is None:
            return (b, a) if now[a] is None else (a, b)
        if shares[a] != shares[b]:
            return (a, b) if shares[a] > shares[b] else (b, a)
        x, y = now[a], now[b]
        same = common_prefix(x, y, shares[a])
        if same == len(x) or same == len(y):
            less = len(x) < len(y) or len(x) == len(y) and a < b
        else:
            less = x[same] < y[same]
        winner, loser = (a, b) if less else (b, a)
        shares[loser] = same
        return winner, loser

    level, start = list(range(size)), size
    while len(level) > 1:
        start //= 2
        up = []
        for i in range(0, len(level), 2):
            winner, losers[start + i // 2] = play(level[i], level[i + 1])
            up.append(winner)
        level = up
    best = level[0]
    while now[best] is not None:
        string = now[best]
        yield best, shares[best], string
        run, at = runs[best], next_at[best]
        if at < len(run.rest):
            shares[best] = run.shared[at]
            now[best] = string[: run.shared[at]] + run.rest[at]
            next_at[best] = at + 1
        else:
            now[best] = None
        node = (best + size) // 2
        while node:
            other = losers[node]
            if now[other] is not None:
                if now[best] is None or shares[other] > shares[best]:
                    losers[node], best = best, other
                elif shares[other] == shares[best]:
                    best, losers[node] = play(best, other)
            node //= 2


_SLICE = "part long, member string, entry array<int>, least array<int>, most array<int>, n array<long>, shared array<int>, rest array<binary>, before array<binary>"
_MEMBER = "one array<long>, two array<long>, texts array<binary>, which array<int>, place array<long>, of_entry array<int>"
_RUN_SCHEMA = pa.schema([
    ("part", pa.int64()), ("member", pa.string()),
    *((name, pa.list_(pa.int32())) for name in ("entry", "least", "most")), ("n", pa.list_(pa.int64())),
    ("shared", pa.list_(pa.int32())), ("rest", pa.list_(pa.binary())), ("before", pa.list_(pa.binary())),
    ("one", pa.list_(pa.int64())), ("two", pa.list_(pa.int64())), ("texts", pa.list_(pa.binary())),
    ("which", pa.list_(pa.int32())), ("place", pa.list_(pa.int64())), ("of_entry", pa.list_(pa.int32())),
])


class _Member:
    """Texts and their entries until there are enough for a run."""

    def __init__(self, sizes: Sampling, parts: int) -> None:
        self._sizes, self._parts = sizes, parts
        self._keys: list[tuple[int, int]] = []
        self._texts: list[bytes] = []
        self._entries: dict[tuple[bytes, bytes, int, int], int] = {}
        self._n: list[int] = []
        self._part: list[int] = []
        self._which: list[int] = []
        self._place: list[int] = []
        self._of_entry: list[int] = []
        self.bytes = 0

    def add(self, key: tuple[int, int], copies: int, text: bytes, found: Anchors, rows: np.ndarray) -> None:
        length = self._sizes.length
        for place, least, most, hashed in zip(*(x[rows].tolist() for x in (found.place, found.least, found.most, found.hashed)), strict=True):
            entry = (text[place : place - least + length], text[place - most : place][::-1], least, most)
            at = self._entries.get(entry)
            if at is None:
                at = self._entries[entry] = len(self._n)
                self._n.append(0)
                self._part.append(hashed % self._parts)
            self._n[at] += copies
            self._which.append(len(self._texts))
            self._place.append(place)
            self._of_entry.append(at)
        self._keys.append(key)
        self._texts.append(text)
        self.bytes += len(text)

    @property
    def full(self) -> bool:
        return len(self._place) >= _MEMBER_ENTRIES or self.bytes >= _MEMBER_BYTES

    def rows(self, name: str) -> Iterator[pa.RecordBatch]:
        """The slices of the sorted run, one a part, and the member itself under part -1."""
        order = sorted(self._entries.items())
        slices: dict[int, dict[str, list]] = {}
        lasts: dict[int, bytes] = {}
        for (after, before, least, most), at in order:
            part = self._part[at]
            own = slices.setdefault(part, {k: [] for k in ("entry", "least", "most", "n", "shared", "rest", "before")})
            shared = common_prefix(lasts[part], after, 0) if part in lasts else 0
            lasts[part] = after
            for k, v in zip(own, (at, least, most, self._n[at], shared, after[shared:], before), strict=True):
                own[k].append(v)
        rows = [{"part": part, "member": name, **own} for part, own in slices.items()]
        rows.append({
            "part": -1, "member": name, "one": [a for a, _ in self._keys], "two": [b for _, b in self._keys], "texts": self._texts,
            "which": self._which, "place": self._place, "of_entry": self._of_entry,
        })
        yield pa.RecordBatch.from_pylist(rows, schema=_RUN_SCHEMA)


def _runs(joined: DataFrame, sizes: Sampling, parts: int) -> DataFrame:
    """Slices and members of (one, two, copies, text, wanted): ``wanted`` holds the hashes of the anchors to keep."""

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        member, made = _Member(sizes, parts), 0
        prefix = None
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            found = find_anchors(texts, sizes)
            wanted = batch.column("wanted")
            spread = np.repeat(np.arange(len(wanted)), wanted.value_lengths().to_numpy(zero_copy_only=False))
            # A text's hashes are told from those of other texts by its number.
            own = wanted.flatten().to_numpy(zero_copy_only=False).view(np.uint64) + spread.astype(np.uint64) * _ODD[0]
            keeps = np.isin(found.hashed.view(np.uint64) + found.which.astype(np.uint64) * _ODD[0], own)
            rows = np.flatnonzero(keeps)
            firsts = np.searchsorted(found.which[rows], np.arange(len(texts) + 1))
            ones, twos, copies = (batch.column(x).to_pylist() for x in ("one", "two", "copies"))
            for i in range(len(texts)):
                if firsts[i] < firsts[i + 1]:
                    # The first text names the task's members; a text is in one member only.
                    prefix = prefix or f"{ones[i]}.{twos[i]}"
                    member.add((ones[i], twos[i]), copies[i], texts[i].as_py(), found, rows[firsts[i] : firsts[i + 1]])
                    if member.full:
                        yield from member.rows(f"{prefix}.{made}")
                        member, made = _Member(sizes, parts), made + 1
        if member.bytes:
            yield from member.rows(f"{prefix}.{made}")

    return joined.mapInArrow(built, f"{_SLICE}, {_MEMBER}")


# --- merge --------------------------------------------------------------------------------------


def equal_windows(
    shared: np.ndarray, before: list[bytes], least: np.ndarray, most: np.ndarray, n: np.ndarray, sizes: Sampling
) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest offset of each entry's windows that have an equal (greatest -1: none).

    Entries stand in order of the bytes after their anchors, of which ``shared`` are those of the entry before.
    """
    count = len(shared)
    low, high = np.full(count, sizes.length), np.full(count, -1)
    order = sorted(range(count), key=before.__getitem__)
    reverse = np.zeros(count, dtype=np.int64)
    for i in range(1, count):
        reverse[i] = common_prefix(before[order[i - 1]], before[order[i]], 0)
    order = np.array(order, dtype=np.int64)
    left = np.empty(count, dtype=np.int64)
    for offset in range(int(least.min(initial=0)), int(most.max(initial=-1)) + 1):
        rows = np.flatnonzero((least <= offset) & (offset <= most))
        if not len(rows):
            continue
        right = np.cumsum(shared < sizes.length - offset)
        left[order] = np.cumsum(reverse < offset)
        _, window = np.unique(right[rows] * (count + 1) + left[rows], return_inverse=True)
        rows = rows[np.bincount(window, weights=n[rows])[window] >= 2]
        low[rows] = np.minimum(low[rows], offset)
        high[rows] = np.maximum(high[rows], offset)
    return low, high


def _merged(slices: DataFrame, sizes: Sampling) -> DataFrame:
    """(member, entry, low, high) arrays: of every slice the entries whose windows have an equal."""

    def found_in(part: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        rows = [row for batch in part for row in batch.to_pylist()]
        runs = [Run(row["shared"], row["rest"]) for row in rows]
        taken = [0] * len(runs)
        whose, which, shared = [], [], []
        for run, same, _ in merge_runs(runs):
            whose.append(run)
            which.append(taken[run])
            shared.append(same)
            taken[run] += 1
        shared = np.array(shared, dtype=np.int64)
        n = np.array([rows[r]["n"][i] for r, i in zip(whose, which, strict=True)], dtype=np.float64)
        # Entries that share too little with both neighbours have no equal.
        group = np.cumsum(shared < sizes.shared) - 1
        keep = np.flatnonzero(np.bincount(group, weights=n)[group] >= 2)
        if not len(keep):
            return None
        at = [(whose[i], which[i]) for i in keep]
        low, high = equal_windows(
            shared[keep], [rows[r]["before"][i] for r, i in at], *(np.array([rows[r][x][i] for r, i in at]) for x in ("least", "most")), n[keep], sizes
        )
        out: dict[str, tuple[list, list, list]] = {}
        for (r, i), a, b in zip(at, low.tolist(), high.tolist(), strict=True):
            if b >= 0:
                for values, v in zip(out.setdefault(rows[r]["member"], ([], [], [])), (rows[r]["entry"][i], a, b), strict=True):
                    values.append(v)
        if not out:
            return None
        lists = [pa.array([x[k] for x in out.values()], type=pa.list_(pa.int32())) for k in range(3)]
        return pa.RecordBatch.from_arrays([pa.array(list(out)), *lists], names=["member", "entry", "low", "high"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            parts = batch.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    if held and parts[a] != now:
                        made = found_in(held)
                        if made is not None:
                            yield made
                        held = []
                    now = parts[a]
                    held.append(batch.slice(a, b - a))
        if held:
            made = found_in(held)
            if made is not None:
                yield made

    return slices.mapInArrow(merged, "member string, entry array<int>, low array<int>, high array<int>")


# --- texts --------------------------------------------------------------------------------------


def text_key(text: Column) -> list[Column]:
    """Two independent hashes that name a text."""
    return [F.xxhash64(text).alias("one"), F.xxhash64(F.lit(1), text).alias("two")]


def spans_of(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Union of half-open intervals, touching ones joined, in order."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    first = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]]))
    return list(zip(starts[first].tolist(), reach[np.append(first[1:], len(starts)) - 1].tolist(), strict=True))


def _cut(joined: DataFrame, sizes: Sampling) -> DataFrame:
    """(one, two, kept, spans) of the members' texts that lose bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in ("one", "two", "texts", "which", "place", "of_entry")}
                found = batch.column("found")[i].as_py()
                count = 1 + max(max(part["entry"]) for part in found)
                low, high = np.full(count, 0), np.full(count, -1)
                for part in found:
                    low[part["entry"]], high[part["entry"]] = part["low"], part["high"]
                which, place, entry = (row[x].values.to_numpy(zero_copy_only=False) for x in ("which", "place", "of_entry"))
                hit = np.flatnonzero((entry < count) & (high[np.minimum(entry, count - 1)] >= 0))
                which, starts, ends = which[hit], place[hit] - high[entry[hit]], place[hit] - low[entry[hit]] + sizes.length
                out = []
                for at in np.unique(which).tolist():
                    own = which == at if len(which) < 64 else slice(np.searchsorted(which, at), np.searchsorted(which, at, side="right"))
                    spans, text, last, kept = spans_of(starts[own], ends[own]), row["texts"].values[at].as_py(), 0, []
                    for a, b in spans:
                        kept.append(text[last:a])
                        last = b
                    out.append({
                        "one": row["one"].values[at].as_py(), "two": row["two"].values[at].as_py(), "kept": b"".join([*kept, text[last:]]),
                        "spans": [{"start": a, "end": b} for a, b in spans],
                    })
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                    ("one", pa.int64()), ("two", pa.int64()), ("kept", pa.binary()),
                    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ]))

    return joined.mapInArrow(cut, "one long, two long, kept binary, spans array<struct<start: long, end: long>>")


def cut_texts(texts: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """(one, two, kept, spans) of every distinct text that loses bytes, named as by ``text_key``.

    ``kept`` are the bytes that stay, ``spans`` the maximal runs that go, as byte offsets.
    """
    if length < 24:
        raise ValueError("windows need 24 bytes at least")
    sizes = Sampling(length)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = find_anchors(batch.column("text").cast(pa.large_binary()), sizes)
            offsets = np.searchsorted(found.which, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("one"), batch.column("two"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.hashed))],
                names=["one", "two", "hashes"],
            )

    own = F.col(text)
    rows = texts.select(own.alias("text")).where(F.octet_length(own) >= length).select(*text_key(F.col("text")), "text")
    keys = ["one", "two"]
    sampled = materialise(
        rows.mapInArrow(hashes, "one long, two long, hashes array<long>").groupBy(*keys).agg(
            F.first("hashes").alias("hashes"), F.count(F.lit(1)).alias("copies")
        ),
        "anchors",
    )
    counted = sampled.select("copies", F.explode("hashes").alias("hash")).groupBy("hash").agg(F.sum("copies").alias("n"))
    shared = counted.where("n > 1").select("hash")
    wanted = materialise(
        sampled.select(*keys, "copies", F.explode(F.array_distinct("hashes")).alias("hash")).join(shared, "hash", "left_semi")
        .groupBy(*keys).agg(F.first("copies").alias("copies"), F.collect_list("hash").alias("wanted")),
        "wanted",
    )
    entries = wanted.agg(F.sum(F.size("wanted"))).first()[0] or 0
    parts = ceil(entries / _PART_ENTRIES) or 1
    # The partial grouping leaves one copy of a text per task; the join needs no other shuffle of texts.
    whole = rows.groupBy(*keys).agg(F.first("text").alias("text"))
    runs = materialise(_runs(whole.join(wanted, keys), sizes, parts), "runs")
    slice_columns = [c.split()[0] for c in _SLICE.split(", ")]
    dealt = runs.where("part >= 0").select(slice_columns).repartition(parts, "part").sortWithinPartitions("part", "member")
    found = materialise(_merged(dealt, sizes), "repeats").groupBy("member").agg(
        F.collect_list(F.struct("entry", "low", "high")).alias("found")
    )
    members = runs.where("part = -1").select("member", *[c.split()[0] for c in _MEMBER.split(", ")])
    return _cut(members.join(found, "member"), sizes)


def drop_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with ``kept`` (the bytes that stay) and ``spans`` (those that go)."""
    whole = whole_text(text)
    cut = cut_texts(docs.select(whole.alias("_text")), "_text", length)
    own = docs.select(F.struct(*docs.columns).alias("_row"), whole.alias("_text"), *text_key(whole))
    return own.join(cut, ["one", "two"], "left").select(
        "_row.*", F.coalesce("kept", F.col("_text").cast("binary")).alias("kept"),
        F.coalesce("spans", F.array().cast("array<struct<start: long, end: long>>")).alias("spans"),
    )
