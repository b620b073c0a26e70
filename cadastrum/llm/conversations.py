"""Repair of conversation structure by weighted CYK parsing of spans.

A conversation is well formed if the initials of its roles, in order of turn, read
``(s?(ua)+)?``. Rows may be kept (0), given the role the place asks for (2) or deleted (3, the
only choice for blank and repeated rows), and empty rows may be inserted anywhere (2); a row that
stays although its text is cut off costs 1 more. The cheapest edits win, among equally
cheap ones the least string of the edits' initials.

The grammar is in Chomsky normal form: a non-terminal ``[p q]`` derives what leads from
place ``p`` of the pattern to place ``q``, ``[p q] -> [p r] [r q]`` joins neighbouring spans,
and ``[p q] -> row`` is a row's edit after the insertions that come before it (the closure of
``[p q] -> inserted``). A span's cell holds the least (cost, edits) of each non-terminal. Cells
combine bottom up by span length: all spans and splits of up to ``BLOCK`` neighbouring parts in
one cell table, then such blocks as the parts of the next round, until one cell spans the
conversation. Costs follow from the edits, so two equally cheap strings are never prefixes of one
another, and least parts make the least whole, wherever a conversation is cut.

Rows are sorted by range, so that a conversation of any length spreads over tasks; its rows are
numbered by adding up the counts of its ranges. No task holds a conversation; only its string of
edits is one value, because that is the result.

Rows of one turn stand in order of role, then of a digest of the text. Null roles and texts count as
one space, null turns stand first, null ids make one conversation. A repeated row is a duplicate.
Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from cadastrum.llm.expressions import ASCII_BLANKS
from cadastrum.session import materialise

BLOCK_BITS = 4
BLOCK = 1 << BLOCK_BITS  # parts of a cell table
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
CUT_OFF = 1

# Places of the pattern: at its start, after the system row, after a user row, after an assistant row.
_PLACES = range(4)
_ENDS = (0, 3)
_STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_ANY_ROLE = {**_STEPS["u"], **_STEPS["a"]}  # where a user or assistant row may stand
_INITIALS = "sua"
_SOUND, _GOES, _CUT = 0, 4, 8  # added to the initial's number
_LEGAL = ("su", "ua", "au")

Cell = dict[tuple[int, int], tuple[int, str]]


def _put(cell: Cell, key: tuple[int, int], cost: int, edits: str) -> None:
    found = cell.get(key)
    if found is None or (cost, edits) < found:
        cell[key] = (cost, edits)


def _inserted() -> Cell:
    """Closure of the insertions: the cheapest way from place to place without a row."""
    cell: Cell = {(p, p): (0, "") for p in _PLACES}
    for _ in _PLACES:
        for (p, q), (cost, edits) in list(cell.items()):
            if q in _ANY_ROLE:
                _put(cell, (p, _ANY_ROLE[q]), cost + INSERT, edits + "I")
    return cell


def join_spans(left: Cell, right: Cell, into: Cell) -> None:
    for (p, r), (cost, edits) in left.items():
        for q in _PLACES:
            more = right.get((r, q))
            if more is not None:
                least = into.get((p, q))
                if least is None or cost + more[0] <= least[0]:
                    _put(into, (p, q), cost + more[0], edits + more[1])


_CLOSURE = _inserted()


@lru_cache(maxsize=None)
def row_cell(symbol: str) -> Cell:
    """Cell of one row: insertions before it, then its edit. There are twelve symbols."""
    code = ord(symbol) - ord("A")
    initial, fault = code % 4, code // 4 * 4
    edits: Cell = {}
    for p in _PLACES:
        _put(edits, (p, p), DELETE, "D")
        if fault != _GOES:
            extra = CUT_OFF if fault == _CUT else 0
            if p in _ANY_ROLE:
                _put(edits, (p, _ANY_ROLE[p]), REROLE + extra, "R")
            if initial < 3 and p in _STEPS[_INITIALS[initial]]:
                _put(edits, (p, _STEPS[_INITIALS[initial]][p]), KEEP + extra, "K")
    cell: Cell = {}
    join_spans(_CLOSURE, edits, cell)
    return cell


def span_cell(parts: list[Cell]) -> Cell:
    """Cell of the span over all parts: every span, by length, from every split."""
    n = len(parts)
    cells = {(i, i + 1): part for i, part in enumerate(parts)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            cell = cells[i, i + length] = {}
            for split in range(i + 1, i + length):
                join_spans(cells[i, split], cells[split, i + length], cell)
    return cells[0, n]


@lru_cache(maxsize=1 << 14)
def _block_cell(symbols: str) -> Cell:
    return span_cell([row_cell(symbol) for symbol in symbols])


def cheapest(cell: Cell) -> tuple[int, str]:
    """(cost, edits) of a whole conversation from the cell that spans it."""
    whole: Cell = {}
    join_spans(cell, _CLOSURE, whole)
    return min(whole[0, q] for q in _ENDS if (0, q) in whole)


_CELL = StructType([
    StructField("ends", StringType()), StructField("illegal", LongType()), StructField("places", ArrayType(LongType())),
    StructField("costs", ArrayType(LongType())), StructField("edits", ArrayType(StringType())),
])
_BEST = StructType([StructField("cost", LongType()), StructField("audit", StringType())])


def _packed(cells: list[Cell], ends: list[str], illegal: list[int]) -> pd.DataFrame:
    return pd.DataFrame({
        "ends": ends,
        "illegal": illegal,
        "places": [[4 * p + q for p, q in cell] for cell in cells],
        "costs": [[cost for cost, _ in cell.values()] for cell in cells],
        "edits": [[edits for _, edits in cell.values()] for cell in cells],
    })


def _unpacked(places, costs, edits) -> Cell:
    return {divmod(int(at), 4): (int(cost), text) for at, cost, text in zip(places, costs, edits, strict=True)}


def _against(initials: str) -> int:
    return sum(initials[i : i + 2] not in _LEGAL for i in range(len(initials) - 1))


@F.pandas_udf(_CELL)
def _cell_of_rows(symbols: pd.Series) -> pd.DataFrame:
    initials = ["".join("suao"[(ord(c) - ord("A")) % 4] for c in text) for text in symbols]
    return _packed([_block_cell(text) for text in symbols], [x[0] + x[-1] for x in initials], [_against(x) for x in initials])


@F.pandas_udf(_CELL)
def _cell_of_blocks(blocks: pd.Series) -> pd.DataFrame:
    cells, ends, illegal = [], [], []
    for parts in blocks:
        parts = [part["cell"] for part in parts]
        cells.append(span_cell([_unpacked(x["places"], x["costs"], x["edits"]) for x in parts]))
        ends.append(parts[0]["ends"][0] + parts[-1]["ends"][1])
        between = sum(a["ends"][1] + b["ends"][0] not in _LEGAL for a, b in zip(parts, parts[1:]))
        illegal.append(between + sum(int(x["illegal"]) for x in parts))
    return _packed(cells, ends, illegal)


@F.pandas_udf(_BEST)
def _cheapest(places: pd.Series, costs: pd.Series, edits: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(
        [cheapest(_unpacked(*cell)) for cell in zip(places, costs, edits, strict=True)], columns=["cost", "audit"]
    )


def _keyed(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, digest): a struct compares null-safely in joins."""
    spaced = rows.select(
        F.struct(F.col(conv).alias("id")).alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"),
    )
    marked = F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text")
    return spaced.withColumn("digest", F.unhex(F.md5(marked)))


def _numbered(keyed: DataFrame) -> DataFrame:
    """Rows without texts: (conv, turn, role, digest, blank, cut, place, pos, total), stored. ``pos`` counts from 0 in a conversation."""
    stripped = F.rtrim("text", F.lit(ASCII_BLANKS))
    order = ["conv", "turn", "role", "digest"]
    sorted_rows = keyed.select(
        *order, (stripped == "").alias("blank"), (~F.substring(stripped, -1, 1).isin(".", "!", "?")).alias("cut")
    ).repartitionByRange(*order).sortWithinPartitions(*order)
    # Ids ascend over the sorted ranges and, once stored, stay as they are.
    placed = materialise(sorted_rows.withColumn("place", F.monotonically_increasing_id()), "turns")
    placed = placed.withColumn("range", F.shiftright("place", 33))
    ranges = placed.groupBy("conv", "range").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    # A window holds a conversation's ranges, not its rows.
    before = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = ranges.select(
        "conv", "range", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(Window.partitionBy("conv")).alias("total"),
    )
    return placed.join(shifts, ["conv", "range"]).withColumn("pos", F.col("place") + F.col("shift")).drop("range", "shift")


def _with_faults(numbered: DataFrame) -> DataFrame:
    """Adds ``duplicate`` and the ``symbol`` of the row's initial and first fault."""
    firsts = numbered.where(~F.col("blank")).groupBy("conv", "digest").agg(F.min("place").alias("place"))
    firsts = firsts.select("place", F.lit(True).alias("first"))
    seen = ~F.col("blank") & F.col("first").isNull()
    initial = F.instr(F.lit(_INITIALS), F.substring("role", 1, 1))
    number = F.when((F.length("role") == 0) | (initial == 0), 3).otherwise(initial - 1)
    fault = F.when(F.col("blank") | F.col("duplicate"), _GOES).when(F.col("cut"), _CUT).otherwise(_SOUND)
    return numbered.join(firsts, "place", "left").withColumn("duplicate", seen).withColumn("symbol", F.char(number + fault + ord("A")))


def _cells(rows: DataFrame) -> DataFrame:
    """(conv, cell): the cell that spans each conversation."""
    in_order = F.array_sort(F.collect_list(F.struct("pos", "symbol")))  # a block's rows, sixteen at most
    blocks = rows.groupBy("conv", "total", F.shiftright("pos", BLOCK_BITS).alias("number")).agg(
        F.array_join(F.transform(in_order, lambda x: x["symbol"]), "").alias("symbols")
    )
    cells = materialise(blocks.select("conv", "total", "number", _cell_of_rows("symbols").alias("cell")), "cells")
    longest = cells.agg(F.max("total")).first()[0] or 0
    spanned, done = BLOCK, [cells]
    while spanned < longest:
        open_cells = done.pop()
        done.append(open_cells.where(F.col("total") <= spanned))
        parts = open_cells.where(F.col("total") > spanned).groupBy(
            "conv", "total", F.shiftright("number", BLOCK_BITS).alias("number")
        ).agg(F.array_sort(F.collect_list(F.struct("number", F.col("cell")))).alias("parts"))
        done.append(materialise(parts.select("conv", "total", "number", _cell_of_blocks("parts").alias("cell")), "cells"))
        spanned <<= BLOCK_BITS
    whole = done[0]
    for cells in done[1:]:
        whole = whole.unionByName(cells)
    return whole.select("conv", "cell")


class Repair:
    """Faults, cheapest edits and repaired rows of all conversations of ``rows``."""

    def __init__(
        self, rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
    ) -> None:
        self._conv = conv
        self._keyed = _keyed(rows, conv, turn, role, text)
        self._rows = materialise(_with_faults(_numbered(self._keyed)), "faults")
        cells = _cells(self._rows)
        parsed = cells.select("conv", F.col("cell.illegal").alias("illegal"), _cheapest("cell.places", "cell.costs", "cell.edits").alias("best"))
        self._parsed = materialise(parsed.select("conv", "illegal", "best.cost", "best.audit"), "parsed")

    def summary(self) -> DataFrame:
        """A row per conversation: id, gaps, blank, duplicate, truncated, illegal, cost, audit."""
        by_turn = self._rows.groupBy("conv", "turn").agg(
            F.count_if("blank").alias("blank"), F.count_if("duplicate").alias("duplicate"),
            F.count_if(F.col("cut") & ~F.col("blank") & ~F.col("duplicate")).alias("truncated"),
        )
        counted = by_turn.groupBy("conv").agg(
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"),
            *(F.sum(name).alias(name) for name in ("blank", "duplicate", "truncated")),
        )
        return counted.join(self._parsed, "conv").select(
            F.col("conv.id").alias(self._conv), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"
        )

    def edits(self) -> DataFrame:
        """(conv, pos, out, edit, role): one row per edit. ``pos`` is null for insertions, ``out`` for deletions.

        ``role`` is what the place asks for: a repaired conversation of odd length has a system row first,
        users and assistants take turns after it.
        """
        schema = StructType([
            self._parsed.schema["conv"], StructField("pos", LongType()), StructField("out", LongType()),
            StructField("edit", StringType()), StructField("role", StringType()),
        ])

        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, audit in enumerate(batch.column("audit").to_pylist()):
                    letters = np.frombuffer(audit.encode(), dtype="S1")
                    conv = batch.column("conv").slice(i, 1)
                    stays, is_row = letters != b"D", letters != b"I"
                    out, pos = np.cumsum(stays) - 1, np.cumsum(is_row) - 1
                    users = out % 2 == stays.sum() % 2
                    for at in range(0, len(letters), 1 << 16):
                        part = slice(at, at + (1 << 16))
                        yield pa.RecordBatch.from_arrays([
                            conv.take(pa.array(np.zeros(len(letters[part]), dtype=np.int64))),
                            pa.array(pos[part], mask=~is_row[part]),
                            pa.array(out[part], mask=~stays[part]),
                            pa.array(letters[part].astype(str), type=pa.string()),
                            pa.array(np.where(users[part], "user", "assistant"), type=pa.string()),
                        ], schema=pa.schema([batch.schema.field("conv"), ("pos", pa.int64()), ("out", pa.int64()), ("edit", pa.string()), ("role", pa.string())]))

        return self._parsed.select("conv", "audit").mapInArrow(listed, schema)

    def rows(self) -> DataFrame:
        """Repaired rows: (conv, out, edit, turn, role, text); ``out`` counts from 0, inserted rows have an empty text and no turn."""
        edits = self.edits().where("out IS NOT NULL")
        kept = edits.where("pos IS NOT NULL").select("conv", "pos", "out", "edit", F.col("role").alias("asked"))
        placed = kept.join(self._rows.select("conv", "pos", "turn", "role", "digest"), ["conv", "pos"])
        key = F.struct("conv", "turn", "digest").alias("key")
        # Of rows alike in all three only the first can stay, so one text is enough; the shuffle of the join groups them too.
        texts = self._keyed.groupBy(key).agg(F.min("text").alias("text"))
        stayed = placed.select(
            key, "out", "edit", F.when(F.col("edit") == "R", F.col("asked")).otherwise(F.col("role")).alias("role")
        ).join(texts, "key").select("key.conv", "out", "edit", "key.turn", "role", "text")
        added = edits.where("pos IS NULL").select(
            "conv", "out", "edit", F.lit(None).cast("long").alias("turn"), "role", F.lit("").alias("text")
        )
        return stayed.unionByName(added)

    def digests(self) -> DataFrame:
        """(id, repaired_sha256): hash of the repaired ``role:text`` lines. Conversations left without rows are absent.

        A hash is sequential, so a conversation's rows pass through one task, in batches.
        """
        name = self._conv
        schema = StructType([
            StructField(name, self._parsed.schema["conv"].dataType["id"].dataType), StructField("repaired_sha256", StringType()),
        ])

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, state, kind = None, None, None
            for batch in batches:
                ids, done = batch.column("id"), []
                kind = ids.type
                for conv, line in zip(ids.to_pylist(), batch.column("line").to_pylist(), strict=True):
                    if state is None or conv != now:
                        if state is not None:
                            done.append((now, state.hexdigest()))
                        now, state = conv, hashlib.sha256()
                    else:
                        state.update(b"\n")
                    state.update(line.encode())
                if done:
                    yield _digest_batch(done, kind, name)
            if state is not None:
                yield _digest_batch([(now, state.hexdigest())], kind, name)

        lines = self.rows().select(F.col("conv.id").alias("id"), "out", F.concat_ws(":", "role", "text").alias("line"))
        return lines.repartition("id").sortWithinPartitions("id", "out").select("id", "line").mapInArrow(hashed, schema)


def _digest_batch(done: list[tuple], kind: pa.DataType, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([conv for conv, _ in done], type=kind), pa.array([digest for _, digest in done])], names=[name, "repaired_sha256"]
    )
