"""Token counts by a finite-state compilation of a byte-pair tokenizer.

A sequence of pieces is the tokenizer's own cut of a text exactly if each piece and each
pair of neighbours is cut that way. So the last piece of the cut of a text's prefix follows from the
last pieces of shorter prefixes, and only prefixes whose rest can still begin a longer
piece matter. These make up a state, of which there are finitely many, and reading a
character moves to another state and changes the count of pieces by a number fixed for
that transition: a deterministic transducer with counts on its transitions. States and
transitions are compiled when first met; the table is dropped when it grows beyond a
bound and compiled anew.

Pieces hold the space mark at their start only, and characters without a piece of their own
(each counts one token per byte) join nothing, so a unit - a run of marks and what follows up to the next mark -
starts in the initial state. A chunk of a text is then a map from states to states and counts that
is constant after its first unit: the map is kept as the chunk's head, its count and its
open tail. Maps compose associatively; a text's chunks are folded in a
balanced tree, which holds each character once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
CHUNK_CHARS = 1 << 16
MAX_STATES, MAX_UNITS, KEPT_CHARS = 400_000, 1_000_000, 64


class CountTransducer:
    """Counts the tokens of a unit for the sentencepiece model at ``path`` (byte pairs with byte fallback)."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        usual = [
            i for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
        self.rank = {model.id_to_piece(i): model.get_score(i) for i in usual}
        if any(MARK in piece.lstrip(MARK) for piece in self.rank):
            raise ValueError("a piece holds the space mark after another character")
        self.begins = {piece[:n] for piece in self.rank for n in range(1, len(piece))}
        self._pairs: dict[tuple[str, str], bool] = {}
        self._start()

    def _start(self) -> None:
        # A state: (characters back, last piece there, count there less the count here), nearest first.
        self._ids = {((0, "", 0),): 0}
        self._states = [((0, "", 0),)]
        self._moves: list[dict[str, tuple[int, int]]] = [{}]

    def cut(self, text: str) -> list[str]:
        """The merges themselves, for short strings: best score first, leftmost of equals."""
        parts = list(text)
        while True:
            scores = [(self.rank.get(a + b), -i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            best = max((s for s in scores if s[0] is not None), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _fits(self, before: str, piece: str) -> bool:
        known = self._pairs.get((before, piece))
        if known is None:
            if len(self._pairs) > MAX_STATES:
                self._pairs.clear()
            wanted = [before, piece] if before else [piece]
            known = self._pairs[before, piece] = self.cut(before + piece) == wanted
        return known

    def _tokens(self, piece: str) -> int:
        return 1 if piece in self.rank else len(piece.encode("utf-8", "surrogatepass"))

    def _compile(self, state: int, char: str, read: str) -> tuple[int, int]:
        """The transition of ``state`` on ``char``; ``read`` ends with the characters the state looks back on."""
        entries = self._states[state]
        for back, before, count in entries:
            piece = read[len(read) - back :] + char
            if (piece in self.rank or back == 0) and self._fits(before, piece):
                change = count + self._tokens(piece)
                break
        else:
            raise AssertionError("no piece fits")  # a cut always exists
        kept = tuple(
            (back + 1, before, count - change) for back, before, count in entries
            if read[len(read) - back :] + char in self.begins
        )
        after = ((0, piece, 0), *kept)
        target = self._ids.get(after)
        if target is None:
            target = self._ids[after] = len(self._states)
            self._states.append(after)
            self._moves.append({})
        self._moves[state][char] = target, change
        return target, change

    def count(self, unit: str) -> int:
        if len(self._states) > MAX_STATES:
            self._start()
        state = total = 0
        for at, char in enumerate(unit):
            move = self._moves[state].get(char)
            if move is None:
                move = self._compile(state, char, unit[max(0, at - 64) : at])
            state, change = move
            total += change
        return total


class UnitCounts(dict):
    """Counts of whole units that were met, up to a bound."""

    def __init__(self, transducer: CountTransducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, unit: str) -> int:
        count = self.transducer.count(unit)
        if len(unit) <= KEPT_CHARS:
            if len(self) >= MAX_UNITS:
                self.clear()
            self[unit] = count
        return count


_UNIT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
_EDGE = re.compile(f"(?<=[^{MARK}])(?={MARK})|(?<=\n)|(?=\n)")


@dataclass(frozen=True)
class ChunkMap:
    """What a chunk does to any state: ``head`` ends the open unit, ``count`` is fixed, ``tail`` stays open.

    A chunk without a unit's edge has only a head and is not ``closed``.
    """

    head: str
    closed: bool = False
    count: int = 0
    tail: str = ""


def chunk_map(chunk: str, counts: UnitCounts) -> ChunkMap:
    edges = _EDGE.search(chunk)
    if edges is None:
        return ChunkMap(chunk)
    units = _UNIT.findall(chunk, edges.start())
    tail = units.pop() if units else ""
    return ChunkMap(chunk[: edges.start()], True, sum(map(counts.__getitem__, units)), tail)


def _closed(units: str, counts: UnitCounts) -> int:
    return sum(map(counts.__getitem__, _UNIT.findall(units)))


def compose(one: ChunkMap, two: ChunkMap, counts: UnitCounts) -> ChunkMap:
    """First ``one``, then ``two``. Associative. A tail and the next head may meet at an edge, so they are cut anew."""
    if not one.closed and not two.closed:
        return chunk_map(one.head + two.head, counts)
    if not one.closed:
        first = chunk_map(one.head + two.head, counts)
        if not first.closed:
            return ChunkMap(first.head, True, two.count, two.tail)
        return ChunkMap(first.head, True, first.count + _closed(first.tail, counts) + two.count, two.tail)
    if not two.closed:
        units = _UNIT.findall(one.tail + two.head)
        tail = units.pop() if units else ""
        return ChunkMap(one.head, True, one.count + sum(map(counts.__getitem__, units)), tail)
    return ChunkMap(one.head, True, one.count + _closed(one.tail + two.head, counts) + two.count, two.tail)


def fold(maps: list[ChunkMap], counts: UnitCounts) -> ChunkMap:
    """The composition of all maps, neighbours first."""
    while len(maps) > 1:
        odd = maps[len(maps) & ~1 :]
        maps = [compose(maps[i], maps[i + 1], counts) for i in range(0, len(maps) - 1, 2)] + odd
    return maps[0]


def count_text(text: str | None, counts: UnitCounts, chunk_chars: int = CHUNK_CHARS) -> int:
    """Tokens of a whole text; null and empty have none. The text gets a space mark in front, as the library does."""
    if not text:
        return 0
    marked = MARK + text.replace(" ", MARK)
    if len(marked) <= chunk_chars:
        return _closed(marked, counts)
    whole = fold([chunk_map(marked[i : i + chunk_chars], counts) for i in range(0, len(marked), chunk_chars)], counts)
    return _closed(whole.head, counts) + whole.count + _closed(whole.tail, counts)


_compiled: dict[str, UnitCounts] = {}


def unit_counts(path: str) -> UnitCounts:
    """One table for each model and Python worker."""
    if path not in _compiled:
        _compiled[path] = UnitCounts(CountTransducer(path))
    return _compiled[path]


def count_tokens(docs: DataFrame, path: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each whole text; a map over the scan, no shuffle.

    Null and empty texts count 0; repeated rows count alike; an empty table gives no rows; a
    column named like the result gives way to it. ``path`` leads to the model file on every machine.
    """

    @F.pandas_udf("long")
    def counted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counts = unit_counts(path)
        for texts in parts:
            yield pd.Series([count_text(text, counts) for text in texts], dtype="int64")

    return docs.withColumn(name, counted(F.col(text)))
