"""Records that may span lines, from files of any size, without reading a file in one task.

Each line acts on the state of the reader: it adds a step to it, or starts it anew. For delimited text
the state is whether a quoted field is open, for JSON the depth of open brackets. Such actions compose,
so the action of a byte range comes from its lines and the state at its start from the ranges before it. A range that
starts outside of records and has no line that steps needs nothing else: its lines are its
records. In the others the task that reads the lines joins them by running states, and what lies over the end of a
range is joined to the ranges that follow.

Lines end with ``\\n``; a ``\\r`` before it stays inside a record and goes at its end. A byte-order mark at a
line's start goes. A record that never ends reaches to the end of its file.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadastrum.session import materialise

_RANGE = ["file", "range"]


@dataclass(frozen=True)
class Grammar:
    """How a line acts: ``fresh`` sets the state to zero before ``step`` is added; states count modulo ``modulus``.

    Where a fresh line ``breaks``, it starts a record even if another is open.
    """

    step: Column
    fresh: Column
    modulus: int | None = None
    breaks: bool = False

    def state(self, value: Column) -> Column:
        return F.pmod(value, F.lit(self.modulus)) if self.modulus else F.greatest(value, F.lit(0))


def delimited_grammar(sep: str, line: str = "value") -> Grammar:
    """State 1: inside a quoted field. A quote opens a field only at its start and is doubled inside."""
    mark = "\\" + sep if not sep.isalnum() else sep
    inside = '[^"]*+(?:""[^"]*+)*+'
    # Whole fields with their delimiters, then a quote that is not closed. Possessive, so a line is passed once.
    opens = f'(?:(?:"{inside}"|(?!"))[^{mark}]*+{mark})*+"{inside}\\z'
    text = F.col(line)
    quoted = F.contains(text, F.lit('"'))
    from_outside = quoted & text.rlike(f"^{opens}")
    from_inside = ~quoted | text.rlike(f'^{inside}(?:\\z|"[^{mark}]*+{mark}{opens})')
    # Unchanged, changed, or the same from either state.
    return Grammar(from_outside.cast("int"), from_outside == from_inside, 2)


def json_grammar(line: str = "value") -> Grammar:
    """State: open brackets. Strings of JSON end on their line; a brace in the first column starts a document."""
    bare = F.regexp_replace(F.col(line), r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "")

    def count(brackets: str) -> Column:
        return F.length(bare) - F.length(F.translate(bare, brackets, ""))

    return Grammar(count("{[") - count("}]"), F.startswith(F.col(line), F.lit("{")), breaks=True)


def lines_of(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, range, row, value): ``range`` is the byte range's start, ``row`` ascends inside it."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"),
        F.monotonically_increasing_id().alias("row"), F.ltrim("value", F.lit("\ufeff")).alias("value"),
    )


def _before(order: str, *keys: str):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _running(rows: DataFrame, keys: list[str], order: str, start: Column, grammar: Grammar) -> DataFrame:
    """Adds ``state`` before each row: the steps since the last fresh row, or since the start."""
    before = _before(order, *keys)
    summed = rows.withColumn("__sum", F.coalesce(F.sum("step").over(before), F.lit(0)))
    base = F.last(F.when(F.col("fresh"), F.col("__sum")), ignorenulls=True).over(before)
    return summed.withColumn("state", grammar.state(F.col("__sum") - F.coalesce(base, -start))).drop("__sum")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The batch cut where the byte range changes."""
    file, start = batch.column("file"), batch.column("range")
    begin = 0
    for end in np.union1d(*[pc.run_end_encode(column).run_ends.to_numpy() for column in (file, start)]).tolist():
        yield (file[begin].as_py(), start[begin].as_py()), batch.slice(begin, end - begin)
        begin = end


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


_ACTIONS = "file string, range long, steps boolean, fresh boolean, step long"


def _range_actions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per range: whether a line steps or is fresh, and the steps since the last fresh line."""
    key, found = None, None
    done: list[tuple] = []
    for batch in batches:
        for run_key, run in _runs(batch):
            if run_key != key:
                if key is not None:
                    done.append((*key, *found))
                key, found = run_key, (False, False, 0)
            step, fresh = _numbers(run, "step"), np.flatnonzero(_numbers(run, "fresh"))
            since = int(step[fresh[-1] :].sum()) if len(fresh) else found[2] + int(step.sum())
            found = (found[0] or bool(step.any()), found[1] or len(fresh) > 0, since)
    if key is not None:
        done.append((*key, *found))
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64())
        columns = [pa.array(column, kind) for column, kind in zip(zip(*done, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=["file", "range", "steps", "fresh", "step"])


def range_states(marked: DataFrame, grammar: Grammar) -> DataFrame:
    """(file, range, state, uneven): the state at each range's start, and whether its lines are not simply its records.

    A task passes its ranges' lines in order; the window holds a file's ranges. Texts take no part.
    """
    ranges = marked.select(*_RANGE, "step", "fresh").mapInArrow(_range_actions, _ACTIONS)
    return _running(ranges, ["file"], "range", F.lit(0), grammar).select(
        *_RANGE, "state", (F.col("steps") | (F.col("state") != 0)).alias("uneven")
    )


_PIECES = "file string, range long, number long, row long, text string, after long"


@dataclass
class _Open:
    """The piece at work in a range: its number, first row and lines, and the state after it."""

    key: tuple[str, int]
    carry: int
    number: int = 0
    row: int = 0
    after: int = 0
    lines: list[str] = field(default_factory=list)

    def batch(self) -> Iterator[pa.RecordBatch]:
        if self.lines:
            yield _piece_batch(self.key, [self.number], [self.row], pa.array(["\n".join(self.lines)]), [self.after])


def _piece_batch(key: tuple[str, int], numbers, rows, texts: pa.Array, after) -> pa.RecordBatch:
    file, start = (pa.repeat(pa.scalar(part, kind), len(texts)) for part, kind in zip(key, (pa.string(), pa.int64()), strict=True))
    columns = [file, start, pa.array(numbers, pa.int64()), pa.array(rows, pa.int64()), texts, pa.array(after, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["file", "range", "number", "row", "text", "after"])


def _pieces(modulus: int | None, breaks: bool):
    """Cuts the lines of ranges, which come in order, where records start; piece 0 belongs to the range before."""

    def state(value: np.ndarray) -> np.ndarray:
        return value % modulus if modulus else np.maximum(value, 0)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            for key, run in _runs(batch):
                if at is None or at.key != key:
                    if at is not None:
                        yield from at.batch()
                    at = _Open(key, run.column("start")[0].as_py())
                step, fresh, rows, texts = _numbers(run, "step"), _numbers(run, "fresh").astype(bool), _numbers(run, "row"), run.column("value")
                upto = np.cumsum(step)
                # Steps before each line since the last fresh one, or since the range's start.
                last = np.maximum.accumulate(np.where(fresh, np.arange(len(step)), -1))
                since = at.carry + upto
                since[last >= 0] = (upto - (upto - step)[last])[last >= 0]
                before = np.concatenate(([at.carry], since[:-1]))
                now = state(before)
                after = state(np.where(fresh, 0, now) + step)
                begins = np.flatnonzero((now == 0) | (fresh & breaks))
                at.carry = int(since[-1])
                first = int(begins[0]) if len(begins) else len(step)
                if first:
                    if not at.lines:
                        at.row = int(rows[0])
                    at.lines += texts.slice(0, first).to_pylist()
                    at.after = int(after[first - 1])
                if not len(begins):
                    continue
                yield from at.batch()
                final = int(begins[-1])
                if final > first:
                    offsets = pa.array(begins - first, pa.int32())
                    whole = pc.binary_join(pa.ListArray.from_arrays(offsets, texts.slice(first, final - first)), "\n")
                    numbers = np.arange(at.number + 1, at.number + len(begins))
                    yield _piece_batch(key, numbers, rows[begins[:-1]], whole, after[begins[1:] - 1])
                at.number += len(begins)
                at.row, at.after, at.lines = int(rows[final]), int(after[-1]), texts.slice(final).to_pylist()
        if at is not None:
            yield from at.batch()

    return cut


def records_of(lines: DataFrame, grammar: Grammar, placed: bool = True) -> DataFrame:
    """(file, range, row, text, complete): one row per record, with the place where it starts.

    ``complete`` is false for a record that its file ends in, or that a fresh line breaks off. ``placed``: a
    task has the lines of a range in order, as ``lines_of`` gives them; others are brought together first.
    States and assembled records are stored, so lines pass the grammar twice and move only if not placed.
    """
    def in_order(rows: DataFrame) -> DataFrame:
        return rows if placed else rows.repartition(*_RANGE).sortWithinPartitions(*_RANGE, "row")

    acts = {"step": grammar.step.cast("long"), "fresh": grammar.fresh}
    states = materialise(range_states(in_order(lines.withColumns(acts).drop("value")), grammar), "ranges")
    uneven = states.where("uneven")
    all_uneven = states.where("NOT uneven").isEmpty()
    whole = lines.join(uneven, _RANGE, "left_anti").select(*_RANGE, "row", F.col("value").alias("text"), F.lit(True).alias("complete"))

    # A row per byte range. The join must keep the lines' order; a file cut otherwise than before is an error.
    known = lines.join(F.broadcast(states), _RANGE, "left")
    cut_alike = F.coalesce("uneven", F.raise_error(F.lit("files were cut into other byte ranges")).cast("boolean"))
    odd = known.where(cut_alike).select(*_RANGE, "row", "value", F.col("state").cast("long").alias("start")).withColumns(acts)
    pieces = materialise(in_order(odd).mapInArrow(_pieces(grammar.modulus, grammar.breaks), _PIECES), "pieces")
    inner = (F.col("number") > 0) & (F.col("after") == 0)
    finished = pieces.where(inner).select(*_RANGE, "row", "text", F.lit(True).alias("complete"))
    # What a range ends inside of, with the pieces that start the ranges after it: one or two a range.
    order = Window.partitionBy("file").orderBy("range", "number")
    chained = pieces.where(~inner).withColumn("chain", F.sum((F.col("number") > 0).cast("int")).over(order))
    joined = chained.groupBy("file", "chain").agg(
        F.min(F.struct("range", "row")).alias("place"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "number", "text"))), lambda x: x["text"]), "\n").alias("text"),
        F.max_by("after", F.struct("range", "number")).alias("after"),
    ).select("file", "place.range", "place.row", "text", (F.col("after") == 0).alias("complete"))
    records = finished.unionByName(materialise(joined, "joined"))
    if not all_uneven:
        records = whole.unionByName(records)
    return records.withColumn("text", F.when(F.contains("text", F.lit("\r")), F.regexp_replace("text", "\r$", "")).otherwise(F.col("text")))


def read_quoted(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """Delimited text whose quoted fields may hold line breaks: header names, every column text, blanks kept as empty text.

    Files are read in byte ranges. Each file has a header; the names are those of the first file. Blank lines
    between records are skipped.
    """
    return parse_records(lines_of(spark, path), sep)


def parse_records(lines: DataFrame, sep: str, placed: bool = True) -> DataFrame:
    """``read_quoted`` of lines (file, range, row, value); ``placed`` as in ``records_of``."""
    spark = lines.sparkSession
    records = records_of(lines, delimited_grammar(sep), placed).where("trim(text) != ''").drop("complete")
    # Only records of a file's first range are compared by their rows; a file has one head.
    first_ranges = records.groupBy("file").agg(F.min("range").alias("range"))
    heads = records.join(F.broadcast(first_ranges), _RANGE).groupBy("file").agg(F.min_by("text", "row").alias("head"))
    heads = F.broadcast(materialise(heads, "heads"))
    first = heads.orderBy("file").select("head").first()
    if first is None:
        return spark.createDataFrame([], "value string").select()
    names = next(csv.reader(io.StringIO(first["head"], newline=""), delimiter=sep))
    named = records.join(heads, "file")
    is_head = F.col("text") == F.col("head")
    # Rows equal to their file's header are data but for one of them.
    repeats = named.where(is_head).groupBy("file", "text").agg(F.count("*").alias("n")).where("n > 1")
    more = repeats.select("text", F.explode(F.sequence(F.lit(2).cast("long"), F.col("n")))).select("text")
    schema = ", ".join(f"`_{i}` string" for i in range(len(names)))
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}
    parsed = F.from_csv("text", schema, options)
    rows = named.where(~is_head).select("text").unionAll(more).select(parsed.alias("row")).select("row.*")
    return rows.toDF(*names).fillna("")


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, text, complete): the documents of JSON files, over one or many lines, any number in a file."""
    return records_of(lines_of(spark, path), json_grammar()).where("trim(text) != ''").select("file", "text", "complete")
