"""Token ids as fixed-width packed binary blocks.

The file format is a Parquet folder with one row per block, written by Spark's own
committer, so a retried or speculative task leaves no half file and any store that Spark
reaches will do. A row holds

- ``part``, ``block``: the range of keys and the block's number in it; (part, block) ascends with the keys,
- ``first``: ids of this part before the block (the block offset), ``n_ids``: ids in it, ``bits``: width of one id,
- ``doc_ids``, ``doc_starts``: the documents in the block and the id offsets in it at which they start,
- ``ids``: all ids back to back, ``bits`` bits each, most significant bit first.

The width is the least for the vocabulary. Because it is fixed, any id of a block lies at
a computable bit, so ``unpack`` reads any run of ids alone, with numpy. Blocks close at the first
end of a document after ``BLOCK_IDS`` ids.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadastrum.session import scratch_path

BLOCK_IDS = 1 << 16
MAX_WORDS, KEPT_CHARS = 400_000, 64
_ROWS_AT_ONCE = 256
END_ID = 0
_AT_ONCE = 1 << 16  # a multiple of eight: packed pieces end on whole bytes

BLOCKS = (
    "part int, block int, first long, n_ids long, bits int, doc_ids array<long>, doc_starts array<long>, ids binary"
)
_BLOCKS = pa.schema([
    ("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("bits", pa.int32()),
    ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64())), ("ids", pa.binary()),
])


def width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    parts = []
    for at in range(0, len(ids), _AT_ONCE):
        whole = ids[at : at + _AT_ONCE].astype(">u4").view(np.uint8).reshape(-1, 4)
        if bits % 8 == 0:  # whole bytes need no spreading
            parts.append(whole[:, 4 - bits // 8 :].tobytes())
        else:
            parts.append(np.packbits(np.unpackbits(whole, axis=1)[:, 32 - bits :]).tobytes())
    return b"".join(parts)


def unpack(packed: bytes, bits: int, first: int, count: int) -> np.ndarray:
    """``count`` ids from the ``first``-th on, as unsigned 32-bit numbers; reads only their bytes."""
    whole = np.empty(count, dtype="<u4")
    for at in range(0, count, _AT_ONCE):
        n = min(_AT_ONCE, count - at)
        start = (first + at) * bits
        raw = np.frombuffer(packed, dtype=np.uint8, offset=start // 8, count=(start % 8 + n * bits + 7) // 8)
        if bits % 8 == 0:
            spread = np.zeros((n, 4), dtype=np.uint8)
            spread[:, 4 - bits // 8 :] = raw.reshape(n, bits // 8)
        else:
            spaced = np.zeros((n, 32), dtype=np.uint8)
            spaced[:, 32 - bits :] = np.unpackbits(raw)[start % 8 : start % 8 + n * bits].reshape(n, bits)
            spread = np.packbits(spaced, axis=1)
        whole[at : at + n] = spread.view(">u4")[:, 0]
    return whole


# The pre-token pattern for texts of ASCII and Latin letters alone, where its classes are these ranges.
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_IS_LATIN = re.compile(f"[\\x00-\\x7f{_LATIN}]*").fullmatch
_LATIN_WORDS = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^ \t-\r{_LATIN}0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"
).findall
# Pre-tokens whose byte-level form is the text itself but for the space.
_PLAIN = re.compile(r" ?[!-~]+").fullmatch


class WordIds(dict):
    """Ids of the tokenizer's pre-tokens, as bytes; those met in the last half million or so are kept.

    The tokenizer merges inside pre-tokens only, so a text's ids are those of its pre-tokens in
    turn. Plain pre-tokens go straight to the library's model, others through the whole of it, as do
    texts that hold a special token's string.
    """

    def __init__(self, path: str):
        super().__init__()
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words = regex.compile(public_tokenizers.PATTERN).findall
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.older: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            if _PLAIN(word):
                ids = array("I", [token.id for token in self.model.tokenize(word.replace(" ", "\u0120"))]).tobytes()
            else:
                ids = self._whole(word)
        if len(word) <= KEPT_CHARS:
            if len(self) >= MAX_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if any(token in text for token in self.special):
            return self._whole(text)
        return b"".join(map(self.__getitem__, (_LATIN_WORDS if text.isascii() or _IS_LATIN(text) else self.words)(text)))


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One table for each tokenizer file and Python worker."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def _encode(path: str, key: str, text: str, end_id: int | None):
    end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        bits = width(words.vocabulary)
        part = TaskContext.get().partitionId()
        block, first, held, keys, starts, parts = 0, 0, 0, [], [], []

        def closed() -> pa.RecordBatch:
            packed = pack(np.frombuffer(b"".join(parts), dtype="<u4"), bits)
            row = [part], [block], [first], [held], [bits], [keys], [starts], [packed]
            return pa.record_batch([pa.array(v, type=f.type) for v, f in zip(row, _BLOCKS, strict=True)], schema=_BLOCKS)

        for batch in (b.slice(at, _ROWS_AT_ONCE) for b in batches for at in range(0, b.num_rows, _ROWS_AT_ONCE)):
            for doc, whole in zip(batch[key].to_pylist(), batch[text].to_pylist()):
                ids = words.encode(whole or "") + end
                keys.append(doc)
                starts.append(held)
                parts.append(ids)
                held += len(ids) // 4
                if held >= BLOCK_IDS:
                    yield closed()
                    block, first, held, keys, starts, parts = block + 1, first + held, 0, [], [], []
        if keys:
            yield closed()

    return blocks


def write_token_files(
    docs: DataFrame, tokenizer: str, folder: str | None = None, key: str = "doc_id", text: str = "text",
    end_id: int | None = END_ID,
) -> str:
    """Writes the ids of all whole texts in ascending order of ``key`` and gives the folder.

    Null texts are empty: they hold the end id alone. Null keys come first. Equal keys are
    ordered by their text's hash, and equal rows by their place in the input, so that they need not
    share a range. An empty table gives a folder without blocks.
    """
    folder = folder or scratch_path(docs.sparkSession, "token-ids")
    rows = docs.select(
        F.col(key), F.col(text), F.xxhash64(text).alias("_hash"), F.monotonically_increasing_id().alias("_place")
    )
    dealt = rows.repartitionByRange(F.col(key).asc_nulls_first(), "_hash", "_place").sortWithinPartitions(
        F.col(key).asc_nulls_first(), "_hash", "_place"
    )
    dealt.select(key, text).mapInArrow(_encode(tokenizer, key, text, end_id), BLOCKS).write.parquet(folder)
    return folder


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            starts = np.array([*row["doc_starts"], row["n_ids"]], dtype=np.int64)
            ids = unpack(row["ids"], row["bits"], 0, row["n_ids"])
            sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, starts[1:])]
            yield pa.record_batch({
                "part": pa.array([row["part"]] * len(sums), pa.int32()),
                "doc_id": pa.array(row["doc_ids"], pa.int64()),
                "in_part": pa.array(row["first"] + starts[:-1], pa.int64()),
                "n_tokens": pa.array(np.diff(starts), pa.int64()),
                "ids_crc32": pa.array(sums, pa.int64()),
            })


def read_token_files(spark, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone.

    ``start`` counts the ids of all documents before it. The parts' totals, one row each, meet in
    one window.
    """
    blocks = spark.read.schema(BLOCKS).parquet(folder)
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    read = blocks.mapInArrow(_documents, "part int, doc_id long, in_part long, n_tokens long, ids_crc32 long")
    return read.join(offsets, "part").select(
        "doc_id", (F.col("before") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32"
    )
