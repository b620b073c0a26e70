"""Removal of repeated byte strings against a table of all windows."""

import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cadastrum.llm import queries, repeats

LENGTH = 200


def brute(rows, length=LENGTH):
    """(doc_id, n_bytes, n_removed, n_spans, sha)"""
    texts = [(doc, (text or "").encode()) for doc, text in rows]
    seen = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for doc, t in texts:
        goes = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                goes[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(goes) if g and (not i or not goes[i - 1]))
        kept = bytes(c for c, g in zip(t, goes, strict=True) if not g)
        out.append((doc, len(t), sum(goes), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def query_rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()]
    found = query_rows(queries.op13_suffix_dedup(spark, f"/root/testdata/{sf}"))
    assert found == brute(rows) and any(r[2] for r in found)


def odd_texts():
    chance = random.Random(11)

    def letters(n, alphabet="abcdefgh \n"):
        return "".join(chance.choice(alphabet) for _ in range(n))

    passage, texts = letters(1000), [None, "", "a" * 199, "a" * 200, "a" * 201, "b" * 5000, "ab" * 400, "\x00" * 450, "é" * 300]
    for size in (150, 198, 199, 200, 201, 230, 359, 360, 361, 420, 700):  # around every size that matters
        for _ in range(3):
            at = chance.randrange(1000 - size)
            texts.append(letters(chance.randrange(400)) + passage[at : at + size] + letters(chance.randrange(400)))
    texts += [passage] * 2 + [letters(600, "é\x00x")] * 3
    for _ in range(20):  # near copies
        t = list(passage)
        for _ in range(chance.randrange(1, 5)):
            t[chance.randrange(len(t))] = "#"
        texts.append("".join(t))
    for _ in range(30):  # one line in many texts, at the start, in the middle, at the end
        texts.append(letters(chance.randrange(50)) + passage[:210] + letters(chance.randrange(3)))
    texts += [letters(chance.randrange(900), "ab") for _ in range(40)]
    texts += [letters(100) + ("xyz" * 300) + letters(100) for _ in range(2)]
    return list(enumerate(texts)) + [(None, passage[100:600]), (None, None), (3, "a" * 201)]


def test_odd_texts_equal_brute_force(spark, tmp_path):
    rows = odd_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("one", "two", "kept", "spans", "part", "member"):
        df = df.withColumn(name, F.lit("x"))
    df.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    assert query_rows(queries.op13_suffix_dedup(spark, str(tmp_path))) == brute(rows)


@pytest.mark.parametrize("length", [24, 40, 64, 100])
def test_other_lengths(spark, length, monkeypatch):
    rows = odd_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1)).repartition(4)
    found = repeats.drop_repeats(df.drop("kept"), length=length).collect()
    assert sorted(
        ((r.doc_id, len((r.text or "").encode()), sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in found),
        key=str,
    ) == brute(rows, length)


def test_long_text_in_pieces(monkeypatch):
    """Anchors of a text do not depend on the pieces it is read in, but for ranges cut at their ends."""
    text = "".join(random.Random(4).choices("abcd", k=20_000)).encode()
    sizes = repeats.Sampling(200)
    array = pa.array([b"short", text, b"", text[:500]], type=pa.large_binary())

    def windows(found):
        return sorted((w, p, o) for w, p, a, b in zip(found.which, found.place, found.least, found.most, strict=True) for o in range(a, b + 1))

    whole = windows(repeats.find_anchors(array, sizes))
    assert len(whole) == 20_000 - 199 + 301
    monkeypatch.setattr(repeats, "_PIECE", 700)
    assert windows(repeats.find_anchors(array, sizes)) == whole
    assert windows(repeats.find_anchors(array.slice(1, 2), sizes)) == [(w - 1, p, o) for w, p, o in whole if w == 1]


def test_loser_tree_merges_and_compares_no_known_prefix(monkeypatch):
    chance = random.Random(8)
    strings = [bytes(chance.choices(b"ab", k=chance.randrange(12))) for _ in range(500)]
    for count in (1, 2, 3, 7, 16):
        runs, own = [], [sorted(strings[i::count]) for i in range(count)] + [[]]
        for run in own:
            shared = [0] + [repeats.common_prefix(a, b, 0) for a, b in zip(run, run[1:])]
            runs.append(repeats.Run(shared[: len(run)], [s[n:] for s, n in zip(run, shared)]))
        calls = []
        plain = repeats.common_prefix
        monkeypatch.setattr(repeats, "common_prefix", lambda a, b, known: calls.append(a[:known] == b[:known]) or plain(a, b, known))
        merged = list(repeats.merge_runs(runs))
        monkeypatch.undo()
        assert [s for *_, s in merged] == sorted(strings) and all(calls)
        assert [n for _, n, _ in merged[1:]] == [plain(a, b, 0) for (*_, a), (*_, b) in zip(merged, merged[1:])]


def test_no_rows(spark):
    assert repeats.drop_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
