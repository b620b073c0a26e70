"""Conversation repair against a left-to-right search over plain edit strings."""

import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cadastrum.llm import conversations, queries
from cadastrum.llm.conversations import Repair

BLANKS = " \t\n\x0b\x0c\r"
NEXT = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        text_end = text.rstrip(BLANKS)
        kind = "blank" if not text_end else "duplicate" if (role, text) in seen else "" if text_end[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append(kind)
    return out


def repaired(rows, kinds):
    """Least (cost, edits, rows) over all edit strings; insertions of at most two before each row and at the end."""
    best = {"0": (0, "", ())}

    def offer(into, state, found):
        if state not in into or found[:2] < into[state][:2]:
            into[state] = found

    def grown(states):
        for _ in range(2):
            for state, (cost, edits, out) in list(states.items()):
                for role in ("user", "assistant"):
                    if (state, role[0]) in NEXT:
                        offer(states, NEXT[state, role[0]], (cost + 2, edits + "I", (*out, f"{role}:")))
        return states

    for (_, role, text), kind in zip(rows, kinds, strict=True):
        after = {}
        for state, (cost, edits, out) in grown(best).items():
            offer(after, state, (cost + 3, edits + "D", out))
            if kind not in ("blank", "duplicate"):
                extra = int(kind == "truncated")
                if (state, role[:1]) in NEXT:
                    offer(after, NEXT[state, role[:1]], (cost + extra, edits + "K", (*out, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if (state, new[0]) in NEXT:
                        offer(after, NEXT[state, new[0]], (cost + 2 + extra, edits + "R", (*out, f"{new}:{text}")))
        best = after
    return min(found for state, found in grown(best).items() if state in "0a")


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else "".join(c for c in text if c not in ".!?") if fate == 2 else text
        yield from [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)


def brute(rows):
    found = {conv: [] for conv, *_ in rows}
    for conv, *row in damaged(rows):
        found[conv].append(row)
    out = []
    for conv, own in found.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1].encode())}:{r[1]}:{r[2]}".encode()).digest()))
        kinds = faults(own)
        turns = {t for t, *_ in own if t is not None}
        initials = [r[1][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, lines = repaired(own, kinds)
        out.append((
            conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
            illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def query_rows(df):
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").collect()]
    assert query_rows(queries.op12_conversation_repair(spark, "/root/testdata/sf0.01")) == brute(rows)


@pytest.fixture(scope="module")
def odd_rows():
    chance = random.Random(5)
    roles = ["system", "user", "assistant", "tool", "", None, "User", "sage"]
    texts = ["Yes.", "No!", "cut", " \t", "", None, "why?\r\n", "Yes.", "\x00.", "é" * 30]
    rows = [
        (chance.choice([1, 2, 3, 4, None]), chance.choice([*range(40), None]), chance.choices(roles, [2, 9, 9, 1, 1, 1, 1, 1])[0], chance.choice(texts))
        for _ in range(300)
    ]
    long = [(9, t, chance.choice(["user", "assistant"]), f"{chance.random()}{chance.choice(['.', ''])}") for t in range(700)]
    same = [(10, t % 7, "user", "Again.") for t in range(200)]
    return rows + long + same + [(11, 2, "user", "Long. " * 50_000 + "?"), (2**40, -(2**40), "assistant", "?")]


def test_odd_rows_equal_brute_force(spark, odd_rows, tmp_path):
    df = spark.createDataFrame(odd_rows, "conv_id long, turn long, role string, text string")
    for name in ("conv", "pos", "place", "symbol", "blank", "digest", "out"):
        df = df.withColumn(name, F.lit("x"))
    df.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    assert query_rows(queries.op12_conversation_repair(spark, str(tmp_path))) == brute(odd_rows)


def test_rows_follow_the_pattern(spark, odd_rows):
    df = spark.createDataFrame(odd_rows, "conv_id long, turn long, role string, text string")
    found = {}
    for r in Repair(df).rows().collect():
        found.setdefault(r.conv.id, []).append((r.out, r.role[:1]))
    for rows in found.values():
        rows.sort()
        assert [out for out, _ in rows] == list(range(len(rows)))
        word = "".join(initial for _, initial in rows)
        assert word.removeprefix("s") == "ua" * (len(word) // 2)


def test_any_split_gives_the_same_cell():
    chance = random.Random(3)
    for _ in range(200):
        parts = [conversations.row_cell(chr(ord("A") + chance.randrange(12))) for _ in range(chance.randrange(2, 9))]
        whole = conversations.span_cell(parts)
        for split in range(1, len(parts)):
            cell = {}
            conversations.join_spans(conversations.span_cell(parts[:split]), conversations.span_cell(parts[split:]), cell)
            assert cell == whole


def test_cheapest_is_least_of_all_edit_strings():
    """Against every string of edits on up to three rows, one at a time."""
    rows = [(None, role, text) for role in ("system", "user", "assistant", "tool") for text in ("A.", "A", "")]
    for chosen in itertools.product(rows, repeat=3):
        kinds = faults(chosen)
        symbols = "".join(
            chr(ord("A") + "suat".index(role[0]) + {"": 0, "blank": 4, "duplicate": 4, "truncated": 8}[kind])
            for (_, role, _), kind in zip(chosen, kinds, strict=True)
        )
        assert conversations.cheapest(conversations.span_cell([conversations.row_cell(s) for s in symbols])) == repaired(chosen, kinds)[:2]


def test_no_rows(spark, tmp_path):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    empty.write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op12_conversation_repair(spark, str(tmp_path)).collect() == []
    assert Repair(empty).rows().collect() == []
