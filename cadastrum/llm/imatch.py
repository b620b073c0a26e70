"""I-Match fingerprints over randomised lexicons.

The lexicon keeps the terms whose document frequency lies within a band; copies of a text count once. A text keeps
its distinct lexicon terms, sorted, and hashes those that fall into each of several
random parts of the lexicon. Parts come at three rates (a 16th, a 128th and a 1024th
of the lexicon, ``PARTS`` of each), so texts of any length have parts that hold
only a few of their terms: those survive an edit of another place. Parts have 24 bits, since only
shares of them count. One more component hashes all kept terms, as the plain method does; it is an
identity by itself and has 64 bits. Two fingerprints are as alike as their parts at the rate that
agrees best.

The lower end of the band is a share of all texts. A corpus of N distinct texts with on
average d distinct terms has N * d (document, term) pairs, so at most d / share terms
reach it: the lexicon's size is bounded whatever N is, and it is checked before it is
broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastrum.llm.expressions import whole_text
from cadastrum.session import materialise

PARTS = 16
RATE_BITS = (4, 3, 3)  # a 16th, then twice an eighth of that
LEAST_SHARE, MOST_SHARE = 0.001, 0.15
# Terms of eight bytes; beyond this the lexicon is joined by a shuffle.
BROADCAST_TERMS = 2_000_000


def terms(text: Column) -> Column:
    """The text's distinct terms: what stands between spaces and line ends, in lower case."""
    return F.array_distinct(F.split(F.replace(F.lower(text), F.lit("\n"), F.lit(" ")), " ", -1))


def lexicon(docs: DataFrame, text: str = "text", least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """(term): hashes of the terms found in ``least`` to ``most`` of all distinct texts, stored.

    Only texts that have copies are grouped; the others are read where they lie.
    """
    whole = whole_text(text)
    hashed = docs.select(F.xxhash64(whole).alias("text_hash"), F.char_length(whole).alias("n_chars"), whole.alias("text"))
    same = ["text_hash", "n_chars"]
    texts = materialise(hashed.groupBy(*same).agg(F.count(F.lit(1)).alias("copies")), "texts")
    rows = texts.count()
    copied = materialise(texts.where("copies > 1").select(*same), "copied")
    once = hashed.join(copied, same, "left_semi").groupBy(*same).agg(F.first("text").alias("text"))
    distinct = hashed.join(copied, same, "left_anti").select("text").union(once.select("text"))
    frequencies = distinct.select(F.explode(terms(F.col("text"))).alias("word")).where("word <> ''").groupBy(
        F.xxhash64("word").alias("term")
    ).agg(F.count(F.lit(1)).alias("documents"))
    return materialise(frequencies.where(F.col("documents").between(least * rows, most * rows)).select("term"), "lexicon")


def _components(prints: DataFrame) -> DataFrame:
    """``prints`` (kept, text) with ``components``: ``parts``, hashes of sorted lexicon terms, and ``whole``, that of all.

    An empty part is null. Where no term is in the lexicon, ``whole`` is the hash of the
    text itself. A bit field of the term's own hash says which parts it is in: the
    parts of a rarer rate are thinned out from those of the rate before.
    """

    def short(hashed: Column) -> Column:
        return hashed.bitwiseAND(0xFFFFFF).cast("int")

    def with_field(terms: Column, used: int, bits: int, value: int) -> Column:
        return F.filter(terms, lambda term: F.shiftrightunsigned(term, used).bitwiseAND((1 << bits) - 1) == value)

    names = [f"_part_{part}" for part in range(PARTS)]
    parts = [with_field(F.col("kept"), 0, RATE_BITS[0], part).alias(name) for part, name in enumerate(names)]
    split = prints.select("*", *parts)
    hashes, used = [], RATE_BITS[0]
    for step in (0, *RATE_BITS[1:]):
        if step:
            thinned = [with_field(F.col(name), used, step, 0).alias(name) for name in names]
            split = split.select(*[c for c in split.columns if c not in names], *thinned)
            used += step
        found = [F.when(F.size(name) > 0, short(F.xxhash64(name))) for name in names]
        hashes.append(f"_hashes_{used}")
        split = split.withColumn(hashes[-1], F.array(*found))
    whole = F.when(F.size("kept") > 0, F.xxhash64("kept")).otherwise(F.col("text"))
    components = F.struct(F.concat(*hashes).alias("parts"), whole.alias("whole"))
    return split.withColumn("components", components).drop(*names, *hashes)


def fingerprints(texts: DataFrame, keys: list[str], text: str, words: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(keys, components, carry) for each key of ``texts``; null texts count as empty.

    Each text adds one row of null term, which holds what is carried along. Rows that are
    already partitioned by ``keys`` are not shuffled again.
    """
    whole = whole_text(text)
    listed = texts.select(
        *keys, F.struct(F.xxhash64(whole).alias("text"), *carry).alias("about"),
        F.explode(F.concat(F.array(F.lit(None).cast("string")), terms(whole))).alias("word"),
    ).select(
        *keys, F.when(F.col("word").isNull(), F.col("about")).alias("about"),
        F.when(F.col("word").isNotNull(), F.xxhash64("word")).alias("term"),
    )
    known = words.withColumn("known", F.lit(True))
    if words.count() <= BROADCAST_TERMS:
        known = F.broadcast(known)
    kept = listed.join(known, "term", "left").where("known OR term IS NULL").groupBy(*keys).agg(
        F.first("about", ignorenulls=True).alias("about"), F.sort_array(F.collect_set("term")).alias("kept")
    )
    prints = kept.select(*keys, "kept", "about.*")
    return _components(prints).select(*keys, "components", *carry)


def as_digits(components: Column) -> Column:
    """A fingerprint as text: six hexadecimal digits for each part, dots for an empty one, then sixteen for the whole."""
    parts = F.transform(components["parts"], lambda part: F.coalesce(
        F.lower(F.lpad(F.hex(part.cast("long")), 6, "0")), F.lit("......")))
    return F.concat(F.array_join(parts, ""), F.lower(F.lpad(F.hex(components["whole"]), 16, "0")))


def likeness(one: Column, other: Column) -> Column:
    """1 if all kept terms agree, else the best rate's share of equal parts (0 to 1).

    The share is among parts not empty in both, and among half the parts at least, so that one
    common term in a sparse rate counts little.
    """
    shares = []
    for first in range(1, PARTS * len(RATE_BITS) + 1, PARTS):
        pairs = F.arrays_zip(F.slice(one["parts"], first, PARTS).alias("a"), F.slice(other["parts"], first, PARTS).alias("b"))
        equal = F.size(F.filter(pairs, lambda pair: pair["a"] == pair["b"]))
        filled = F.size(F.filter(pairs, lambda pair: pair["a"].isNotNull() | pair["b"].isNotNull()))
        shares.append(equal / F.greatest(filled, F.lit(PARTS // 2)))
    return F.when(one["whole"] == other["whole"], 1.0).otherwise(F.greatest(*shares))


def next_keys(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text_hash, n_chars, next_id, next_hash) of each distinct key and text, in the order of key, then hash.

    Nulls come first; after the last row comes the first. The rows are dealt by ranges, so a
    row finds its follower in its own range; only the ranges' first rows, one each, meet in
    one window.
    """
    rows = docs.groupBy(F.col(key).alias("id"), F.xxhash64(text).alias("text_hash"),
                        F.char_length(whole_text(text)).cast("long").alias("n_chars")).agg(F.count(F.lit(1)).alias("copies"))
    ranged = materialise(
        rows.repartitionByRange("id", "text_hash").withColumn("range", F.spark_partition_id()), "ranges"
    )
    order = F.struct(F.col("id").isNotNull().alias("some"), "id", "text_hash")
    firsts = ranged.groupBy("range").agg(F.min(order).alias("head"))
    following = firsts.select(
        "range",
        F.coalesce(F.lead("head").over(Window.orderBy("head")), F.min("head").over(Window.partitionBy())).alias("head"),
    )
    inside = Window.partitionBy("range").orderBy(order)
    led = ranged.withColumn("_next", F.lead(order).over(inside)).join(F.broadcast(following), "range")
    follower = F.coalesce("_next", "head")
    return led.select(
        "id", "text_hash", "n_chars", "copies", follower["id"].alias("next_id"), follower["text_hash"].alias("next_hash")
    )
