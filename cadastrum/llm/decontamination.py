"""Benchmark decontamination by a hash set of normalised test n-grams.

A window is ``window`` consecutive words of a benchmark item (a shorter item is one
window). The scan need not look at every word: any 10 consecutive words of a document
hold a 5-gram that starts at a multiple of 6, so the 5-grams at every sixth word are
looked up in the set of all 5-grams of the windows. Windows of a shorter item are
looked up at every word, and only if there are such items. The scan compares hashes
of the same normal form as the verification (A-Z in lower case), so it misses
nothing; documents with a hit are then verified word by word.

The set is joined plainly: Spark broadcasts it while its stored size is below the
session's threshold and shuffles the grams of the documents otherwise. The scan's
result is combined per document before it is shuffled, and texts travel only for the
documents that are verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastrum.llm.expressions import ALNUM_WORD, all_words, ascii_lower, repeat_rows, whole_text
from cadastrum.session import materialise


def _gram_hashes(words: Column, length: int, step: int = 1) -> Column:
    """Hashes of the word n-grams that start at every ``step``-th word."""
    last = F.size(words) - length + 1
    grams = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1)), F.lit(step)),
                        lambda start: F.xxhash64(F.slice(words, start, length)))
    return F.when(last >= 1, grams).otherwise(F.array().cast("array<bigint>"))


def _windows(words: Column, length: int) -> Column:
    """(first word from 0, text) of every run of ``length`` words."""
    last = F.size(words) - length + 1
    runs = F.transform(
        F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
        lambda start: F.struct((start - 1).alias("first"), F.array_join(F.slice(words, start, length), " ").alias("window")),
    )
    return F.when(last >= 1, runs).otherwise(F.array().cast("array<struct<first:int,window:string>>"))


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = 10) -> DataFrame:
    """(window, length, items): each distinct window with the sorted ids of the items that have it.

    Items without words, and items of null id, have no windows.
    """
    items = benchmark.where(F.col(item).isNotNull()).select(
        F.col(item).cast("string").alias("item"), all_words(ascii_lower(whole_text(text)), ALNUM_WORD).alias("words")
    ).where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(window))
    return (
        items.withColumn("length", length)
        .select("item", "length", F.explode(_windows(F.col("words"), F.col("length"))).alias("found"))
        .groupBy(F.col("found.window").alias("window"), "length")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )


def contamination(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", window: int = 10
) -> DataFrame:
    """(key, text_hash, n_words, n_hit, items) of every row of ``docs``.

    A word is hit if it lies inside any occurrence of a window. Null and empty texts have
    no words. An empty benchmark hits nothing; repeated items count once by id; repeated
    rows of ``docs`` each give a row. An empty table gives no rows.
    """
    windows = materialise(benchmark_windows(benchmark, text=text, window=window), "benchmark-windows")
    short = sorted(row.length for row in windows.select("length").distinct().collect() if row.length < window)  # < window
    gram = max(1, window // 2)
    step = window - gram + 1
    window_words = F.split("window", " ")
    set_grams = F.when(F.col("length") == window, _gram_hashes(window_words, gram)).otherwise(
        F.array(F.xxhash64(window_words))
    )
    gram_set = materialise(windows.select(F.explode(set_grams).alias("gram")).distinct(), "benchmark-grams")

    scanned_words = F.col("words")
    looked_up = F.concat(_gram_hashes(scanned_words, gram, step), *(_gram_hashes(scanned_words, n) for n in short))
    grams = (
        docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("text_hash"),
                    all_words(ascii_lower(whole_text(text)), ALNUM_WORD).alias("words"))
        .select("id", "text_hash", F.size("words").cast("long").alias("n_words"), looked_up.alias("grams"))
        .select("id", "text_hash", "n_words", F.posexplode_outer("grams").alias("place", "gram"))
    )
    marked = gram_set.withColumn("hit", F.lit(True))
    scan = materialise(
        grams.join(marked, "gram", "left").groupBy("id", "text_hash", "n_words").agg(
            F.max(F.coalesce("hit", F.lit(False))).alias("suspect"),
            F.count(F.when(F.coalesce("place", F.lit(0)) == 0, 1)).alias("copies"),
        ),
        "scan",
    )

    suspects = scan.where("suspect").select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"))
    suspects = materialise(suspects, "suspects")
    texts = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    texts = texts.join(suspects, texts["id"].eqNullSafe(suspects["_id"]) & (texts["text_hash"] == suspects["_hash"]), "left_semi")
    exact = texts.select("id", "text_hash", all_words(ascii_lower(whole_text("text")), ALNUM_WORD).alias("words"))
    occurrences = None
    for length in [*short, window]:
        part = exact.select("id", "text_hash", F.lit(length).alias("length"),
                            F.explode(_windows(F.col("words"), length)).alias("at"))
        occurrences = part if occurrences is None else occurrences.union(part)
    verified = (
        occurrences.select("id", "text_hash", "length", "at.first", "at.window")
        .join(windows, ["window", "length"])
        .groupBy("id", "text_hash")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence("first", F.col("first") + F.col("length") - 1)))))
            .cast("long").alias("n_hit"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
        .withColumnsRenamed({"id": "_id", "text_hash": "_hash"})
    )
    joined = scan.join(verified, scan["id"].eqNullSafe(verified["_id"]) & (scan["text_hash"] == verified["_hash"]), "left")
    return repeat_rows(joined, "copies").select(
        F.col("id").alias(key), "text_hash", "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def remove_contaminated(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", window: int = 10
) -> DataFrame:
    """``docs`` without the documents that hold a window of the benchmark; columns unchanged."""
    found = contamination(docs, benchmark, key, text, window).where("n_hit > 0")
    bad = materialise(found.select(F.col(key).alias("_id"), F.col("text_hash").alias("_hash")), "contaminated")
    return docs.join(bad, docs[key].eqNullSafe(bad["_id"]) & (F.xxhash64(docs[text]) == bad["_hash"]), "left_anti")
