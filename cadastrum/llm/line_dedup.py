"""Line dedup on levelled sorted runs of line hashes.

Documents come in batches. A run is a stored table (line hash, number of documents
with the line), sorted by hash. Each batch is merge-anti-joined with the run of lines
already known to be common (they need no more counting), and what is left becomes a
run of its own on level 0. When a level holds ``fanout`` runs they are compacted into
one run of the next level: counts of equal hashes are added, and hashes that have
reached the threshold move to the common run. At the end the remaining runs are
merged the same way, and common lines go from every document of every batch.

Lines are hashed inside the text's row, so a line that repeats in one document counts
once without a shuffle. Only hashes, counts and line numbers travel; texts are
shuffled once, to meet the numbers of their common lines. Counts are combined
before each shuffle, so a line of every document costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastrum.llm.expressions import ASCII_BLANKS, ascii_lower, whole_text
from cadastrum.session import materialise


def line_keys(text: Column) -> Column:
    """Array of the lines' keys: blanks stripped at both ends, A-Z in lower case."""
    return F.transform(F.split(ascii_lower(text), "\n", -1), lambda line: F.btrim(line, F.lit(ASCII_BLANKS)))


class LineRuns:
    """The levelled runs of a growing collection. ``common`` has the hashes found in at least ``threshold`` documents."""

    def __init__(self, threshold: int = 10, fanout: int = 4):
        self.threshold, self.fanout = threshold, fanout
        self.levels: list[list[DataFrame]] = []
        self.common: list[DataFrame] = []

    @staticmethod
    def _sorted_run(counts: DataFrame) -> DataFrame:
        return materialise(counts.sortWithinPartitions("hash"), "line-run")

    def _all_common(self) -> DataFrame:
        whole = self.common[0]
        for part in self.common[1:]:
            whole = whole.union(part)
        return whole

    def add(self, lines: DataFrame) -> None:
        """``lines``: one row (hash) for each document and each of its distinct lines."""
        fresh = lines.join(self._all_common(), "hash", "left_anti") if self.common else lines
        self._put(0, self._sorted_run(fresh.groupBy("hash").agg(F.count(F.lit(1)).alias("documents"))))

    def _put(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._compact(runs))

    def _compact(self, runs: list[DataFrame]) -> DataFrame:
        """Merges runs: what is common now leaves the counts for the common run."""
        merged = runs[0]
        for run in runs[1:]:
            merged = merged.union(run)
        counted = self._sorted_run(merged.groupBy("hash").agg(F.sum("documents").alias("documents")))
        self.common.append(self._sorted_run(counted.where(F.col("documents") >= self.threshold).select("hash")))
        return counted.where(F.col("documents") < self.threshold)

    def finish(self) -> DataFrame:
        """Hashes of all common lines; merges what is left on all levels."""
        left = [run for level in self.levels for run in level]
        if len(left) > 1 or self.levels[0]:
            self.levels = [[], [self._compact(left)]]
        return self._all_common()


def drop_common_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = 10, min_chars: int = 1,
    batches: int = 6, fanout: int = 2,
) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text``.

    Every row counts as a document. Null and empty texts have one empty line, which is
    too short to be dropped. A document that loses all lines keeps the empty text.
    Rows of one key and text share their lines' numbers. An empty table gives no rows. A
    column with a result's name gives way to it.
    """
    lines = materialise(
        docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("text_hash"), line_keys(whole_text(text)).alias("keys"))
        .select("id", "text_hash", F.pmod(F.xxhash64("id", "text_hash"), F.lit(batches)).cast("int").alias("batch"),
                F.transform("keys", lambda line: F.when(F.char_length(line) >= min_chars, F.xxhash64(line))).alias("hashes")),
        "line-hashes",
    )
    runs = LineRuns(threshold, fanout)
    for batch in range(batches):
        runs.add(
            lines.where(F.col("batch") == batch)
            .select(F.explode(F.array_distinct("hashes")).alias("hash"))
            .where("hash IS NOT NULL")
        )
    common = runs.finish()

    numbered = lines.select("id", "text_hash", F.posexplode("hashes").alias("number", "hash")).where("hash IS NOT NULL")
    hits = numbered.join(common, "hash", "left_semi").groupBy("id", "text_hash").agg(
        F.collect_set("number").alias("_common")
    ).toDF("_id", "_hash", "_common")
    own = [name for name in docs.columns if name not in ("n_lines", "n_dropped", "kept_text")]
    packed = docs.select(
        F.struct(*own).alias("_row"), F.col(key).alias("_key"), whole_text(text).alias("_text"), F.xxhash64(text).alias("_text_hash")
    )
    found = packed.join(hits, packed["_key"].eqNullSafe(hits["_id"]) & (packed["_text_hash"] == hits["_hash"]), "left")
    count = F.size("_lines")
    kept = F.array_except(F.sequence(F.lit(0), count - 1), F.coalesce("_common", F.array().cast("array<int>")))
    return (
        found.withColumn("_lines", F.split("_text", "\n", -1))
        .withColumn("_kept", kept)
        .select(
            "_row.*",
            count.cast("long").alias("n_lines"),
            (count - F.size("_kept")).cast("long").alias("n_dropped"),
            F.when(count == F.size("_kept"), F.col("_text")).otherwise(
                F.expr("array_join(transform(_kept, number -> element_at(_lines, number + 1)), '\n')")
            ).alias("kept_text"),
        )
    )
