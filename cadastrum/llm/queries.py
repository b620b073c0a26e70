"""One query for each operator, over its whole table, and the SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastrum.llm import (
    conversations, decontamination, imatch, line_dedup, mixing, quality, repeats, secrets, sharding, simhash, token_counts, token_files,
    whitening,
)
from cadastrum.llm.expressions import repeat_rows, whole_text
from cadastrum.registry.base import table
from cadastrum.session import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SHARDS = 8
TOKEN_LIMIT = 4096
CUT_AT = 0.3


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(function):
    QUERIES[function.__name__] = function
    return function


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards; counts at most one apart."""
    text = whole_text("text")
    rows = documents(spark, sf_dir).select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32")
    )
    placed = sharding.assign_shards(rows, ["doc_id", "text_crc32"], SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "home_shard",
    )


def quality_model(spark: SparkSession, sf_dir: str) -> quality.RuleModel:
    """Fitted on labelled documents outside the held-out fifth."""
    labels = table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    chosen = quality.sample_labels(labels.select("doc_id", "quality"), "doc_id")
    # About FIT_ROWS short rows at most, so the texts need no shuffle.
    labelled = documents(spark, sf_dir).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return quality.fit_on_texts(labelled, "text", "quality")


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    scored = quality.score_texts(documents(spark, sf_dir), quality_model(spark, sf_dir))
    return scored.select(
        "doc_id", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0).alias("held_out"), "score",
        (F.col("score") >= CUT_AT).cast("int").alias("predicted"),
    )


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by piece_bpe_32k.model."""
    rows = documents(spark, sf_dir).select("doc_id", whole_text("text").alias("text"))
    counted = token_counts.count_tokens(rows, tokenizer_path("piece_bpe_32k.model"))
    return counted.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens",
        (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"),
    )


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more leave every document."""
    kept = line_dedup.drop_common_lines(documents(spark, sf_dir).select("doc_id", "text"), threshold=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op4_line_dedup"] = """
WITH docs AS (SELECT row_number() OVER () AS row_no, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
numbered AS (SELECT row_no, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS number FROM docs),
keyed AS (
  SELECT row_no, doc_id, number, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM numbered),
common AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row_no) >= 10),
marked AS (SELECT k.*, c.key IS NOT NULL AS dropped FROM keyed k LEFT JOIN common c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY number) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY row_no, doc_id
"""


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150 % of all words, sources weighing 3, 1, 2 in turn."""
    rows = materialise(
        documents(spark, sf_dir).select(
            "doc_id", "source", mixing.word_count(F.col("text")).alias("size"), mixing.mix_hash("doc_id", "text").alias("mix_hash")
        ),
        "mix-rows",
    )
    mixed = mixing.mix_rows(rows, weights=(3, 1, 2), share=1.5, most=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of ten words in every document."""
    found = decontamination.contamination(
        documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "benchmark"), window=10
    )
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLES["op6_decontamination"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item, array_to_string(words[i : i + least(len(words), 10) - 1], ' ') AS win, least(len(words), 10) AS n
  FROM (SELECT item, words, unnest(generate_series(1, greatest(len(words) - 9, 1))) AS i FROM items WHERE len(words) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
runs AS (
  SELECT row_no, n, i, array_to_string(words[i : i + n - 1], ' ') AS win
  FROM (SELECT row_no, words, n, unnest(generate_series(1, len(words) - n + 1)) AS i FROM docs, lengths WHERE len(words) >= n)),
found AS (SELECT r.row_no, r.i, r.n, w.item FROM runs r JOIN windows w USING (win, n)),
hit AS (
  SELECT row_no, count(DISTINCT spot) AS n_hit
  FROM (SELECT row_no, unnest(generate_series(i, i + n - 1)) AS spot FROM (SELECT DISTINCT row_no, i, n FROM found)) GROUP BY row_no),
named AS (
  SELECT row_no, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT row_no, item FROM found) GROUP BY row_no)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (row_no) LEFT JOIN named USING (row_no)
"""


@query
def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its text with the last quarter replaced by the next document's start.

    Texts are shuffled once by key; both joins and the grouping of the terms use that partitioning.
    """
    docs = documents(spark, sf_dir).select("doc_id", "text")
    words = imatch.lexicon(docs)
    ring = materialise(imatch.next_keys(docs), "next-documents")
    keys = ["_id", "_none", "_hash"]

    def keyed(id_column: str, hash_column: str):
        return [F.coalesce(id_column, F.lit(0)).alias("_id"), F.col(id_column).isNull().alias("_none"), F.col(hash_column).alias("_hash")]

    texts = docs.withColumn("_text_hash", F.xxhash64("text")).select(
        *keyed("doc_id", "_text_hash"), whole_text("text").alias("text")
    )
    asked = ring.select(
        *keyed("next_id", "next_hash"), F.col("id").alias("by_id"), F.col("text_hash").alias("by_hash"),
        F.expr("cast(n_chars div 4 AS int)").alias("wanted"),
    )
    starts = texts.join(asked, keys).select(
        *keyed("by_id", "by_hash"), F.expr("substring(text, 1, wanted)").alias("start")
    ).groupBy(*keys).agg(F.first("start").alias("start"))
    quarter = F.expr("char_length(text) div 4")
    edited = F.concat(F.substring("text", F.lit(1), (F.char_length("text") - quarter).cast("int")), F.col("start"))
    both = texts.join(starts, keys).withColumn("edited", edited).select(
        *keys,
        F.explode(F.array(
            F.struct(F.lit(False).alias("is_edited"), F.col("text"), F.lit(None).cast("string").alias("sha")),
            F.struct(F.lit(True).alias("is_edited"), F.col("edited").alias("text"), F.sha2("edited", 256).alias("sha")),
        )).alias("one"),
    ).select(*keys, "one.*")
    prints = imatch.fingerprints(both, [*keys, "is_edited"], "text", words, carry=("sha",))
    paired = materialise(
        prints.groupBy(*keys).agg(
            F.first(F.when(~F.col("is_edited"), F.col("components")), ignorenulls=True).alias("own"),
            F.first(F.when(F.col("is_edited"), F.col("components")), ignorenulls=True).alias("changed"),
            F.max("sha").alias("edited_sha256"),
        ),
        "fingerprints",
    )
    following = paired.select(*keys, F.col("own").alias("following")).join(
        ring.select(*keyed("next_id", "next_hash"), F.col("id").alias("by_id"), F.col("text_hash").alias("by_hash"), "n_chars", "copies"),
        keys,
    ).select(*keyed("by_id", "by_hash"), F.col("by_id").alias("doc_id"), "n_chars", "copies", "following")
    rows = paired.join(following, keys)
    return repeat_rows(rows, "copies").select(
        "doc_id", "n_chars", "edited_sha256",
        imatch.as_digits(F.col("own")).alias("fingerprint"), imatch.as_digits(F.col("changed")).alias("edited_fingerprint"),
        imatch.likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        imatch.likeness(F.col("own"), F.col("following")).alias("near_next"),
    )


@query
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    found = secrets.scan_secrets(documents(spark, sf_dir).select("doc_id", "text")).drop("text")

    def spans(kinds) -> str:
        listed = ", ".join(f"'{kind}'" for kind in kinds)
        return f"array_join(transform(filter(secrets, s -> s.kind IN ({listed})), s -> concat_ws(':', s.kind, s.start, s.end)), ',')"

    return found.select(
        "doc_id",
        *(F.expr(f"cast(size(filter(secrets, s -> s.kind = '{kind}')) AS bigint)").alias(f"n_{kind}") for kind in secrets.BASE_KINDS),
        F.sha2(F.expr(spans(secrets.BASE_KINDS)), 256).alias("base_sha256"),
        F.expr(spans(secrets.KINDS)).alias("spans"),
    )


@query
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents written as packed blocks and read back."""
    folder = token_files.write_token_files(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))
    return token_files.read_token_files(spark, folder)


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose fingerprints are linked by three bits or fewer."""
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with a fifth of their turns damaged: dropped, emptied, cut off, repeated or given to the user."""
    spaced = rows.select("conv_id", "turn", *(F.coalesce(name, F.lit(" ")).alias(name) for name in ("role", "text")))
    named = F.concat_ws(":", *(F.coalesce(F.col(name).cast("string"), F.lit(" ")) for name in ("conv_id", "turn")))
    fate = F.crc32(named) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    changed = spaced.where(fate != 0).select(
        "conv_id", "turn", F.when(fate == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.when(fate == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    return changed.drop("copy")


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation."""
    rows = table(spark, sf_dir, "conversations")
    repair = conversations.Repair(damaged(rows))
    found = repair.summary().withColumn("parsed", F.struct("conv_id"))
    digests = repair.digests().select(F.struct("conv_id").alias("hashed"), "repaired_sha256")
    every = rows.select("conv_id").distinct().select(F.struct("conv_id").alias("own"))
    joined = every.join(found.drop("conv_id"), F.col("own") == F.col("parsed"), "left").join(
        digests, F.col("own") == F.col("hashed"), "left"
    )
    return joined.select(
        "own.conv_id",
        *(F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen whitened components of every embedding."""
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


@query
def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every byte of a 200-byte string that starts twice goes."""
    docs = documents(spark, sf_dir).select("doc_id", whole_text("text").alias("text"))
    cut = repeats.cut_texts(docs).select(
        "one", "two", F.sha2("kept", 256).alias("cut_sha256"), F.size("spans").cast("long").alias("n_spans"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
    )
    rows = docs.select(
        "doc_id", *repeats.text_key(F.col("text")), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha256")
    )
    zero = F.lit(0).cast("long")
    return rows.join(cut, ["one", "two"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("cut_sha256", "sha256").alias("kept_sha256"),
    )
