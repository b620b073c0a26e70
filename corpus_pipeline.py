"""From raw documents to token files in five stages, each stored before the next one reads it.

1. quality: rejects documents that score below 0.3,
2. near_duplicates: keeps one document of each group of SimHash fingerprints linked at three bits or fewer,
3. decontamination: removes documents that hold a benchmark window of ten words,
4. mixing: takes documents by source to the target weights, some of them twice,
5. token_files: writes the ids as packed blocks and returns one row per document read from them.

Every stage but the last returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadastrum.llm import decontamination, mixing, quality, simhash, token_files
from cadastrum.llm.queries import CUT_AT, quality_model, tokenizer_path
from cadastrum.registry.base import table
from cadastrum.session import materialise


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = quality.score_texts(docs, quality_model(spark, sf_dir), name="_quality")
    return scored.where(f"_quality >= {CUT_AT}").drop("_quality")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_per_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs, weights=(3, 1, 2), share=1.5, most=2.0)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    folder = token_files.write_token_files(docs, tokenizer_path("byte_bpe_50k.json"))
    return token_files.read_token_files(spark, folder)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]

# Fitted weights, XXH64 and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
