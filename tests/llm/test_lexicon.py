"""Copies of a text do not move the lexicon."""

from pyspark.sql import functions as F

from cadastrum.llm import imatch


def test_copies_count_once(spark):
    hot = "t1 u1 rare words"
    texts = [f"t{i % 10} u{i % 7} v{i}" for i in range(100)] + [hot, "", None]
    once = spark.createDataFrame([(t,) for t in texts], "text string")
    many = spark.createDataFrame([(t,) for t in texts + [hot] * 60 + [None] * 5], "text string")
    found = [{r.term for r in imatch.lexicon(table, least=0.005, most=0.2).collect()} for table in (once, many)]
    assert found[0] == found[1]
    terms = spark.createDataFrame([(t,) for t in hot.split()], "term string").select(F.xxhash64("term").alias("hash"))
    assert {r["hash"] for r in terms.collect()} <= found[1]
    assert imatch.lexicon(many.limit(0)).count() == 0
