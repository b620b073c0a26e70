"""Indexed searches against the condition on the whole table."""

import random

import pytest
from pyspark.sql import functions as F

from cadastrum.functions.text import like_any
from cadastrum.operators.search_index import SearchIndex, pattern_trigrams


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    chance = random.Random(3)
    words = ["Saint-Étienne", "PARIS 07", "Lyon", "a%b", "x_y", "back\\slash", "île", "ab", "", None, "Aix-en-Provence"]
    rows = [(i, f"{i:05d}", " ".join(w for w in chance.choices(words, k=2) if w is not None) if i % 7 else None) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, code string, name string").repartition(5)
    return df, SearchIndex(str(tmp_path_factory.mktemp("index")), ("code", "name")).write(df, [F.col("code")], partitions=16)


PATTERNS = ["", "  ", "0123", "00123", "étienne", "ÉTIENNE pa", "a%b", "x_y", "%", "_", "ab", "lyon%ly", "0_12", "back\\slash", "nowhere", "paris 07 a", "12%34"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_equal_to_the_scan(spark, index, pattern):
    df, stored = index
    expected = sorted(r.id for r in df.where(like_any(["code", "name"], pattern)).collect())
    assert sorted(r.id for r in stored.search(spark, pattern).collect()) == expected


def test_only_zones_that_can_match_are_read(spark, index):
    stored = index[1]
    assert 1 <= stored.candidates(spark, "00123").count() <= 5 < stored.zones.rows(spark).select("zone").distinct().count()
    assert stored.candidates(spark, "nowhere").count() == 0
    assert stored.candidates(spark, "x_y") is None
    found = stored.search(spark, "00123")
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()


def test_trigrams_of_patterns():
    assert pattern_trigrams("Abcd%ef_ghi") == ["abc", "bcd", "ghi"] and pattern_trigrams("a%b_cd") == []


def test_no_rows(spark, tmp_path):
    stored = SearchIndex(str(tmp_path / "i"), ("v",)).write(spark.createDataFrame([], "v string"), [F.col("v")])
    assert stored.search(spark, "abc").collect() == [] and stored.search(spark, "").collect() == []
