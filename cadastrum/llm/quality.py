"""Quality classifier: a sparse ensemble of rules over text statistics.

A small random forest on statistics of the texts proposes rules: every path from a root
to a node is a conjunction of comparisons. Each rule is a 0/1 feature; a lasso-penalised
logistic regression keeps few of them, and these are compiled into one Spark column
expression over the statistics. Scoring is therefore a plain projection of the scan.

The fit takes about ``FIT_ROWS`` labelled rows at most, chosen by a hash of their key, so its
cost does not grow with the corpus; the lasso weights are found on the driver from these rows' few statistics.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastrum.llm.expressions import SPACED_WORD, all_words, whole_text
from cadastrum.session import materialise

FIT_ROWS = 20_000
TREES, DEPTH = 24, 4
LASSO = 0.002
STEPS, SETTLED = 2_000, 1e-6

_SPLIT = re.compile(r"(If|Else) \(feature (\d+) (<=|>) (\S+)\)")


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text as columns. Empty texts have zeros and no nulls."""
    chars = F.char_length(text)

    def share(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)) / F.greatest(chars, F.lit(1))

    words = all_words(text, SPACED_WORD)
    count = F.size(words)
    lines = F.split(text, "\n", -1)
    return {
        "log_chars": F.log1p(chars),
        "log_words": F.log1p(count),
        "chars_per_word": chars / F.greatest(count, F.lit(1)),
        "distinct_words": F.size(F.array_distinct(words)) / F.greatest(count, F.lit(1)),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "chars_per_line": F.log1p(chars / F.size(lines)),
        "upper": share(r"\p{Lu}"),
        "digits": share(r"\p{Nd}"),
        "symbols": share(r"[^\p{L}\p{N}\s.,;:'\"()-]"),
        "stops": share(r"[.!?]"),
        "commas": share(r","),
        "repeats": share(r"(\S)\1\1"),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, comparison, bound)."""

    terms: tuple[tuple[str, str, float], ...]

    def marks(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        tests = [rows[name] <= bound if sign == "<=" else rows[name] > bound for name, sign, bound in self.terms]
        return np.logical_and.reduce(tests)

    def column(self) -> Column:
        tests = [F.col(name) <= bound if sign == "<=" else F.col(name) > bound for name, sign, bound in self.terms]
        whole = tests[0]
        for test in tests[1:]:
            whole = whole & test
        return whole


def tree_rules(debug_string: str, names: list[str]) -> list[Rule]:
    """The rules of all paths of a tree ensemble, from its public description."""
    rules: dict[Rule, None] = {}
    path: list[tuple[str, str, float]] = []
    for line in debug_string.splitlines():
        found = _SPLIT.search(line)
        if not found:
            if line.lstrip().startswith("Tree "):
                path, margin = [], len(line) - len(line.lstrip()) + 2
            continue
        depth = (len(line) - len(line.lstrip()) - margin)
        path = path[:depth]
        path.append((names[int(found[2])], found[3], float(found[4])))
        bounds: dict[tuple[str, str], float] = {}
        for name, sign, bound in path:
            tightest = min if sign == "<=" else max
            bounds[name, sign] = tightest(bounds.get((name, sign), bound), bound)
        rules[Rule(tuple((name, sign, bound) for (name, sign), bound in sorted(bounds.items())))] = None
    return list(rules)


@dataclass(frozen=True)
class RuleModel:
    """Weighted rules and an intercept; ``score`` is a column over the statistics."""

    intercept: float
    weights: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.weights:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def lasso_weights(marks: np.ndarray, ones: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the mean logistic loss plus ``penalty`` times the weights' absolute sum.

    Accelerated proximal gradient steps, restarted where they turn back; the intercept bears no penalty.
    """
    n = len(marks)
    whole = np.hstack([marks, np.ones((n, 1))]).astype(np.float32)
    top = np.ones(whole.shape[1], dtype=np.float32)
    for _ in range(30):
        top = whole.T @ (whole @ top)
        top /= np.linalg.norm(top)
    step = 4 * n / float(np.linalg.norm(whole @ top) ** 2) / 1.01
    weights = ahead = np.zeros(whole.shape[1])
    pace = 1.0
    for _ in range(STEPS):
        chance = 1 / (1 + np.exp(-(whole @ ahead.astype(np.float32)).astype(np.float64)))
        moved = ahead - step * (whole.T @ (chance - ones).astype(np.float32)).astype(np.float64) / n
        moved[:-1] = np.sign(moved[:-1]) * np.maximum(np.abs(moved[:-1]) - step * penalty, 0)
        turned = (ahead - moved) @ (moved - weights) > 0
        later = 1.0 if turned else (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        ahead = moved if turned else moved + (pace - 1) / later * (moved - weights)
        settled = np.abs(moved - weights).max() < SETTLED
        weights, pace = moved, later
        if settled:
            break
    return weights[:-1], float(weights[-1])


def fit_rules(labelled: DataFrame, names: list[str], label: str = "label", seed: int = 7) -> RuleModel:
    """Fits on rows of the statistics ``names`` and a 0/1 ``label``; nulls in the label are skipped.

    Rows of one class alone, or no rows, give a constant score (the share of label 1, 0.5 if none).
    """
    rows = materialise(labelled.where(F.col(label).isin(0, 1)).select(*names, F.col(label).cast("double").alias("label")), "fit-rows")
    ones, count = rows.agg(F.sum("label"), F.count(F.lit(1))).first()
    if not count or ones in (0, count):
        share = 0.5 if not count else min(max(ones / count, 1e-3), 1 - 1e-3)
        return RuleModel(math.log(share / (1 - share)), ())
    assembled = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, seed=seed, featureSubsetStrategy="sqrt", minInstancesPerNode=5
    ).fit(assembled)
    rules = tree_rules(forest.toDebugString, names)
    if not rules:
        share = ones / count
        return RuleModel(math.log(share / (1 - share)), ())
    # FIT_ROWS short rows at most, in an order of their own so that sums come out alike.
    table = rows.select(*names, "label").toArrow()
    columns = {name: table.column(name).to_numpy().astype(np.float64) for name in [*names, "label"]}
    order = np.lexsort(list(columns.values()))
    columns = {name: values[order] for name, values in columns.items()}
    marks = np.stack([rule.marks(columns) for rule in rules], axis=1)
    found, intercept = lasso_weights(marks, columns["label"], LASSO)
    return RuleModel(intercept, tuple((rule, float(w)) for rule, w in zip(rules, found, strict=True) if w))


def sample_labels(labels: DataFrame, key: str, rows: int = FIT_ROWS) -> DataFrame:
    """All of ``labels``, or about ``rows`` of them where there are more: those whose key's hash is low.

    The choice depends on the keys and their number alone. Rows of a null key are left out.
    """
    keyed = labels.where(F.col(key).isNotNull())
    count = keyed.count()
    if count <= rows:
        return keyed
    return keyed.where(F.shiftrightunsigned(F.xxhash64(F.lit("fit"), F.col(key)), 11) < int(rows / count * 2**53))


def fit_on_texts(labelled: DataFrame, text: str, label: str) -> RuleModel:
    """``fit_rules`` on the statistics of a bounded number of labelled texts."""
    stats = statistics(whole_text(text))
    known = labelled.where(F.col(label).isNotNull())
    return fit_rules(
        known.select(*(column.alias(name) for name, column in stats.items()), F.col(label).alias("label")), list(stats)
    )


def score_texts(docs: DataFrame, model: RuleModel, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of the whole text (null as empty); one projection.

    Other columns stay as they are; one named like the score gives way to it. Every row is scored,
    repeated rows alike; an empty table gives no rows.
    """
    stats = statistics(whole_text(text))
    own = [column for column in docs.columns if column != name]
    inner = docs.select(F.struct(*own).alias("_row"), *(column.alias(stat) for stat, column in stats.items()))
    # The generator keeps a later filter on the score from being pushed below the statistics, where
    # every rule would compute them anew.
    scored = inner.select("_row", F.explode(F.array(model.score())).alias("_score"))
    return scored.select("_row.*", F.col("_score").alias(name))
