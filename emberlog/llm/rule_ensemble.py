"""Quality classifier: a sparse ensemble of rules over statistics of the text.

Each path of a small random forest, from the root to any node below it, is a rule: a conjunction of thresholds. A
lasso logistic regression over the rules' outcomes keeps a few of them and weighs them. The kept rules become one
Spark column expression over the statistics, so scoring needs no model on the executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.shared import learning_fold, scratch, stored
from emberlog.llm.textstats import COUNTS, with_counts

TREES, DEPTH, SEED = 12, 3, 17
LASSO = 0.002
#: Labelled rows in one partition while fitting.
ROWS_A_TASK = 200_000
#: Statistics that rules speak of, over the counts of a text. All are 0 for an empty text.
STATISTICS = {
    "words_log2": "log2(1 + n_words)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(word_chars, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "top_word_share": "n_top_word / greatest(n_words, 1)",
    "short_share": "n_short_words / greatest(n_words, 1)",
    "words_a_line": "n_words / greatest(n_lines, 1)",
}

#: (statistic, threshold, at most the threshold?)
Condition = tuple[str, float, bool]


@dataclass(frozen=True)
class RuleEnsemble:
    """A logistic sum of weighted rules."""

    intercept: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def score(self) -> Column:
        """The probability of label 1 as a column over the statistics."""
        total = F.lit(self.intercept)
        for conditions, weight in self.rules:
            total += F.when(rule_column(conditions), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def rule_column(conditions: tuple[Condition, ...]) -> Column:
    holds = F.lit(True)
    for name, threshold, at_most in conditions:
        holds &= (F.col(name) <= threshold) if at_most else (F.col(name) > threshold)
    return holds


def tightest(conditions: tuple[Condition, ...]) -> tuple[Condition, ...]:
    """The same conjunction with one condition for each statistic and side, in a fixed order."""
    bounds: dict[tuple[str, bool], float] = {}
    for name, threshold, at_most in conditions:
        old = bounds.get((name, at_most), threshold)
        bounds[name, at_most] = min(old, threshold) if at_most else max(old, threshold)
    return tuple((name, t, side) for (name, side), t in sorted(bounds.items()))


def tree_rules(node, names: list[str], above: tuple[Condition, ...] = ()) -> list[tuple[Condition, ...]]:
    """The conjunctions on all paths below a node of a fitted tree."""
    if node.subtreeDepth() == 0:
        return []
    split, found = node.split(), []
    for child, at_most in ((node.leftChild(), True), (node.rightChild(), False)):
        path = tightest((*above, (names[split.featureIndex()], split.threshold(), at_most)))
        found += [path, *tree_rules(child, names, path)]
    return found


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, STATISTICS) of each row of docs."""
    return with_counts(docs, "doc_id").select("doc_id", *[F.expr(e).cast("double").alias(name) for name, e in STATISTICS.items()])


def learn(labelled: DataFrame) -> RuleEnsemble:
    """Fits the ensemble on labelled (STATISTICS, label 0.0 or 1.0). With one label or none: its rate, or 0.5, and no rule."""
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows at most
    total = sum(counts.values())
    if len(counts) < 2:
        rate = (sum(label * n for label, n in counts.items()) + 1) / (total + 2)
        return RuleEnsemble(math.log(rate / (1 - rate)), ())
    names = list(STATISTICS)
    spread = labelled.repartition(max(1, -(-total // ROWS_A_TASK)))
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(spread).select("features", "label", *names)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird").fit(rows)
    found = sorted({rule for tree in forest.trees for rule in tree_rules(tree._java_obj.rootNode(), names)})
    if not found:
        return RuleEnsemble(math.log(counts[1.0] / counts[0.0]), ())
    outcomes = rows.select("label", *[rule_column(r).cast("double").alias(f"rule_{k}") for k, r in enumerate(found)])
    inputs = VectorAssembler(inputCols=[f"rule_{k}" for k in range(len(found))], outputCol="outcomes").transform(outcomes).select("outcomes", "label")
    lasso = LogisticRegression(featuresCol="outcomes", regParam=LASSO, elasticNetParam=1.0, maxIter=60, standardization=False).fit(inputs)
    weights = lasso.coefficients.toArray()
    return RuleEnsemble(float(lasso.intercept), tuple((r, float(w)) for r, w in zip(found, weights, strict=True) if w))


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text); learns from labels (doc_id, quality).

    Rows whose id's fold is `held_out` are never learnt from; null labels don't count, and of several labels of one id
    the smallest holds. Null texts score as empty ones. An empty table of documents gives no row.
    """
    table = stored(statistics(docs), f"{scratch(docs.sparkSession, 'rule-ensemble')}/statistics")
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("double").alias("label"))
    learnt = table.where(learning_fold(F.col("doc_id"), folds) != held_out).join(known, "doc_id")
    ensemble = learn(stored(learnt.drop("doc_id"), f"{scratch(docs.sparkSession, 'rule-ensemble')}/labelled"))
    out = table.select("doc_id", (learning_fold(F.col("doc_id"), folds) == held_out).alias("held_out"), ensemble.score().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
