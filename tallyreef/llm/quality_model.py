"""Quality classifier as a sparse rule ensemble.

Small trees are grown on statistics of labelled texts; every path from a root to
a node is a conjunctive rule. A logistic regression with a lasso penalty weighs
the rules, most weights become zero, and the remaining rules are compiled into
one Spark column expression over the statistics.

The model is fitted on a bounded sample of labelled rows (SAMPLE_ROWS, by hash of
the id), so the rules number at most TREES * 2^(DEPTH + 1).

Defined cases: a null text counts as empty, and an empty text is scored from its
statistics like any other; labels that are null do not count, and several labels
of one id are averaged; without labels of both kinds every text scores the share
of label 1 (0.5 without any); repeated rows are scored alike; a very long
text is read whole, in time linear in its length; an empty table gives no rows; rules of
equal weight stand in the order in which trees name them; extra columns of the documents
are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyreef.llm import common
from tallyreef.llm.quality_rules import Text

#: Labelled rows at most that the model is fitted on, about.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS = 16, 3, 32
LASSO = 0.002
THRESHOLD = 0.7
SEED = 7

STATISTICS = (
    "log_words", "word_length", "symbols", "exclamations", "bars", "capitals", "letters", "digits", "punctuation",
    "distinct", "top_word", "stutter", "repeated", "dup_lines", "line_words", "line_ends",
)


def statistics(text: str | None) -> tuple[float, ...]:
    """The values of STATISTICS; shares are of words or code points, 0 for empty texts."""
    t = Text(text)
    n, chars = max(1, t.n_words), max(1, t.word_chars)
    lines = max(1, len(t.lines))
    counts = Counter(t.words)
    flat = t.text
    letters = sum(map(len, re.findall(r"[^\W\d_]+", flat)))
    upper = sum(map(len, _UPPER.findall(flat)))
    digits = sum(map(len, re.findall(r"\d+", flat)))
    return (
        math.log1p(t.n_words), t.word_chars / n, t.n_symbols / n, flat.count("!") / n, flat.count("|") / n, upper / max(1, letters), letters / chars, digits / chars,
        (chars - letters - digits) / chars, len(counts) / n, max(counts.values(), default=0) / n, sum(map(bytes.__eq__, t.words, t.words[1:])) / n, t.n_repeat_words / n,
        t.n_dup_lines / lines, t.n_words / lines, sum(x.rstrip().endswith((".", "!", "?")) for x in t.lines) / lines,
    )


_UPPER = re.compile("[A-ZÀ-ÖØ-Þ]+")


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of docs but those named like statistics, and one column for each statistic."""

    @F.pandas_udf(", ".join(f"{s} double" for s in STATISTICS))
    def measure(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([statistics(t) for t in texts], columns=list(STATISTICS))

    rest = [F.col(f"`{c}`") for c in docs.columns if c not in STATISTICS and c != text_col]
    return docs.select(*rest, measure.asNondeterministic()(F.col(f"`{text_col}`")).alias("__s")).select(*rest, "__s.*")


@dataclass(frozen=True)
class Rule:
    """A conjunction of tests (statistic, whether it is at most the bound, bound)."""

    tests: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        held = F.lit(True)
        for name, at_most, bound in self.tests:
            held = held & ((F.col(name) <= bound) if at_most else (F.col(name) > bound))
        return held


@dataclass
class Ensemble:
    intercept: float
    rules: list[tuple[Rule, float]]

    def score(self) -> Column:
        """Chance of label 1 as an expression over the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


_LINE = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) ([-\d.eE+]+)\)")


def tree_paths(described: str) -> set[Rule]:
    """A rule for each path from the root to a node, from a tree's description."""
    paths, held = set(), []
    for line in described.splitlines():
        if not (m := _LINE.match(line)):
            continue
        indent = len(m[1])
        held = [h for h in held if h[0] < indent] + [(indent, STATISTICS[int(m[3])], m[4] == "<=", float(m[5]))]
        # Tests of one statistic in one direction: only the tightest counts.
        bounds: dict[tuple[str, bool], float] = {}
        for _, name, at_most, bound in held:
            key = (name, at_most)
            bounds[key] = bound if key not in bounds else (min if at_most else max)(bounds[key], bound)
        paths.add(Rule(tuple(sorted((n, a, b) for (n, a), b in bounds.items()))))
    return paths


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Ensemble:
    """The ensemble of rows with an id, the statistics and a label 0 or 1."""
    rows = labelled.count()
    labelled = labelled.filter(common.in_sample("quality", F.col("id"), sample_rows, rows))
    labelled = labelled.persist()
    try:
        share, kinds = labelled.agg(F.avg("label"), F.countDistinct("label")).first()
        if kinds < 2:
            share = 0.5 if share is None else min(0.999, max(0.001, share))
            return Ensemble(math.log(share / (1 - share)), [])
        vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(labelled)
        forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=BINS, subsamplingRate=0.7, seed=SEED).fit(vectors)
        rules = sorted(set().union(*(tree_paths(tree.toDebugString) for tree in forest.trees)), key=lambda r: r.tests)
        if not rules:
            return Ensemble(math.log(share / (1 - share)), [])
        held = labelled.select("label", *[r.column().cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
        held = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(held)
        lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, standardization=False, maxIter=60).fit(held)
        weights = lasso.coefficients.toArray()
        return Ensemble(float(lasso.intercept), [(r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-9])
    finally:
        labelled.unpersist()


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learned from labels of the folds that are not held out."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels").filter("quality is not null")
    held_out = common.crc32_mod(F.col("doc_id"), 4) == 2
    known = labels.filter(~held_out & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    measured = common.written(with_statistics(docs), "quality-statistics")
    model = fit(measured.withColumnRenamed("doc_id", "id").join(known, "id"))
    score = model.score()
    return measured.select("doc_id", held_out.alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))
