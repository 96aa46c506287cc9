"""Quality rules as a short-circuit cascade.

Every rule is a cheap test of a text's statistics. A bounded sample is run through
all rules first, which measures what each rule and each statistic that it needs
cost and which texts it rejects. The cascade then takes, again and again, the rule
with the most rejections per second among the texts that the rules before it
leave, where a statistic costs only its first user. It stops at a text's first
rejection. The order changes the work and never the verdict, which is that of all
rules together.

Defined cases: a null or empty text has no words and fails the base; a very long text
is judged whole, in time linear in its length; repeated rows are judged alike; an empty
table has no rows and leaves the rules in their places; rules of equal worth go by cost,
then by place; other columns pass through, and a column that is named like the new one
keeps its name (``common.free_name``).
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyreef.llm import common

SYMBOLS = "#*$%&|<>"
#: Words of a window, fewest words, and percent of repeated words of the base.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Rows that are sampled to order the rules, and files that they are from, about; the order affects speed alone.
SAMPLE_ROWS, SAMPLE_FILES = 1000, 16
SEED = 17


class Text:
    """A text with its statistics, each computed when a rule first asks for it."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.words = common.words_of(text)
        self.n_words = len(self.words)

    @cached_property
    def strings(self) -> list[str]:
        return b"\n".join(self.words).decode("utf-8", "surrogatepass").split("\n") if self.words else []

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, common.WORD_SEPARATORS))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(common.WORD_SEPARATORS)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words that a window of 8 covers which occurs twice or more; hashes find candidates, words confirm them."""
        n = self.n_words - WINDOW + 1
        if n < 2:
            return 0
        code = np.fromiter(map(hash, self.words), np.int64, self.n_words).astype(np.uint64)
        mixed = np.zeros(n, np.uint64)
        for i in range(WINDOW):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + code[i : i + n]
        order = np.argsort(mixed, kind="stable")
        same = mixed[order[1:]] == mixed[order[:-1]]
        if not same.any():
            return 0
        suspects = np.unique(np.concatenate([order[1:][same], order[:-1][same]])).tolist()
        windows = [tuple(self.words[i : i + WINDOW]) for i in suspects]
        times = Counter(windows)
        edges = np.zeros(self.n_words + 1, np.int64)
        for i, w in zip(suspects, windows, strict=True):
            if times[w] > 1:
                edges[i] += 1
                edges[i + WINDOW] -= 1
        return int((edges.cumsum() > 0).sum())

    @cached_property
    def base_failed(self) -> bool:
        return self.n_words < LEAST_WORDS or 100 * self.n_repeat_words > MOST_REPEATED * self.n_words


@dataclass(frozen=True)
class Rule:
    """A named test, and the statistics of a text that it reads beyond those that the base needs anyway."""

    name: str
    rejects: Callable[[Text], bool]
    needs: tuple[str, ...] = ()


def _shouting(t: Text) -> bool:
    """More than 60 % of the words are in capitals."""
    return sum(w.isupper() and len(w) > 1 for w in t.strings) > 0.6 * t.n_words


def _lettered(t: Text) -> bool:
    """Fewer than 70 % of the words hold a letter."""
    return sum(any(map(str.isalpha, w)) for w in t.strings) < 0.7 * t.n_words


def _monotony(t: Text) -> bool:
    """One word makes up over 30 % of the words."""
    return Counter(t.words).most_common(1)[0][1] > 0.3 * t.n_words


def _stutter(t: Text) -> bool:
    """Over 30 % of the words equal the word before."""
    return 10 * sum(map(bytes.__eq__, t.words, t.words[1:])) > 3 * t.n_words


RULES = (
    Rule("symbols: over one to four words", lambda t: 4 * t.n_symbols > t.n_words, ("n_symbols",)),
    Rule("exclamations: over one to three words", lambda t: 3 * t.text.count("!") > t.n_words),
    Rule("word length: mean outside 2 to 20", lambda t: not 2 * t.n_words <= t.word_chars <= 20 * t.n_words, ("word_chars",)),
    Rule("lines: over half repeat", lambda t: 2 * t.n_dup_lines > len(t.lines), ("lines", "n_dup_lines")),
    Rule("shouting", _shouting, ("strings",)),
    Rule("letters", _lettered, ("strings",)),
    Rule("monotony", _monotony),
    Rule("stutter", _stutter),
)


def some_files(docs: DataFrame, most: int = SAMPLE_FILES) -> DataFrame:
    """The rows of about so many files, drawn by a hash of their paths, of docs that are read from many; else docs."""
    n = len(docs._jdf.inputFiles())  # their names stay in the JVM
    if n <= most:
        return docs
    try:
        return docs.filter(F.pmod(F.xxhash64(F.lit(SEED), F.col("_metadata.file_path")), F.lit(n)) < most)
    except AnalysisException:  # the files of rows are no longer known
        return docs


def measured(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[tuple[list[bool], dict[str, float]]]:
    """For sampled texts that pass the base: which rules reject them, and seconds of each rule and statistic by name.

    Rows are drawn one by one from all rows of the files, whose number Parquet's footers
    tell, so every place of a file is as likely. Texts are measured where they are read:
    no text leaves its task.
    """
    names = [rule.name for rule in rules]
    needs = sorted({x for rule in rules for x in rule.needs})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rejected, seconds = [], []
            for text in batch.column(0).to_pylist():
                t = Text(text)
                if t.base_failed:
                    continue
                spent = []
                for x in needs:
                    began = time.perf_counter()
                    getattr(t, x)
                    spent.append(time.perf_counter() - began)
                found = []
                for rule in rules:
                    began = time.perf_counter()
                    found.append(bool(rule.rejects(t)))
                    spent.append(time.perf_counter() - began)
                rejected.append(found)
                seconds.append(spent)
            yield pa.RecordBatch.from_arrays([pa.array(rejected, pa.list_(pa.bool_())), pa.array(seconds, pa.list_(pa.float64()))], names=["rejected", "seconds"])

    files = some_files(docs)
    share = sample_rows / max(1, files.count())
    drawn = files if share >= 1 else files.filter(F.rand(SEED) < share)
    rows = drawn.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "rejected array<boolean>, seconds array<double>").collect()
    return [(list(r.rejected), dict(zip([*needs, *names], r.seconds, strict=True))) for r in rows]


def cascade_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[int]:
    """Places of the rules by rejections per second among what earlier rules leave, on a bounded sample; rules of equal worth by what they cost."""
    return order_of(measured(docs, rules, text_col, sample_rows), rules)


def order_of(sample: list[tuple[list[bool], dict[str, float]]], rules: tuple[Rule, ...]) -> list[int]:
    """The greedy order for measured texts."""
    order: list[int] = []
    paid: set[str] = set()
    left = sample
    while len(order) < len(rules):

        # What is left may be nothing at the end; costs are then those of the whole sample.
        def worth(i: int) -> tuple[float, float, int]:
            spent = sum(sum(seconds[x] for x in {rules[i].name, *rules[i].needs} - paid) for _, seconds in left or sample)
            return -sum(found[i] for found, _ in left) / max(spent, 1e-9), spent, i

        best = min((i for i in range(len(rules)) if i not in order), key=worth)
        order.append(best)
        paid |= set(rules[best].needs)
        left = [x for x in left if not x[0][best]]
    return order


def verdict(text: Text, rules: list[Rule]) -> bool:
    """Whether the text is kept; the first rejection ends it."""
    return not text.base_failed and not any(rule.rejects(text) for rule in rules)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", out: str = "quality") -> DataFrame:
    """All columns of docs and a struct of the base's statistics and the cascade's verdict, named ``common.free_name(docs, out)``."""
    ordered = [rules[i] for i in cascade_order(docs, rules, text_col)]

    @F.pandas_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")
    def quality(texts):
        import pandas as pd

        rows = []
        for text in texts:
            t = Text(text)
            rows.append((t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, t.base_failed, verdict(t, ordered)))
        return pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    return docs.withColumn(common.free_name(docs, out), quality.asNondeterministic()(docs[text_col]))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that no rule rejects, with all their columns."""
    name = common.free_name(docs, "quality")
    return judge(docs, text_col=text_col).filter(F.col(name)["kept"]).drop(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", "quality.*")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d),
pos AS (SELECT row_id, len(words) AS n, words, unnest(range(1, greatest(len(words) - 6, 1))) AS i FROM w),
win AS (SELECT row_id, i, md5(array_to_string(words[i:i + 7], ' ')) || array_to_string(words[i:i + 7], ' ') AS k FROM pos WHERE i + 7 <= n),
rep AS (SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT row_id, count(DISTINCT i + j) AS n_repeat_words FROM rep, range(8) t(j) GROUP BY row_id),
top AS (SELECT row_id, max(c) AS top FROM (SELECT row_id, count(*) AS c FROM (SELECT row_id, unnest(words) AS x FROM w) GROUP BY row_id, x) GROUP BY row_id),
s AS (
  SELECT w.row_id, doc_id, text, words, lines, len(words) AS n_words,
    CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(top, 0) AS top
  FROM w LEFT JOIN cov USING (row_id) LEFT JOIN top USING (row_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (4 * n_symbols > n_words)
    AND NOT (3 * (length(text) - length(replace(text, '!', ''))) > n_words)
    AND word_chars BETWEEN 2 * n_words AND 20 * n_words
    AND NOT (2 * n_dup_lines > len(lines))
    AND NOT (len(list_filter(words, lambda x: length(x) > 1 AND x = upper(x) AND x <> lower(x))) > 0.6 * n_words)
    AND NOT (len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) < 0.7 * n_words)
    AND NOT (top > 0.3 * n_words)
    AND NOT (10 * len(list_filter(range(1, n_words), lambda i: words[i] = words[i + 1])) > 3 * n_words) AS kept
FROM b
"""
