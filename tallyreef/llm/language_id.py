"""Language identification of mixed texts.

A word's script, by code point ranges, leaves the languages that are written in
it. Each of these scores the word by the log-likelihoods of its letter trigrams,
and a Viterbi pass over the words, with a penalty for each switch, labels spans
of the text. The text's language is the one whose spans hold most letters.

The model is fitted on a bounded sample of labelled rows (SAMPLE_ROWS, by hash of
the id); its size is languages times 2^HASH_BITS, whatever the input.

Defined cases: a text that is null or has no letter is ``und`` with score 0; so is
every text if no row is labelled. Words in a script that no learned language uses
count for none, though their letters count in the total that the score is a share
of, and their spans are ``und``; a text of such words alone has score 0 and the
language with the most letters learned. Ties go to the language that sorts first;
extra columns pass through, one that is named like the new column keeps its name, and
repeated rows are labelled alike. An empty table gives no rows. Long texts are
scored in runs of RUN_CHARS, and the sums along a text begin anew from the best
state with each block, so that they keep their precision.

Trigrams share 2^HASH_BITS counters; see the README for what collisions cost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyreef.llm import common

#: Labelled rows that the model is fitted on, about; more are sampled by hash of the id.
SAMPLE_ROWS = 20_000
HASH_BITS = 16
#: Log-likelihood that a switch of language costs, and additive smoothing of the counts.
SWITCH, SMOOTH = 8.0, 0.5
#: Share of a language's letters from which it counts as written in a script.
LEAST_SHARE = 0.001
#: Words of a block whose transitions are multiplied at once, and characters of a run that is scored at once.
BLOCK, RUN_CHARS = 64, 1 << 20
UNKNOWN = "und"

# First code points of script ranges and the script that starts there; "" is any other.
_SCRIPTS = (
    (0x0000, ""), (0x0041, "Latin"), (0x0250, ""), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"),
    (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, ""), (0x0750, "Arabic"), (0x0780, ""), (0x08A0, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"),
    (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, ""),
    (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, ""), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, ""),
    (0x3040, "Kana"), (0x3100, ""), (0x3400, "Han"), (0xA000, ""), (0xAC00, "Hangul"), (0xD7B0, ""), (0xF900, "Han"), (0xFB00, ""), (0x20000, "Han"), (0x30000, ""),
)
SCRIPT_NAMES = sorted({name for _, name in _SCRIPTS})
_STARTS = np.array([start for start, _ in _SCRIPTS])
_SCRIPT_OF_RANGE = np.array([SCRIPT_NAMES.index(name) for _, name in _SCRIPTS])


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@dataclass
class Words:
    """Words of a batch of texts: doc of each word, its letters, its script, and trigrams with word starts."""

    doc: np.ndarray
    letters: np.ndarray
    script: np.ndarray
    trigrams: np.ndarray
    starts: np.ndarray


def words_of(texts: list[str | None]) -> Words:
    """Words are runs of letters, lower-cased; trigrams reach over their ends by one blank."""
    lowered = [(t or "").lower() for t in texts]
    points = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    docs = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])
    is_letter = _letters()[points]
    shown = np.where(is_letter, points, 32).astype(np.uint64)
    at = np.flatnonzero(is_letter)
    if not len(at):
        none = np.zeros(0, np.int64)
        return Words(none, none, none, none, none)
    before = shown[np.maximum(at - 1, 0)]
    before[at == 0] = 32
    mixed = (before * np.uint64(0x9E3779B97F4A7C15) + shown[at]) * np.uint64(0xC2B2AE3D27D4EB4F) + shown[at + 1]
    mixed *= np.uint64(0xFF51AFD7ED558CCD)
    trigrams = (mixed >> np.uint64(64 - HASH_BITS)).astype(np.int64)
    starts = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    first = at[starts]
    return Words(docs[first], np.diff(starts, append=len(at)), _SCRIPT_OF_RANGE[np.searchsorted(_STARTS, points[first], "right") - 1], trigrams, starts)


@dataclass
class Model:
    languages: list[str]
    #: Log-likelihoods, trigram by language, and whether a language is written in a script.
    likelihood: np.ndarray
    written: np.ndarray
    #: Letters learned of each language.
    letters: np.ndarray

    def scores(self, words: Words) -> np.ndarray:
        """Score of each word in each language; a word's script leaves candidates, and without any all scores are 0."""
        found = np.add.reduceat(self.likelihood[words.trigrams], words.starts, axis=0)
        candidate = self.written[words.script]
        found = np.where(candidate, found, found.min(1, keepdims=True) - 100)
        return np.where(candidate.any(1, keepdims=True), found, 0).astype(np.float32)

    def known(self, words: Words) -> np.ndarray:
        """Whether a learned language is written in the word's script."""
        return self.written[words.script].any(1)


def learn(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of labelled rows."""
    labelled = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).filter("text is not null and lang is not null")
    labelled = labelled.filter(common.in_sample("language", F.col("id"), sample_rows, labelled.select("id").count()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << HASH_BITS
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            frame = batch.to_pandas()
            for lang, texts in frame.groupby("lang")["text"]:
                total = totals.setdefault(lang, np.zeros(size + len(SCRIPT_NAMES), np.int64))
                for at in range(0, len(texts), 256):
                    words = words_of(texts.iloc[at : at + 256].tolist())
                    total[:size] += np.bincount(words.trigrams, minlength=size)
                    total[size:] += np.bincount(words.script, words.letters, len(SCRIPT_NAMES)).astype(np.int64)
        for lang, total in totals.items():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["lang", "place", "n"])

    counts = labelled.select("lang", "text").mapInArrow(count, "lang string, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    size = 1 << HASH_BITS
    table = np.zeros((size + len(SCRIPT_NAMES), len(languages)))
    table[counts["place"], counts["lang"].map({name: i for i, name in enumerate(languages)})] = counts["n"]
    trigrams, scripts = table[:size] + SMOOTH, table[size:]
    return Model(languages, np.log(trigrams / trigrams.sum(0)).astype(np.float32), scripts >= LEAST_SHARE * np.maximum(scripts.sum(0), 1), scripts.sum(0))


def _runs(text: str) -> Iterator[str]:
    """The text in runs that end where no letter stands, as far as there is such a place."""
    at = 0
    while at < len(text):
        end = min(len(text), at + RUN_CHARS)
        while end < len(text) and text[end - 1].isalpha() and text[end].isalpha():
            end += 1
        yield text[at:end]
        at = end


def scored(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; letters, whether the script is known, and scores of each word in turn."""
    counts, letters, known, scores = [], [], [], []
    # Short texts are scored together, a long one in runs.
    groups: list[list[str | None]] = []
    size = RUN_CHARS + 1
    for i, text in enumerate(texts):
        if size + len(text or "") > RUN_CHARS:
            groups.append([])
            size = 0
        groups[-1].append(i)
        size += len(text or "")
    for group in groups:
        several = len(group) > 1
        total = np.zeros(len(group), np.int64)
        for part in [[texts[i] for i in group]] if several else ([run] for run in _runs(texts[group[0]] or "")):
            words = words_of(part)
            if len(words.doc):
                total += np.bincount(words.doc, minlength=len(group))
                letters.append(words.letters)
                known.append(model.known(words))
                scores.append(model.scores(words))
        counts.append(total)
    empty = np.zeros((0, len(model.languages)), np.float32)
    return np.concatenate(counts), np.concatenate([np.zeros(0, np.int64), *letters]), np.concatenate([np.zeros(0, bool), *known]), np.concatenate([empty, *scores])


def label_words(scores: np.ndarray, counts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Viterbi labels of the words of several texts; counts has each text's words.

    Texts are padded to whole blocks. For each block and entry state the best way
    to each end state is found for all blocks at once; these small matrices are
    then chained along each text, and the chosen ways are traced inside blocks.
    Only differences of states matter, so the values are lowered by the best one
    after each block and each word's scores by its own best.
    """
    n_states = scores.shape[1]
    kind = np.int8 if n_states < 128 else np.int32
    per_text = -(-counts // BLOCK)
    first_block = np.concatenate([[0], per_text.cumsum()])[:-1]
    place = np.arange(len(scores)) + np.repeat(first_block * BLOCK - np.concatenate([[0], counts.cumsum()])[:-1], counts)
    padded = np.zeros((int(per_text.sum()) * BLOCK, n_states), np.float32)
    padded[place] = scores - scores.max(1, keepdims=True) if len(scores) else scores
    x = padded.reshape(-1, BLOCK, n_states)
    enter = np.where(np.eye(n_states, dtype=bool), 0.0, -switch)
    way = enter[None] + x[:, 0, None, :]
    for t in range(1, BLOCK):
        way = np.maximum(way, way.max(2, keepdims=True) - switch) + x[:, t, None, :]
    # Along the texts: longest first, so that the open ones stay a prefix.
    order = np.argsort(-per_text, kind="stable")
    value = np.zeros((len(counts), n_states))
    came = np.zeros((len(x), n_states), kind)
    n_open = np.searchsorted(-per_text[order], -np.arange(1, per_text.max(initial=0) + 1), "right")
    for k, n in enumerate(n_open):
        blocks = first_block[order[:n]] + k
        step = value[:n, :, None] + way[blocks]
        came[blocks] = step.argmax(1)
        best = step.max(1)
        value[:n] = best - best.max(1, keepdims=True)
    ends, entries = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    state = value.argmax(1)
    for k in range(len(n_open) - 1, -1, -1):
        blocks = first_block[order[: n_open[k]]] + k
        ends[blocks] = state[: n_open[k]]
        state[: n_open[k]] = entries[blocks] = came[blocks, state[: n_open[k]]]
    # Inside the blocks, from the entry state to the end state.
    rows = np.arange(len(x))
    now = enter[entries] + x[:, 0]
    stays, tops = np.zeros((BLOCK, len(x), n_states), bool), np.zeros((BLOCK, len(x)), kind)
    for t in range(1, BLOCK):
        tops[t] = now.argmax(1)
        best = now.max(1, keepdims=True) - switch
        stays[t] = now >= best
        now = np.maximum(now, best) + x[:, t]
    labels = np.zeros((len(x), BLOCK), kind)
    state = ends
    for t in range(BLOCK - 1, -1, -1):
        labels[:, t] = state
        state = np.where(stays[t, rows, state], state, tops[t])
    return labels.reshape(-1)[place]


def labelled_texts(texts: list[str | None], model: Model) -> list[tuple[str, float, list[dict]]]:
    """Language, score and spans of each text."""
    if not model.languages:
        return [(UNKNOWN, 0.0, [])] * len(texts)
    counts, n_letters, known, scores = scored(texts, model)
    if not len(scores):
        return [(UNKNOWN, 0.0, [])] * len(texts)
    labels = label_words(scores, counts)
    doc = np.repeat(np.arange(len(texts)), counts)
    n_states = len(model.languages)
    letters = np.bincount(doc[known] * n_states + labels[known], n_letters[known], len(texts) * n_states).reshape(-1, n_states)
    total = np.bincount(doc, n_letters, len(texts))
    best = np.where(letters.any(1), letters.argmax(1), model.letters.argmax())
    shown = np.where(known, labels.astype(np.int64), -1)
    change = np.flatnonzero((np.diff(shown, prepend=-2) != 0) | (np.diff(doc, prepend=-1) != 0))
    spans: list[list] = [[] for _ in texts]
    first = np.concatenate([[0], counts.cumsum()])
    for a, b in zip(change.tolist(), [*change[1:].tolist(), len(shown)], strict=True):
        d = doc[a]
        spans[d].append({"start": int(a - first[d]), "words": b - a, "lang": model.languages[shown[a]] if shown[a] >= 0 else UNKNOWN})
    return [(model.languages[k], float(letters[i, k] / total[i]), spans[i]) if total[i] else (UNKNOWN, 0.0, []) for i, k in enumerate(best.tolist())]


def identify(docs: DataFrame, model: Model, text_col: str = "text", out: str = "language") -> DataFrame:
    """All columns of docs and a struct, named ``common.free_name(docs, out)``, of lang_pred, score (share of letters) and spans (first letter-word, words, language)."""

    @F.pandas_udf("lang_pred string, score double, spans array<struct<start:int,words:int,lang:string>>")
    def language(texts: pd.Series) -> pd.DataFrame:
        rows: list[tuple] = []
        for at in range(0, len(texts), 256):
            rows += labelled_texts(texts.iloc[at : at + 256].tolist(), model)
        return pd.DataFrame(rows, columns=["lang_pred", "score", "spans"])

    return docs.withColumn(common.free_name(docs, out), language.asNondeterministic()(docs[text_col]))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the folds that are not held out."""
    docs = common.table(spark, sf_dir, "documents")
    fold = common.crc32_mod(F.col("doc_id"), 5)
    model = learn(docs.filter(fold != 0))
    found = identify(docs.select("doc_id", (fold == 0).alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "language.lang_pred", "language.score")
