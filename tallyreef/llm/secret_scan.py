"""Secret scans: fixed patterns, and a guess-cost dynamic program over credential contexts.

The base patterns find assignments, access keys and hex digests. Values that
stand in a credential context (``bearer ...``, ``pwd: ...``, ``passphrase is
...``) are then cut into the cheapest sequence of words, dates, repeats,
keyboard walks and brute-force spans; the decimal logarithm of the guesses that
this sequence takes is the value's cost, and a value that costs enough is a
secret of kind ``guess``; a value shorter than the bound must cost as much as
brute force over all of it, which is the most that its length allows. Words and
their ranks come from a public vocabulary file, so no word list is kept here.

Defined cases: a null text counts as empty and has no spans; spans are code
points with exclusive ends; every value in a context is scored, also one that a base span
covers, and stands beside it; spans of one start stand in the order of their kinds; a very
long text is scanned whole, and a value's cost takes time linear in its length; repeated
rows are scanned alike; an empty table gives no rows; other columns pass through, and one
that is named like the new column keeps its name (``common.free_name``).
"""

from __future__ import annotations

import base64
import hashlib
import math
import re

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyreef.llm import common

KINDS = ("assign", "access", "hex", "guess")
#: Decimal logarithm of the guesses from which a value counts as a secret; its length where that is less.
LEAST_COST = 10.0
REDACTED = "[secret]"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|api[_-]?key|(?:access|private|client|signing|encryption)[_-]?key|auth(?:orization)?|bearer|basic)"""
    r"""["']?(?:\x20*[:=]\x20*|\x20+(?:is|was)\x20+|(?<=bearer)\x20+|(?<=basic)\x20+)["']?([^\s"'<>]{8,})""",
    re.ASCII | re.IGNORECASE,
)
_CUES = re.compile(r"[:=]|\x20(?:is|was)\x20|(?:bearer|basic)\x20", re.ASCII | re.IGNORECASE)
_DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d")
# Rows of a common keyboard and usual stand-ins for letters.
_KEY_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "0123456789")
_STAND_INS = str.maketrans("@4301!5$7", "aaeoiisst")


#: Most characters of a unit that repeats.
LONGEST_UNIT = 8


class _Starts:
    """Starts of a span whose cost grows with the logarithm of its length.

    A later start that is no cheaper than an earlier one stays so, since the
    logarithms draw nearer; so few starts are kept, however long the span.
    """

    def __init__(self):
        self.places: list[int] = []

    def cheapest(self, before: list[float], place: int, end: int) -> tuple[float, int]:
        """Least of cost before a start plus the logarithm of the length, with ``place`` as one more start."""
        self.places.append(place)
        costs = [before[j] + math.log10(end - j) for j in self.places]
        at = min(range(len(costs)), key=costs.__getitem__)
        found = costs[at], self.places[at]
        del self.places[at + 1 :]
        return found


class GuessCost:
    """Minimum-cost segmentation of a value; costs are decimal logarithms of guesses."""

    #: Longest word looked up, and the cost of each further segment of a value.
    LONGEST_WORD, JOINT = 20, math.log10(2)

    def __init__(self, ranks_path: str):
        with open(ranks_path, "rb") as lines:
            tokens = [base64.b64decode(line.split()[0]) for line in lines]
        words = (t[1:].decode().lower() for t in tokens if len(t) > 3 and t[:1] == b" " and t[1:].isalpha())
        self.words: dict[str, float] = {}
        for word in words:
            self.words.setdefault(word, math.log10(len(self.words) + 2))
        self.walks = {row[i : i + 2] for row in _KEY_ROWS for i in range(len(row) - 1)}
        self.walks |= {w[::-1] for w in self.walks}

    def _word(self, plain: str, shown: str) -> float | None:
        cost = self.words.get(plain)
        if cost is None:
            return None
        changed = sum(a != b for a, b in zip(plain, shown.lower(), strict=True))
        capital = 0.0 if shown.islower() else math.log10(2) if shown.istitle() or shown.isupper() else math.log10(2) * sum(map(str.isupper, shown))
        return cost + capital + changed * math.log10(2)

    def segments(self, value: str) -> tuple[float, list[tuple[str, int, int]]]:
        """Least cost and the segments (kind, start, end) that reach it; every start and end of each kind is tried."""
        n, low = len(value), value.lower()
        plain = low.translate(_STAND_INS)
        best: list[tuple[float, int, str]] = [(0.0, 0, "")]
        before = [0.0]  # least cost up to a place and of the joint there
        brute = (0.0, 0)  # cheapest way to be inside a brute-force span, and where that began
        walk = _Starts()
        walk_from = 0
        # Repeats of each length: characters that equal the one so far back, and starts by their remainder.
        equal = [0] * (LONGEST_UNIT + 1)
        repeats: list[dict[int, _Starts]] = [{} for _ in equal]
        for i in range(1, n + 1):
            brute = min((brute[0] + 1 if i > 1 else 1.0, brute[1]), (before[i - 1] + 1, i - 1))
            options = [(brute[0], brute[1], "brute")]
            if i > 1 and low[i - 2 : i] not in self.walks:
                walk, walk_from = _Starts(), i - 1
            if i - walk_from >= 3:
                cost, j = walk.cheapest(before, i - 3, i)
                options.append((cost + math.log10(94 * 4), j, "walk"))
            for unit in range(1, min(LONGEST_UNIT, i - 1) + 1):
                if value[i - 1] != value[i - 1 - unit]:
                    equal[unit] = 0
                    repeats[unit] = {}
                    continue
                equal[unit] += 1
                if equal[unit] >= 2 * unit:
                    cost, j = repeats[unit].setdefault(i % unit, _Starts()).cheapest(before, i - 3 * unit, i)
                    options.append((cost + unit - math.log10(unit), j, "repeat"))
            if value[i - 1].isdigit():
                for j in range(max(0, i - 10), i - 3):
                    if value[j].isdigit() and _DATE.fullmatch(value, j, i):
                        options.append((before[j] + math.log10(120 if i - j == 4 else 4 * 365 * 120), j, "date"))
            for j in range(max(0, i - self.LONGEST_WORD), i - 2):
                if (c := self._word(plain[j:i], value[j:i])) is not None:
                    options.append((before[j] + c, j, "word"))
            best.append(min(options))
            before.append(best[i][0] + self.JOINT)
        parts, i = [], n
        while i:
            _, j, kind = best[i]
            parts.append((kind, j, i))
            i = j
        return best[n][0], parts[::-1]


_models: dict[str, GuessCost] = {}


def model(path: str) -> GuessCost:
    if path not in _models:
        _models[path] = GuessCost(path)
    return _models[path]


Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by start, then kind."""
    spans = []
    if ":" in text or "=" in text:
        spans += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    spans += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(spans, key=_order)


def guesses(text: str, cost: GuessCost) -> list[tuple[int, int, float]]:
    """Start, end and least cost of every value in a credential context."""
    if not _CUES.search(text):
        return []
    found = []
    for m in _CONTEXT.finditer(text):
        value = m[1].rstrip(".,;:!?)]}")
        if len(value) >= 8:
            found.append((m.start(1), m.start(1) + len(value), cost.segments(value)[0]))
    return found


def guessed_spans(values: list[tuple[int, int, float]], least: float = LEAST_COST) -> list[Span]:
    """The values whose least cost reaches the bound, whether or not a base span covers them."""
    return [("guess", start, end) for start, end, cost in values if cost >= min(least, end - start)]


def _order(span: Span) -> tuple[int, int]:
    return span[1], KINDS.index(span[0])


def _told(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each run of overlapping spans replaced by one mark."""
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], REDACTED]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None, least: float = LEAST_COST, out: str = "secrets") -> DataFrame:
    """All columns of docs and a struct, named ``common.free_name(docs, out)``: counts, digest of the base spans, all spans, redacted text, and each value in a context with its cost."""
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string, guesses string")
    def secrets(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            text = text or ""
            base, values = base_spans(text), guesses(text, model(path))
            spans = sorted([*base, *guessed_spans(values, least)], key=_order)
            counts = [sum(k == kind for k, _, _ in base) for kind in KINDS[:3]]
            told = ",".join(f"{start}:{end}:{cost:.2f}" for start, end, cost in values)
            rows.append((*counts, hashlib.sha256(_told(base).encode()).hexdigest(), _told(spans), redacted(text, spans) if spans else None, told))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted", "guesses"])

    return docs.withColumn(common.free_name(docs, out), secrets.asNondeterministic()(docs[text_col]))


def redact(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The rows and columns of docs with every secret replaced by a mark, and the count of code points brought up to date."""
    found, name = scan(docs, text_col), common.free_name(docs, "secrets")
    marked = F.col(name)["redacted"]
    columns = {text_col: F.coalesce(marked, F.col(f"`{text_col}`"))}
    if chars_col in docs.columns:
        columns[chars_col] = F.when(marked.isNotNull(), F.char_length(marked).cast(docs.schema[chars_col].dataType)).otherwise(F.col(f"`{chars_col}`"))
    return found.select(*[columns[c].alias(c) if c in columns else F.col(f"`{c}`") for c in docs.columns])


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs).select("doc_id", *[f"secrets.{c}" for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "guesses")])
