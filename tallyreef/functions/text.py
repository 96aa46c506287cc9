"""Text functions: normalization, masking, markup stripping, keyword scores.

All are Column expressions but ``nfkc_casefold`` and ``repair_mojibake``, for
which Spark has no built-in; these two are Arrow-batched UDFs.
"""

from __future__ import annotations

import email
import email.policy
import html as html_module
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
LONG_TOKEN = r"[A-Za-z0-9_-]{24,}"


def blank(column: Column) -> Column:
    """Missing, null and blank collapse to the empty string."""
    return F.coalesce(F.trim(column.cast("string")), F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first value that is not blank, else the empty string."""
    return F.coalesce(*[F.nullif(blank(c), F.lit("")) for c in columns], F.lit(""))


@F.pandas_udf(StringType())
def nfkc_casefold(texts: pd.Series) -> pd.Series:
    """NFKC and case folding."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def collapsed(column: Column) -> Column:
    """Runs of white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(column, r"(?U)\s+", " "))


def search_text(column: Column) -> Column:
    """The form in which searches compare texts."""
    return collapsed(nfkc_casefold(F.coalesce(column.cast("string"), F.lit(""))))


def repair_mojibake(column: Column) -> Column:
    """Text that was read as cp1252 though written in cp932, decoded anew where that works."""

    def repaired(text: str | None) -> str | None:
        if text is None or not any("\x80" <= c for c in text):
            return text
        try:
            fixed = text.encode("cp1252").decode("cp932")
        except UnicodeError:
            return text
        return fixed if any("぀" <= c <= "鿿" for c in fixed) else text

    return F.pandas_udf(lambda texts: texts.map(repaired), StringType())(column)


def mask_personal(column: Column, length: int = 300) -> Column:
    """E-mail addresses and long tokens replaced, white space collapsed, cut to a length."""
    masked = F.regexp_replace(F.regexp_replace(F.coalesce(column, F.lit("")), EMAIL, "[mail]"), LONG_TOKEN, "[token]")
    return F.substring(F.trim(F.regexp_replace(masked, "[ \\t\\n\\r]+", " ")), 1, length)


def masked_reference(*columns: Column) -> Column:
    """First filled reference: up to 4 characters fully masked, else two, up to eight dots, two."""
    value = first_filled(*columns)
    size = F.length(value)
    dots = F.expr("'•'")
    return F.when(size <= 4, F.repeat(dots, size)).otherwise(F.concat(F.substring(value, 1, 2), F.repeat(dots, F.least(size - 4, F.lit(8))), F.right(value, F.lit(2))))


def page_title(html: Column) -> Column:
    """Text of the first title element."""
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"[ \t\r\n]+", " "))


def stripped(html: Column) -> Column:
    """Markup removed: scripts and styles go with their content, block ends become new lines; entities stay."""
    text = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    text = F.regexp_replace(text, r"(?i)<(br|/p|/div|/li|/tr|/h[1-6])[^>]*>", "\n")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def unescaped(text: Column) -> Column:
    """Character references decoded."""

    def decode(t: str | None) -> str | None:
        return None if t is None else html_module.unescape(t)

    return F.pandas_udf(lambda texts: texts.map(decode), StringType())(text)


def mail_text(raw: Column) -> Column:
    """Text of a message as it was sent: its plain parts, else its HTML parts without markup; attachments are left out."""

    def walk(source: str | None) -> str | None:
        if source is None:
            return None
        message = email.message_from_bytes(source.encode("utf-8", "surrogateescape"), policy=email.policy.default)
        found = {"plain": [], "html": []}
        for part in message.walk():
            if part.get_content_maintype() == "text" and part.get_content_disposition() != "attachment" and part.get_content_subtype() in found:
                try:
                    found[part.get_content_subtype()].append(part.get_content())
                except (LookupError, ValueError):
                    continue
        lines = found["plain"] or [html_module.unescape(re.sub(r"<[^>]*>", " ", x)) for x in found["html"]]
        return "\n".join(x.strip() for x in lines)

    return F.pandas_udf(lambda texts: texts.map(walk), StringType())(raw)


def plain_text(html: Column) -> Column:
    """A page as lines of text: pictures stand for their words, scripts and styles go, block ends become new lines, references are decoded."""
    shown = F.regexp_replace(html, r"""(?is)<img\b[^>]*?\balt\s*=\s*["']([^"']+)["'][^>]*>""", " $1 ")
    return unescaped(stripped(shown))


def links(html: Column) -> Column:
    """Distinct targets of anchors in page order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'<a [^>]*href="([^"]*)"'), F.lit(1)))


def labelled(text: Column, label: str) -> Column:
    """What follows "label:" up to the end of its line; empty if absent."""
    return F.trim(F.regexp_extract(text, rf"(?m){label}\s*[:：]\s*([^\n]*)", 1))


def tokens(column: Column, stop: list[str] | None = None) -> Column:
    """Distinct lower-case words of letters and digits less stop words, sorted."""
    found = F.regexp_extract_all(F.lower(F.coalesce(column, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_sort(F.array_except(found, F.array(*map(F.lit, stop)).cast("array<string>")) if stop else F.array_distinct(found))


def hits(text: Column, words: list[str]) -> Column:
    """How many of the words the text contains."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((low.contains(w.lower()).cast("int") for w in words), F.lit(0))


def keyword_lines(text: Column, words: list[str], most: int = 80) -> Column:
    """Lines that hold a keyword, the first ``most`` of them."""
    found = F.filter(F.split(text, "\n"), lambda line: F.lower(line).rlike("|".join(words)))
    return F.array_join(F.slice(found, 1, most), "\n")


def version_order(column: Column) -> Column:
    """Version text as a struct that sorts by number, release candidates before the release."""
    part = lambda i: F.coalesce(F.try_element_at(F.regexp_extract_all(column, F.lit(r"(\d+)"), F.lit(1)), F.lit(i)).cast("int"), F.lit(0))
    candidate = F.regexp_extract(column, r"(?i)rc\.?(\d+)", 1)
    return F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"), F.when(candidate == "", 1 << 30).otherwise(F.expr("try_cast(0 as int)") + candidate.try_cast("int")).alias("candidate"))
