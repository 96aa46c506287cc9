"""Fill-in-the-middle arrangement of documents, in Spark SQL functions only.

A text is cut into units (lines), two places between units are drawn from a hash of
its id, and the parts before, between and after them are put in another order behind
sentinels: ``psm`` is prefix, suffix, middle; ``spm`` is suffix, prefix, middle. A text
that is empty or already holds a sentinel stays plain, so every sentinel of an arranged
text stands there once and parsing gives back the text.

All steps are column expressions on one row: no shuffle, no Python, no state. Units of a
text are an array that lives as long as its row.

Defined cases: a null text counts as empty and stays plain, with no unit; a null id
hashes as the empty text; a very long text is handled whole, in time linear in its
length; repeated rows and ids give equal results; an empty table gives no rows; extra
columns are kept, and where one has the name of the new column, the new column's name
gets underscores (``common.free_name``). There are no ties: nothing is ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyreef.llm import common

SEED, RATE, SPM_RATE = 7, 100, 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A line with its end, or the rest of a text that ends without one.
UNIT = r"([^\n]*\n|[^\n]+)"
PSM, SPM, PLAIN = "psm", "spm", "plain"


def _draws(key: Column, seed: int, n: int) -> list[Column]:
    """The first n groups of eight hexadecimal digits of sha256 of ``seed:key``, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def _joined(units: Column, start: Column, end: Column) -> Column:
    """Units from start (0 is the first) up to end."""
    return F.array_join(F.slice(units, (start + 1).cast("int"), (end - start).cast("int")), "")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "fim", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """docs with a struct of n (units), form, text (the arranged one), prefix_chars and middle_chars (code points; null if plain).

    ``rate`` percent of the texts are arranged, ``spm_rate`` percent of those as spm.
    """
    step = common.free_name(docs, "fim_step")
    name = common.free_name(docs, out)
    at = F.col(step)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    h1, h2, h3, h4 = _draws(F.col(f"`{id_col}`"), seed, 4)
    plain = (text == "") | text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE) | (F.pmod(h3, F.lit(100)) >= rate)
    form = F.when(plain, PLAIN).when(F.pmod(h4, F.lit(100)) < spm_rate, SPM).otherwise(PSM)
    # One struct a step: what a later step uses more than once is worked out in the step before.
    cut = docs.withColumn(step, F.struct(text.alias("text"), F.regexp_extract_all(text, F.lit(UNIT), 1).alias("units"), form.alias("form"), h1.alias("h1"), h2.alias("h2")))
    n = F.size(at["units"]).cast("long")
    a, b = F.pmod(at["h1"], n + 1), F.pmod(at["h2"], n + 1)
    cut = cut.withColumn(step, F.struct(at["text"].alias("text"), at["units"].alias("units"), at["form"].alias("form"), n.alias("n"), F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))
    parts = [_joined(at["units"], x, y).alias(k) for k, x, y in (("prefix", F.lit(0), at["a"]), ("middle", at["a"], at["b"]), ("suffix", at["b"], at["n"]))]
    cut = cut.withColumn(step, F.struct(at["text"].alias("text"), at["form"].alias("form"), at["n"].alias("n"), *[F.when(at["form"] != PLAIN, p).alias(k) for p, k in zip(parts, ("prefix", "middle", "suffix"), strict=True)]))
    psm = F.concat(F.lit(PREFIX), at["prefix"], F.lit(SUFFIX), at["suffix"], F.lit(MIDDLE), at["middle"])
    spm = F.concat(F.lit(SUFFIX), at["suffix"], F.lit(PREFIX), at["prefix"], F.lit(MIDDLE), at["middle"])
    arranged = F.when(at["form"] == PSM, psm).when(at["form"] == SPM, spm).otherwise(at["text"])
    chars = [F.length(at[k]).cast("long").alias(f"{k}_chars") for k in ("prefix", "middle")]
    return cut.withColumn(name, F.struct(at["n"].alias("n"), at["form"].alias("form"), arranged.alias("text"), *chars)).drop(step)


def restored(text: Column, form: Column) -> Column:
    """The text that an arranged text was made from, by its sentinels alone.

    The first sentinel starts the text and each stands there once: no text that is
    arranged holds one, and none can arise where parts meet, as ``<`` only starts and
    ``>`` only ends a sentinel.
    """
    body, first = F.substring_index(text, MIDDLE, 1), F.length(F.lit(PREFIX)) + 1
    middle = F.substring_index(text, MIDDLE, -1)
    inner = F.substring(body, first, F.length(body))
    psm = F.concat(F.substring_index(inner, SUFFIX, 1), middle, F.substring_index(inner, SUFFIX, -1))
    spm = F.concat(F.substring_index(inner, PREFIX, -1), middle, F.substring_index(inner, PREFIX, 1))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(text)


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document arranged and restored, as digests."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    fim = F.col("fim")
    done = fill_in_middle(docs)
    return done.select("doc_id", fim["n"].alias("n"), fim["form"].alias("form"), fim["prefix_chars"].alias("prefix_chars"), fim["middle_chars"].alias("middle_chars"), _digest(fim["text"]).alias("output_sha256"), _digest(restored(fim["text"], fim["form"])).alias("restored_sha256"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units FROM documents),
k AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (
  SELECT doc_id, text, units, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (
  SELECT doc_id, text, n, form, coalesce(array_to_string(units[1:a], ''), '') AS pre, coalesce(array_to_string(units[a + 1:b], ''), '') AS mid,
    coalesce(array_to_string(units[b + 1:n], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
