"""Joins: state with fallback, match ladders, containment, best match, prefixes, deltas."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyreef.functions.urls import host
from tallyreef.operators.resolve import MOST_EVIDENCE, distinct_values


def left_with_fallback(df: DataFrame, state: DataFrame, on: Sequence[str], fallback: str, columns: Sequence[str]) -> DataFrame:
    """State columns by the full key, else by the fallback key where it names one state row only."""
    exact = state.select(*on, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__exact"))
    single = state.groupBy(F.col(fallback).alias("__key")).agg(F.count("*").alias("__n"), *[F.first(c).alias(f"__{c}_legacy") for c in columns]).filter("__n = 1").drop("__n")
    joined = df.join(exact, list(on), "left").join(single, df[fallback] == F.col("__key"), "left")
    return joined.select(*df.columns, *[F.when(F.col("__exact"), F.col(f"__{c}")).otherwise(F.col(f"__{c}_legacy")).alias(c) for c in columns])


def domain_ladder(df: DataFrame, domains: DataFrame, host: str, domain: str = "domain", group: str = "group") -> DataFrame:
    """The rows with the group of the longest domain that the host is or lies below.

    A host is unfolded into its few suffixes, so that this is an equal join.
    """
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    keyed = df.withColumn("__row", F.monotonically_increasing_id())
    found = keyed.select("__row", F.explode(suffixes).alias(domain)).join(domains.select(domain, group), domain)
    best = found.groupBy("__row").agg(F.max_by(group, F.struct(F.length(domain), domain)).alias(group), F.max_by(domain, F.struct(F.length(domain), domain)).alias(domain))
    return keyed.join(best, "__row", "left").drop("__row")


#: Characters of the phrases that one pass over the texts looks for at most, and words of a run by which longer lists are joined.
PASS_CHARACTERS, RUN_WORDS = 2_000_000, 5


def containing(texts: DataFrame, phrases: DataFrame, id_col: str, text: str, phrase_id: str, phrase: str, most: int = PASS_CHARACTERS) -> DataFrame:
    """(id, phrase_id) of texts that contain a phrase, in any case and at any place, also within words; blank phrases are in none.

    Phrases of a checked size are sent to the texts, which stay where they are and
    are read once for all of them. Beyond that size, phrases of RUN_WORDS words
    between their first and last one meet texts by these words, which stand in the
    text as a whole, as an equal join; the rest are sent in several passes.
    """
    listed = phrases.select(F.col(phrase_id).alias("__id"), F.lower(F.col(phrase)).alias("__phrase")).filter(F.trim("__phrase") != "")
    low = texts.select(id_col, F.lower(F.col(text)).alias("__text")).filter("__text is not null")
    size = listed.agg(F.sum(F.length("__phrase"))).first()[0] or 0
    if size <= most:
        return _found_in(low, listed, id_col, phrase_id)
    words = F.filter(F.split("__phrase", r"\s+"), lambda x: x != "")
    inner = F.slice(words, 2, RUN_WORDS)
    long = listed.filter(F.size(words) > RUN_WORDS + 1).select("__id", "__phrase", F.array_join(inner, " ").alias("__run"))
    every = F.filter(F.split("__text", r"\s+"), lambda x: x != "")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(every) - RUN_WORDS + 1, F.lit(1))), lambda i: F.array_join(F.slice(every, i, RUN_WORDS), " "))
    pairs = low.select(id_col, F.explode(F.array_distinct(runs)).alias("__run")).join(long.select("__id", "__run"), "__run").select(id_col, "__id").distinct()
    out = pairs.join(low, id_col).join(long.select("__id", "__phrase"), "__id").filter(F.contains("__text", "__phrase")).select(id_col, F.col("__id").alias(phrase_id))
    # Shorter phrases, dealt by hash into passes of about half the size.
    short = listed.filter(F.size(words) <= RUN_WORDS + 1)
    passes = max(1, -(-2 * (short.agg(F.sum(F.length("__phrase"))).first()[0] or 0) // most))
    for i in range(passes):
        out = out.union(_found_in(low, short.filter(F.pmod(F.xxhash64("__phrase"), F.lit(passes)) == i), id_col, phrase_id))
    return out.distinct()


def _found_in(low: DataFrame, listed: DataFrame, id_col: str, phrase_id: str) -> DataFrame:
    """(id, phrase_id) by one automaton of all phrases listed, a bounded number; low has id and __text, listed __id and __phrase."""
    known: dict[str, list] = {}
    for r in listed.collect():
        known.setdefault(r["__phrase"], []).append(r["__id"])
    kinds = {f.name: f.dataType.simpleString() for f in [*low.schema.fields, *listed.schema.fields]}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for found in known:
            automaton.add_word(found, found)
        automaton.make_automaton()
        for frame in frames:
            rows = [(i, p) for i, t in zip(frame[id_col], frame["__text"], strict=True) for found in sorted({x for _, x in automaton.iter(t)} if known else ()) for p in known[found]]
            yield pd.DataFrame(rows, columns=[id_col, phrase_id])

    return low.mapInPandas(run, f"`{id_col}` {kinds[id_col]}, `{phrase_id}` {kinds['__id']}").distinct()


def best_match(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_words: str, right_words: str, least: int, weight: int = 2, bonus: Sequence[tuple[str, str, int]] = (), frequent: int = 1000) -> DataFrame:
    """The right row with the highest score for each left row; below ``least`` there is none; ties go to the smaller id.

    Score: ``weight`` for each shared word, and a bonus for each equal pair of
    columns (counted for rows that share a word). Rows meet on shared words that
    at most ``frequent`` right rows have, and are then scored by all their words.
    Rows that share frequent words alone are scored by these and the columns of
    the bonus, so right rows that agree in both stand as one, the smallest id.
    """
    sides = []
    for side, key, words, at in ((left, left_id, left_words, 0), (right, right_id, right_words, 1)):
        sides.append(side.select(F.col(key).alias(f"__{at}"), F.array_distinct(words).alias(f"__words{at}"), *[F.col(pair[at]).alias(f"__b{i}_{at}") for i, pair in enumerate(bonus)]))
    a, b = sides
    each = b.select("__1", F.explode("__words1").alias("__w"))
    counts = each.groupBy("__w").agg((F.count("*") > frequent).alias("__frequent"))
    points = sum((F.when(F.col(f"__b{i}_0") == F.col(f"__b{i}_1"), n).otherwise(0) for i, (_, _, n) in enumerate(bonus)), F.lit(0))
    told = a.select("__0", F.explode("__words0").alias("__w"))
    rare = told.join(each.join(counts.filter("not __frequent"), "__w", "left_semi"), "__w").select("__0", "__1").distinct()
    scored = rare.join(a, "__0").join(b, "__1").select("__0", "__1", (F.size(F.array_intersect("__words0", "__words1")) * weight + points).alias("score"))
    # One row for all right rows of the same frequent words and columns.
    usual = each.join(counts.filter("__frequent"), "__w").groupBy("__1").agg(F.array_sort(F.collect_set("__w")).alias("__usual"))
    alike = [f"__b{i}_1" for i in range(len(bonus))]
    kinds = usual.join(b, "__1").groupBy("__usual", *alike).agg(F.min("__1").alias("__1"))
    met = told.join(kinds.select("__1", "__usual", *alike, F.explode("__usual").alias("__w")), "__w").groupBy("__0", "__1").agg((F.count("*") * weight).alias("__n"))
    met = met.join(a.drop("__words0"), "__0").join(kinds.drop("__usual"), "__1").select("__0", "__1", (F.col("__n") + points).alias("score"))
    best = scored.unionByName(met).filter(F.col("score") >= least).groupBy("__0").agg(F.min(F.struct((-F.col("score")).alias("s"), "__1")).alias("x"))
    return left.select(left_id).join(best, F.col(left_id) == F.col("__0"), "left").select(left_id, F.col("x.__1").alias(right_id), (-F.col("x.s")).alias("score"))


def prefix_anti(df: DataFrame, excluded: DataFrame, key: str, prefix: str, separator: str = " ") -> DataFrame:
    """Rows whose key is neither an excluded one nor begins with one at a separator; prefixes are unfolded for an equal join."""
    parts = F.split(key, separator)
    keyed = df.withColumn("__row", F.monotonically_increasing_id())
    starts = keyed.select("__row", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), separator))).alias(prefix))
    hit = starts.join(excluded.select(prefix).distinct(), prefix, "left_semi").select("__row").distinct()
    return keyed.join(hit, "__row", "left_anti").drop("__row")


def _filled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    for c in columns:
        df = df.filter(F.col(c).isNotNull() & (F.col(c).cast("string") != ""))
    return df


def same_case(left: DataFrame, right: DataFrame, keys: Sequence[Sequence[str]], left_id: str, right_id: str) -> DataFrame:
    """left_id, links and first: how many right rows agree with a left row in any of several keys, and the least of them; empty parts agree with nothing.

    Right rows are counted by key before they meet the left side, and rows that agree in
    several keys are counted once by adding and taking away what sets of keys have in common,
    so no pair is put out and a hot key sends one row.
    """
    out = left.select(left_id, *dict.fromkeys(c for key in keys for c in key))
    links, firsts = F.lit(0).cast("long"), []
    for size in range(1, len(keys) + 1):
        for i, some in enumerate(combinations(keys, size)):
            columns = list(dict.fromkeys(c for key in some for c in key))
            n, least = f"__n{size}_{i}", f"__first{size}_{i}"
            counted = _filled(right, columns).groupBy(*columns).agg(F.count("*").alias(n), F.min(right_id).alias(least))
            out = out.join(counted if size == 1 else counted.drop(least), columns, "left")
            links = links + F.coalesce(n, F.lit(0)) * (1 if size % 2 else -1)
            firsts += [F.col(least)] if size == 1 else []
    first = F.least(*firsts) if len(firsts) > 1 else firsts[0]
    return out.select(left_id, links.alias("links"), first.alias("first"))


def outcomes(df: DataFrame, id_col: str, flags: Sequence[tuple[str, DataFrame, str]], otherwise: str) -> DataFrame:
    """Rows with the outcome of the first table that holds their key."""
    out = df
    for name, table, key in flags:
        out = out.join(table.select(key).distinct().withColumn(f"__{name}", F.lit(True)), key, "left")
    chain = F
    for name, _, _ in flags:
        chain = chain.when(F.col(f"__{name}"), name)
    return out.withColumn("outcome", chain.otherwise(otherwise)).drop(*[f"__{n}" for n, _, _ in flags])


def unseen(df: DataFrame, seen: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key was not seen before."""
    return df.join(seen.select(*key).distinct(), list(key), "left_anti")


def with_count(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Rows and how many share their key."""
    return df.withColumn(name, F.count("*").over(Window.partitionBy(*keys)))


def with_fallback_counts(df: DataFrame, counters: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows with their counters, 0 where there are none."""
    return df.join(counters.select(*key, *columns), list(key), "left").select(*df.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in columns])


def discovered(incoming: DataFrame, known: DataFrame, key: str, known_id: str) -> DataFrame:
    """Incoming rows with ``merge`` and the known row where exactly one has the key, ``ambiguous`` for several, ``create`` for none."""
    counted = known.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"), F.min(known_id).alias("target"))
    n = F.coalesce("__n", F.lit(0))
    out = incoming.join(counted, key, "left").withColumn("action", F.when(n == 1, "merge").when(n > 1, "ambiguous").otherwise("create"))
    return out.withColumn("target", F.when(F.col("action") == "merge", F.col("target"))).drop("__n")


def verified(candidates: DataFrame, evidence: DataFrame, key: str, order: str, rejects: Column, confirms: Column, cancelled: Column) -> DataFrame:
    """key and status: the first piece of evidence that rejects or confirms decides; a cancelled candidate is rejected at once; else pending.

    Only the first place of either kind counts, so no row of evidence is listed.
    """
    first = evidence.groupBy(key).agg(F.min(F.when(rejects, F.col(order))).alias("__no"), F.min(F.when(confirms & ~rejects, F.col(order))).alias("__yes"))
    status = F.when(cancelled, "rejected").when(F.col("__no").isNotNull() & (F.col("__yes").isNull() | (F.col("__no") < F.col("__yes"))), "rejected").when(F.col("__yes").isNotNull(), "confirmed").otherwise("pending")
    return candidates.join(first, key, "left").select(*candidates.columns, status.alias("status"))


def two_sources(first: DataFrame, second: DataFrame, keys: Sequence[Sequence[str]], row: str, evidence: str, confidence: str) -> DataFrame:
    """Rows of the first source with what equal rows of the second add: distinct evidence, the first MOST_EVIDENCE, and the greatest confidence; then the second's rows that equal none.

    A second row joins the first one, by ``row``, of the rows that it equals.
    """
    # Only the least first row of a key can be the one, so each key sends one row.
    joined = same_case(second, first, keys, row, row).select(row, F.col("first").alias("__a")).join(second, row)
    met = joined.filter("__a is not null").select(F.col("__a").alias(row), F.col(evidence).alias("__added"), F.col(confidence).alias("__best"))
    out = first.join(met.groupBy(row).agg(F.max("__best").alias("__best")), row, "left").join(distinct_values(met, [row], "__added", MOST_EVIDENCE), row, "left")
    merged = out.select(row, F.array_sort(F.array_distinct(F.concat(F.array(evidence), F.coalesce("__added", F.array().cast("array<string>"))))).alias("evidence"), F.greatest(confidence, F.coalesce("__best", F.col(confidence))).alias("confidence"), F.lit("first").alias("source"))
    alone = joined.filter("__a is null").select(row, F.array(evidence).alias("evidence"), F.col(confidence).alias("confidence"), F.lit("second").alias("source"))
    return merged.unionByName(alone)


def new_members(dimension: DataFrame, settings: DataFrame, key: str, renamed: DataFrame, enabled: str) -> DataFrame:
    """key, enabled and whether it is new: settings keep their state under the key's present name, members without one are off."""
    named = settings.join(renamed, key, "left").select(F.coalesce("present", key).alias(key), enabled).groupBy(key).agg(F.bool_or(enabled).alias(enabled))
    return dimension.select(key).join(named.withColumn("__known", F.lit(True)), key, "left").select(key, F.coalesce(enabled, F.lit(False)).alias(enabled), F.col("__known").isNull().alias("new"))


def store_ladder(df: DataFrame, stores: DataFrame, row: str) -> DataFrame:
    """Rows (row, name, code, url) with the store (store, alias, group, code, domain) that they mean, and the step that told it.

    By alias, the least store of it; else by code in any case; else by the longest
    domain that the address lies in, if all of its stores are of one group.
    """
    by_alias = stores.groupBy(F.col("alias").alias("name")).agg(F.min("store").alias("__alias"))
    by_code = stores.groupBy(F.lower("code").alias("__key")).agg(F.min("store").alias("__code"))
    domains = stores.groupBy("domain").agg(F.when(F.countDistinct("group") == 1, F.min("store")).alias("__domain"))
    found = df.join(by_alias, "name", "left").join(by_code, F.lower("code") == F.col("__key"), "left").withColumn("__host", host(F.col("url")))
    found = domain_ladder(found, domains, "__host", "domain", "__domain")
    step = F.when(F.col("__alias").isNotNull(), "alias").when(F.col("__code").isNotNull(), "code").when(F.col("__domain").isNotNull(), "domain").otherwise("none")
    return found.select(row, F.coalesce("__alias", "__code", "__domain").alias("store"), step.alias("step"))
