"""Mixing sources to target weights by Sainte-Lague apportionment.

Sizes are words. Each source's documents form one stream in a seeded order, cut
into blocks of equal size. The mix has as many blocks as all sources together;
blocks go to sources by highest quotients target / (2k + 1), and each source's
blocks go to its shards (runs of neighbouring blocks) in the same way, which gives
every shard an integer quota. A shard takes all its blocks ``quota div blocks``
times and, by a seeded permutation, ``quota mod blocks`` of them once more.

A source whose target has few blocks of the usual size has smaller ones, by halves;
sources of one block size are apportioned together, so a small source changes
nothing for a large one. Shards of a source are equal but for the last, so the
order of their quotients is known and a shard's quota follows from its number.

Targets: sources by code point, null last, have weights 5, 2, 1, repeating, and
share the words of all; a target stops at ``most_copies`` times its source's
size and the excess is shared again by weight until none is above.

No task sees a whole source: sources are numbered, and documents placed in their
stream, by running sums over ranges; quotients are ranked by searching for the
divisor that gives the right number of blocks, with aggregates alone.

Defined cases: a null or empty text has size 0 and is not taken; an empty table
gives no rows; sources of size 0 have target 0; rows that repeat a doc_id are
rows of their own; equal rows may swap places in the order, not in what is taken
overall; sources of equal quotient go by their place in the order; a very
long text is a row like any other, of which at most three times its words are taken;
clashing extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyreef.llm import common

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Words of a block at most; halved for a source until its target has LEAST_BLOCKS blocks.
BLOCK_WORDS, LEAST_BLOCKS = 2048, 400
#: Blocks of a shard.
SHARD_BLOCKS = 64
SEED = 42
#: Divisors that are tried in one step of the search, and steps at most.
TRIED, MOST_STEPS = 48, 40

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: For each number of blocks, the steps that visit all of them.
_STEPS = [[s for s in range(1, max(2, n)) if math.gcd(s, n) == 1] for n in range(SHARD_BLOCKS + 1)]


def running_sum(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Exclusive running sum of a long column in a global order.

    Rows are dealt into ranges of the order; each range sums by itself and is then
    shifted by the total of those before it, of which there is one row a range.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    at = df.columns.index(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            inside = total + sizes.cumsum() - sizes
            total += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(inside, pa.int64()), pa.array(np.full(len(sizes), part), pa.int32())], names=[*batch.schema.names, "__inside", "__part"])

    ranged = common.written(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, f"{schema}, __inside long, __part int"), "mix-ranges")
    parts = common.running_totals(ranged.groupBy("__part").agg(F.sum(value).alias("__sum")), [], ["__part"], "__sum", "__before")
    return ranged.join(F.broadcast(parts.select("__part", "__before")), "__part").withColumn(out, F.col("__inside") + F.col("__before")).drop("__part", "__inside", "__before")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_copies: int = MOST_COPIES) -> DataFrame:
    """key, source_size, place, before (words of the sources before), weight and target; ``sizes`` has one row a source (key, source_size)."""
    numbered = running_sum(running_sum(sizes.withColumn("one", F.lit(1).cast("long")), ["key"], "one", "place").drop("one"), ["key"], "source_size", "before")
    ranked = numbered.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int")))
    ranked = common.written(ranked, "mix-sources")
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, F.lit(False)
    while True:
        row = ranked.agg(
            F.sum(F.when(capped, most_copies * F.col("source_size"))).alias("fixed"),
            F.sum(F.when(~capped, F.col("weight"))).alias("open"),
        ).first()
        if not row["open"]:
            break
        level_now = (total - float(row["fixed"] or 0)) / float(row["open"])
        if level_now <= level:
            break
        level = level_now
        capped = F.lit(level) * F.col("weight") > most_copies * F.col("source_size")
    return ranked.withColumn("target", F.least(F.lit(level) * F.col("weight"), (most_copies * F.col("source_size")).cast("double")))


def apportion(items: DataFrame, group: str, key: str, weight: str, seats: str, most: str) -> DataFrame:
    """Seats of each item of a group by highest quotients weight / (2k + 1), at most ``most`` of them; ties by key.

    An item has as many seats as its quotients above a border. Borders are found
    for all groups at once (there are few groups, and items may be many): each
    step sums the seats that TRIED borders would give and keeps the interval
    around the right one. Items that tie at the border are seated by key.
    """
    items = common.written(items, "mix-items")
    groups = {
        r[group]: r
        for r in items.groupBy(group)
        .agg(F.max(weight).alias("top"), F.min(F.when((F.col(weight) > 0) & (F.col(most) > 0), F.col(weight))).alias("low"), F.max(most).alias("most"), F.max(seats).alias("seats"), F.sum(weight).alias("total"), F.sum(F.when(F.col(weight) > 0, F.col(most)).otherwise(0)).alias("places"))
        .collect()
    }
    # No border is below ``low`` and every item is below ``high``; with too few places all are filled.
    low = {g: (r["low"] or 1.0) / (2.0 * r["most"] + 1) / 2 for g, r in groups.items()}
    high = {g: max(r["top"] or 0.0, r["low"] or 1.0) * 2 for g, r in groups.items()}
    wanted = {g: min(r["seats"], r["places"]) for g, r in groups.items()}
    # Without limits on seats the border is near half the weight of a seat, so the first step looks around that.
    near = {g: (r["total"] or 0.0) / (2.0 * max(1, wanted[g])) for g, r in groups.items()}

    def seated(border: Column) -> Column:
        return F.when(F.col(weight) > 0, F.least(F.col(most), F.floor((F.col(weight) / border + 1) / 2))).otherwise(0).cast("long")

    def by_group(values: dict) -> Column:
        chain = F.lit(None).cast("double")
        for g, v in values.items():
            chain = F.when(F.col(group) == F.lit(g), F.lit(float(v))).otherwise(chain)
        return chain

    kind = items.schema[group].dataType.simpleString()
    def differing(some: list) -> DataFrame:
        """Items that ``low`` gives more seats than ``high``, their seats at ``high``, how many more, and the quotient of the next."""
        sure = seated(by_group({g: high[g] for g in some}))
        found = items.filter(F.col(group).isin(*some)).select(group, key, sure.alias("__sure"), (seated(by_group({g: low[g] for g in some})) - sure).alias("__more"), (F.col(weight) / (2 * sure + 1)).alias("__next"))
        return found.filter("__more > 0")

    exact: set = set()
    tied: set = set()
    for step in range(MOST_STEPS):
        searched = [g for g in groups if g not in exact and g not in tied and high[g] > low[g] * (1 + 4e-16)]
        if not searched:
            break
        tried = {}
        for g in searched:
            a, b = low[g], high[g]
            if step:
                tried[g] = [a * (b / a) ** (i / (TRIED + 1)) for i in range(1, TRIED + 1)]
            else:
                tried[g] = sorted(x for k in range(TRIED // 2) for x in (near[g] * (1 - 2.0 ** -(k + 1)), near[g] * (1 + 2.0**-k)) if a < x < b)
        # A small table of borders, so that every step runs the same compiled plan.
        borders = items.sparkSession.createDataFrame([(g, i, x) for g, some in tried.items() for i, x in enumerate(some)], f"`{group}` {kind}, __i int, __border double")
        sums = items.join(F.broadcast(borders), group).groupBy(group, "__i").agg(F.sum(seated(F.col("__border"))).alias("n")).collect()
        for g, i, n in sorted(((r[group], r["__i"], r["n"]) for r in sums), key=lambda x: x[1]):
            # Sums fall as borders rise.
            if n >= wanted[g]:
                low[g] = tried[g][i]
                if n == wanted[g]:
                    exact.add(g)
            else:
                high[g] = min(high[g], tried[g][i])
        # Where only items of one quotient are left between the borders, a closer look parts them no further.
        if some := [g for g in searched if g not in exact]:
            for r in differing(some).groupBy(group).agg(F.min("__next").alias("a"), F.max("__next").alias("b"), F.max("__more").alias("n")).collect():
                if r["a"] == r["b"] and r["n"] == 1:
                    tied.add(r[group])
    at_least = seated(by_group(high))
    out = items.withColumn("__sure", F.when(by_group({g: 1.0 for g in exact}).isNotNull(), seated(by_group(low))).otherwise(at_least) if exact else at_least)
    # Items that have one more seat just below the border than above it tie there.
    rest = {g: 0 for g in groups}
    for r in out.groupBy(group).agg(F.sum("__sure").alias("n")).collect():
        rest[r[group]] = wanted[r[group]] - r["n"]
    if any(rest[g] > 0 for g in groups):
        queued = running_sum(differing([g for g in groups if rest[g] > 0]).select(group, key, "__more"), [group, key], "__more", "__queue")
        first = queued.groupBy(group).agg(F.min("__queue").alias("__first"))
        won = queued.join(first, group).withColumn("__won", F.least(F.col("__more"), by_group(rest) - (F.col("__queue") - F.col("__first"))).cast("long")).filter("__won > 0").select(group, key, "__won")
        out = out.join(won, [group, key], "left").withColumn("quota", F.col("__sure") + F.coalesce("__won", F.lit(0))).drop("__won")
    else:
        out = out.withColumn("quota", F.col("__sure"))
    return out.drop("__sure")


def _shard_quota(shard: Column) -> Column:
    """Quota of a shard by its number, for columns quota, shards (full ones), last_blocks, last_quota of its source.

    Full shards are equal: each round of quotients seats all of them in turn.
    """
    full = F.col("quota") - F.col("last_quota")
    return F.when(shard < F.col("shards"), F.floor(full / F.greatest(F.col("shards"), F.lit(1))) + F.when(shard < full % F.greatest(F.col("shards"), F.lit(1)), 1).otherwise(0)).otherwise(F.col("last_quota")).cast("long")


def with_shards(quotas: DataFrame) -> DataFrame:
    """Columns for _shard_quota; quotas has source_size, block, blocks, quota.

    The j-th seat of the last shard, which weighs w' words of a full one's w, comes
    after the seats of all S full shards with quotients no smaller, S * floor(((2j +
    1) w / w' + 1) / 2) of them; it is had if that is within the quota.
    """
    words = F.col("block") * SHARD_BLOCKS
    sized = quotas.withColumn("shards", F.floor((F.col("blocks") - 1) / SHARD_BLOCKS)).withColumn("last_blocks", F.col("blocks") - F.col("shards") * SHARD_BLOCKS)
    weigh = words / F.greatest(F.lit(1), F.col("source_size") - F.col("shards") * words)
    places = F.sequence(F.lit(0).cast("long"), MOST_COPIES * F.col("last_blocks") - 1)
    had = F.size(F.filter(places, lambda j: j + 1 + F.col("shards") * F.floor(((2 * j + 1) * weigh + 1) / 2) <= F.col("quota")))
    # What the full shards cannot take, at MOST_COPIES times all their blocks, is left to the last one.
    return sized.withColumn("last_quota", F.greatest(had, F.col("quota") - F.col("shards") * (MOST_COPIES * SHARD_BLOCKS)).cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """id, size, source_size, target, taken, and takes: for each run of words taken, (from, until, times)."""
    text = F.col(f"`{text_col}`").cast("string")
    base = common.written(
        docs.select(
            F.col(f"`{id_col}`").alias("id"),
            F.when(F.col(f"`{source_col}`").isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), F.col(f"`{source_col}`").cast("string"))).alias("key"),
            F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), text).alias("h"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "mix-sizes",
    )
    sources = source_targets(base.groupBy("key").agg(F.sum("size").alias("source_size")))
    halves = F.greatest(F.lit(0), F.least(F.lit(BLOCK_WORDS.bit_length() - 1), F.floor(F.log2(F.greatest(F.col("target") / LEAST_BLOCKS, F.lit(1.0))))))
    sources = sources.withColumn("block", F.pow(F.lit(2.0), halves).cast("long")).withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
    sources = common.written(sources, "mix-targets")
    seats = sources.groupBy("block").agg(F.least(F.round(F.sum("target") / F.max("block")), F.sum(MOST_COPIES * F.col("blocks"))).cast("long").alias("seats"))
    quotas = apportion(sources.join(seats, "block").withColumn("most", MOST_COPIES * F.col("blocks")), "block", "key", "target", "seats", "most")
    quotas = common.written(with_shards(quotas.filter("blocks > 0")), "mix-quotas")

    # Documents stand in their source's stream by hash; the first word of each follows from one running sum over all.
    placed = running_sum(base.filter("size > 0"), ["key", "h", "id", "size", "row"], "size", "stream")
    placed = placed.join(quotas, "key").withColumn("start", F.col("stream") - F.col("before"))
    block, blocks = F.col("block"), F.col("blocks")
    # A seeded permutation of a shard's blocks: i * step + shift modulo the blocks, step coprime to them.
    steps = F.array(*[F.array(*map(F.lit, s)) for s in _STEPS[1:]])

    def cut(b: Column) -> Column:
        shard = F.floor(b / SHARD_BLOCKS)
        n = F.least(F.lit(SHARD_BLOCKS), blocks - shard * SHARD_BLOCKS)
        salt = F.pmod(F.xxhash64(F.lit(seed), F.col("key"), shard), F.lit(1 << 30))
        some = F.element_at(steps, n.cast("int"))
        step = F.element_at(some, (salt % F.size(some) + 1).cast("int"))
        quota = _shard_quota(shard)
        once_more = (b % SHARD_BLOCKS * step + salt) % n < quota % n
        return F.struct(
            (F.greatest(F.col("start"), b * block) - F.col("start")).alias("from"),
            (F.least(F.col("start") + F.col("size"), (b + 1) * block) - F.col("start")).alias("until"),
            (F.floor(quota / n) + F.when(once_more, 1).otherwise(0)).alias("times"),
        )

    spanned = F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))
    taken = F.aggregate("takes", F.lit(0).cast("long"), lambda a, c: a + (c["until"] - c["from"]) * c["times"])
    rows = placed.withColumn("takes", F.transform(spanned, cut)).select("id", "size", "source_size", "target", taken.alias("taken"), "takes")
    none = base.filter("size = 0").join(sources.select("key", "source_size", "target"), "key")
    rows = rows.unionByName(none.select("id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.array().cast("array<struct<from:bigint,until:bigint,times:bigint>>").alias("takes")))
    return rows.withColumnRenamed("id", id_col)


def _passes(takes: list[dict], size: int) -> list[list[tuple[int, int]]]:
    """For each time round, the runs of words taken; neighbouring runs are put together."""
    rounds = []
    for turn in range(max((t["times"] for t in takes), default=0)):
        runs: list[tuple[int, int]] = []
        for t in takes:
            if t["times"] > turn:
                if runs and runs[-1][1] == t["from"]:
                    runs[-1] = (runs[-1][0], t["until"])
                else:
                    runs.append((t["from"], t["until"]))
        rounds.append(runs)
    return rounds


def _taken_texts(text: str, takes: list[dict]) -> list[str]:
    """The text of each time round: whole where all words are taken, else the taken runs as they stand, by line."""
    places = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    out = []
    for runs in _passes(takes, len(places)):
        if runs == [(0, len(places))]:
            out.append(text)
        else:
            out.append("\n".join(text[places[a][0] : places[b - 1][1]] for a, b in runs))
    return out


def materialize(docs: DataFrame, text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars", seed: int = SEED) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each time round that takes words of a document."""
    names = docs.columns
    # The mix moves keys alone; texts stay where they are until they meet what is taken of them.
    columns_of_row = [F.col(f"`{c}`") for c in names]
    keyed = docs.withColumn("__row", F.concat(*[F.hex(F.xxhash64(F.lit(i), *columns_of_row)) for i in range(2)]))
    # Equal rows share a key. What is taken of them is counted by its kind, so that many copies are few rows.
    plan = mix(keyed, "__row", text_col, source_col, seed).filter("taken > 0").groupBy("__row", "takes").agg(F.count("*").alias("__copies"))
    plan = common.written(plan, "mix-takes")

    @F.pandas_udf("array<string>")
    def texts(text: pd.Series, takes: pd.Series) -> pd.Series:
        return pd.Series([_taken_texts(t or "", list(k)) for t, k in zip(text, takes, strict=True)])

    met = keyed.dropDuplicates(["__row"]).join(plan, "__row").withColumn("__texts", texts.asNondeterministic()(F.col(f"`{text_col}`").cast("string"), "takes"))
    met = met.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).withColumn("__text", F.explode("__texts"))
    columns = {text_col: F.col("__text")}
    if chars_col in names:
        columns[chars_col] = F.char_length("__text").cast(docs.schema[chars_col].dataType)
    return met.select(*[columns[c].alias(c) if c in columns else F.col(f"`{c}`") for c in names])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
