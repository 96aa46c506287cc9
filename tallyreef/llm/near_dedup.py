"""Near-duplicate detection with HyperMinHash sketches.

A document's set holds the hashes of its distinct word shingles. Its sketch has
one register a bucket: the least value of the bucket's hash function over the
set, kept as its count of leading zeros and its first mantissa bits. Bands of
registers name candidate groups; a candidate pair's Jaccard similarity is first
estimated from the registers, less the collisions that compressed registers are
expected to have, and pairs that may reach the bound are confirmed on full sets.

Documents with equal sets (by a digest of 128 bits) are one class from the start.
A group of candidates is not expanded into pairs: members are compared with the
group's leader, the node whose groups are largest, which is the text that the
others were made from, and links are contracted into components. Where groups
still span several components, the sketches of these are compared block by block,
which tells the nodes that may have a link in a block. Only these are given their
full sets there, and only links leave a block.

Defined cases: without words or text a set is empty and linked with nothing;
texts with fewer words than a shingle have their whole sequence as the one
shingle; in ``near_duplicates`` a null doc_id takes no part and has a null
component, in ``keep_one`` it comes after all others; rows that repeat a doc_id
with another text stand for that text; of rows of one doc_id, or of none, that are near
copies, the one with the smallest digest of all its columns stays; a very long text has its
whole set; an empty
table gives no rows; extra columns are ignored, and ``keep_one`` keeps them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyreef.llm import common
from tallyreef.llm.components import connect

SHINGLE_WORDS, PERCENT = 5, 80
#: A pair with similarity 0.8 shares no band with a chance of 5e-8.
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
#: Mantissa bits of a register; its other 6 bits count leading zeros.
MANTISSA = 10
#: Standard deviations by which an estimate may fall short of the bound.
SLACK = 5.0
#: Ids of a list (16 bytes each) that is broadcast at most.
BROADCAST_IDS = 1_000_000
#: Members of a block in the comparison of groups that span several components, and rows of sketches and of full sets that a task is given, about.
BLOCK, SKETCH_ROWS, SET_ROWS = 256, 2048, 512

_seeds = np.random.default_rng(20240229)
_MULTIPLY = _seeds.integers(0, 1 << 63, REGISTERS, np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _seeds.integers(0, 1 << 63, REGISTERS, np.uint64) * np.uint64(2)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; A-Z count as a-z."""
    tokens = common.utf8(text).lower().split()
    n = len(tokens)
    if not n:
        return np.zeros(0, np.uint64)
    code = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, n)
    width = min(words, n)
    mixed = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _STEP + code[i : i + len(mixed)]
    mixed = (mixed ^ (mixed >> np.uint64(30))) * _MIX
    return np.unique(mixed ^ (mixed >> np.uint64(31)))


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of non-empty sets, one row each."""
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], sizes.cumsum()[:-1]])
    values = np.concatenate(sets)
    least = np.empty((REGISTERS, len(sets)), np.uint64)
    scratch = np.empty_like(values)
    for i in range(REGISTERS):
        np.bitwise_xor(values, _FLIP[i], out=scratch)
        np.multiply(scratch, _MULTIPLY[i], out=scratch)
        least[i] = np.minimum.reduceat(scratch, starts)
    share, exponent = np.frexp(least.T.astype(np.float64))
    zeros = np.clip(64 - exponent, 0, 63)
    mantissa = np.minimum(np.floor((share * 2 - 1) * (1 << MANTISSA)), (1 << MANTISSA) - 1)
    return (zeros.astype(np.uint16) << MANTISSA) | np.maximum(mantissa, 0).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers.

    Least values of unrelated sets of n and m elements fall in one cell with a
    chance of n m / (n + m)^2 / (2 ln 2 * 2^mantissa): the cell around x is about
    x / (2 ln 2 * 2^mantissa) wide and least values are exponentially spread.
    """
    chance = n_a * n_b / (n_a + n_b) ** 2.0 / (2 * math.log(2) * (1 << MANTISSA))
    return ((a == b).mean(-1) - chance) / (1 - chance)


def sketch_documents(texts: DataFrame, words: int) -> DataFrame:
    """All columns of texts but ``text`` (id, text, more of any name), n (set size), set_hash and sketch (null for empty sets)."""
    narrow = texts.select(*[F.col(f"`{c}`") for c in texts.columns if c != "text"], "text")
    names = narrow.columns[:-1]
    last = len(names)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:last])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = [shingle_set(t, words) for t in part.column(last).to_pylist()]
                full = [s for s in sets if len(s)]
                made = iter(sketches(full) if full else ())
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:last],
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s, digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([next(made).astype("<u2").tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=[*names, "n", "set_hash", "sketch"],
                )

    return narrow.mapInArrow(run, f"{fields}, n long, set_hash binary, sketch binary")


def _with_key(texts: DataFrame) -> DataFrame:
    """Rows of one id and text share a key; a clash of keys does no harm, since sets are told apart by their digest."""
    return texts.withColumn("key", F.xxhash64("id", "text"))


def _passing(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose estimate may reach the bound."""
    at_least = _least_estimate(percent)
    sides = [nodes.select(F.col("cid").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")) for x in "ab"]
    joined = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n_a, n_b = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (2, 3))
            s_a, s_b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, REGISTERS) for i in (4, 5))
            # Sizes alone bound the similarity too.
            near = (estimate(s_a, s_b, n_a, n_b) >= at_least) & (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(near)) for c in batch.columns[:2]], names=["a", "b"])

    return joined.mapInArrow(run, "a long, b long")


def _least_estimate(percent: int) -> float:
    bound = percent / 100
    return bound - SLACK * math.sqrt(bound * (1 - bound) / REGISTERS)


def _sets_of(wanted: DataFrame, docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """cid and full set (sorted hashes) of the wanted cids; docs has key and text."""
    # A list of checked size is sent to the texts, which then stay where they are; beyond it both sides are shuffled.
    wanted = common.written(wanted.distinct().join(nodes.select("cid", F.col("key").alias("rep"), F.col("set_hash").alias("expected")), "cid"), "dedup-wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = [shingle_set(t, words) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([hashlib.blake2b(s, digest_size=16).digest() for s in sets], pa.binary()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())],
                    names=["cid", "expected", "set_hash", "full"],
                )

    sets = docs.join(wanted, docs["key"] == wanted["rep"]).select("cid", "expected", "text").mapInArrow(fill, "cid long, expected binary, set_hash binary, full binary")
    # Rows may repeat; the text of the class counts, once.
    return common.written(sets.filter(F.col("set_hash") == F.col("expected")).dropDuplicates(["cid"]).select("cid", "full"), "dedup-sets")


def _confirmed(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the bound."""
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("cid")), docs, nodes, words)
    both = pairs.join(sets.select(F.col("cid").alias("a"), F.col("full").alias("f_a")), "a").join(sets.select(F.col("cid").alias("b"), F.col("full").alias("f_b")), "b").select("a", "b", "f_a", "f_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                near.append(bool(_linked(a, [b], percent)[0]))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(near, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    return common.written(both.mapInArrow(check, "a long, b long"), "dedup-links")


def _linked(one: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the other sets reach the bound with one set."""
    sizes = np.array([len(x) for x in others])
    joined = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, joined), len(one) - 1)
    both = np.add.reduceat((one[at] == joined).astype(np.int64), np.concatenate([[0], sizes.cumsum()[:-1]]))
    return 100 * both >= percent * (len(one) + sizes - both)


def _remaining_links(rest: DataFrame, labels: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between components that still meet in a group; rest has bucket, cid, reach, label.

    Each group belongs to the component of its farthest-reaching node; members of
    other components are attached to that component. Attached nodes are compared
    with all its nodes and with each other, blocks against blocks: sketches first,
    which leave the nodes that may have a link in that pair of blocks, and then the
    full sets of these.
    """
    owners = rest.groupBy("bucket").agg(F.max(F.struct("reach", "label")).alias("x")).select("bucket", F.col("x.label").alias("owner"))
    attached = rest.join(common.written(owners, "dedup-owners"), "bucket").filter("label <> owner").select("owner", "cid", "label", F.lit(True).alias("attached")).distinct()
    attached = common.written(attached, "dedup-attached")
    own = nodes.select("cid").join(labels, "cid", "left").select("cid", F.coalesce("label", "cid").alias("label"))
    own = own.join(attached.select(F.col("owner").alias("label")).distinct(), "label").select(F.col("label").alias("owner"), "cid", "label", F.lit(False).alias("attached"))
    rows = common.written(attached.unionByName(own), "dedup-sides")
    blocks = rows.groupBy("owner").agg(F.ceil(F.count_if("attached") / BLOCK).cast("int").alias("n_attached"), F.greatest(F.lit(1), F.ceil(F.count_if(~F.col("attached")) / BLOCK)).cast("int").alias("n_own"))
    dealt = rows.join(common.written(blocks, "dedup-blocks"), "owner").withColumn("block", F.pmod(F.xxhash64("cid"), F.when(F.col("attached"), F.col("n_attached")).otherwise(F.col("n_own"))).cast("int"))
    # Cells: (0, own block, attached block), and (1, low, high) of two attached blocks.
    other_own, other_attached = F.sequence(F.lit(0), F.col("n_own") - 1), F.sequence(F.lit(0), F.col("n_attached") - 1)
    cell = lambda kind, low, high, left: F.struct(F.lit(kind).alias("kind"), low.cast("int").alias("low"), high.cast("int").alias("high"), left.alias("left"))
    block = F.col("block")
    cells = F.when(F.col("attached"), F.concat(
        F.transform(other_own, lambda k: cell(0, k, block, F.lit(False))),
        F.transform(other_attached, lambda k: cell(1, F.least(block, k), F.greatest(block, k), block <= k)),
    )).otherwise(F.transform(other_attached, lambda k: cell(0, block, k, F.lit(True))))
    place = ["owner", "kind", "low", "high"]
    sketched = nodes.select("cid", "n", "sketch")
    # Rows are few bytes and much work, so tasks are told by rows.
    tasks = (dealt.agg(F.sum(F.size(cells))).first()[0] or 0) // SKETCH_ROWS + 1
    spread = dealt.withColumn("cell", F.explode(cells)).select("owner", "cell.*", "cid", "label").join(sketched, "cid").repartition(tasks, *place)
    at_least = _least_estimate(percent)

    def near_ones(pdf) -> Iterator[tuple[int, np.ndarray]]:
        """For rows of a pair of blocks: each row and the rows of other components that may be linked with it."""
        s = np.frombuffer(b"".join(pdf["sketch"]), "<u2").reshape(-1, REGISTERS)
        n, label, left = pdf["n"].to_numpy(float), pdf["label"].to_numpy(), pdf["left"].to_numpy()
        inside = pdf["kind"].iloc[0] == 1 and pdf["low"].iloc[0] == pdf["high"].iloc[0]
        for i in range(len(n)) if inside else np.flatnonzero(left):
            others = np.arange(i + 1, len(n)) if inside else np.flatnonzero(~left)
            others = others[label[others] != label[i]]
            near = others[(estimate(s[others], s[i], n[others], n[i]) >= at_least) & (100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i]))]
            if len(near):
                yield i, near

    def involved(pdf):
        found = np.zeros(len(pdf), bool)
        for i, near in near_ones(pdf):
            found[i] = True
            found[near] = True
        return pdf.loc[found, [*place, "left", "cid", "label"]]

    kept = common.written(spread.groupBy(*place).applyInPandas(involved, "owner long, kind int, low int, high int, left boolean, cid long, label long"), "dedup-involved")
    sets = _sets_of(kept.select("cid"), docs, nodes, words)

    def confirm(pdf):
        import pandas as pd

        full = [np.frombuffer(x, "<u8") for x in pdf["full"]]
        label, cid = pdf["label"].to_numpy(), pdf["cid"].to_numpy()
        found = []
        for i, near in near_ones(pdf):
            hit = near[_linked(full[i], [full[j] for j in near], percent)]
            # One link to a component is as good as all.
            hit = hit[np.unique(label[hit], return_index=True)[1]]
            found += [(min(cid[i], cid[j]), max(cid[i], cid[j])) for j in hit]
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return common.written(kept.join(sketched, "cid").join(sets, "cid").repartition(kept.count() // SET_ROWS + 1, *place).groupBy(*place).applyInPandas(confirm, "a long, b long").distinct(), "dedup-last")


def _labelled(texts: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """texts (id, text, more) without the text but with n and set_hash, and the label of each set_hash: sets of one component share it."""
    keyed = _with_key(texts)
    drawn = common.written(sketch_documents(keyed, words), "dedup-sketches")
    # A class is named by a number that is drawn once, when its row is written.
    nodes = drawn.filter("n > 0").groupBy("set_hash").agg(F.min(F.struct(F.col("id").isNull(), "id", "key", "n", "sketch")).alias("x")).select("set_hash", "x.key", "x.n", "x.sketch")
    nodes = common.written(nodes.withColumn("cid", F.monotonically_increasing_id()), "dedup-classes")

    # Groups: nodes that agree in a band; the band's 8 bytes are the registers themselves.
    bands = nodes.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))).select(
        F.xxhash64("band", F.substring("sketch", F.col("band") * (2 * ROWS) + 1, F.lit(2 * ROWS))).alias("bucket"), "cid"
    )
    shared = common.written(bands.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1"), "dedup-buckets")
    members = common.written(bands.join(shared, "bucket"), "dedup-members")
    # A node's reach, the sizes of its groups, is largest for the text that others were made from: each of its bands is the usual one.
    reach = members.groupBy("cid").agg(F.sum("members").alias("reach"))
    members = common.written(members.select("bucket", "cid").join(reach, "cid"), "dedup-reach")

    leaders = members.groupBy("bucket").agg(F.max(F.struct("reach", "cid")).alias("x")).select("bucket", F.col("x.cid").alias("leader"))
    pairs = members.join(common.written(leaders, "dedup-leaders"), "bucket").filter("cid <> leader").select(F.least("cid", "leader").alias("a"), F.greatest("cid", "leader").alias("b")).distinct()
    pairs = common.written(_passing(pairs, nodes, percent), "dedup-passing")
    links = _confirmed(pairs, keyed, nodes, words, percent)
    labels = connect(links)

    rest = members.join(labels, "cid", "left").select("bucket", "cid", "reach", F.coalesce("label", "cid").alias("label"))
    last = _remaining_links(rest, labels, keyed, nodes, words, percent)
    if not last.isEmpty():
        labels = connect(links.union(last))
    return drawn.drop("key", "sketch"), common.written(nodes.select("set_hash", "cid").join(labels, "cid", "left").select("set_hash", F.coalesce("label", "cid").alias("label")), "dedup-labels")


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable by links), kept (it is that id)."""
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    # Rows without an id take no part, but their sets are counted.
    known = texts.filter("id is not null")
    drawn, labels = _labelled(known, words, percent)
    heads = drawn.filter("n > 0").join(labels, "set_hash").groupBy("label").agg(F.min("id").alias("head"))
    classes = common.written(labels.join(common.written(heads, "dedup-heads"), "label").select("set_hash", "head"), "dedup-components")
    out = drawn.join(classes, "set_hash", "left").select("id", "n", F.coalesce("head", "id").alias("head"))
    nameless = sketch_documents(texts.filter("id is null"), words).select("id", "n", F.lit(None).cast("long").alias("head"))
    out = out.unionByName(nameless)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("head").alias("component_id"), F.coalesce(F.col("id") == F.col("head"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, words: int = SHINGLE_WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs less all but one of each component: the row of the smallest id, null last, then of the smallest digest of all columns."""
    keyed = docs.withColumn("__row", F.concat(*[F.hex(F.xxhash64(F.lit(i), *[F.col(f"`{c}`") for c in docs.columns])) for i in range(2)]))
    texts = keyed.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"), "__row")
    drawn, labels = _labelled(texts, words, percent)
    chosen = drawn.filter("n > 0").join(labels, "set_hash").groupBy("label").agg(F.min(F.struct(F.col("id").isNull(), "id", "__row")).alias("x")).select("x.__row")
    chosen = common.written(chosen, "dedup-chosen")
    wordless = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).rlike(r"\A[\x20\x09-\x0D]*\z")
    kept = keyed.filter(~wordless).join(chosen, "__row", "left_semi").dropDuplicates(["__row"]).drop("__row")
    return kept.unionByName(docs.filter(wordless))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document by 4-word shingles and a similarity of 0.8."""
    return near_duplicates(common.table(spark, sf_dir, "documents"), words=4)
