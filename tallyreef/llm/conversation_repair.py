"""Repair of the turn structure of conversations at least cost.

Rows of a conversation stand in the order of their turns. A row may be blank, a duplicate
of an earlier one, or cut off; roles must follow ``(s?(ua)+)?`` by their initials. Edits
keep, rerole or delete rows and insert empty ones; ``repair_costs`` finds the cheapest.

A first pass carries one narrow row a message, without its text (a digest stands for it),
to its conversation, where a task reads them as a stream and keeps a byte and two numbers
a row until the conversation ends: about the size of the audit, which is one value for a
whole conversation by contract. A second pass streams the texts in the same order past the
edits, so no conversation is ever held in memory, whatever its length. Both sorts spill.
One conversation stays in one task, as its audit and its digest are read in order.

Defined cases: a null role or text counts as one space, so such a text is blank; a null
turn counts as one space in the draw of damage and stands first; a null id is an id of its
own; rows of one turn stand by role, then by the sha256 of their text; an empty role has no
initial and cannot be kept; a text of white space alone is blank, and a very long one is
streamed like any other; equal rows are duplicates, but for the first; equally cheap edits
go by their letters in ASCII order; a conversation without rows after damage has zeros and
an empty audit; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyreef.llm import common
from tallyreef.llm.repair_costs import DELETE, INSERT, KEEP, NONE, Grammar, Repairer

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"u": "user", "a": "assistant"}
#: (s?(ua)+)? over initials; reroling costs 3, deleting 4, inserting 3.
TURNS = Grammar(
    {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER},
    final=frozenset({START, ASSISTANT}), new=tuple(ROLES), rerole=3, delete=4, insert=3,
)
#: What a truncated row costs that stays.
TRUNCATED_COST = 3
#: Neighbours that are no fault, and initials that the grammar knows.
LEGAL, INITIALS = ("su", "ua", "au"), "sua"
#: A row's fault as a number; the first that holds counts.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
SYMBOLS = [(x, extra) for x in (*INITIALS, "") for extra in (0, TRUNCATED_COST)] + [("", None)]
_CODES = {symbol: code for code, symbol in enumerate(SYMBOLS)}
#: Conversations that leave a task together.
BATCH = 512


def _rows(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, turn, role, text; nulls of role and text are one space."""
    text = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")).alias(k) for c, k in ((role_col, "role"), (text_col, "text"))]
    return conversations.select(F.col(f"`{id_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), *text)


def damaged(conversations: DataFrame, every: int = 20, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text and alive: rows after damage drawn from crc32 of ``id:turn``; dropped rows stay, not alive."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    drawn = _rows(conversations, id_col, turn_col, role_col, text_col).withColumn("draw", F.pmod(F.crc32(key.cast("binary")), F.lit(every)))
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 4, ROLES["u"]).otherwise(F.col("role"))
    out = drawn.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("draw") != 0).alias("alive"), "draw")
    return out.withColumn("copy", F.explode(F.when(F.col("draw") == 3, F.sequence(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("draw", "copy")


def _mark(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _narrow(rows: DataFrame) -> DataFrame:
    """A row a message without its text: conv_id, alive, turn, initial, fault; by conversation and in order."""
    trimmed = F.rtrim(F.col("text"), F.lit(common.WORD_SEPARATORS))
    n = rows.select("conv_id", "alive", "turn", "role", _mark(F.col("text")).alias("mark"), (trimmed == "").alias("blank"), (~F.substring(trimmed, -1, 1).isin(*".!?")).alias("truncated"))
    # Blank and dropped rows are compared with nothing: each turn's are by themselves.
    seen = F.when(F.col("blank") | ~F.col("alive"), F.coalesce(F.col("turn").cast("string"), F.lit("")).cast("binary")).otherwise(F.col("mark"))
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "alive", "blank", "seen").orderBy(F.asc_nulls_first("turn"))) > 1
    fault = F.when(F.col("blank"), BLANK).when(F.col("again"), DUPLICATE).when(F.col("truncated"), TRUNCATED).otherwise(SOUND)
    placed = n.repartition("conv_id").withColumn("seen", seen).withColumn("again", again)
    return placed.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "mark").select("conv_id", "alive", "turn", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


class _Account:
    """What is known of one conversation while its rows pass."""

    def __init__(self, conv_id):
        self.conv_id, self.codes = conv_id, bytearray()
        self.faults, self.illegal = [0] * 4, 0
        self.initial = self.least = self.last = None
        self.turns = 0

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        self.illegal += self.initial is not None and self.initial + initial not in LEGAL
        self.initial = initial
        self.faults[fault] += 1
        if turn is not None and turn != self.last:
            self.least = turn if self.least is None else self.least
            self.last = turn
            self.turns += 1
        symbol = ("", None) if fault in (BLANK, DUPLICATE) else (initial if initial in INITIALS else "", TRUNCATED_COST if fault == TRUNCATED else 0)
        self.codes.append(_CODES[symbol])

    def row(self, repairer: Repairer) -> tuple:
        cost, audit, initials = repairer.repair(self.codes)
        gaps = self.last - self.least + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, *self.faults[BLANK:], self.illegal, cost, audit, initials)


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    repairer, account, done, kind = Repairer(TURNS, SYMBOLS), None, [], None

    def out() -> pa.RecordBatch:
        names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "initials"]
        columns = list(zip(*done, strict=True))
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [kind, *[pa.int64()] * 6, pa.string(), pa.string()], strict=True)], names=names)

    for batch in batches:
        kind = batch.schema.field(0).type
        for conv_id, alive, turn, initial, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if account is None or account.conv_id != conv_id:
                if account is not None:
                    done.append(account.row(repairer))
                account = _Account(conv_id)
                if len(done) >= BATCH:
                    yield out()
            if alive:
                account.add(turn, initial, fault)
    if account is not None:
        done.append(account.row(repairer))
        yield out()


def audits(rows: DataFrame) -> DataFrame:
    """Faults, cost and edits of each conversation of ``damaged`` rows; ``initials`` has the new initial of each edit."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, initials string"
    return common.written(_narrow(rows).mapInArrow(_audit, schema), "conversation-audits")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, audit, initials, role, text), the row with the audit before the others of its conversation, to repaired rows."""
    audit, initials, at, place = "", "", 0, 0
    for batch in batches:
        done: list[tuple] = []

        def inserted(conv_id) -> None:
            nonlocal at, place
            while at < len(audit) and audit[at] == INSERT:
                done.append((conv_id, place, INSERT, ROLES[initials[at]], ""))
                at, place = at + 1, place + 1

        for conv_id, row_audit, row_initials, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row_audit is not None:
                audit, initials, at, place = row_audit, row_initials, 0, 0
            else:
                edit = audit[at]
                if edit != DELETE:
                    done.append((conv_id, place, edit, role if edit == KEEP else ROLES[initials[at]], text))
                    place += 1
                at += 1
            # Inserts go out as soon as the row before them has, so the last ones need no later row.
            inserted(conv_id)
        columns = list(zip(*done, strict=True)) if done else [[]] * 5
        types = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["conv_id", "place", "edit", "role", "text"])


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit, role, text of the repaired conversations; a task has whole conversations, in order."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    nothing = F.lit(None).cast("string")
    messages = rows.filter("alive").select("conv_id", nothing.alias("audit"), nothing.alias("initials"), "turn", "role", "text", _mark(F.col("text")).alias("mark"))
    heads = found.select("conv_id", "audit", "initials", F.lit(None).cast("long").alias("turn"), nothing.alias("role"), nothing.alias("text"), F.lit(None).cast("binary").alias("mark"))
    ordered = heads.unionByName(messages).repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), F.asc_nulls_first("turn"), "role", "mark")
    return ordered.select("conv_id", "audit", "initials", "role", "text").mapInArrow(_apply, f"conv_id {kind}, place long, edit string, role string, text string")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, digest, any_rows = None, None, False
    for batch in batches:
        ids, digests = [], []
        for conv_id, place, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if place == 0:
                if any_rows:
                    ids.append(current)
                    digests.append(digest.hexdigest())
                current, digest, any_rows = conv_id, hashlib.sha256(), True
            digest.update(common.utf8(f"{'' if place == 0 else chr(10)}{role}:{text}"))
        kind = batch.schema.field(0).type
        yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(digests, pa.string())], names=["conv_id", "repaired_sha256"])
    if any_rows:
        yield pa.RecordBatch.from_arrays([pa.array([current], kind), pa.array([digest.hexdigest()])], names=["conv_id", "repaired_sha256"])


def digests(rows: DataFrame) -> DataFrame:
    """sha256 of each conversation's ``role:text`` lines; rows as ``repaired`` gives them."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    return rows.select("conv_id", "place", "role", "text").mapInArrow(_digest, f"conv_id {kind}, repaired_sha256 string")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage, faults, cost and cheapest edits of every conversation, with a digest of what they give."""
    rows = damaged(common.table(spark, sf_dir, "conversations"))
    found = audits(rows)
    hashes = digests(repaired(rows, found)).withColumnRenamed("conv_id", "hashed_id")
    out = found.join(hashes, F.col("conv_id").eqNullSafe(F.col("hashed_id")), "left")
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
