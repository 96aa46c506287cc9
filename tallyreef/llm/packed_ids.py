"""Token ids as fixed-width bit-packed files.

Documents are dealt into ranges of ascending doc_id; each task encodes its range
in order and cuts the stream of ids into shards. A shard is one self-describing
byte string: header, block offsets, document table, and the ids in the fewest
bits that the vocabulary needs. Blocks hold a multiple of eight ids and so begin
on a byte, which lets numpy unpack any block by itself. Shards are written as
binary rows of a Parquet table in a shared folder, so that Spark's committer
guards them against lost executors and repeated tasks.

Defined cases: a null text counts as empty and still has its end id; rows that
repeat a doc_id stand next to each other in the order in which they are read, so
that ranges may part them; a null doc_id comes first; the string of a special
token becomes that token, as the library has it; a very long text is encoded
whole, and its ids span as many blocks as they need; an empty table gives no shards and
no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyreef.llm import common

END_ID = 1
#: Ids of a block, a multiple of 8, and ids from which a shard is closed.
BLOCK_IDS, SHARD_IDS = 1024, 1 << 20
#: Distinct words whose ids a Python worker remembers; beyond that it starts anew with the next batch.
CACHE_WORDS = 600_000
#: Distinct pieces of words that it remembers beside them.
CACHE_PIECES = 300_000
#: New words that are given to the tokenizer at once.
RUN_WORDS = 1000
#: Texts that are encoded at once.
RUN_TEXTS = 2048

# How a tokenizer forms and cuts words when what follows cuts plain ones alike: letters of ASCII and Latin-1, digits, signs, and no beginning of a special token.
_FORMED = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = re.compile(r"(?:[ -;=-~À-ÖØ-öø-ÿ]++|<(?!\|))*+")
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")

_MAGIC = b"TRPK"
_HEADER = struct.Struct("<4sBBHIQ")  # magic, version, bits, nothing, documents, ids


def bits_for(vocabulary: int) -> int:
    """Fewest bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, lowest bit first."""
    if bits in (8, 16, 32):  # the same bytes, without going through single bits
        return ids.astype(f"<u{bits // 8}").tobytes()
    single = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(single.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    """The first ``count`` ids of packed bytes."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    single = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :bits] = single
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(-1)


def write_shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, bits: int) -> bytes:
    """One shard: header, offsets of blocks in the payload, documents (known, id, end), payload."""
    starts = range(0, len(ids), BLOCK_IDS)
    blocks = [pack(ids[i : i + BLOCK_IDS], bits) for i in starts]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks], dtype=np.int64)]).astype("<u8")
    known = np.array([d is not None for d in doc_ids], np.uint8)
    names = np.array([0 if d is None else d for d in doc_ids], "<i8")
    ends = np.cumsum(lengths, dtype=np.int64).astype("<u8")
    return b"".join([_HEADER.pack(_MAGIC, 1, bits, 0, len(doc_ids), len(ids)), offsets.tobytes(), known.tobytes(), names.tobytes(), ends.tobytes(), *blocks])


class Shard:
    """Random access to a shard's ids."""

    def __init__(self, data: bytes):
        magic, version, self.bits, _, n_docs, self.n_ids = _HEADER.unpack_from(data)
        if magic != _MAGIC or version != 1:
            raise ValueError("not a shard of packed ids")
        at = _HEADER.size
        n_blocks = -(-self.n_ids // BLOCK_IDS)

        def table(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, count, at)
            at += found.nbytes
            return found

        self.offsets = table("<u8", n_blocks + 1)
        self.known, self.doc_ids, self.ends = table("u1", n_docs), table("<i8", n_docs), table("<u8", n_docs)
        self.data, self.payload = data, at

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids from ``start`` to before ``end``; only the blocks that hold them are unpacked."""
        if start >= end:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK_IDS, (end - 1) // BLOCK_IDS
        low, high = self.payload + int(self.offsets[first]), self.payload + int(self.offsets[last + 1])
        count = min(self.n_ids, (last + 1) * BLOCK_IDS) - first * BLOCK_IDS
        return unpack(self.data[low:high], count, self.bits)[start - first * BLOCK_IDS : end - first * BLOCK_IDS]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))


class WordEncoder:
    """Ids of texts by the tokenizers library, with words and their pieces remembered.

    The tokenizer drops white space and no token reaches over it, so a text's ids
    are those of its words in turn. Nor does one reach over the pieces into which it
    cuts a word; fewer of these are new, and the library's model takes them as they are.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {}
        self.model = self.tokenizer.model
        # Letters as the model has them; what is left out stands for itself.
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100) if c != 0xF7}
        self.cuts_plainly = self._cuts_plainly()

    def _cuts_plainly(self) -> bool:
        """Whether the tokenizer is one whose cuts of plain words are known."""
        made = json.loads(self.tokenizer.to_str())
        first, *rest = (made["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        cut = first.get("pattern") == {"Regex": _CUT} and (first["behavior"], first["invert"]) == ("Removed", True)
        level = [(r["type"], r.get("add_prefix_space"), r.get("use_regex")) for r in rest] == [("ByteLevel", False, False)]
        special = all(t["content"].startswith("<|") and not t["normalized"] for t in made["added_tokens"])
        return made["normalizer"] == _FORMED and cut and level and special and made["post_processor"] is None

    def _encode_run(self, words: list[str]) -> list[bytes]:
        """Ids of each word from one call for all; the offsets of the ids tell the words apart."""
        found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids = np.array(found.ids, "<u4").tobytes()
        starts = np.cumsum([0, *(len(w) + 1 for w in words)])
        cuts = (4 * np.searchsorted(np.array([first for first, _ in found.offsets], np.int64), starts)).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _encode_plain(self, word: str) -> bytes:
        """Ids of a plain word from those of its pieces."""
        found = []
        for piece in _PIECE.findall(word.lower()):
            ids = self.pieces.get(piece)
            if ids is None:
                tokens = self.model.tokenize(piece if piece.isascii() else piece.translate(self.letters))
                ids = self.pieces[piece] = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
            found.append(ids)
        return b"".join(found)

    def _learn(self, words: list[str]) -> None:
        """Remember the ids of new words."""
        plain, odd = words, []
        if not (self.cuts_plainly and _PLAIN.fullmatch(" ".join(words))):
            parted: tuple[list[str], list[str]] = ([], [])
            for word in words:
                parted[not (self.cuts_plainly and _PLAIN.fullmatch(word))].append(word)
            plain, odd = parted
        self.known.update(zip(plain, map(self._encode_plain, plain), strict=True))
        for at in range(0, len(odd), RUN_WORDS):
            run = odd[at : at + RUN_WORDS]
            self.known.update(zip(run, self._encode_run(run), strict=True))

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """For each text its ids as little-endian 32-bit integers."""
        if len(self.known) > CACHE_WORDS:
            self.known = {"": b""}
        if len(self.pieces) > CACHE_PIECES:
            self.pieces = {}
        # Arrow parts texts at the same white space as ``common.words_of``; white space at an end gives an empty word, which has no ids.
        words = pc.ascii_split_whitespace(pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), ""))
        coded = words.flatten().dictionary_encode()
        distinct, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        found = list(map(self.known.get, distinct))
        new = [i for i, ids in enumerate(found) if ids is None]
        self._learn([distinct[i] for i in new])
        for i in new:
            found[i] = self.known[distinct[i]]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids, begins = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
        # The ids of all words in turn: each word's run of ids begins where its distinct word has them.
        counts = sizes[at]
        ends = np.cumsum(counts)
        flat = ids[np.repeat(begins[at] - (ends - counts), counts) + np.arange(counts.sum())]
        cuts = (4 * np.concatenate([[0], ends])[words.offsets.to_numpy()]).tolist()
        data = flat.tobytes()
        return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_packed(docs: DataFrame, tokenizer_path: str, target: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the shards of docs to ``target``: part (range), place (in the part), n_ids, shard."""
    from tokenizers import Tokenizer

    bits = bits_for(max(Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True), end_id + 1))
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    # Rows of one id keep the order in which they are read, which parts them without a look at their texts.
    order = ["id", "place"]
    ordered = narrow.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        names, lengths, held, size = [], [], [], 0

        def shard() -> pa.RecordBatch:
            data = write_shard(names, lengths, np.frombuffer(b"".join(held), "<u4"), bits)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([place], pa.int64()), pa.array([size], pa.int64()), pa.array([data], pa.binary())], names=["part", "place", "n_ids", "shard"])

        for batch in batches:
            for at in range(0, batch.num_rows, RUN_TEXTS):
                rows = batch.slice(at, RUN_TEXTS)
                for doc_id, ids in zip(rows.column(0).to_pylist(), encoder(tokenizer_path).encode(rows.column(1)), strict=True):
                    names.append(doc_id)
                    held.append(ids + end)
                    lengths.append(len(held[-1]) // 4)
                    size += lengths[-1]
                    if size >= SHARD_IDS:
                        yield shard()
                        names, lengths, held, size, place = [], [], [], 0, place + 1
        if names:
            yield shard()

    ordered.mapInArrow(run, "part int, place long, n_ids long, shard binary").write.parquet(target)


def read_packed(spark: SparkSession, target: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the shards at ``target``."""
    shards = spark.read.schema("part int, place long, n_ids long, shard binary").parquet(target)
    # Ids before a shard: those of earlier parts and of earlier shards of its part. One row a part, then one a shard.
    sizes = shards.select("part", "place", "n_ids")
    parts = common.running_totals(sizes.groupBy("part").agg(F.sum("n_ids").alias("ids")), [], ["part"], "ids", "before")
    inside = common.running_totals(sizes, ["part"], ["place"], "n_ids", "within")
    starts = common.written(inside.join(parts, "part").select("part", "place", (F.col("before") + F.col("within")).alias("shard_start")), "packed-starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, place, data in zip(*(batch.column(i) for i in range(3)), strict=True):
                shard = Shard(data.as_py())
                found = [(shard.document(i)) for i in range(len(shard.doc_ids))]
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part.as_py()] * n, pa.int32()),
                        pa.array([place.as_py()] * n, pa.int64()),
                        pa.array(shard.doc_ids, pa.int64(), mask=shard.known == 0),
                        pa.array(np.concatenate([[0], shard.ends[:-1]]).astype(np.int64)),
                        pa.array([len(x) for x in found], pa.int64()),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in found], pa.int64()),
                    ],
                    names=["part", "place", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    rows = shards.select("part", "place", "shard").mapInArrow(run, "part int, place long, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "place"]).select("doc_id", (F.col("shard_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op4_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of all documents, read the files back, and return what they hold."""
    target = common.new_path(spark, "packed-ids")
    write_packed(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), target)
    return read_packed(spark, target)
