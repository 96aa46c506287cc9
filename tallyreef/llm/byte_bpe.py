"""Byte-level BPE encoding and decoding by monoid tree reduction.

A piece (one match of the split pattern) is halved until leaves are short; leaves
are merged plainly, and two neighbouring encodings are joined by re-encoding a
window around their boundary. Leaves and windows of all pieces of a batch are merged
together, level by level. The window grows until its first token equals the
token the left side had there and its last token the one the right side had.
Then every adjacent pair of the joined sequence occurs in a correct encoding, and
a sequence whose adjacent pairs are all correct is the encoding of its bytes, so
nothing outside the window can change. Where a few bytes repeat, windows never
stabilise; such runs differ in length and phase alone, so each is encoded once.
Decoding concatenates up the same tree.

Defined cases: a null text counts as empty; an empty text has no ids, the digest
of the empty string, and zero tokens; rows are handled one by one, so repeated
rows and null ids pass through; a very long text is encoded whole, and so is a piece of
any length; pairs of equal rank merge from the left; an empty table gives no rows; other
columns are ignored, but for those that are asked for.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tallyreef.llm import common

#: Bytes of a leaf of the encoding tree, pieces from which leaves are longer, and the bytes of those.
LEAF_BYTES, LONG_PIECE, LONG_LEAF_BYTES = 12, 64, 32
#: Longest period of repeating bytes that is looked for.
PERIOD = 12
#: Ids that one leaf of the decoding tree holds.
LEAF_IDS = 4096
#: Distinct pieces that a Python worker remembers; beyond that it starts anew with the next batch.
CACHE_PIECES = 200_000
NO_RANK = 1 << 40


class TreeBpe:
    """Encoder and decoder for one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN, leaf_bytes: int = LEAF_BYTES):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.leaf_bytes = max(2, leaf_bytes)
        self.pieces: dict[str, tuple[int, ...]] = {}
        # Every way to put two tokens together to a third, as left * base + right.
        self.base = max(self.bytes_of) + 1
        pairs = sorted((ranks[t[:i]] * self.base + ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks)
        self.pair_keys, self.pair_ranks = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.array([-1]), np.array([0]))
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)

    @classmethod
    def from_file(cls, path: str, **options) -> TreeBpe:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, **options)

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Merging of one byte string, lowest rank first and leftmost among equals."""
        ranks, n = self.ranks, len(data)
        part: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, data[i : i + 2]) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if part[i] is None or j < 0 or part[i] + part[j] != pair:
                continue
            part[i], part[j] = pair, None
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (r := ranks.get(pair + part[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, pair + part[after[i]]))
            if (p := before[i]) >= 0 and (r := ranks.get(part[p] + pair)) is not None:
                heapq.heappush(heap, (r, p, part[p] + pair))
        return tuple([ranks[p] for p in part if p is not None])

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of two tokens put together; NO_RANK if that is no token."""
        keys = left * self.base + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NO_RANK)

    def merge_leaves(self, leaves: list[bytes]) -> dict[bytes, tuple[int, ...]]:
        """Merging of many short byte strings at once: strings of one length take one step each a round."""
        out: dict[bytes, tuple[int, ...]] = {}
        by_length: dict[int, list[bytes]] = {}
        for leaf in leaves:
            by_length.setdefault(len(leaf), []).append(leaf)
        for length, group in by_length.items():
            ids = self.of_byte[np.frombuffer(b"".join(group), np.uint8).reshape(len(group), length)]
            names = np.arange(len(group))
            ranks = self._pair(ids[:, :-1], ids[:, 1:])
            while True:
                best = ranks.min(1) if ranks.shape[1] else np.full(len(ids), NO_RANK)
                if len(done := np.flatnonzero(best == NO_RANK)):
                    out.update(zip([group[i] for i in names[done].tolist()], map(tuple, ids[done].tolist()), strict=True))
                    rest = np.flatnonzero(best != NO_RANK)
                    ids, names, ranks, best = ids[rest], names[rest], ranks[rest], best[rest]
                if not len(ids):
                    break
                n, width = ids.shape
                row, at = np.arange(n), ranks.argmin(1)
                ids[row, at] = best
                stay = np.ones((n, width), bool)
                stay[row, at + 1] = False
                ids = ids[stay].reshape(n, width - 1)
                stay = np.ones((n, width - 1), bool)
                stay[row, at] = False
                ranks = ranks[stay].reshape(n, width - 2)
                some = np.flatnonzero(at < width - 2)
                ranks[some, at[some]] = self._pair(best[some], ids[some, at[some] + 1])
                some = np.flatnonzero(at > 0)
                ranks[some, at[some] - 1] = self._pair(ids[some, at[some] - 1], best[some])
        return out

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """Encoding of the concatenation of two encoded byte strings."""
        if not left or not right:
            return left or right
        width = 2
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            window = self.merge(self.decode(left[a:] + right[:b]))
            if (a == 0 or window[0] == left[a]) and (b == len(right) or window[-1] == right[b - 1]):
                return left[:a] + window + right[b:]
            width *= 2

    def join_many(self, pairs: list[tuple[tuple[int, ...], tuple[int, ...]]]) -> list[tuple[int, ...]]:
        """``join`` of many pairs: windows of one width are merged together."""
        out: list[tuple[int, ...]] = [left or right for left, right in pairs]
        width, open_ = 2, [i for i, (left, right) in enumerate(pairs) if left and right]
        while open_:
            cuts = [(max(0, len(pairs[i][0]) - width), min(len(pairs[i][1]), width)) for i in open_]
            windows = [self.decode(pairs[i][0][a:] + pairs[i][1][:b]) for i, (a, b) in zip(open_, cuts, strict=True)]
            merged = self.merge_leaves(list(set(windows)))
            left_open = []
            for i, (a, b), data in zip(open_, cuts, windows, strict=True):
                left, right = pairs[i]
                window = merged[data]
                if (a == 0 or window[0] == left[a]) and (b == len(right) or window[-1] == right[b - 1]):
                    out[i] = left[:a] + window + right[b:]
                else:
                    left_open.append(i)
            width, open_ = 2 * width, left_open
        return out

    def _leaves(self, data: bytes, most: int) -> list[bytes]:
        if len(data) <= most:
            return [data]
        middle = len(data) // 2
        return self._leaves(data[:middle], most) + self._leaves(data[middle:], most)

    def _reduce_many(self, nodes: dict[str, list[tuple[int, ...]]]) -> dict[str, tuple[int, ...]]:
        """Encodings of pieces from those of their leaves: neighbours are joined, level by level, in all trees at once."""
        out: dict[str, tuple[int, ...]] = {}
        while nodes:
            out.update((piece, parts[0]) for piece, parts in nodes.items() if len(parts) == 1)
            nodes = {piece: parts for piece, parts in nodes.items() if len(parts) > 1}
            joined = iter(self.join_many([(parts[i], parts[i + 1]) for parts in nodes.values() for i in range(0, len(parts) - 1, 2)]))
            nodes = {piece: [next(joined) for _ in range(len(parts) // 2)] + parts[len(parts) - len(parts) % 2 :] for piece, parts in nodes.items()}
        return out

    def _reduce(self, data: bytes, known: dict[bytes, tuple[int, ...]], runs: dict[tuple[bytes, int], tuple[int, ...]]) -> tuple[int, ...]:
        if len(data) <= LONG_LEAF_BYTES:
            return known[data]
        run = next(((data[:p], len(data)) for p in range(1, PERIOD + 1) if data[p : 2 * p] == data[:p] and data[p:] == data[:-p]), None)
        if run in runs:
            return runs[run]
        middle = len(data) // 2
        ids = self.join(self._reduce(data[:middle], known, runs), self._reduce(data[middle:], known, runs))
        if run is not None:
            runs[run] = ids
        return ids

    def encode_pieces(self, pieces: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Ids of each piece; the leaves of all their trees are merged together."""
        out, short, long = {}, {}, {}
        for piece in pieces:
            data = common.utf8(piece)
            if (whole := self.ranks.get(data)) is not None:
                out[piece] = (whole,)
            elif len(data) < LONG_PIECE:
                short[piece] = self._leaves(data, self.leaf_bytes)
            else:
                long[piece] = data
        leaves = {leaf for cut in short.values() for leaf in cut} | {leaf for data in long.values() for leaf in self._leaves(data, LONG_LEAF_BYTES)}
        known = self.merge_leaves(list(leaves))
        out |= self._reduce_many({piece: [known[leaf] for leaf in cut] for piece, cut in short.items()})
        return out | {piece: self._reduce(data, known, {}) for piece, data in long.items()}

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; each match of the pattern is encoded by itself."""
        return self.encode_batch([text])[0]

    def encode_batch(self, texts: Iterable[str | None]) -> list[list[int]]:
        pieces = [self.find(t) if t else [] for t in texts]
        if len(self.pieces) > CACHE_PIECES:
            self.pieces = {}
        new = set(chain.from_iterable(pieces)).difference(self.pieces)
        known = self.pieces
        known.update(self.encode_pieces(new))
        out = [list(chain.from_iterable(map(known.__getitem__, p))) for p in pieces]
        for piece in new:
            if len(piece) > 64:
                del known[piece]
        return out

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids: leaves of the tree are concatenated, then their parents."""
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


_coders: dict[str, TreeBpe] = {}


def coder(path: str) -> TreeBpe:
    """One coder for each rank file and Python worker."""
    if path not in _coders:
        _coders[path] = TreeBpe.from_file(path)
    return _coders[path]


def encode_documents(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", keep: Iterable[str] = (), decoded: bool = False) -> DataFrame:
    """id, the columns of ``keep``, ids array<int>, n_tokens long; if ``decoded``, also the digest of the bytes decoded from the ids."""
    kept = [docs.schema[id_col], *(docs.schema[c] for c in keep)]
    narrow = docs.select(id_col, *keep, docs[text_col].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks_path)
        for batch in batches:
            for part in _slices(batch):
                ids = bpe.encode_batch(part.column("__text").to_pylist())
                columns = [part.column(i) for i in range(part.num_columns - 1)]
                columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(list(map(len, ids)), pa.int64())]
                if decoded:
                    columns.append(pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names[:-1], *added])

    added = ["ids", "n_tokens", *(["decoded_sha256"] if decoded else [])]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return narrow.mapInArrow(run, f"{fields}, ids array<int>, n_tokens long" + (", decoded_sha256 string" if decoded else ""))


def decode_documents(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, decoded binary of an array of ids."""
    narrow = encoded.select(id_col, encoded[ids_col].alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks_path)
        for batch in batches:
            data = [bpe.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=[id_col, "decoded"])

    return narrow.mapInArrow(run, f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, decoded binary")


def round_trip_digests(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, digest of the ids and digest of the bytes decoded from them; each task encodes and decodes in turn."""
    narrow = docs.select(id_col, docs[text_col].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks_path)
        decimal = {i: str(i) for i in bpe.bytes_of}
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for part in _slices(batch):
                for ids in bpe.encode_batch(part.column(1).to_pylist()):
                    counts.append(len(ids))
                    of_ids.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                    of_bytes.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return narrow.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents by the public 50k ranks, decode the ids, and return counts and digests."""
    docs = common.table(spark, sf_dir, "documents")
    return round_trip_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
