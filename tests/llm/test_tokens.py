import hashlib
import time
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyreef.llm import byte_bpe, packed_ids
from tests.llm import plain

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_op5_equals_tiktoken(spark, sf, docs):
    other = plain.tiktoken_of(RANKS, public_tokenizers.PATTERN)
    found = {r.doc_id: r for r in byte_bpe.op5_byte_bpe(spark, sf).collect()}
    for r in docs.select("doc_id", "text").collect():
        ids = other.encode_ordinary(r.text or "")
        assert found[r.doc_id].n_tokens == len(ids)
        assert found[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert found[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.text(max_size=400), st.text("ab c", max_size=500), st.text("é你\U0001f600 \n'", max_size=200)))
def test_tree_equals_plain_merging(text):
    small = TREES.setdefault("small", byte_bpe.TreeBpe.from_file(RANKS, leaf_bytes=4))
    other = TREES.setdefault("other", plain.tiktoken_of(RANKS, public_tokenizers.PATTERN))
    ids = small.encode(text)
    assert ids == other.encode_ordinary(text) and small.decode(ids) == text.encode()


TREES = {}


def test_long_piece_without_breaks():
    other = plain.tiktoken_of(RANKS, public_tokenizers.PATTERN)
    for text in ("a" * 5000, "abcde" * 2000, "=" * 3001, "你好" * 900):
        assert byte_bpe.coder(RANKS).encode(text) == other.encode_ordinary(text)


def test_repeating_bytes_take_no_square():
    other = plain.tiktoken_of(RANKS, public_tokenizers.PATTERN)
    coder = byte_bpe.coder(RANKS)
    for unit in ("a", "=", "ab", "-=-", "哈", "qwertyuiopas"):
        text = unit * (30_001 // len(unit.encode())) + "b" + unit * 700
        assert coder.encode(text) == other.encode_ordinary(text)
        taken = []
        for n in (20_000, 160_000):
            began = time.perf_counter()
            coder.encode(unit * (n // len(unit.encode())))
            taken.append(time.perf_counter() - began)
        assert taken[1] < 40 * max(taken[0], 0.05)


def test_bpe_on_odd_rows(odd, nothing):
    coded = byte_bpe.encode_documents(odd, RANKS, keep=("source",))
    assert coded.count() == 14 and coded.filter("text is not null" if "text" in coded.columns else "size(ids) = n_tokens").count() == 14
    back = {(r.doc_id, bytes(r.decoded)) for r in byte_bpe.decode_documents(coded, RANKS).collect()}
    assert back == {(r.doc_id, (r.text or "").encode()) for r in odd.collect()}
    assert byte_bpe.round_trip_digests(nothing, RANKS).count() == 0


def test_op4_equals_tokenizers(spark, sf, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    found = {r.doc_id: r for r in packed_ids.op4_packed_ids(spark, sf).collect()}
    start = 0
    for r in sorted(docs.select("doc_id", "text").collect(), key=lambda r: r.doc_id):
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        x = found[r.doc_id]
        assert (x.start, x.n_tokens, x.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 32), st.data())
def test_packing_round_trip(bits, data):
    ids = np.array(data.draw(st.lists(st.integers(0, (1 << bits) - 1), max_size=3000)), np.uint32)
    packed = packed_ids.pack(ids, bits)
    assert len(packed) == -(-len(ids) * bits // 8) and packed_ids.unpack(packed, len(ids), bits).tolist() == ids.tolist()


def test_shard_random_access():
    ids = np.random.default_rng(3).integers(0, 49_152, 5000).astype(np.uint32)
    shard = packed_ids.Shard(packed_ids.write_shard([7, None, 9], [1, 4000, 999], ids, 17))
    assert shard.document(1).tolist() == ids[1:4001].tolist() and shard.ids(1023, 1025).tolist() == ids[1023:1025].tolist()
    assert shard.known.tolist() == [1, 0, 1] and shard.ids(5, 5).tolist() == []


def test_packed_on_odd_rows(spark, odd, nothing, tmp_path):
    packed_ids.write_packed(odd, WORDS, str(tmp_path / "odd"))
    rows = packed_ids.read_packed(spark, str(tmp_path / "odd")).orderBy("start").collect()
    assert len(rows) == 14 and [r.doc_id for r in rows][:2] == [None, None]
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows[:-1])]).tolist()
    assert next(r for r in rows if r.doc_id == 1).n_tokens == 1
    packed_ids.write_packed(nothing, WORDS, str(tmp_path / "none"))
    assert packed_ids.read_packed(spark, str(tmp_path / "none")).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|", "é", " ", "a'll", "\u0301", "x\xa0y"]), max_size=9).map("".join)), max_size=6))
def test_word_encoder_equals_whole_texts(texts):
    """Any text, with marks, blanks of all kinds and special tokens, in one batch, against the library as it comes."""
    from tokenizers import Tokenizer

    coder = packed_ids.encoder(WORDS)
    library = Tokenizer.from_file(WORDS)
    whole = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts)] == whole


def test_words_of_known_pieces_are_not_encoded_anew(monkeypatch):
    """Words that differ in case and signs share their pieces; whole words of them are not given to the tokenizer, and all ids are the library's."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    coder = packed_ids.WordEncoder(WORDS)
    words = [f"{stem}{end}" for stem in ("Größe", "ÉTAIT", "x<y", "don't", "1'll'S", "''S're", "O'Neill") for end in ("", ",", "$$$", "'S", "''d", "<", ">|", "42!")]
    text = " \t".join(words)
    with monkeypatch.context() as m:
        m.setattr(coder, "_encode_run", None)
        assert np.frombuffer(coder.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    for c in map(chr, range(0x21, 0x250)):
        text = f"a{c} {c}a '{c}S {c}{c}1"
        assert np.frombuffer(coder.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
