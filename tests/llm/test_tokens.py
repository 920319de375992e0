import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.conftest import SF, by_id
from tidemill.llm import bpe_codec, byte_bpe, packing, token_count
from tidemill.llm.common import documents

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
BYTE_LIB, WORD_LIB = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)

SPECIAL = ["<|endoftext|>", "<|startoftext|>", " ", "  ", "\n", "\t", "\x1c", "\x1f", "\x85", "\xa0", "\u3000", "\u200b", "'s", "'RE", "é", "É", "ß", "²", "Ⅷ", "1", "23", "a", "aaa", "the", "ing", "!", "!!", "😀", "中", "\u0301", "İ", "Σ", "\x00", "\ufffd", "\U0001e4d0", "\u088f"]
texts = st.one_of(st.text(max_size=60), st.lists(st.sampled_from(SPECIAL), max_size=30).map("".join), st.text("ab", max_size=60), st.text("aehinorst ", max_size=80))


@settings(max_examples=400, deadline=None)
@given(texts)
def test_counts_and_ids_are_the_library_s(text):
    text = text.encode("utf-8", "replace").decode()
    want = BYTE_LIB.encode(text, add_special_tokens=False).ids
    assert token_count.count_texts([text], BYTES)[0] == len(want)
    ids = bpe_codec.encode_texts([text], BYTES)[0]
    assert ids.tolist() == want
    assert bpe_codec.decode_ids(ids, BYTES) == BYTE_LIB.decode(want, skip_special_tokens=False) == text


@settings(max_examples=300, deadline=None)
@given(texts)
def test_packing_ids_are_the_library_s(text):
    text = text.encode("utf-8", "replace").decode()
    assert packing.token_ids([text], WORDS)[0].tolist() == [*WORD_LIB.encode(text, add_special_tokens=False).ids, 2]


def test_long_texts_are_cut_without_effect(monkeypatch):
    text = " ".join(["word and 'quotes' 12", "x" * 300, "été  \n", "end."] * 400)
    for name, lib in (("ids", BYTE_LIB), ("words", WORD_LIB)):
        want = lib.encode(text, add_special_tokens=False).ids
        for module in (token_count, bpe_codec, packing):
            monkeypatch.setattr(module, "slices", lambda t: byte_bpe.slices(t, 500))
        if name == "ids":
            assert bpe_codec.encode_texts([text], BYTES)[0].tolist() == want
            assert token_count.count_texts([text], BYTES)[0] == len(want)
        else:
            assert packing.token_ids([text], WORDS)[0].tolist() == [*want, 2]


def test_one_very_long_word():
    word = "ab" * 20_000
    assert token_count.count_texts([word], BYTES)[0] == len(BYTE_LIB.encode(word, add_special_tokens=False).ids)


def test_a_full_table_starts_anew(monkeypatch):
    table = token_count._table(BYTES)
    monkeypatch.setattr(table, "capacity", 3)
    many = [f"word{k} other{k}" for k in range(50)]
    assert token_count.count_texts(many, BYTES).tolist() == [len(BYTE_LIB.encode(t, add_special_tokens=False).ids) for t in many]


def test_every_token_encodes_to_itself():
    encoder = bpe_codec._encoder(BYTES)[0]
    assert all(encoder.is_own(i) for i in range(50_256))


ROWS = [(1, None), (2, ""), (3, "two words"), (3, "two words"), (None, "no id"), (4, "<|endoftext|> é " + "x" * 5000)]


def test_token_counts_of_odd_rows(docs):
    out = sorted(map(tuple, token_count.token_counts(docs(ROWS), BYTES, limit=1).collect()), key=repr)
    lib = lambda t: len(BYTE_LIB.encode(t or "", add_special_tokens=False).ids)
    assert out == sorted([(i, len((t or "").encode()), lib(t), lib(t) > 1) for i, t in ROWS], key=repr)
    assert token_count.token_counts(docs([]), BYTES).count() == 0


def test_roundtrip_of_odd_rows(docs):
    found = sorted(map(tuple, bpe_codec.bpe_roundtrip(docs(ROWS), BYTES).collect()), key=repr)
    want = []
    for i, t in ROWS:
        ids = BYTE_LIB.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert found == sorted(want, key=repr)
    ids = by_id(bpe_codec.encode_documents(docs(ROWS[2:3]), BYTES))[3]["ids"]
    assert ids == BYTE_LIB.encode("two words", add_special_tokens=False).ids


def test_queries_on_whole_tables(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in documents(spark, SF).collect()}
    counts, codec = by_id(token_count.op1_token_counts(spark, SF)), by_id(bpe_codec.op2_bpe_roundtrip(spark, SF))
    assert set(counts) == set(codec) == set(texts)
    for i, t in texts.items():
        ids = BYTE_LIB.encode(t, add_special_tokens=False).ids
        assert tuple(counts[i])[1:] == (len(t.encode()), len(ids), len(ids) > 1024)
        assert codec[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert codec[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("n", [1, 2, 3, 4095, 4096, 4097, 9000, 8192])
def test_piece_lengths(n):
    found = packing.piece_lengths(n)
    assert sum(found) == n and all(x & (x - 1) == 0 and x <= 4096 for x in found)
    assert len(found) == n // 4096 + (n % 4096).bit_count()


def test_packing_of_odd_rows_and_whole_table(spark, docs):
    with pytest.raises(ValueError, match="power of two"):
        packing.pack_documents(docs(ROWS), WORDS, cap=100)
    assert packing.pack_documents(docs([]), WORDS).count() == 0
    odd = packing.pack_documents(docs(ROWS), WORDS, cap=64).collect()
    assert sorted(r["doc_tokens"] for r in odd if r["doc_id"] in (1, 2)) == [1, 1] and len([r for r in odd if r["doc_id"] is None]) > 0
    pieces: dict = {}
    for r in packing.pack_documents(documents(spark, SF), WORDS).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    assert len({p["sequence_id"] for x in pieces.values() for p in x}) == sum(map(len, pieces.values()))
    for r in documents(spark, SF).collect():
        want, at = np.array([*WORD_LIB.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for p in sorted(pieces[r["doc_id"]], key=lambda p: p["start"]):
            part = want[at : at + p["length"]]
            assert (p["start"], p["offset"], p["doc_tokens"], p["ids_crc32"], p["ids"]) == (at, 0, len(want), zlib.crc32(part.tobytes()), part.tolist())
            assert p["length"] == 1 << p["bucket"]
            at += p["length"]
        assert at == len(want)
