import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import bpe

RANKS = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
TRUE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
MERGES = bpe.Merges(RANKS)
ODD = ["", "a", "aaaaaaaaaaaaa", "Hello  world\n\n x", "été ñandú 漢字 🎉🎉", "it's we'll 'S", "\t\r\n \x0b\x1c\x1d\x85  z", "1234567 ½ ²", "<|endoftext|>", "ab" * 5000, " " * 999, "é​﻿"]


def encoded(texts):
    encoder = bpe.Encoder(MERGES, public_tokenizers.PATTERN)
    cut = [encoder.cut(t) for t in texts]
    encoder.learn()
    return [encoder.ids(c).tolist() for c in cut]


def test_odd_texts():
    assert encoded(ODD) == [TRUE.encode_ordinary(t) for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(), st.text("abcdeth 'sn\n"), st.text("ÀÉçß ü1 ")), max_size=5))
def test_any_text(texts):
    assert encoded(texts) == [TRUE.encode_ordinary(t) for t in texts]


def test_ranks_out_of_order():
    """Tokens whose parts rank above them: the order of single merges decides."""
    ranks = {bytes([b]): b for b in range(256)}
    for i, w in enumerate([b"abc", b"bca", b"ab", b"bc", b"ca", b"abca", b"aa", b"aaa", b"caa"]):
        ranks[w] = 256 + i
    true = tiktoken.Encoding("odd", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
    encoder = bpe.Encoder(bpe.Merges(ranks), r".+")
    import itertools

    texts = ["".join(t) for n in range(1, 8) for t in itertools.product("abc", repeat=n)]
    cut = [encoder.cut(t) for t in texts]
    encoder.learn()
    assert [encoder.ids(c).tolist() for c in cut] == [true.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("flush", [48 << 20, 10])
def test_operator(spark, monkeypatch, flush):
    monkeypatch.setattr(bpe, "FLUSH_BYTES", flush)
    monkeypatch.setattr(bpe, "FLUSH_PIECES", flush)
    rows = [(i, t, 5, b"x") for i, t in enumerate([*ODD, None, "same", "same"])] + [(None, "no id", 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids binary")
    out = bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, bpe.unpacked(r.ids), bytes(r.decoded)) for r in out.collect())
    want = sorted((-1 if i is None else i, len(TRUE.encode_ordinary(t or "")), TRUE.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in rows)
    assert got == want
    both = bpe.encode(df, RANKS, public_tokenizers.PATTERN, decoded=True)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, bpe.unpacked(r.ids), bytes(r.decoded)) for r in both.collect()) == want
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    assert bpe.encode(df.limit(0), RANKS, public_tokenizers.PATTERN).collect() == []


def test_query_digests(spark):
    from quarry.llm.queries import op2_bpe

    got = {r.doc_id: r for r in op2_bpe(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = TRUE.encode_ordinary(r.text or "")
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256) == (len(ids), hashlib.sha256(packed).hexdigest())
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
