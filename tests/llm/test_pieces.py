"""Merge rounds against the sentencepiece library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm.pieces import Encoder, Pieces, encode_documents

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    return Pieces(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)


def same(both, texts):
    pieces, library = both
    flat, counts, said = Encoder(pieces).encode(texts)
    want = [library.encode(t) for t in texts]
    assert said == [" ".join(map(str, w)) for w in want]
    assert flat.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]
    assert [d.decode() for d in pieces.decode(flat, counts)] == [library.decode(w) for w in want]


def test_hard_texts(both):
    same(both, ["", " ", "  a  b ", "\n\n", "a\tb\r\n", "▁x▁", "<s></s><unk><0x41>", "\x00", "😀🏽 é é", "梦的人" * 200, "a" * 5000, "ab" * 3000, "-" * 777 + "=" * 500, " " * 999, "the " * 999, "in" * 50 + "er" * 50])


def test_repetitive_alphabets(both):
    random.seed(7)
    same(both, ["".join(random.choice(a) for _ in range(300)) for a in ("ab", "the", "in", "aer", "0 1", "=-", "é的a ") for _ in range(40)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text(both, texts):
    same(both, texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31999)), max_size=12))
def test_decode_any_ids(both, ids):
    pieces, library = both
    got = pieces.decode(np.array(ids, np.int64), np.array([len(ids)]))[0].decode()
    if not {0, 1, 2} & set(ids):  # the library drops control ids and marks unknown ones in ways of its own
        assert got == library.decode(ids)


def test_bound_on_kept_words_changes_nothing(both):
    texts = [f"some words {i} and {i * 7}" for i in range(200)]
    small, large = Encoder(both[0], keep=5), Encoder(both[0])
    assert [small.encode([t])[2] for t in texts] == [large.encode([t])[2] for t in texts]


def test_query(spark, both):
    rows = [(1, "Hello  world\n"), (2, None), (3, ""), (3, ""), (None, "x" * 20000)]
    df = spark.createDataFrame([(i, t, 1, "q") for i, t in rows], "doc_id long, text string, n_tokens int, ids string")
    got = encode_documents(df, PATH, keep_ids=True, keep_text=True).collect()
    for (i, t), r in zip(sorted(rows, key=str), sorted(got, key=lambda r: str((r.doc_id, r.decoded or None)))):
        del i, t
        ids = both[1].encode(r.decoded) + [2]
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert sorted(r.decoded for r in got) == sorted(t or "" for _, t in rows)
    assert encode_documents(df.limit(0), PATH).count() == 0
