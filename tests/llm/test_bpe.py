import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tidemark.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    return bpe.Bpe(open(PATH, "rb").read()), Tokenizer.from_file(PATH)


def same(both, text):
    own, theirs = both
    ids = own.encode_batch([text])[0]
    want = theirs.encode(text or "", add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == want, text
    assert own.decode(ids).decode() == theirs.decode(want, skip_special_tokens=False)


CASES = ["", "  ", "Hello, world's it'll I'd 've", "aaaaaaaaa aaaa aaa aa", "<|endoftext|>x<|startoftext|> <|endoftext|", "ΣΟΣ İstanbul", "é K ﬁ \x1c\x1d a\x85b\xa0c d", "你好\U0001f600 12²3", "x" * 5000, "!!??..,,", "''s 'S 'LL"]


@pytest.mark.parametrize("text", CASES)
def test_equals_the_library(both, text):
    same(both, text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(both, text):
    same(both, text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["an", "the", "Tion", "é", " ", "\n", "'s", "!", "12", "aa", "ß", "<|endoftext|>"]), max_size=40).map("".join))
def test_joined_pieces(both, text):
    same(both, text)


def test_query_columns(spark):
    rows = [(1, "Hello world"), (2, None), (2, ""), (None, "Hello world"), (5, "long " * 50_000)]
    got = bpe.digests(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as n_tokens"), PATH).collect()
    lib = Tokenizer.from_file(PATH)
    assert len(got) == len(rows)
    for r in got:
        text = next(t or "" for i, t in rows if i == r.doc_id)
        ids = lib.encode(text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_encode_and_decode_keep_columns(spark):
    docs = spark.createDataFrame([(1, "One two", "x"), (2, None, None)], "doc_id long, text string, decoded string")
    out = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert {r.doc_id: r.decoded for r in out.collect()} == {1: "one</w> two</w>", 2: ""}
