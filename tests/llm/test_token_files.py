import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tidemark.llm import token_files as tf

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 32).flatmap(lambda b: st.tuples(st.just(b), st.lists(st.integers(0, 2**b - 1), max_size=70))))
def test_pack_round_trip(case):
    bits, ids = case
    data = tf.pack(np.array(ids, "<u4"), bits)
    assert len(data) == (len(ids) * bits + 7) // 8
    assert tf.unpack(data, bits, len(ids)).tolist() == ids


@pytest.mark.parametrize("bits", [11, 16])
def test_random_access(bits):
    rng = np.random.default_rng(1)
    docs = [(i, rng.integers(0, 2**bits, n).astype("<u4").tobytes()) for i, n in enumerate([3, 0, 100, 1, 57])]
    f = tf.TokenFile(tf.write_file(docs, bits, block=16))
    every = np.frombuffer(b"".join(x for _, x in docs), "<u4")
    for i in range(0, len(every), 7):
        for j in range(i, len(every) + 1, 13):
            assert f.ids(i, j).tolist() == every[i:j].tolist()
    assert [f.doc(k).tobytes() for k in range(5)] == [x for _, x in docs]


def test_width():
    assert [tf.width(n) for n in (1, 2, 3, 256, 257, 49408)] == [1, 1, 2, 8, 9, 16]


def test_id_beyond_the_vocabulary():
    with pytest.raises(ValueError):
        tf.write_file([(1, np.array([8], "<u4").tobytes())], 3)


def test_library_by_words():
    library = tf.Library(open(PATH, "rb").read())
    tokenizer = Tokenizer.from_file(PATH)
    texts = ["One two, one's 2x", None, "", "ΣΟΣ 你", "<|endoftext|> a", "b\x01c d", "naïve café\x85x\xa0y", "a\x1cb"]
    got = [np.frombuffer(x, "<u4").tolist() for x in library.encode_batch(texts)]
    assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_query(spark, monkeypatch):
    rows = [(5, "five words are in here"), (3, None), (None, "no id"), (9, ""), (5, "again five"), (-4, "long " * 3000), (7, "ok"), (6, "é ü")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as start", "'x' as data").repartition(3)
    got = tf.round_trip(docs, PATH).collect()
    tokenizer = Tokenizer.from_file(PATH)
    start = 0
    assert len(got) == len(rows)
    want = []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want
    assert tf.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_read_gives_the_ids(spark, tmp_path):
    docs = spark.createDataFrame([(2, "two"), (1, "one one")], "doc_id long, text string")
    tf.write(docs, f"{tmp_path}/files", PATH)
    ids = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in tf.read(spark, f"{tmp_path}/files").collect()}
    tokenizer = Tokenizer.from_file(PATH)
    assert ids == {k: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for k, t in ((1, "one one"), (2, "two"))}
