import hashlib
import random

import numpy as np
import pytest

from factloom.llm import bpe


@pytest.fixture(scope="module")
def enc():
    return bpe.encoder(bpe.vocabulary_path())


def test_tree_equals_library_on_hard_seams(enc):
    r = random.Random(3)
    alphabet = ["a", "B", "é", "中", " ", "  ", "\n", "\t", "'", "'ll", "1", "23", ".", "!!", " ", "\x1c", " ", "\U0001f600", "the ", "don't "]
    for _ in range(1500):
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(0, 60)))
        assert bpe.encode_tree(text, enc.encode_ordinary, 4) == enc.encode_ordinary(text), repr(text)


def test_one_token_runs_longer_than_any_window(enc):
    for text in ("x" * 3000, " " * 3000, "ab" * 900 + " " + "1" * 900, "." * 2000):
        assert bpe.encode_tree(text, enc.encode_ordinary, 16) == enc.encode_ordinary(text)


def test_decoding_concatenates(enc):
    ids = np.asarray(enc.encode_ordinary("naïve 中文 text " * 50))
    assert bpe.decode_tree(ids, enc.decode_bytes, 3) == ("naïve 中文 text " * 50).encode()


def test_round_trip_rows(spark, documents, odd_texts, enc):
    docs = documents(odd_texts)
    got = {r.doc_id: r for r in bpe.round_trip(docs).collect()}
    assert len(got) == len(odd_texts)
    for i, text in enumerate(odd_texts):
        ids = enc.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_general_interface_and_empty_table(spark, documents, odd_texts):
    docs = documents(odd_texts).withColumnRenamed("doc_id", "key").withColumnRenamed("lang", "ids")
    back = bpe.decoded(bpe.encoded(docs, id_col="key"), id_col="key").collect()
    assert {r.key: r.text for r in back} == {i: t or "" for i, t in enumerate(odd_texts)}
    assert bpe.round_trip(documents([])).count() == 0
