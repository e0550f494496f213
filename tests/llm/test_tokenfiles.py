import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm_texts import prose
from pyspark.sql import functions as F

from factloom.llm import tokenfiles


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenfiles.vocabulary_path())


def test_word_by_word_equals_library(library):
    r = random.Random(1)
    bits = ["the", " ", "  ", "\n", "\t", "\x0b", " ", "don't", "'s", "'", "É", "é", "́", "中文", "12", "3a", "...", "!", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|end", "\U0001f600", "ABC", "x" * 30, "\x1c", "ﬁ", "İ"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(0, 30))) for _ in range(800)] + [None, "", " \n "]
    ids, at = tokenfiles.WordEncoder(tokenfiles.vocabulary_path()).encode(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_special_tokens_as_the_library_does():
    texts = ["hello <|endoftext|> world", "hello<|endoftext|>world", "<|startoftext|>", "<|startoftext|><|endoftext|>x"]
    ids, at = tokenfiles.WordEncoder(tokenfiles.vocabulary_path()).encode(pa.array(texts))
    found = [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]
    assert found[:3] == [[3306, 49407, 1002], [3306, 49407, 1002], [49406]] and found[3][:2] == [49406, 49407]


@pytest.mark.parametrize("plane_bits", [1, 8])
def test_blocks_round_trip(plane_bits):
    r = np.random.default_rng(2)
    for n in (1, 7, 8, 1000):
        for top in (2, 50_000, 1 << 32):
            ids = r.integers(0, top, n, dtype=np.uint32)
            sizes, data = tokenfiles.packed_block(ids, plane_bits)
            assert len(sizes) == 32 // plane_bits and sum(sizes) == len(data)
            assert (tokenfiles.unpacked_block(sizes, data, n, plane_bits) == ids).all()


def test_joined_crc():
    a, b = b"some bytes", bytes(range(256)) * 9
    assert tokenfiles.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert tokenfiles.joined_crc(zlib.crc32(a), zlib.crc32(b""), 0) == zlib.crc32(a)


@pytest.mark.parametrize(("block_ids", "plane_bits"), [(50, 1), (4096, 8), (1 << 16, 1)])
def test_files_hold_every_document(spark, documents, odd_texts, tmp_path, library, block_ids, plane_bits):
    texts = [*odd_texts, *(prose(i, 10 + i, 300) for i in range(60))]
    docs = documents(texts, first=100).repartition(3).withColumnRenamed("lang", "shard")
    path = f"file://{tmp_path}/tokens"
    tokenfiles.write(docs, path, block_ids=block_ids, plane_bits=plane_bits)
    got = {r.doc_id: r for r in tokenfiles.read_back(spark, path).collect()}
    index = {r.doc_id: r for r in tokenfiles.index_of(spark, path).collect()}
    start = 0
    for i, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        row = got[100 + i]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert (index[100 + i].start, index[100 + i].n_ids) == (start, len(ids))
        start += len(ids)
    assert len(got) == len(index) == len(texts)


def test_ties_and_empty_table(spark, documents, tmp_path):
    docs = documents(["b", "a", "b"]).withColumn("doc_id", F.lit(7).cast("long"))
    tokenfiles.write(docs, f"file://{tmp_path}/ties")
    assert sorted(r.start for r in tokenfiles.read_back(spark, f"file://{tmp_path}/ties").collect()) == [0, 2, 4]
    tokenfiles.write(documents([]), f"file://{tmp_path}/none")
    assert tokenfiles.read_back(spark, f"file://{tmp_path}/none").count() == 0
