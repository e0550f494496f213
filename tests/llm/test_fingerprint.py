import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from factloom.llm import fingerprint
from llm_texts import prose

MASK = (1 << 64) - 1


def slow(text):
    """Lanes of a text, a window at a time, in Python's integers."""

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & MASK
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & MASK
        return x ^ x >> 31

    identity, counts = [0] * 8, [0] * 128
    for line in (text or "").encode().split(b"\n") if text else []:
        digest = hashlib.blake2b(line, digest_size=64).digest()
        for i in range(8):
            identity[i] = identity[i] + int.from_bytes(digest[8 * i : 8 * i + 8], "little") & MASK
        for i in range(len(line)):
            window = line[i : i + fingerprint.WINDOW_BYTES]
            h = mix(sum(b * pow(fingerprint.BASE, j, 1 << 64) for j, b in enumerate(window)) + len(window) & MASK)
            counts[h & 127] += -1 if h >> 32 & 1 else 1
    return identity, [c & 0xFFFFFFFF for c in counts]


def test_vectors_equal_the_definition():
    texts = ["", "a", "a\nb", "b\na", "\n", "a\n", "\n\nlonger lines of text é\n" * 3, None, prose(3, 200), "x" * 3000]
    identity, counts = fingerprint.vectors(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert (identity[i].tolist(), counts[i].tolist()) == slow(text), repr(text)
    shown = fingerprint.shown((identity, counts))
    assert shown[2] == shown[3] and len({*shown}) == len(texts) - 2
    back = fingerprint.parsed(shown)
    assert (back[0] == identity).all() and (back[1] == counts).all()


def test_insertion_and_deletion(spark):
    old, new = "one\ntwo\nthree", "zero\ntwo\none\none"
    v = fingerprint.shown(fingerprint.vectors(pa.array([old, new])))
    edits = spark.createDataFrame([(1, v[0], "zero\none", "three"), (2, v[1], None, None)], "k int, fingerprint string, inserted string, deleted string")
    got = {r.k: r.fingerprint for r in fingerprint.changed(edits).collect()}
    assert got == {1: v[1], 2: v[1]}


def edits_of(texts):
    n = len(texts)
    for i in range(n):
        text, after = texts[i], texts[(i - 1) % n]
        half = len(text) // 2
        yield i, text[: len(text) - half] + after[:half]


@pytest.mark.parametrize("parts", [1, 7])
def test_edited_texts(spark, documents, odd_texts, parts):
    texts = [*odd_texts, *(prose(i, 150) for i in range(40))]
    docs = documents(texts).repartition(parts)
    got = {r.doc_id: r for r in fingerprint.with_edits(docs).collect()}
    plain = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(docs).collect()}
    full = [t or "" for t in texts]
    assert len(got) == len(texts)
    edited = dict(edits_of(full))
    prints = fingerprint.shown(fingerprint.vectors(pa.array([edited[i] for i in range(len(full))])))
    better = 0
    for i, text in enumerate(full):
        r = got[i]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited[i].encode()).hexdigest(), i
        assert (r.fingerprint, r.edited_fingerprint) == (plain[i], prints[i])
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if edited[i] == text:
            assert r.near_edited == 1
        if i > len(odd_texts):  # neighbours of the odd texts are near copies of them
            better += r.near_edited > r.near_next
    assert better >= 38


def test_few_documents(spark, documents):
    one = fingerprint.with_edits(documents(["abcd"])).collect()
    assert [r.edited_sha256 for r in one] == [hashlib.sha256(b"abab").hexdigest()]
    assert fingerprint.with_edits(documents([])).count() == 0
    random.seed(1)
    two = fingerprint.with_edits(documents(["abcd", "xy"])).collect()
    assert {r.doc_id: r.edited_sha256 for r in two} == {0: hashlib.sha256(b"abxy").hexdigest(), 1: hashlib.sha256(b"xa").hexdigest()}
    assert np.isfinite([r.near_next for r in two]).all()


def test_long_repetitive_texts():
    pairs = [("a" * 65_543, "a" * 30_000), ("a" * 20_000, "a" * 27_000), ("ab\n" * 90_000, "ab\n" * 10)]
    for pair in pairs:
        v = fingerprint.vectors(pa.array(pair))
        assert fingerprint.likeness(*((v[0][i : i + 1], v[1][i : i + 1]) for i in (0, 1)))[0] > 0.99


def test_seams_by_blocks_of_ranges(spark, documents, monkeypatch):
    texts = [prose(i, 20) for i in range(60)]
    docs = documents(texts)
    want = sorted(map(tuple, fingerprint.with_edits(docs).collect()))
    monkeypatch.setattr(fingerprint, "SEAMS_AT_ONCE", 2)
    monkeypatch.setattr(fingerprint, "width", lambda _: 13)
    assert sorted(map(tuple, fingerprint.with_edits(docs).collect())) == want
    assert len(want) == 60
    assert sorted(r.edited_sha256 for r in fingerprint.with_edits(documents(texts[:3])).collect()) == sorted(hashlib.sha256(t.encode()).hexdigest() for _, t in edits_of(texts[:3]))
