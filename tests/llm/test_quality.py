import random
import zlib

import numpy as np
import pyarrow as pa

from factloom.llm import quality
from llm_texts import prose


def junk(r, kind, n):
    words = [f"w{r.randrange(400)}" for _ in range(n)]
    return {"shout": " ".join(w.upper() + "!!" for w in words), "marks": " ".join(w + r.choice(["***", "$$$", "%%%"]) for w in words), "bars": " | ".join(words), "again": " ".join([words[0]] * n)}[kind]


def corpus(seed, n):
    r = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        lines = [prose(seed * 1000 + i * 7 + j, r.randrange(5, 40)) for j in range(r.randrange(1, 5))]
        bad = r.random() < 0.25
        if bad:
            lines.insert(r.randrange(len(lines) + 1), junk(r, r.choice(["shout", "marks", "bars", "again"]), 60))
        texts.append("\n".join(lines))
        labels.append(0 if bad else 1)
    return texts, labels


def slow_marginals(field, x):
    """By summing over all labellings of one text."""
    n = len(x)
    unary = x @ field.emission
    good, total = np.zeros(n), 0.0
    for code in range(2**n):
        y = [code >> i & 1 for i in range(n)]
        score = sum(u for u, b in zip(unary, y, strict=True) if b) + sum(field.transition[a, b] for a, b in zip(y, y[1:], strict=False))
        weight = np.exp(score)
        total += weight
        good += weight * np.array(y)
    return good / total


def test_marginals_equal_all_labellings():
    r = np.random.default_rng(1)
    field = quality.Field(r.normal(size=4), r.normal(size=(2, 2)))
    rows = np.repeat([0, 1, 2, 3], [1, 5, 3, 8])
    x = r.normal(size=(len(rows), 4))
    got, pairs = field.marginals(x, rows)
    for row in range(4):
        assert np.allclose(got[rows == row], slow_marginals(field, x[rows == row]))
    assert np.isclose(pairs.sum(), 4 + 2 + 7)


def test_lines_of_texts(odd_texts):
    texts = ["a\n\nB B B\n", "", "\n", None, "x | y | z", *odd_texts]
    x, sizes, rows = quality.line_features(pa.array(texts, pa.string()))
    assert x.shape[1] == quality.COLUMNS and np.isfinite(x).all()
    want = [(i, len(line.encode())) for i, t in enumerate(texts) for line in (t or "").split("\n")]
    assert list(zip(rows.tolist(), sizes.tolist(), strict=True)) == want
    alone = [quality.line_features(pa.array([t], pa.string()))[0] for t in texts]
    assert np.allclose(x, np.concatenate(alone))


def test_held_out_accuracy(spark, documents):
    texts, labels = corpus(1, 900)
    table = spark.createDataFrame([(i, q, 0) for i, q in enumerate(labels) if i % 3], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality(documents(texts), table).collect()}
    assert len(got) == len(texts)
    right = []
    for i, q in enumerate(labels):
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.held_out:
            right.append(r.predicted == q)
    assert np.mean(right) > 0.95


def test_held_out_labels_teach_nothing(spark, documents):
    texts, labels = corpus(2, 200)
    known = [(i, q) for i, q in enumerate(labels)]
    wrong = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in known]
    scores = []
    for rows in (known, wrong):
        table = spark.createDataFrame([(i, q, 0) for i, q in rows], "doc_id long, quality int, toxic int")
        scores.append(sorted((r.doc_id, round(r.score, 12)) for r in quality.quality(documents(texts), table).collect()))
    assert scores[0] == scores[1]


def test_odd_tables(spark, documents, odd_texts):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.quality(documents(odd_texts).withColumnRenamed("lang", "score"), empty).collect()
    assert [r.score for r in rows] == [0.5] * len(odd_texts)
    odd = spark.createDataFrame([(None, 1, 0), (1, None, 0), (3, 1, 0), (3, 0, 0), (4, 1, 1)], empty.schema)
    assert all(0 <= r.score <= 1 for r in quality.quality(documents(odd_texts), odd).collect())
    assert quality.quality(documents([]), empty).count() == 0
