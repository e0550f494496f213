import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, source string"
NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def table(spark, rows):
    return spark.createDataFrame([(i, v and [x if x is None else float(x) for x in v], y, "x") for i, v, y in rows], SCHEMA).repartition(3)


def brute(rows, every):
    fine = []
    for i, v, y in rows:
        if i is None or y is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [math.floor(256 * float(np.float32(x))) for x in v]
        fine.append((i, (y + 1) % 10 if i % 7 == 0 else y, whole))
    out = []
    asking = {(i, y, tuple(v)) for i, y, v in fine if i % every == 0}
    for a, label, q in asking:
        scored = [(-sum(x * y for x, y in zip(v, q, strict=True)), i, y) for i, y, v in fine if len(v) == len(q) and i != a]
        for p, pid, _ in sorted(x for x in scored if x[2] == label)[:5]:
            fit = sorted(x for x in scored if x[2] != label and 80 * -p <= 100 * -x[0] <= 100 * -p)
            out += [(a, pid, k, i, -p, -s) for k, (s, i, _) in enumerate(fit[:5], 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select(*NAMES).collect())


@pytest.fixture()
def small_buckets(monkeypatch):
    monkeypatch.setattr(negatives, "LEAST_ROWS", 100)
    monkeypatch.setattr(negatives, "BUCKET_ROWS", 32)
    monkeypatch.setattr(negatives, "SAMPLE_ROWS", 40)
    monkeypatch.setattr(negatives, "SENT_ROWS", 7)


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_all_rows_against_brute_force(spark, small_buckets, spread):
    r = np.random.default_rng(4)
    centres = r.normal(size=(12, 8))
    v = centres[r.integers(0, 12, 900)] + 0.3 * r.normal(size=(900, 8))
    v = v / np.linalg.norm(v, axis=1, keepdims=True) * np.exp(spread * r.normal(size=(900, 1)))
    rows = [(i, x.tolist(), int(r.integers(0, 10))) for i, x in enumerate(v)]
    want = brute(rows, 10)
    assert len(want) > 500
    assert found(negatives.hard_negatives(table(spark, rows), F.col("vec_id") % 10 == 0)) == want


def test_one_vector_that_is_everywhere_and_ties(spark, small_buckets):
    r = np.random.default_rng(5)
    v = r.normal(size=(600, 4)).round(1)
    v[r.random(600) < 0.4] = v[0]
    rows = [(i, x.tolist(), int(r.integers(0, 3))) for i, x in enumerate(v)]
    assert found(negatives.hard_negatives(table(spark, rows), F.col("vec_id") % 20 == 0)) == brute(rows, 20)


def test_rows_that_take_no_part_and_repeated_rows(spark, small_buckets):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1, 0.5], 3), (1, None, 3), (2, [nan, 1], 3), (3, [inf, 1], 3), (4, [None, 1], 3), (5, [1, 1], None), (None, [1, 1], 3), (6, [0, 0], 4), (7, [1, 0.25], 2), (8, [1, 0], 4), (9, [0.9, 0], 4)]
    rows += [(8, [1, 0], 4), (10, [1, 1, 1], 3), (11, [1, 1, 1], 4), (12, [], 3), (13, [], 5), (14, [], 2), (20, [-1, 0], 3), (0, [1, 0.5], 3), (30, [0, 0], 4)]
    assert found(negatives.hard_negatives(table(spark, rows), F.col("vec_id") % 1 == 0)) == brute(rows, 1)


def test_scores_beyond_53_bits(spark, small_buckets):
    r = np.random.default_rng(8)
    for scale in (1e5, 1e6, 3e5):
        rows = [(i, (scale * r.normal(size=3)).tolist(), i % 3) for i in range(60)]
        assert found(negatives.hard_negatives(table(spark, rows), F.col("vec_id") % 5 == 0)) == brute(rows, 5)
    big = [(i, (1e30 * r.normal(size=3)).tolist(), i % 3) for i in range(60)]
    assert all(-(1 << 63) <= x[4] <= (1 << 63) - 1 for x in found(negatives.hard_negatives(table(spark, big), F.col("vec_id") % 5 == 0)))


def test_few_or_no_rows(spark):
    for rows in ([], [(0, None, 1)], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 2)]):
        assert negatives.hard_negatives(table(spark, rows), F.col("vec_id") % 100 == 0).count() == 0


def test_ranges_prune_and_lose_nothing():
    r = np.random.default_rng(1)
    v = np.floor(256 * r.normal(size=(500, 6)))
    bucket = negatives.Bucket(np.arange(500), np.zeros(500, np.int64), v)
    pruned = 0
    for q in v[::10]:
        length = float(np.linalg.norm(q))
        scores = v @ q
        for least in np.quantile(scores, [0.6, 0.9, 0.99, 1]).astype(int).tolist():
            rows = bucket.candidates(q / length, length, np.argsort(-np.abs(q))[:4], least)
            rows = np.arange(500) if rows is None else rows
            assert set(np.flatnonzero(scores >= least).tolist()) <= set(rows.tolist())
            pruned += 500 - len(rows)
    assert pruned > 0.3 * 50 * 4 * 500
