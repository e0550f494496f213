import numpy as np
from pyspark.sql import functions as F

from factloom.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, vectors, first=0):
    rows = [(first + i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def brute(vectors, k, every=20):
    v = np.asarray(vectors, np.float32).astype(np.float64)
    out = {}
    for q in range(0, len(v), every):
        scores = (v * v[q]).sum(axis=1)
        out[q] = sorted(((-s, i) for i, s in enumerate(scores.tolist()) if i != q))[:k]
    return out


def recall(got, want, k):
    hits = sum(len({r.vec_id for r in got if r.query_id == q} & {i for _, i in best}) for q, best in want.items())
    return hits / sum(len(best) for best in want.values())


def checked(rows, vectors):
    v = np.asarray(vectors, np.float32).astype(np.float64)
    last = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        assert r.vec_id != r.query_id
        assert abs(r.score - float((v[r.query_id] * v[r.vec_id]).sum())) < 1e-9
        before = last.get(r.query_id, (0, -np.inf, -1))
        assert r["rank"] == before[0] + 1 and (-r.score, r.vec_id) > before[1:]
        last[r.query_id] = (r["rank"], -r.score, r.vec_id)


def test_recall_of_unit_and_other_vectors(spark, monkeypatch):
    r = np.random.default_rng(4)
    v = r.normal(size=(2500, 24))
    for vectors in (v / np.linalg.norm(v, axis=1, keepdims=True), v * r.uniform(0.2, 3, (2500, 1))):
        rows = neighbours.nearest(table(spark, vectors), F.col("vec_id") % 20 == 0).collect()
        checked(rows, vectors)
        assert len(rows) == 125 * 20
        assert recall(rows, brute(vectors, 20), 20) >= 0.95


def test_one_vector_that_is_everywhere(spark):
    r = np.random.default_rng(5)
    v = r.normal(size=(900, 8))
    v[r.random(900) < 0.4] = v[0]
    rows = neighbours.nearest(table(spark, v).repartition(5), F.col("vec_id") % 20 == 0).collect()
    checked(rows, v)
    want = brute(v, 20)
    hot = [q for q in want if (v[q] == v[0]).all()]
    for q in hot:
        assert [x.vec_id for x in sorted((x for x in rows if x.query_id == q), key=lambda x: x["rank"])] == [i for _, i in want[q]]
    assert recall(rows, want, 20) >= 0.95


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1, 0], None, [0, 0], [nan, 1], [inf, 1], [None, 1], [], [1, 2, 3], [0.5, 1], [0.0, -1], [-0.0, -1]]
    rows = neighbours.nearest(table(spark, vectors), F.col("vec_id") % 1 == 0, k=3).collect()
    assert {r.query_id for r in rows} == {r.vec_id for r in rows} == {0, 8, 9, 10}
    assert len(rows) == 4 * 3
    assert [(r.vec_id, r.score) for r in sorted((r for r in rows if r.query_id == 9), key=lambda r: r["rank"])] == [(10, 1.0), (0, 0.0), (8, -1.0)]


def test_few_or_no_rows(spark):
    assert neighbours.nearest(table(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert neighbours.nearest(table(spark, [None, [0.0, 0.0]]), F.col("vec_id") % 20 == 0).count() == 0
    assert neighbours.nearest(table(spark, [[1.0, 2.0]]), F.col("vec_id") % 20 == 0).count() == 0
    assert neighbours.nearest(table(spark, [[1.0, 2.0], [2.0, 1.0]]), F.col("vec_id") % 20 == 0).count() == 1
