import random

import numpy as np

from factloom.llm import common


def test_word_hashes_are_of_the_bytes_alone():
    r = random.Random(3)
    words = ["".join(r.choice("ab") for _ in range(r.choice([1, 2, 7, 8, 9, 15, 16, 17, 24, 31, 32, 33, 70]))) for _ in range(4000)]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = common.words_of(data, np.array([0, len(data)]))
    for which in (0, 1):
        found = common.word_hashes(data, starts, ends, which).tolist()
        by_word, by_hash = {}, {}
        for w, h in zip(words, found, strict=True):
            assert by_word.setdefault(w, h) == h and by_hash.setdefault(h, w) == w
    assert common.word_hashes(data[:0], starts[:0], ends[:0]).tolist() == []


def test_a_join_spreads_a_hot_key_and_loses_no_row(spark, tmp_path):
    rows = [("hot", i) for i in range(400)] + [(f"k{i % 30}", i) for i in range(60)] + [(None, 1), (None, 2), ("alone", 3)]
    spark.createDataFrame(rows, "key string, n int").repartition(3).write.parquet(f"{tmp_path}/big")
    big = spark.read.parquet(f"{tmp_path}/big")
    small = spark.createDataFrame([("hot", "h1"), ("hot", "h2"), ("k1", "x"), (None, "null"), ("unused", "u")], "key string, value string")
    of = {"hot": ["h1", "h2"], "k1": ["x"]}
    inner = sorted((k, n, v) for k, n in rows if k in of for v in of[k])
    got = common.spread_join(big, small, ["key"], "inner")
    assert got.columns == ["key", "n", "value"]
    assert sorted(map(tuple, got.collect())) == inner
    left = common.spread_join(big, small, ["key"]).collect()
    assert len(left) == len(inner) + sum(k not in of for k, _ in rows)
    assert sorted((r.key, r.n, r.value) for r in left if r.value) == inner
    assert common.spread_join(big.where("false"), small, ["key"], "inner").count() == 0
