import random
import re
import zlib
from collections import Counter

import numpy as np

from factloom.llm import spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute(words, ratio=5):
    forms, out = {}, {}
    for w, n in words.items():
        found = [(-m, x) for x, m in words.items() if near(w, x)]
        best = min(found, default=None)
        form = best[1] if best and -best[0] >= ratio * n else None
        forms[w] = form
        out[w] = (n, len(found), form, words[form] if form else None)
    ends = {}
    for w in words:
        end = w
        while forms[end]:
            end = forms[end]
        ends[w] = end
    return {w: (*out[w], ends[w]) for w in words}


def found(df):
    rows = df.collect()
    out = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}
    assert len(out) == len(rows)
    return out


def table(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)


def test_words_of_few_letters_have_many_near_words(spark):
    r = random.Random(3)
    words = {"".join(r.choice("abc") for _ in range(r.randrange(4, 9))): r.choice([1, 5, 6, 30, 31, 160, 900]) for _ in range(700)}
    assert found(spelling.variants(table(spark, words))) == brute(words)


def test_repeated_bigrams_other_alphabets_and_long_words(spark):
    words = {"a" * i: 7**k for k, i in enumerate(range(4, 12))}
    words |= {"nanana": 5, "nananan": 40, "nanan": 3, "mananana": 250, "ninana": 5, "ananas": 200}
    words |= {"中文字典": 9, "中文字点": 60, "中文字": 1, "中文字典学": 9, "\U0001f600\U0001f601\U0001f602\U0001f603": 5, "\U0001f600\U0001f601\U0001f604\U0001f603": 25}
    words = {w: n for w, n in words.items() if len(w) >= 4}
    long = "".join(random.Random(1).choice("xyz") for _ in range(20_000))
    words |= {long: 6, long[:9_000] + "q" + long[9_000:]: 31, "a" * 3_000: 2, "a" * 3_001: 11, "b" + "a" * 3_000: 11}
    assert found(spelling.variants(table(spark, words))) == brute(words)


def test_ties_go_to_the_smallest_form_and_chains_are_followed(spark):
    words = {"abcdef": 5, "abcdeg": 25, "abcdeh": 25, "abcdxg": 125, "abcyxg": 625, "abzyxg": 3125, "zzzzzz": 5}
    got = found(spelling.variants(table(spark, words)))
    assert got == brute(words)
    assert got["abcdef"] == (5, 2, "abcdeg", 25, "abzyxg") and got["zzzzzz"] == (5, 0, None, None, "zzzzzz")


def test_one_word_with_thousands_of_near_words(spark):
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 700)]
    words = {"kettle": 100_000} | {f"ket{c}le": 5 for c in letters} | {f"{c}kettle": 6 for c in letters}
    got = found(spelling.variants(table(spark, words)))
    assert got["kettle"] == (100_000, 1400, None, None, "kettle")
    assert got[f"ket{letters[0]}le"] == (5, 700, "kettle", 100_000, "kettle")
    assert got[f"{letters[5]}kettle"] == (6, 700, "kettle", 100_000, "kettle")


def counted(rows, least):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{w}".encode())
            if doc_id is not None and h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 6:
                out[w] += 1
    return {w: n for w, n in out.items() if n >= least}


def test_counts(spark):
    r = random.Random(5)
    pool = ["".join(r.choice("abcdeÉéßÀ×") for _ in range(r.randrange(1, 12))) for _ in range(300)] + ["KETTLE", "Kettle", "中kettle文", "don't"]
    rows = [(i, r.choice(["-", " ", "\n", "7"]).join(r.choice(pool) for _ in range(400))) for i in range(40)]
    rows += [(None, "kettle kettle Kettle"), (91, None), (92, ""), (93, "x" * 50_000), (94, "kettle " * 30_000), (40, rows[0][1]), (40, rows[0][1])]
    docs = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id long, text string, n int, word string")
    got = {x.word: x.n for x in spelling.counted_words(docs).collect()}
    assert got == counted(rows, 5)
    assert len(got) > 100


def test_empty_and_null(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.counted_words(docs)).count() == 0
    words = spark.createDataFrame([("kettle", 5), (None, 7), ("kettles", None), ("kettel", 25)], "word string, n long")
    assert found(spelling.variants(words)) == brute({"kettle": 5, "kettel": 25})


def test_no_side_of_a_join_goes_through_the_driver(spark):
    words = table(spark, {"abcdef": 5, "abcdeg": 25, "abcdxg": 125})
    for df in (spelling.near_pairs(words), spelling.variants(words)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_pivots_are_the_lightest_disjoint_pair():
    r = np.random.default_rng(2)
    for k in (3, 5):
        places = np.sort(np.stack([r.choice(9, k, replace=False) for _ in range(500)]), axis=1)
        weights = r.integers(1, 6, (500, k))
        got = spelling.pivots(places, weights)
        for p, w, (a, b) in zip(places, weights, got, strict=True):
            assert p[b] - p[a] >= 2
            assert w[a] + w[b] == min(w[i] + w[j] for i in range(k) for j in range(k) if p[j] - p[i] >= 2)
