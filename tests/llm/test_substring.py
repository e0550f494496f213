import hashlib
import random
import re
from collections import defaultdict

import pytest

from factloom.llm import substring

WORD = re.compile("[^\x20\x09-\x0d]+")


def slow(texts, window):
    """kept words and number of words of each text, by a table of all windows."""
    words = [WORD.findall(t or "") for t in texts]
    places = defaultdict(list)
    for d, w in enumerate(words):
        for i in range(len(w) - window + 1):
            places[tuple(w[i : i + window])].append((d, i))
    gone = [set() for _ in words]
    for found in places.values():
        if len(found) > 1:
            for d, i in found:
                gone[d].update(range(i, i + window))
    return [([x for i, x in enumerate(w) if i not in gone[d]], len(w)) for d, w in enumerate(words)]


def check(rows, texts, window):
    got = {r.doc_id: r for r in rows}
    want = slow(texts, window)
    assert len(rows) == len(texts)
    for i, (kept, n) in enumerate(want):
        assert (got[i].n_words, got[i].n_removed) == (n, n - len(kept)), i
        assert got[i].kept_sha256 == hashlib.sha256(" ".join(kept).encode()).hexdigest(), i
    return sum(n - len(kept) for kept, n in want)


def planted(seed, n, window):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(3000)}é"
    passages = [[word() for _ in range(r.choice([window - 1, window, window + 1, 2 * window, 5 * window]))] for _ in range(12)]
    texts = []
    for _ in range(n):
        out = [word() for _ in range(r.randrange(0, 90))]
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            p = r.choice(passages)
            cut = r.randrange(0, 4)
            out += p[cut:] + [word() for _ in range(r.randrange(0, 60))]
        texts.append("".join(x + r.choice([" ", " ", "\n", "\t", "  "]) for x in out))
    return texts


@pytest.mark.parametrize("window", [35, 7, 6])
def test_against_brute_force(spark, documents, window):
    texts = planted(window, 150, window)
    assert check(substring.repeats(documents(texts), window).collect(), texts, window) > 100


def test_repeats_inside_a_document_and_overlaps(spark, documents):
    once = " ".join(f"v{i}" for i in range(40))
    texts = ["a " * 300, once + " x " + once, once[:200], "b " * 34, "b " * 35, "c " * 36]
    check(substring.repeats(documents(texts)).collect(), texts, 35)


def test_odd_texts(spark, documents, odd_texts):
    check(substring.repeats(documents(odd_texts)).collect(), odd_texts, 35)
    assert substring.repeats(documents([])).count() == 0


def test_texts_come_back_whole(spark, documents):
    texts = [*planted(5, 60, 35), None, "  two\nwords  "]
    docs = documents(texts).withColumnRenamed("lang", "kept")
    rows = {r.doc_id: r for r in substring.without_repeats(docs).collect()}
    assert substring.without_repeats(docs).columns == docs.columns
    for i, ((kept, n), text) in enumerate(zip(slow(texts, 35), texts, strict=True)):
        assert rows[i].text == (text if len(kept) == n else " ".join(kept))
        assert rows[i].kept == "en"
        assert rows[i].n_chars == (None if text is None else len(rows[i].text))


def thue_morse(n):
    first, second = "a", "b"
    while len(first) < n:
        first, second = first + second, second + first
    return first, second


def test_words_that_polynomials_confuse(spark, documents):
    """Two words of 4,096 letters that collide under any odd base modulo 2**64."""
    first, second = thue_morse(4096)
    rest = " ".join(f"v{i}" for i in range(34))
    texts = [f"{first} {rest}", f"{second} {rest}", *(f"{w[:n]} {rest} tail" for n in (8, 9, 16, 31, 32, 33, 64) for w in (first, second))]
    check(substring.repeats(documents(texts)).collect(), texts, 35)


def test_repeated_rows_spread(spark, documents):
    text = " ".join(f"v{i}" for i in range(60))
    docs = documents([text]).crossJoin(spark.range(64).select()).coalesce(1)
    rows = substring.repeats(docs).collect()
    assert len(rows) == 64 and {r.n_removed for r in rows} == {60}
