import random

import numpy as np

from factloom.llm import toxicity
from llm_texts import prose

LABELS = "doc_id long, quality int, toxic int"


def corpus(seed, n):
    r = random.Random(seed)
    bad = ["vileword", "nastyterm", "foulname", "grimstem"]
    texts, labels = [], []
    for i in range(n):
        words = prose(seed * 10_000 + i, r.randrange(5, 200), 600).split()
        toxic = r.random() < 0.2
        if toxic:
            for _ in range(r.randrange(1, 5)):
                words.insert(r.randrange(len(words)), r.choice(bad) + r.choice(["", "s", "ed", "."]))
        texts.append(" ".join(words))
        labels.append((i, int(r.random() < 0.8), int(toxic)))
    return texts, labels


def test_chain_finds_held_out_texts(spark, documents):
    texts, labels = corpus(1, 700)
    known = spark.createDataFrame(labels[:500], LABELS)
    got = {r.doc_id: r for r in toxicity.toxicity(documents(texts), known).collect()}
    assert len(got) == 700
    caught = [got[i].toxic for i, _, t in labels[500:] if t]
    flagged = [got[i].toxic for i, _, t in labels[500:] if not t]
    assert np.mean(caught) > 0.9 and np.mean(flagged) < 0.02
    stay = {r.doc_id for r in toxicity.without_toxic(documents(texts), known).collect()}
    assert stay == {i for i in got if not got[i].toxic}


def test_earlier_probabilities_feed_later_models():
    r = np.random.default_rng(2)
    x = (r.random((600, 3)) < 0.3).astype(float)
    first = (x[:, 0] + x[:, 1] > 1).astype(float)
    y = np.column_stack([first, first * x[:, 2]])
    chain = toxicity.fitted_chain(x, y, np.arange(600) % toxicity.FOLDS, ("a", "b"), {"f": 0, "g": 1, "h": 2})
    assert [len(w) for w in chain.weights] == [4, 5]
    assert abs(chain.weights[1][3]) > 0.1
    p = chain.probabilities(x)
    assert np.mean((p[:, 1] > 0.5) == y[:, 1]) > 0.95


def test_fitted_weights_are_the_optimum():
    r = np.random.default_rng(3)
    x = np.column_stack([r.normal(size=(300, 4)), np.ones(300)])
    y = (r.random(300) < 1 / (1 + np.exp(-x @ [1, -2, 0, 0.5, -1]))).astype(float)
    w = toxicity.fitted(x, y, 1.0, 2000)
    gradient = (1 / (1 + np.exp(-x @ w)) - y) @ x + np.array([1, 1, 1, 1, 0]) * w
    assert np.abs(gradient).max() < 1e-3


def test_odd_tables(spark, documents, odd_texts):
    empty = spark.createDataFrame([], LABELS)
    docs = documents(odd_texts).withColumnRenamed("lang", "toxic").withColumnRenamed("source", "f")
    assert {r.toxic for r in toxicity.toxicity(docs, empty).collect()} == {0}
    odd = spark.createDataFrame([(None, 1, 1), (0, 1, None), (1, None, 1), (1, 0, 0), (3, 1, 0), (7, 1, 0)], LABELS)
    rows = toxicity.toxicity(docs, odd).collect()
    assert len(rows) == len(odd_texts) and all(0 <= r.p_toxic <= 1 for r in rows)
    assert toxicity.toxicity(documents([]), odd).count() == 0
    kept = toxicity.without_toxic(docs, empty)
    assert kept.columns == docs.columns and kept.count() == len(odd_texts)


def test_toxic_rests_on_the_earlier_links(spark, documents):
    """The flag is the chain's last link: without the earlier probabilities it changes."""
    texts, labels = corpus(3, 500)
    docs, known = documents(texts), spark.createDataFrame(labels, LABELS)
    chain = toxicity.trained(docs, toxicity.categories_of(known))
    assert chain.categories[-1] == "toxic"
    n = len(chain.vocabulary)
    assert [len(w) for w in chain.weights] == [n + 1, n + 2, n + 3]
    deaf = toxicity.Chain(chain.categories, chain.vocabulary, [*chain.weights[:2], chain.weights[2].copy()])
    deaf.weights[2][n : n + 2] = 0
    assert chain.weights[2][n] > 0.5
    whole, without = ({r.doc_id: r.p_toxic for r in toxicity.scored(docs, c).collect()} for c in (chain, deaf))
    truth = {i for i, _, t in labels if t}
    most = max(truth, key=lambda i: whole[i] - without[i])
    assert whole[most] - without[most] > 0.02
    between = (whole[most] + without[most]) / 2
    flagged = {r.doc_id for r in toxicity.toxicity(docs, known, between).where("toxic = 1").collect()}
    assert flagged == {i for i in whole if whole[i] >= between} and most in flagged
    assert most not in {i for i in without if without[i] >= between}
    assert {i for i in whole if whole[i] >= toxicity.THRESHOLD} == {r.doc_id for r in toxicity.toxicity(docs, known).where("toxic = 1").collect()}
