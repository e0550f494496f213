"""Operator 6: toxicity by a classifier chain.

The categories of a labelled table are predicted one after another.  Each category has
a linear (logistic) model over the text's features and the probabilities of all earlier
categories.  While training, those are out-of-fold: each fold's rows get them from
models that never saw that fold, so a later model meets them as uncertain as they are
on new texts.

A text's features are its different words and their prefixes (4 to 7 letters); a
feature's value is log(1 + how many of the text's different words have it).  The
vocabulary is chosen by Spark from the training rows.  Only those are bounded
(``TRAIN_ROWS``, by a hash of doc_id); scoring covers every whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import CHUNK_BYTES, slices, table, text_bytes

#: Labelled rows that the models are fitted on at most, and features at most.
TRAIN_ROWS = 8_000
FEATURES = 512
FOLDS = 4
THRESHOLD = 0.3
PREFIXES = (4, 5, 6, 7)
WORD = re.compile(r"\w+")
#: Words whose features a task remembers.
CACHE_WORDS = 200_000
#: Bytes of text whose features a task holds at once to learn from: some hundred times as
#: much memory.
TRAIN_BYTES = 1 << 17

#: In the order of the chain: whether a text is toxic at all is asked last, of a model that
#: also sees how probable the two kinds are.
CATEGORIES = ("toxic_fluent", "toxic_junk", "toxic")


def categories_of(labels: DataFrame) -> DataFrame:
    """doc_id and the chain's categories from labels of toxic and quality: toxic in a text
    of good quality, toxic in a text of bad quality, toxic.  Rows without a doc_id or a
    toxic label teach nothing; repeated rows count once, as toxic if one says so."""
    clean = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    good = F.coalesce(F.col("quality"), F.lit(1)) == 1
    toxic = F.col("toxic") == 1
    return clean.select("doc_id", (toxic & good).cast("int").alias("toxic_fluent"), (toxic & ~good).cast("int").alias("toxic_junk"), toxic.cast("int").alias("toxic"))


def features_of(word: str) -> list[str]:
    return ["=" + word, *(word[:n] for n in PREFIXES if len(word) >= n)]


def counts_of(text: str | None) -> dict[str, int]:
    out: dict[str, int] = {}
    for word in set(WORD.findall((text or "").lower())):
        for f in features_of(word):
            out[f] = out.get(f, 0) + 1
    return out


def _parts(batch: pa.RecordBatch, text_at: int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts, and rows of ``FEATURES`` numbers, take about
    ``limit`` bytes; a longer text is taken alone."""
    lengths = np.diff(text_bytes(batch.column(text_at))[1])
    for low, high in slices(lengths + 4 * FEATURES, limit):
        yield batch.slice(low, high - low)


@dataclass
class Chain:
    """weights[c]: of the features, then of earlier categories, then the intercept."""

    categories: tuple[str, ...]
    vocabulary: dict[str, int]
    weights: list[np.ndarray]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), 0))
        for w in self.weights:
            out = np.column_stack([out, _logistic(np.column_stack([x, out, np.ones(len(x))]) @ w)])
        return out


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 150) -> np.ndarray:
    """Weights of a logistic regression; the last column of x is the intercept's."""
    w = np.zeros(x.shape[1])
    share = (y.sum() + 0.5) / (len(y) + 1)
    w[-1] = np.log(share / (1 - share))
    if not 0 < y.sum() < len(y):
        return w
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 0
    # Each feature has its own step, from its part of the curvature; momentum on top.
    step = 1 / (0.25 * (np.abs(x) * np.abs(x).sum(axis=1, keepdims=True)).sum(axis=0) + penalty + 1e-9)
    ahead, before = w, w
    for i in range(rounds):
        gradient = (_logistic(x @ ahead) - y) @ x + penalty * ahead
        w = ahead - step * gradient
        ahead = w + i / (i + 3) * (w - before)
        before = w
    return w


def fitted_chain(x: np.ndarray, y: np.ndarray, fold: np.ndarray, categories: Sequence[str], vocabulary: dict[str, int]) -> Chain:
    weights = []
    earlier = np.zeros((len(x), 0))
    for c in range(len(categories)):
        full = np.column_stack([x, earlier, np.ones(len(x))])
        out_of_fold = np.zeros(len(x))
        for f in range(FOLDS):
            out = fold == f
            out_of_fold[out] = _logistic(full[out] @ fitted(full[~out], y[~out, c]))
        weights.append(fitted(full, y[:, c]))
        earlier = np.column_stack([earlier, out_of_fold])
    return Chain(tuple(categories), vocabulary, weights)


def trained(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = CATEGORIES, rows: int = TRAIN_ROWS, features: int = FEATURES) -> Chain:
    """The chain from ``labels`` (doc_id and a 0/1 column for each category).

    Without a labelled text every probability is as good as 0.
    """
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", *categories)  # bounded by rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, 1, TRAIN_BYTES):
                found = [list(counts_of(t).items()) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pa.array(found, pa.map_(pa.string(), pa.int32()))], names=["doc_id", *categories, "f"])

    kinds = dict(texts.dtypes)
    counted = texts.mapInArrow(run, f"doc_id {kinds['doc_id']}, " + "".join(f"{c} {kinds[c]}, " for c in categories) + "f map<string,int>").persist()
    try:
        total = counted.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in categories]).first()
        n = total["n"]
        if not n:
            return Chain(tuple(categories), {}, [np.append(np.zeros(i), -35.0) for i in range(len(categories))])
        # How far each feature's share among a category's rows is from its share among the others.
        usual = counted.select(*categories, F.explode(F.map_keys("f")).alias("k")).groupBy("k").agg(F.count("*").alias("d"), *[F.sum(c).alias(c) for c in categories]).where("d >= 3")
        weight = F.lit(0.0)
        for c in categories:
            p, q = int(total[c] or 0), n - int(total[c] or 0)
            if p and q:
                a, b = F.col(c) / p, (F.col("d") - F.col(c)) / q
                weight = F.greatest(weight, F.abs(a - b) / F.sqrt((F.col("d") / n * (1 - F.col("d") / n) + 1e-4) * (1 / p + 1 / q)))
        best = usual.select("k", weight.alias("z")).orderBy(F.desc("z"), "k").limit(features).collect()
        vocabulary = {r["k"]: i for i, r in enumerate(best)}
        keep = F.map_filter("f", lambda k, v: k.isin(list(vocabulary))) if vocabulary else F.col("f")
        data = counted.select("doc_id", *categories, keep.alias("f")).orderBy("doc_id").collect()  # bounded by rows and features
    finally:
        counted.unpersist()
    x = np.zeros((n, len(vocabulary)))
    for i, r in enumerate(data):
        for k, v in r["f"].items():
            if k in vocabulary:
                x[i, vocabulary[k]] = np.log1p(v)
    y = np.array([[r[c] or 0 for c in categories] for r in data], float)
    fold = np.random.default_rng(3).permutation(n) % FOLDS
    return fitted_chain(x, y, fold, categories, vocabulary)


def _fill(x: np.ndarray, texts: list, vocabulary: dict[str, int], known: dict) -> None:
    """Adds each text's counts to its row; ``known`` remembers the features of words."""
    for row, text in zip(x, texts, strict=True):
        for word in set(WORD.findall((text or "").lower())):
            try:
                at = known[word]
            except KeyError:
                if len(known) >= CACHE_WORDS:
                    known.clear()
                at = known[word] = [vocabulary[f] for f in features_of(word) if f in vocabulary] or None
            if at:
                row[at] += 1


def _judged(batches: Iterator[pa.RecordBatch], chain: Chain, text_at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, their probabilities), some rows at a time."""
    known: dict[str, list[int] | None] = {}
    for batch in batches:
        for part in _parts(batch, text_at):
            x = np.zeros((part.num_rows, len(chain.vocabulary)))
            _fill(x, part.column(text_at).to_pylist(), chain.vocabulary, known)
            yield part, chain.probabilities(np.log1p(x))


def scored(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id and p_<category> for every text; null is an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, p in _judged(batches, chain, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in np.ascontiguousarray(p.T))], names=["doc_id", *(f"p_{c}" for c in chain.categories)])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}" + "".join(f", p_{c} double" for c in chain.categories))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, p_toxic_fluent, p_toxic_junk, p_toxic and toxic (1 if p_toxic, the chain's last
    link, is at the threshold or above).  Null and empty texts have no features and get the
    intercepts' probabilities; every row has a row, repeated ones too; all words of a text
    count, however long it is; an empty table gives none; columns besides doc_id and text
    are ignored."""
    found = scored(docs, trained(docs, categories_of(labels)))
    return found.withColumn("toxic", (F.col("p_toxic") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose last link's probability is below the threshold, all
    columns as they are.

    Scores are made beside the rows, so no row is joined or shuffled for them.  Null and
    empty texts are judged by the intercepts, which keep them unless most labels are toxic;
    repeated rows stay or go together; texts are read whole; an empty table stays empty.
    """
    chain = trained(docs, categories_of(labels))
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, p in _judged(batches, chain, text_at):
            yield part.filter(pa.array(p[:, -1] < threshold))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
