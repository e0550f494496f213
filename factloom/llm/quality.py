"""Operator 5: a quality classifier from a linear-chain conditional random field.

Every line of a text is labelled good or bad.  A line's features are its own (letter
case, symbols, separators, repeated words, length ...) and those of the line before and
after it; the field adds weights for which label follows which.  Forward-backward gives
each line's marginal, and a text's raw quality is the mean of its lines' marginals,
weighted by length; a two-parameter curve turns that into the probability of label 1.

Only documents are labelled.  So the lines of a bad text first count as bad; then the
field is fitted again with those lines of bad texts as good that it finds good, except
each bad text's worst line.  Fitting takes a bounded sample of labelled texts, each whole
(``TRAIN_ROWS`` texts with ``TRAIN_LINES`` lines in all, by a hash of doc_id); scoring
covers every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import SPACE, slices, span_hashes, stored, table, text_bytes, words_of

#: Labelled texts that the field is fitted on at most.
TRAIN_ROWS = 4_000
#: Lines of those texts at most, and twenty times those of the longest that teaches.
TRAIN_LINES = 200_000
THRESHOLD = 0.3
#: Bytes by kind; letters of UTF-8's second and later bytes are OTHER.
UPPER, LOWER, DIGIT, STOP, MARK, BAR, OTHER = range(7)
KIND = np.full(256, OTHER, np.uint8)
KIND[ord("A") : ord("Z") + 1] = UPPER
KIND[ord("a") : ord("z") + 1] = LOWER
KIND[ord("0") : ord("9") + 1] = DIGIT
KIND[[ord(c) for c in ".,;:?'\"()-"]] = STOP
KIND[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{}~"]] = MARK
KIND[ord("|")] = BAR
KIND[SPACE] = 255
BASE = 0x9E3779B97F4A7C15
OWN = 15


def line_features(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, bytes, row) of each line of an Arrow string column, in order; a text
    without lines has one empty line."""
    data, offsets = text_bytes(texts)
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    rows_of_breaks = np.searchsorted(offsets, breaks, "right") - 1
    rows = np.sort(np.concatenate([np.arange(n), rows_of_breaks]))
    order = np.argsort(np.concatenate([np.arange(n) * 1.0, rows_of_breaks + 0.5]), kind="stable")
    starts = np.concatenate([offsets[:-1], breaks + 1])[order]
    ends = np.empty(len(starts), np.int64)
    last = np.append(rows[1:] != rows[:-1], True) if len(rows) else np.zeros(0, bool)
    ends[last] = offsets[1:]
    ends[~last] = starts[np.flatnonzero(~last) + 1] - 1
    sizes = ends - starts
    kinds = KIND[data]
    share = np.zeros((len(starts), 7))
    for kind in (UPPER, LOWER, DIGIT, STOP, MARK, BAR, OTHER):
        sums = np.concatenate([[0], np.cumsum(kinds == kind, dtype=np.int64)])
        share[:, kind] = sums[ends] - sums[starts]
    solid = share.sum(axis=1)
    w0, w1, _ = words_of(data, offsets)
    line = np.searchsorted(starts, w0, "right") - 1
    # An empty line starts where the next one does or ends; words belong to the last line that starts at or before them.
    words = np.bincount(line, minlength=len(starts)).astype(float)
    hashes = np.empty(len(w0), np.uint64)
    for low, high in slices(w1 - w0, 1 << 19):
        a, b = int(w0[low]), int(w1[high - 1])
        hashes[low:high] = span_hashes(data[a:b].astype(np.uint64), w0[low:high] - a, w1[low:high] - a, BASE)
    again = [np.zeros(len(starts)) for _ in range(3)]
    for gap, out in enumerate(again, 1):
        if len(hashes) > gap:
            same = (hashes[gap:] == hashes[:-gap]) & (line[gap:] == line[:-gap])
            out += np.bincount(line[gap:][same], minlength=len(starts))
    with np.errstate(invalid="ignore", divide="ignore"):
        part = np.where(solid[:, None] > 0, share / np.maximum(solid, 1)[:, None], 0.0)
        repeats = [np.where(words > g, r / np.maximum(words - g, 1), 0.0) for g, r in enumerate(again, 1)]
    own = np.column_stack(
        [
            part[:, UPPER], np.maximum(part[:, UPPER] - 0.3, 0) * 3, part[:, DIGIT], part[:, STOP], part[:, MARK], np.minimum(part[:, MARK] * 10, 1), part[:, BAR], np.minimum(part[:, BAR] * 20, 1), part[:, OTHER],
            *repeats, np.log1p(words) / 5, np.where(words > 0, np.minimum(solid / np.maximum(words, 1), 30) / 10, 0.0), (words == 0).astype(float),
        ]
    )
    before, after = np.zeros_like(own), np.zeros_like(own)
    if len(own) > 1:
        same_row = (rows[1:] == rows[:-1])[:, None]
        before[1:] = own[:-1] * same_row
        after[:-1] = own[1:] * same_row
    first = np.append(True, rows[1:] != rows[:-1])[: len(rows)].astype(float)
    return np.column_stack([own, before, after, first, last.astype(float), np.ones(len(own))]), sizes, rows


COLUMNS = 3 * OWN + 3


@dataclass
class Field:
    """emission: weight of each feature for good over bad; transition[i, j]: of label j
    after i (0 bad, 1 good); slope and shift of the curve from raw quality to score."""

    emission: np.ndarray
    transition: np.ndarray
    slope: float = 8.0
    shift: float = 0.0

    def marginals(self, x: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability of good of each line, expected transitions (2, 2) summed)."""
        unary = np.column_stack([np.zeros(len(x)), x @ self.emission])
        _, counts = np.unique(rows, return_counts=True)
        begin = np.cumsum(counts) - counts
        order = np.argsort(-counts, kind="stable")
        counts, begin = counts[order], begin[order]
        longest = int(counts.max(initial=0))
        open_at = np.searchsorted(-counts, -np.arange(longest), "left")  # texts with more lines than t
        forward, backward = np.zeros_like(unary), np.zeros_like(unary)
        for t in range(longest):
            at = begin[: open_at[t]] + t
            forward[at] = unary[at]
            if t:
                forward[at] += np.logaddexp(*(forward[at - 1][:, i, None] + self.transition[i] for i in (0, 1)))
        for t in range(longest - 2, -1, -1):
            at = begin[: open_at[t + 1]] + t
            ahead = unary[at + 1] + backward[at + 1]
            backward[at] = np.logaddexp(*(ahead[:, j, None] + self.transition[:, j] for j in (0, 1)))
        total = np.logaddexp(*(forward + backward).T)
        good = np.exp(forward[:, 1] + backward[:, 1] - total)
        pairs = np.flatnonzero(rows[1:] == rows[:-1])
        joint = forward[pairs][:, :, None] + self.transition + (unary + backward)[pairs + 1][:, None, :] - total[pairs][:, None, None]
        return good, np.exp(joint).sum(axis=0)

    def raw(self, x: np.ndarray, sizes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """Each text's mean marginal, weighted by the bytes of its lines (and one)."""
        good, _ = self.marginals(x, rows)
        weight = sizes + 1.0
        return np.bincount(rows, good * weight, n) / np.bincount(rows, weight, n)

    def score(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * _logit(raw) + self.shift, -35, 35)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _fit_field(x, rows, y, weight, start: Field, rounds: int = 120) -> Field:
    """Gradient ascent (Adam) on the lines' likelihood; weight is that of each line's text."""
    field = Field(start.emission.copy(), start.transition.copy())
    pairs = np.flatnonzero(rows[1:] == rows[:-1])
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[pairs], y[pairs + 1]), 1.0)
    m = [np.zeros_like(field.emission), np.zeros_like(field.transition)]
    v = [np.zeros_like(field.emission), np.zeros_like(field.transition)]
    for i in range(1, rounds + 1):
        good, expected = field.marginals(x, rows)
        slopes = [((y - good) * weight) @ x / weight.sum() - 1e-4 * field.emission, (seen - expected) / max(1, len(pairs)) - 1e-3 * field.transition]
        for p, (value, slope) in enumerate(zip((field.emission, field.transition), slopes, strict=True)):
            m[p] = 0.9 * m[p] + 0.1 * slope
            v[p] = 0.99 * v[p] + 0.01 * slope * slope
            value += 0.2 * (m[p] / (1 - 0.9**i)) / (np.sqrt(v[p] / (1 - 0.99**i)) + 1e-8)
    return field


def fitted(x: np.ndarray, sizes: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> Field:
    """The field from lines (``rows`` counts texts from 0) and the labels of texts."""
    n = len(labels)
    field = Field(np.zeros(x.shape[1]), np.zeros((2, 2)))
    share = (labels.sum() + 0.5) / (n + 1)
    if not 0 < labels.sum() < n:
        field.slope, field.shift = 0.0, float(np.log(share / (1 - share)))
        return field
    lines = np.bincount(rows, minlength=n)
    weight = (1.0 / lines)[rows]
    y = labels[rows]
    for _ in range(3):
        field = _fit_field(x, rows, y, weight, field)
        good, _ = field.marginals(x, rows)
        y = np.where(labels[rows] == 1, 1, (good > 0.5).astype(int))
        worst = np.full(n, np.inf)
        np.minimum.at(worst, rows, good)
        y = np.where((labels[rows] == 0) & (good == worst[rows]), 0, y)
    raw = _logit(field.raw(x, sizes, rows, n))
    a, b = 1.0, 0.0
    for _ in range(60):  # Newton, with a slight pull of the slope to 1
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -35, 35)))
        d = p * (1 - p) + 1e-6
        h = np.array([[(d * raw * raw).sum() + 1, (d * raw).sum()], [(d * raw).sum(), d.sum() + 1e-3]])
        g = np.array([((labels - p) * raw).sum() - (a - 1), (labels - p).sum() - 1e-3 * b])
        move = np.linalg.solve(h, g)
        move *= min(1.0, 2.0 / (np.abs(move).max() + 1e-12))
        a, b = a + move[0], b + move[1]
    field.slope, field.shift = float(max(a, 1e-3)), float(b)
    return field


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of its doc_id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, lines: int = TRAIN_LINES) -> Field:
    """The field from labelled rows that are not held out; of repeated labels of a doc_id
    the lowest counts; rows of null doc_id or label teach nothing."""
    usable = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg((F.min("quality") == 1).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")  # bounded by rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = text_bytes(batch.column(1))
            for low, high in slices(np.diff(offsets)):
                part = batch.slice(low, high - low)
                x, sizes, at = line_features(part.column(1))
                cut = np.searchsorted(at, np.arange(part.num_rows + 1))
                fields = [x[a:b].astype(np.float32).tobytes() for a, b in zip(cut, cut[1:], strict=False)]
                lengths = [sizes[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(np.diff(cut), pa.int64()), pa.array(fields, pa.binary()), pa.array(lengths, pa.binary())], names=["doc_id", "y", "n", "x", "sizes"])

    measured = stored(texts.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, y int, n long, x binary, sizes binary"), "lines")
    in_order = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rangeBetween(Window.unboundedPreceding, 0)  # two numbers of bounded rows
    sized = measured.groupBy("doc_id").agg(F.sum("n").alias("n")).where(F.col("n") <= lines // 20)
    few = sized.withColumn("so_far", F.sum("n").over(in_order)).where(F.col("so_far") <= lines).select("doc_id")
    data = measured.join(F.broadcast(few), "doc_id").orderBy("doc_id").select("y", "x", "sizes").collect()  # bounded by lines
    if not data:
        return Field(np.zeros(COLUMNS), np.zeros((2, 2)), 0.0, 0.0)
    x = np.concatenate([np.frombuffer(r["x"], np.float32).reshape(-1, COLUMNS) for r in data]).astype(float)
    sizes = np.concatenate([np.frombuffer(r["sizes"], np.int64) for r in data])
    at = np.repeat(np.arange(len(data)), [len(r["sizes"]) // 8 for r in data])
    return fitted(x, sizes, at, np.array([r["y"] for r in data]))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every text; null and empty texts are one
    empty line; a null doc_id is not held out.  Without labels every score is 0.5.

    Every row has a row, repeated ones too; all lines of a text count, however many; an
    empty table gives none; columns besides doc_id and text are ignored."""
    field = trained(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = text_bytes(batch.column(1))
            for low, high in slices(np.diff(offsets)):
                part = batch.slice(low, high - low)
                x, sizes, rows = line_features(part.column(1))
                score = field.score(field.raw(x, sizes, rows, part.num_rows))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], names=["doc_id", "score"])

    scores = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
