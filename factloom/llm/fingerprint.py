"""Operator 3: document fingerprints by a homomorphic multiset hash.

A paragraph (a line of the text) is hashed to a wide vector with two parts:

- identity: 8 lanes of 64 bits of its BLAKE2b digest, added modulo 2**64;
- likeness: 128 signed counters of its byte windows, added modulo 2**32, which is more
  than a text can have bytes, so no counter of a text wraps.

A fingerprint is the sum of the vectors of its paragraphs.  So it does not depend on
their order, paragraphs can be inserted or deleted without the rest of the text
(``changed``), and equal multisets have equal fingerprints.  The counters are a linear
sketch: the cosine of two of them estimates how many windows two texts share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import mixed, powers, slices, table, text_bytes, width

IDENTITY_LANES = 8
LIKENESS_LANES = 128
#: Bytes of a window; one that would run over its paragraph ends with it.
WINDOW_BYTES = 8
BASE = 0x9E3779B97F4A7C15
NEWLINE = 10
#: Ranges whose first and last texts one task links.
SEAMS_AT_ONCE = 64


def _paragraphs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each line; an empty row has none."""
    breaks = np.flatnonzero(data == NEWLINE)
    full = np.flatnonzero(np.diff(offsets) > 0)
    starts = np.concatenate([offsets[full], breaks + 1])
    ends = np.concatenate([breaks, offsets[full + 1]])
    rows = np.concatenate([full, np.searchsorted(offsets, breaks, "right") - 1])
    order = np.lexsort((starts, rows))
    finish = np.lexsort((ends, np.concatenate([np.searchsorted(offsets, breaks, "right") - 1, full])))
    return starts[order], ends[finish], rows[order]


def vectors(texts) -> tuple[np.ndarray, np.ndarray]:
    """(identity lanes, likeness lanes) of each text of an Arrow string column."""
    data, offsets = text_bytes(texts)
    n = len(offsets) - 1
    starts, ends, rows = _paragraphs(data, offsets)
    identity = np.zeros((n, IDENTITY_LANES), np.uint64)
    raw = data.tobytes()
    digests = b"".join(hashlib.blake2b(raw[a:b], digest_size=64).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
    if len(rows):
        new = np.flatnonzero(np.diff(rows, prepend=-1))
        identity[rows[new]] = np.add.reduceat(np.frombuffer(digests, "<u8").reshape(-1, IDENTITY_LANES), new, axis=0)
    return identity, _sketch(data, starts, ends, rows, n)


def _sketch(data, starts, ends, rows, n) -> np.ndarray:
    out = np.zeros(n * LIKENESS_LANES)
    sizes = ends - starts
    # Pieces of about a megabyte; a long paragraph alone.
    for low, high in slices(sizes):
        a, b = int(starts[low]), int(ends[high - 1])
        if b <= a:
            continue
        up, down = powers(BASE, b - a + 1)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(data[a:b].astype(np.uint64) * up[:-1], out=sums[1:])
        lengths = sizes[low:high]
        total = int(lengths.sum())
        first = np.cumsum(lengths) - lengths
        at = np.arange(total) + np.repeat(starts[low:high] - a - first, lengths)
        stop = np.minimum(at + WINDOW_BYTES, np.repeat(ends[low:high] - a, lengths))
        keys = mixed((sums[stop] - sums[at]) * down[at] + (stop - at).astype(np.uint64))
        cell = np.repeat(rows[low:high] - rows[low], lengths) * LIKENESS_LANES + (keys & np.uint64(LIKENESS_LANES - 1)).astype(np.int64)
        sign = 1.0 - 2.0 * ((keys >> np.uint64(32)) & np.uint64(1)).astype(np.float64)
        counts = np.bincount(cell, sign, minlength=(int(rows[high - 1]) - int(rows[low]) + 1) * LIKENESS_LANES)
        out[int(rows[low]) * LIKENESS_LANES :][: len(counts)] += counts
    return out.astype(np.int64).astype(np.uint32).reshape(n, LIKENESS_LANES)


def likeness(first, second) -> np.ndarray:
    """0 to 1 for each pair of rows: 1 exactly for equal fingerprints, and otherwise
    the cosine of the counters, negative ones being 0."""
    a, b = (x[1].view(np.int32).astype(float) for x in (first, second))
    size = np.sqrt((a * a).sum(1) * (b * b).sum(1))
    cosine = np.divide((a * b).sum(1), size, out=np.zeros(len(a)), where=size > 0)
    same = (first[0] == second[0]).all(1) & (first[1] == second[1]).all(1)
    return np.where(same, 1.0, np.clip(cosine, 0.0, 1.0))


def shown(vector) -> list[str]:
    """Hex digits: identity lanes, then likeness lanes, little-endian."""
    a = np.ascontiguousarray(vector[0].astype("<u8")).view(np.uint8)
    b = np.ascontiguousarray(vector[1].astype("<u4")).view(np.uint8)
    return [bytes(x).hex() for x in np.concatenate([a, b], axis=1)]


def parsed(prints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex("".join(prints)), np.uint8).reshape(len(prints), -1)
    cut = IDENTITY_LANES * 8
    return np.ascontiguousarray(raw[:, :cut]).view("<u8"), np.ascontiguousarray(raw[:, cut:]).view("<u4")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every text; null and empty texts have no paragraph (zero)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = text_bytes(batch.column(1))
            for low, high in slices(np.diff(offsets)):
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shown(vectors(part.column(1))), pa.string())], names=["id", "fingerprint"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, fingerprint string").withColumnRenamed("id", id_col)


def changed(edits: DataFrame) -> DataFrame:
    """The fingerprints of ``edits`` (fingerprint, inserted, deleted: lines of text or
    null) after inserting and deleting those paragraphs; other columns are kept."""
    taken = [f for f in edits.columns if f not in ("fingerprint", "inserted", "deleted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            now = parsed(batch.column("fingerprint").to_pylist())
            more, less = vectors(batch.column("inserted")), vectors(batch.column("deleted"))
            out = shown(tuple(x + y - z for x, y, z in zip(now, more, less, strict=True)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in taken), pa.array(out, pa.string())], names=[*taken, "fingerprint"])

    kinds = dict(edits.dtypes)
    return edits.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in taken), "fingerprint string"]))


SCHEMA = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
    """Rows for texts[i], each followed by its next document texts[i + 1]."""
    edited = []
    for text, after in zip(texts, texts[1:], strict=False):
        half = len(text) // 2
        edited.append(text[: len(text) - half] + after[:half])
    own = vectors(pa.array(texts, pa.string()))
    new = vectors(pa.array(edited, pa.string()))
    mine, after = tuple(x[:-1] for x in own), tuple(x[1:] for x in own)
    return pa.RecordBatch.from_arrays(
        [ids, pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()), pa.array(shown(mine), pa.string()), pa.array(shown(new), pa.string()), pa.array(likeness(mine, new)), pa.array(likeness(mine, after))],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text (see ``op3``).

    Null texts are empty; texts of any length count whole, one at a time; repeated rows
    have a row each; an empty table gives none.  Documents follow each other by descending doc_id, null last,
    equal doc_ids by descending text; the last is followed by the first, and a single
    document by itself.  The text is shuffled once, into ranges of doc_id; the last row
    of a range finds its successor among the ranges' first rows, one for each range.
    """
    kind = dict(docs.dtypes)["doc_id"]
    order = [F.desc_nulls_last("doc_id"), F.desc("text")]
    ranged = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(width(docs.sparkSession), order[0])  # by the id alone: its samples go to the driver

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_id, held = [], []
        for batch in batches:
            _, offsets = text_bytes(batch.column(1))
            for low, high in slices(np.diff(offsets), 1 << 19):
                ids = held_id + batch.column(0).slice(low, high - low).to_pylist()
                texts = held + batch.column(1).slice(low, high - low).to_pylist()
                if len(texts) > 1:
                    yield _compared(pa.array(ids[:-1], batch.column(0).type), texts)
                held_id, held = ids[-1:], texts[-1:]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pair = [batch.column(1)[i].as_py(), batch.column(2)[i].as_py()]
                yield _compared(batch.column(0).slice(i, 1), pair)

    inner = ranged.sortWithinPartitions(*order).mapInArrow(run, f"doc_id {kind}, {SCHEMA}")
    ends = ranged.groupBy(F.spark_partition_id().alias("part")).agg(F.max(F.struct("doc_id", "text")).alias("first"), F.min(F.struct("doc_id", "text")).alias("last"))
    seams, parts = [], width(docs.sparkSession)
    while parts > SEAMS_AT_ONCE:  # blocks of ranges first, then blocks of blocks, so that no task meets the texts of all
        along = Window.partitionBy(F.floor(F.col("part") / SEAMS_AT_ONCE)).orderBy("part")
        seams.append(ends.select("last", F.lead("first.text").over(along).alias("after")).where("after is not null"))
        ends = ends.groupBy(F.floor(F.col("part") / SEAMS_AT_ONCE).cast("int").alias("part")).agg(F.min_by("first", "part").alias("first"), F.max_by("last", "part").alias("last"))
        parts = -(-parts // SEAMS_AT_ONCE)
    along = Window.orderBy("part")  # SEAMS_AT_ONCE rows at most
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seams.append(ends.select("last", F.coalesce(F.lead("first.text").over(along), F.first("first.text").over(whole)).alias("after")))
    out = inner
    for seam in seams:
        out = out.unionByName(seam.select("last.doc_id", "last.text", "after").mapInArrow(finish, f"doc_id {kind}, {SCHEMA}"))
    return out


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edits(table(spark, sf_dir, "documents"))
