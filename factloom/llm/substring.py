"""Operator 1: substring dedup with fixed-block anchors.

A repeat of 35 words or more contains, wherever it lies in either copy, a whole
block of 18 words of the grid that cuts each document into non-overlapping blocks
(2 * 18 - 1 = 35).  So:

1. Index: the hash of every grid block.  Probe: the hash of every rolling window of
   18 words.  Both are dealt to slices of the hash space, packed: each group of
   documents sends a slice its distinct hashes, sorted, as 4-byte remainders.  A
   hash that a third of all documents share costs one entry for each group.
2. A slice answers each group with two bits for each hash it sent: is it a grid
   block anywhere, and is it one at two places or more.
3. A window of 35 words that has a hit among its first 18 starts is a candidate.
   These alone are extended: their 96-bit hashes are counted over all documents the
   same way, and what occurs twice or more is a repeat.  Touching repeats merge into
   maximal ones, whose words are removed.

The text is shuffled once, into groups; the three passes over it read the same
exchange.  Hits are a filter, so their 4-byte remainders cannot lose a repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import even_keys, span_hashes, table, text_bytes, width, window_hashes, word_hashes, words_of

#: Words of a window that counts as a repeat, and of the blocks that anchor it.
WINDOW_WORDS = 35
#: Groups of documents for each shuffle partition: a task holds one at a time, and sends
#: each slice a message for each.
GROUPS_PER_PARTITION = 2

FIRST_BASE = 0xC2B2AE3D27D4EB4F
SECOND_BASE = 0xD6E8FEB86659FD93


def _packed(values: np.ndarray, kind: str) -> bytes:
    """Integers by planes of bytes, compressed."""
    planes = np.ascontiguousarray(values.astype(kind).view(np.uint8).reshape(len(values), -1).T)
    return zstandard.compress(planes.tobytes(), 1)


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _sorted_packed(values: np.ndarray) -> bytes:
    return _packed(np.diff(values, prepend=np.uint32(0)), "<u4")


def _sorted_unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data, "<u4"), dtype=np.uint32)


class _Words:
    """Words of a group of texts, and the hashes that the passes need again and again."""

    def __init__(self, texts, window: int):
        self.window, self.block = window, (window + 1) // 2
        self.data, self.offsets = text_bytes(texts)
        self.starts, self.ends, self.rows = words_of(self.data, self.offsets)
        self.first = np.searchsorted(self.rows, np.arange(len(self.offsets) - 1))  # word at which a row starts
        self.hashes = word_hashes(self.data, self.starts, self.ends)
        self.at, self.keys = window_hashes(self.hashes, self.rows, self.block, FIRST_BASE)
        self.on_grid = (self.at - self.first[self.rows[self.at]]) % self.block == 0

    def cells(self, slices: int) -> np.ndarray:
        """slice << 32 | remainder of each rolling window."""
        return ((self.keys >> np.uint64(32)) % np.uint64(slices) << np.uint64(32)) | (self.keys & np.uint64(0xFFFFFFFF))

    def candidates(self, cells: np.ndarray, answers: dict[int, tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, first hash, second hash) of the long windows that hold a hit."""
        distinct, inverse = np.unique(cells, return_inverse=True)
        borders = _borders(distinct)
        one, two = np.zeros(len(distinct), bool), np.zeros(len(distinct), bool)
        for part, (low, high) in borders.items():
            if part in answers:
                for bits, out in zip(answers[part], (one, two), strict=True):
                    out[low:high] = np.unpackbits(np.frombuffer(bits, np.uint8), count=high - low)
        hit = np.zeros(len(self.hashes) + 1, np.int64)
        hit[self.at] = np.where(self.on_grid, two[inverse], one[inverse])
        hits = np.concatenate([[0], np.cumsum(hit)])
        n = len(self.hashes) - self.window + 1
        if n <= 0 or not hits[-1]:
            none = np.zeros(0, np.uint64)
            return np.zeros(0, np.int64), none, none
        at = np.flatnonzero((self.rows[:n] == self.rows[self.window - 1 :]) & (hits[self.block : self.block + n] > hits[:n]))
        first = span_hashes(self.hashes, at, at + self.window, SECOND_BASE)
        second = span_hashes(word_hashes(self.data, self.starts, self.ends, 1), at, at + self.window, FIRST_BASE)
        return at, first, second


def _borders(distinct: np.ndarray) -> dict[int, tuple[int, int]]:
    """slice -> its range in sorted cells."""
    part = (distinct >> np.uint64(32)).astype(np.int64)
    cut = np.flatnonzero(np.diff(part, prepend=-1))
    return {int(part[a]): (int(a), int(b)) for a, b in zip(cut, np.append(cut[1:], len(part)), strict=True)} if len(part) else {}


LONG_KEY = np.dtype([("a", "<u8"), ("b", "<u8")])


def _long_cells(first: np.ndarray, second: np.ndarray, slices: int) -> np.ndarray:
    out = np.empty(len(first), LONG_KEY)
    out["a"] = ((first >> np.uint64(32)) % np.uint64(slices) << np.uint64(32)) | (first & np.uint64(0xFFFFFFFF))
    out["b"] = second
    return out


def _distinct_long(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct, index of each cell in it, count of each)."""
    order = np.lexsort((cells["b"], cells["a"]))
    ranked = cells[order]
    new = np.ones(len(ranked), bool)
    new[1:] = (ranked["a"][1:] != ranked["a"][:-1]) | (ranked["b"][1:] != ranked["b"][:-1])
    index = np.empty(len(cells), np.int64)
    index[order] = np.cumsum(new) - 1
    return ranked[new], index, np.bincount(index, minlength=int(new.sum()))


MESSAGE = "g long, part long, kind int, data binary, flags binary"
_MESSAGE = pa.schema([("g", pa.int64()), ("part", pa.int64()), ("kind", pa.int32()), ("data", pa.binary()), ("flags", pa.binary())])
INDEX, PROBE, CANDIDATE = 0, 1, 2


def _messages(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * 5, _MESSAGE, strict=True)], schema=_MESSAGE)


def _answer_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by slice and kind: the index of a slice, then its probes."""
    part, index, known, twice = None, [], None, None
    for batch in batches:
        out = []
        for g, p, kind, data, flags in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if p != part:
                part, index, known = p, [], None
            if kind == INDEX:
                index.append((_sorted_unpacked(data), flags))
                continue
            if known is None:
                if index:
                    keys = np.concatenate([k for k, _ in index])
                    counts = np.concatenate([1 + np.unpackbits(np.frombuffer(f, np.uint8), count=len(k)) for k, f in index])
                    known, inverse = np.unique(keys, return_inverse=True)
                    twice = np.bincount(inverse, counts) >= 2
                else:
                    known = np.zeros(0, np.uint32)
                index = []
            asked = _sorted_unpacked(data)
            if len(known):
                at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
                one = known[at] == asked
                two = one & twice[at]
            else:
                one = two = np.zeros(len(asked), bool)
            if one.any():
                out.append((g, p, PROBE, zstandard.compress(np.packbits(one).tobytes(), 1), zstandard.compress(np.packbits(two).tobytes(), 1)))
        yield from _messages(out).to_batches()


def _answer_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by slice; a slice's keys are gathered, counted and answered."""

    def answered(part, sent):
        keys = np.concatenate([k for _, k, _ in sent])
        times = np.concatenate([t for _, _, t in sent])
        _, index, _ = _distinct_long(keys)
        repeated = (np.bincount(index, times) >= 2)[index]
        out, low = [], 0
        for g, k, _ in sent:
            mine = repeated[low : low + len(k)]
            low += len(k)
            if mine.any():
                out.append((g, part, CANDIDATE, zstandard.compress(np.packbits(mine).tobytes(), 1), None))
        return _messages(out).to_batches()

    part, sent = None, []
    for batch in batches:
        for g, p, data, flags in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
            if p != part and sent:
                yield from answered(part, sent)
                sent = []
            part = p
            keys = np.frombuffer(zstandard.decompress(data), np.uint8)
            n = len(keys) // 12
            long = np.empty(n, LONG_KEY)
            long["a"] = np.ascontiguousarray(keys[: 4 * n].reshape(4, n).T).view("<u4").ravel().cumsum(dtype=np.uint32)
            long["b"] = keys[4 * n :].view("<u8")
            sent.append((g, long, 1 + np.unpackbits(np.frombuffer(flags, np.uint8), count=n)))
    if sent:
        yield from answered(part, sent)


def repeats(docs: DataFrame, window: int = WINDOW_WORDS, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (or, with_text, all columns and ``kept``).

    Words are runs of characters other than ASCII white space.  Each word covered by
    a window of ``window`` words whose words also start anywhere else is removed.  A
    null or empty text has no words and its kept text is empty; repeated rows are copies
    of each other like any two documents, and each gives a row.  A very long text is read
    whole, in one group.  An empty table gives no row.  Rows must come in the same order
    whenever they are read, as those of a written table do.
    """
    spark = docs.sparkSession
    slices = width(spark)
    keys = even_keys(spark, slices, GROUPS_PER_PARTITION)
    block = (window + 1) // 2
    if 2 * block - 1 > window:
        block -= 1
    names = docs.columns if with_text else ["doc_id", "text"]
    # The row's number is in it so that repeated rows, which nothing else tells apart, spread.
    number = F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(slices * GROUPS_PER_PARTITION))
    dealt = docs.select(number.alias("number"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(names)])
    own = dealt.join(F.broadcast(keys.withColumnRenamed("key", "_g")), "number").select("_g", *[f"_{i}" for i in range(len(names))])  # two numbers for each group
    grouped = own.repartition(slices, "_g")
    text_at = 1 + names.index("text")

    def ask(group: pa.Table) -> pa.Table:
        g = group.column(0)[0].as_py()
        words = _Words(group.column(text_at), window)
        cells = words.cells(slices)
        out = []
        for kind, mine in ((INDEX, cells[words.on_grid]), (PROBE, cells)):
            distinct, counts = np.unique(mine, return_counts=True)
            for part, (low, high) in _borders(distinct).items():
                flags = np.packbits(counts[low:high] >= 2).tobytes() if kind == INDEX else None
                out.append((g, part, kind, _sorted_packed((distinct[low:high] & np.uint64(0xFFFFFFFF)).astype(np.uint32)), flags))
        return _messages(out)

    def bits(answers: pa.Table, kind: int) -> dict[int, tuple]:
        out = {}
        for p, k, data, flags in zip(*(answers.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
            if k == kind:
                out[p] = tuple(zstandard.decompress(x) if x is not None else None for x in (data, flags))
        return out

    def extend(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not group.num_rows or not answers.num_rows:
            return _messages([])
        g = group.column(0)[0].as_py()
        words = _Words(group.column(text_at), window)
        at, first, second = words.candidates(words.cells(slices), bits(answers, PROBE))
        distinct, _, counts = _distinct_long(_long_cells(first, second, slices))
        out = []
        for part, (low, high) in _borders(distinct["a"]).items():
            short = np.diff((distinct["a"][low:high] & np.uint64(0xFFFFFFFF)).astype(np.uint32), prepend=np.uint32(0))
            data = np.ascontiguousarray(short.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() + distinct["b"][low:high].astype("<u8").tobytes()
            out.append((g, part, CANDIDATE, zstandard.compress(data, 1), np.packbits(counts[low:high] >= 2).tobytes()))
        return _messages(out)

    def cut(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not group.num_rows:
            return result(group, [], [], [], [])
        words = _Words(group.column(text_at), window)
        removed = np.zeros(len(words.hashes), bool)
        if answers.num_rows:
            at, first, second = words.candidates(words.cells(slices), bits(answers, PROBE))
            distinct, index, _ = _distinct_long(_long_cells(first, second, slices))
            repeated = np.zeros(len(distinct), bool)
            found = bits(answers, CANDIDATE)
            for part, (low, high) in _borders(distinct["a"]).items():
                if part in found:
                    repeated[low:high] = np.unpackbits(np.frombuffer(found[part][0], np.uint8), count=high - low)
            at = at[repeated[index]]
            change = np.zeros(len(removed) + 1, np.int64)
            np.add.at(change, at, 1)
            np.add.at(change, at + window, -1)
            removed = np.cumsum(change[:-1]) > 0
        counts = np.bincount(words.rows, minlength=group.num_rows)
        gone = np.bincount(words.rows[removed], minlength=group.num_rows)
        sums, kept = [], []
        raw = words.data.tobytes()
        for i in range(group.num_rows):
            low, high = words.offsets[i], words.offsets[i + 1]
            if not gone[i]:
                text = b" ".join(raw[low:high].split())
            else:
                mine = slice(words.first[i], words.first[i] + counts[i])
                stay = ~removed[mine]
                text = b" ".join(raw[a:b] for a, b in zip(words.starts[mine][stay].tolist(), words.ends[mine][stay].tolist(), strict=True))
            if with_text:
                kept.append(text.decode())
            else:
                sums.append(hashlib.sha256(text).hexdigest())
        return result(group, counts, gone, sums, kept)

    def result(group: pa.Table, counts, gone, sums, kept) -> pa.Table:
        shown = group.columns[1:] if with_text else [group.column(1)]
        last = pa.array(kept, pa.string()) if with_text else pa.array(sums, pa.string())
        arrays = [*shown, pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), last]
        return pa.table(arrays, names=[f"c{i}" for i in range(len(arrays))])

    message = grouped.groupBy("_g").applyInArrow(ask, MESSAGE)
    sent = message.repartitionById(slices, F.col("part").cast("int")).sortWithinPartitions("part", "kind")
    hits = sent.mapInArrow(_answer_anchors, MESSAGE)
    longer = grouped.groupBy("_g").cogroup(hits.groupBy("g")).applyInArrow(extend, MESSAGE)
    counted = longer.repartitionById(slices, F.col("part").cast("int")).sortWithinPartitions("part").mapInArrow(_answer_candidates, MESSAGE)
    answers = hits.unionByName(counted)
    kinds = dict(docs.dtypes)
    shown = names if with_text else ["doc_id"]
    schema = ", ".join([f"c{i} {kinds[c]}" for i, c in enumerate(shown)] + [f"c{len(shown)} long", f"c{len(shown) + 1} long", f"c{len(shown) + 2} string"])
    out = grouped.groupBy("_g").cogroup(answers.groupBy("g")).applyInArrow(cut, schema)
    return out.toDF(*shown, "n_words", "n_removed", "kept" if with_text else "kept_sha256")


def without_repeats(docs: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """``docs`` with every repeat removed from its text; rows without one stay as they
    are, text and all; n_chars, where there is one, follows the text.  No row goes."""
    taken = {"n_words", "n_removed", "kept"} & set(docs.columns)
    source = docs.withColumnsRenamed({c: f"_own_{c}" for c in taken})
    cut = repeats(source, window, with_text=True)
    changed = F.col("n_removed") > 0
    fresh = {"text": F.when(changed, F.col("kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.when(changed, F.length("kept").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars"))
    return cut.withColumns(fresh).drop("n_words", "n_removed", "kept").withColumnsRenamed({f"_own_{c}": c for c in taken}).select(*docs.columns)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))


OP1_SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
windows AS (SELECT doc_id, i, array_to_string(words[i : i + 34], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM d)),
starts AS (SELECT doc_id, i FROM windows WHERE s IN (SELECT s FROM windows GROUP BY s HAVING count(*) > 1)),
marked AS (SELECT w.doc_id, w.i, w.word, count(starts.i) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) > 0 AS gone FROM w LEFT JOIN starts ON starts.doc_id = w.doc_id AND starts.i = w.i),
kept AS (SELECT doc_id, count(*) AS n_words, count_if(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id"""
