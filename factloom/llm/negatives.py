"""Operator 11: hard negatives by inner product, with length buckets and coordinate pruning.

1. Rows are dealt to shards by length (ranges of the squared length, ties by a hash) and,
   within a shard, cut into buckets of like length.  A bucket holds, for each coordinate
   of its vectors made unit, their order by that coordinate.
2. A score of at least t needs a cosine of at least c = t / (|anchor| * longest of the
   bucket).  If c is over 1 no row of the bucket has it.  Else unit vectors that reach c
   lie within an angle of it in every coordinate, which gives a range of values for each
   coordinate; the anchor's focus coordinates (its largest) have the narrowest.
3. The sorted list of the focus coordinate with the fewest rows in its range gives the
   candidates, the ranges of the others are intersected with it, and what is left is
   verified by its exact score.
4. The least score t that can matter is known from a bounded sample of rows (any rows give
   a valid bound) and rises with what has been found.  Anchors are sent only to shards
   whose longest row can reach it.

The two searches (an anchor's positives, and the negatives below each) read one index,
which is written once.  An anchor row and a positive carry at most ``NEGATIVES`` rows out
of a shard.  Nothing is approximate: ranges are widened by rounding errors, and every
score is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import stored, table, width

#: Components are multiplied by this and rounded down.
SCALE = 256
#: Positives of an anchor, and negatives of a positive.
POSITIVES = 5
NEGATIVES = 5
#: A negative has at least 80 and at most 100 hundredths of its positive's score.
LEAST_SHARE, MOST_SHARE = 80, 100
#: Rows of a shard at most, and wanted at least; rows of a bucket.
SHARD_ROWS = 131_072
LEAST_ROWS = 4_096
BUCKET_ROWS = 2_048
#: Coordinates of an anchor whose ranges are intersected.
FOCUS = 6
#: Rows that give the first bounds.  They only save work.
SAMPLE_ROWS = 1_024
#: Anchors that are sent to shards at once.
SENT_ROWS = 4_096
#: By how much ranges of unit coordinates and cosines are widened.
SLACK = 1e-7
TOP, BOTTOM = (1 << 63) - 1, -(1 << 63)


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, label, v array<double>, dims, square) of the rows that take part: a vec_id,
    a label, and a vector with neither null nor non-finite components.  ``v`` holds
    floor(SCALE * x); a label moves on by one (of ten) where vec_id is divisible by 7."""
    fine = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e")).where("vec_id is not null and label is not null and e is not null")
    fine = fine.where(~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x * SCALE) == float("inf"))))
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    # Not F.floor, which gives longs: components may be larger.
    scaled = F.transform("e", lambda x: F.rint(x * SCALE) - F.when(F.rint(x * SCALE) > x * SCALE, 1.0).otherwise(0.0))
    out = fine.select("vec_id", label.alias("label"), scaled.alias("v"))
    return out.withColumn("dims", F.size("v")).withColumn("square", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))


def _stacked(column, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def exact_scores(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of whole-numbered rows as longs; beyond 64 bits, the nearest long."""
    if not len(v) or not v.shape[1]:
        return np.zeros(len(v), np.int64)
    most = float(np.abs(v).max()) * float(np.abs(q).max()) * v.shape[1]
    if most < 1 << 53:
        return (v @ q).astype(np.int64)
    if most < 1 << 62:
        return v.astype(np.int64) @ q.astype(np.int64)
    whole = [int(x) for x in q]
    return np.array([min(TOP, max(BOTTOM, sum(int(x) * y for x, y in zip(row, whole, strict=True)))) for row in v], np.int64)


class Bucket:
    """Rows of like length with a sorted list for each coordinate."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, order: np.ndarray | None = None):
        self.ids, self.labels, self.v = ids, labels, v
        # Scaled before they are squared, so no length overflows.
        most = np.abs(v).max(axis=1, initial=0.0)
        fit = np.where(most > 0, most, 1)
        lengths = np.sqrt(((v / fit[:, None]) ** 2).sum(axis=1)) * fit
        self.longest = float(lengths.max(initial=0.0)) * (1 + SLACK)
        self.unit = v / np.where(lengths > 0, lengths, 1)[:, None]
        self.order = np.argsort(self.unit, axis=0, kind="stable").astype(np.int32).T.copy() if order is None else order
        self.sorted = np.take_along_axis(self.unit.T, self.order, axis=1)

    def candidates(self, unit: np.ndarray, length: float, focus: np.ndarray, least: int) -> np.ndarray | None:
        """Indices of the rows that may score ``least`` or more; None stands for all."""
        if least <= 0 or not length or not self.longest:
            return None if least <= 0 else np.zeros(0, np.int64)
        cosine = least / (length * self.longest) - SLACK
        if cosine > 1:
            return np.zeros(0, np.int64)
        angle, reach = np.arccos(np.clip(unit[focus], -1, 1)), np.arccos(cosine)
        low, high = np.cos(np.minimum(np.pi, angle + reach)) - SLACK, np.cos(np.maximum(0, angle - reach)) + SLACK
        first = [int(np.searchsorted(self.sorted[f], x, "left")) for f, x in zip(focus, low, strict=True)]
        after = [int(np.searchsorted(self.sorted[f], x, "right")) for f, x in zip(focus, high, strict=True)]
        sizes = np.subtract(after, first)
        best = int(np.argmin(sizes))
        found = self.order[focus[best], first[best] : after[best]]
        for k in np.argsort(sizes):
            if k != best and sizes[k] < len(self.ids):
                x = self.unit[found, focus[k]]
                found = found[(x >= low[k]) & (x <= high[k])]
        return found


def _first(scores: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """Indices of the ``count`` highest scores, ties to smaller ids."""
    if len(scores) > 4 * count:
        line = np.partition(scores, len(scores) - count)[len(scores) - count]
        some = np.flatnonzero(scores >= line)
        return some[np.lexsort((ids[some], -scores[some]))[:count]]
    return np.lexsort((ids, -scores))[:count]


def _share(score: int) -> int:
    """The least whole score s with LEAST_SHARE * score <= MOST_SHARE * s."""
    return -(-LEAST_SHARE * score // MOST_SHARE)


class Search:
    """What one anchor has found so far: its best ``count`` rows of its own label, or, if
    it has positives, for each of them its best rows of other labels within the range."""

    def __init__(self, anchor: int, label: int, q: np.ndarray, positives: list[int] | None, bounds: list[int] | None):
        self.anchor, self.label, self.q = anchor, label, q
        self.tops = [TOP] if positives is None else positives
        self.count = POSITIVES if positives is None else NEGATIVES
        self.own = positives is None
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in self.tops]
        self.least = list(bounds) if bounds else [BOTTOM if self.own else _share(p) if p >= 0 else TOP for p in self.tops]
        most = float(np.abs(q).max(initial=0.0))
        self.length = float(np.sqrt(((q / most) ** 2).sum()) * most) if most else 0.0
        self.unit = q / self.length if self.length else q
        self.focus = np.argsort(-np.abs(q), kind="stable")[:FOCUS]

    def visit(self, bucket: Bucket) -> None:
        if bucket.v.shape[1] != len(self.q) or not self.tops:
            return
        rows = bucket.candidates(self.unit, self.length, self.focus, min(self.least))
        rows = np.arange(len(bucket.ids)) if rows is None else rows
        wanted = bucket.labels[rows] == self.label if self.own else bucket.labels[rows] != self.label
        rows = rows[wanted & (bucket.ids[rows] != self.anchor)]
        if not len(rows):
            return
        scores, ids = exact_scores(bucket.v[rows], self.q), bucket.ids[rows]
        for i, top in enumerate(self.tops):
            fit = (scores >= self.least[i]) & (scores <= top)
            if not fit.any():
                continue
            s, x = np.concatenate([self.found[i][0], scores[fit]]), np.concatenate([self.found[i][1], ids[fit]])
            best = _first(s, x, self.count)
            self.found[i] = s[best], x[best]
            if len(best) == self.count:
                self.least[i] = int(s[best[-1]])


INDEX = "shard int, bucket int, dims int, longest double, ids binary, labels binary, vectors binary, order binary"
NAMES = ["shard", "bucket", "dims", "longest", "ids", "labels", "vectors", "order"]


def built(rows: DataFrame) -> DataFrame:
    """The index of ``usable`` rows: one row for each bucket, written once."""
    total = rows.count()
    n = max(1, min(width(rows.sparkSession), -(-total // LEAST_ROWS)), -(-total // SHARD_ROWS))
    dealt = rows.repartitionByRange(n, "dims", "square", F.xxhash64("vec_id", "v")).withColumn("shard", F.spark_partition_id())
    # The borders of ranges come from a sample, so rows are written with their shard.
    dealt = stored(dealt, "lengths")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A shard's rows come together, longest first, and number SHARD_ROWS at most or so.
        held: list[pa.RecordBatch] = []
        state = {"shard": None, "bucket": 0}

        def bucket() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            dims = whole.column("dims")[0].as_py()
            made = Bucket(whole.column("vec_id").to_numpy(), whole.column("label").to_numpy(), _stacked(whole.column("v"), dims))
            row = {
                "shard": whole.column("shard")[0].as_py(), "bucket": state["bucket"], "dims": dims, "longest": made.longest,
                "ids": made.ids.tobytes(), "labels": made.labels.tobytes(), "vectors": made.v.tobytes(), "order": made.order.tobytes(),
            }
            state["bucket"] += 1
            held.clear()
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            shard, dims = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(dims) != 0)) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                key = (int(shard[begin]), int(dims[begin]))
                if held and key != state["shard"]:
                    yield bucket()
                state["shard"] = key
                while begin < end:
                    room = min(end, begin + BUCKET_ROWS - sum(b.num_rows for b in held))
                    held.append(batch.slice(begin, room - begin))
                    begin = room
                    if sum(b.num_rows for b in held) == BUCKET_ROWS:
                        yield bucket()
        if held:
            yield bucket()

    schema = pa.schema([("shard", pa.int32()), ("bucket", pa.int32()), ("dims", pa.int32()), ("longest", pa.float64()), ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary()), ("order", pa.binary())])
    shards = (dealt.agg(F.max("shard")).first()[0] or 0) + 1
    sorted_rows = dealt.select("shard", "vec_id", "label", "dims", "v", "square").repartitionById(shards, "shard").sortWithinPartitions("shard", "dims", F.desc("square"), "vec_id")
    return stored(sorted_rows.mapInArrow(build, INDEX), "buckets")


def _opened(row: dict) -> Bucket:
    ids = np.frombuffer(row["ids"], np.int64)
    v = np.frombuffer(row["vectors"], np.float64).reshape(len(ids), row["dims"])
    return Bucket(ids, np.frombuffer(row["labels"], np.int64), v, np.frombuffer(row["order"], np.int32).reshape(row["dims"], len(ids)))


ASKED = "anchor_id long, label long, v array<double>, positives array<long>"


def bounded(asked: DataFrame, sample: list[tuple[int, int, list[float]]], shards: list[tuple[int, int, float]]) -> DataFrame:
    """``asked`` with ``bounds`` from the sample, once for each shard that can hold a row
    above them.  ``shards`` has (shard, dims, longest) of each, a few numbers a shard."""
    by_dims: dict[int, list[tuple[int, int, list[float]]]] = {}
    for row in sample:
        by_dims.setdefault(len(row[2]), []).append(row)
    columns = {d: (np.array([r[0] for r in x], np.int64), np.array([r[1] for r in x], np.int64), np.array([r[2] for r in x], np.float64).reshape(len(x), d)) for d, x in by_dims.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = {d: Bucket(*x) for d, x in columns.items()}
        for batch in batches:
            at, to, bounds = [], [], []
            for i, (anchor, label, v, positives) in enumerate(zip(*[c.to_pylist() for c in batch.columns], strict=True)):
                search = Search(anchor, label, np.array(v, np.float64), positives, None)
                if len(v) in buckets:
                    search.visit(buckets[len(v)])
                least = min(search.least, default=TOP)
                for shard, dims, longest in shards:
                    if dims == len(v) and (least <= 0 or least <= search.length * longest * (1 + SLACK)):
                        at.append(i)
                        to.append(shard)
                        bounds.append(search.least)
            for low in range(0, len(at), SENT_ROWS):
                some = slice(low, low + SENT_ROWS)
                rows = batch.take(pa.array(at[some], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(to[some], pa.int32()), *rows.columns, pa.array(bounds[some], pa.list_(pa.int64()))], names=["shard", "anchor_id", "label", "v", "positives", "bounds"])

    return asked.select("anchor_id", "label", "v", "positives").mapInArrow(run, f"shard int, {ASKED}, bounds array<long>")


FOUND = "anchor_id long, label long, h long, place int, score long, vec_id long"


def searched(index: DataFrame, asked: DataFrame, shards: int) -> DataFrame:
    """(anchor_id, label, h, place, score, vec_id): what each shard has found for each row
    of ``asked`` (see ``bounded``); ``place`` counts its positives, ``h`` tells its vector."""
    empty = {"anchor_id": "long", "label": "long", "v": "array<double>", "positives": "array<long>", "bounds": "array<long>", "h": "long"}
    # A partition is a shard: its buckets come first, and then the anchors stream by.
    held = index.select("shard", F.lit(0).alias("kind"), (-F.col("longest")).alias("by"), F.struct(*NAMES).alias("b"), *[F.lit(None).cast(t).alias(c) for c, t in empty.items()])
    asks = asked.select("shard", F.lit(1).alias("kind"), F.lit(0.0).alias("by"), F.lit(None).cast(held.schema["b"].dataType).alias("b"), "anchor_id", "label", "v", "positives", "bounds", F.xxhash64("v").alias("h"))
    both = held.unionByName(asks).repartitionById(shards, "shard").sortWithinPartitions("shard", "kind", "by")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, buckets = None, []
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            rows: list[tuple] = []
            for i, (of, kind) in enumerate(zip(columns[0].to_pylist(), columns[1].to_pylist(), strict=True)):
                if of != shard:
                    shard, buckets = of, []
                if kind == 0:
                    buckets.append(_opened(columns[3][i].as_py()))
                    continue
                anchor, label, v, positives, bounds, h = (c[i].as_py() for c in columns[4:])
                one = Search(anchor, label, np.array(v, np.float64), positives, bounds)
                for bucket in buckets:
                    one.visit(bucket)
                rows += [(anchor, label, h, place, s, x) for place, (scores, ids) in enumerate(one.found) for s, x in zip(scores.tolist(), ids.tolist(), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=["anchor_id", "label", "h", "place", "score", "vec_id"])

    TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    return both.mapInArrow(search, FOUND)


def _merged(found: DataFrame, count: int) -> DataFrame:
    """The first ``count`` of what the shards found; each gives ``count`` at most."""
    # ~score turns the order round for every long.
    ranked = F.array_sort(F.collect_list(F.struct(F.expr("~score").alias("away"), "vec_id")))
    top = found.groupBy("anchor_id", "label", "h", "place").agg(F.slice(ranked, 1, count).alias("top"))
    return top.select("anchor_id", "label", "h", "place", F.transform("top", lambda x: F.struct(F.bitwise_not(x["away"]).alias("score"), x["vec_id"].alias("vec_id"))).alias("top"))


def hard_negatives(rows: DataFrame, anchors) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` is a condition on vec_id.  An anchor's positives are its first
    ``POSITIVES`` rows of its label, a positive's negatives the first ``NEGATIVES`` rows of
    other labels that score at most as much as it and at least ``LEAST_SHARE`` hundredths
    of that; first means by falling score, ties to the smaller vec_id.

    Rows that are not ``usable`` take no part; columns besides vec_id, label and embedding
    are ignored.  Vectors of different lengths have no inner product and do not meet.  Rows
    that repeat a vec_id are rows each, but none is a positive or negative of that vec_id;
    an anchor that is repeated whole asks once.  A positive without such negatives, an
    anchor without positives and an empty table give no row.
    """
    spark = rows.sparkSession
    fine = stored(usable(rows), "vectors")
    index = built(fine)
    shards = [(r["shard"], r["dims"], r["longest"]) for r in index.groupBy("shard", "dims").agg(F.max("longest").alias("longest")).collect()]
    count = max((s for s, _, _ in shards), default=0) + 1
    sample = [(r["vec_id"], r["label"], r["v"]) for r in fine.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).collect()]
    asking = fine.where(anchors).select(F.col("vec_id").alias("anchor_id"), "label", "v").distinct()

    def best(asked: DataFrame, each: int) -> DataFrame:
        return _merged(searched(index, bounded(asked, sample, shards), count), each)

    own = stored(best(asking.withColumn("positives", F.lit(None).cast("array<long>")), POSITIVES).select("anchor_id", "label", "h", F.col("top").alias("positive")), "positives")
    asking = asking.withColumn("h", F.xxhash64("v")).join(own, ["anchor_id", "label", "h"])
    others = best(asking.select("anchor_id", "label", "v", F.col("positive.score").alias("positives")), NEGATIVES)
    pairs = others.join(own, ["anchor_id", "label", "h"]).select("anchor_id", F.expr("positive[place]").alias("p"), F.posexplode("top").alias("at", "n"))
    return pairs.select("anchor_id", F.col("p.vec_id").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("n.score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH fine AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS own, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM fine a JOIN fine b ON a.vec_id != b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT * FROM scored WHERE own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
pairs AS (SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
    n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.own AND 80 * p.score <= 100 * n.score AND n.score <= p.score)
SELECT * FROM pairs WHERE rank <= 5
"""
