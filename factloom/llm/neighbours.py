"""Operator 8: approximate nearest neighbours by inner product, with a hierarchical
navigable small-world graph for each shard.

1. Vectors that are equal are one point, which keeps the smallest vec_ids (as ties go
   to them, more could never be returned); they are reduced before any shuffle.
2. Points are dealt to shards by hash.  A search grows with the logarithm of a shard, so
   few large shards beat many small ones: a shard has ``LEAST_POINTS`` points or more,
   beyond that shards are added to keep all shuffle partitions busy, and none grows above
   ``SHARD_POINTS``.  So the shards that a query visits follow the points.
3. A graph is built for each shard and written as flat arrays to the shared folder.
4. A query visits every shard; the shards' results are merged by the exact measure on
   the original vectors.  (Sending a query to the nearest of clustered shards only was
   measured and dropped: on vectors without clusters half the shards find 0.81.)

Inner product becomes distance by one more dimension, sqrt(longest² - |x|²), which is 0
for a query; so vectors need not have one length.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import stored, table, width

#: Points of a shard at most, and wanted at least.
SHARD_POINTS = 262_144
LEAST_POINTS = 4_096
#: Links of a node (twice as many on the lowest level), and breadths of the searches.
LINKS = 16
BUILD_BREADTH = 64
SEARCH_BREADTH = 100


class Graph:
    """The graph of one shard: ``links[level]`` is a flat array of neighbours, ``width``
    for each node of that level, -1 where there are fewer."""

    def __init__(self, vectors: np.ndarray, seed: int = 7):
        self.vectors = np.ascontiguousarray(vectors, np.float32)
        n = len(vectors)
        draw = np.random.default_rng(seed).random(n)
        self.levels = np.minimum((-np.log(1 - draw) / np.log(LINKS)).astype(np.int64), 12)
        self.links = [np.full((n, 2 * LINKS), -1, np.int32)]
        self.rows = [np.arange(n, dtype=np.int32)]
        for level in range(1, int(self.levels.max(initial=0)) + 1):
            here = self.levels >= level
            row = np.full(n, -1, np.int32)
            row[here] = np.arange(int(here.sum()))
            self.rows.append(row)
            self.links.append(np.full((int(here.sum()), LINKS), -1, np.int32))
        self.entry = -1
        self.seen = np.zeros(n, np.int32)
        self.visit = 0

    def build(self) -> Graph:
        for node in range(len(self.vectors)):
            self._insert(node)
        return self

    def _search(self, query: np.ndarray, enter: list[tuple[float, int]], breadth: int, level: int) -> list[tuple[float, int]]:
        """The nearest (nearness, node) found on a level, nearest first."""
        self.visit += 1
        seen, visit, links, rows, vectors = self.seen, self.visit, self.links[level], self.rows[level], self.vectors
        ahead = [(-s, x) for s, x in enter]
        best = list(enter)
        for _, x in enter:
            seen[x] = visit
        heapq.heapify(ahead)
        heapq.heapify(best)
        while ahead:
            away, node = heapq.heappop(ahead)
            if -away < best[0][0] and len(best) >= breadth:
                break
            near = links[rows[node]]
            near = near[near >= 0]
            near = near[seen[near] != visit]
            if not len(near):
                continue
            seen[near] = visit
            scores = vectors[near] @ query
            if len(best) >= breadth:
                good = scores > best[0][0]
                near, scores = near[good], scores[good]
            for s, x in zip(scores.tolist(), near.tolist(), strict=True):
                if len(best) < breadth:
                    heapq.heappush(best, (s, x))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, x))
                else:
                    continue
                heapq.heappush(ahead, (-s, x))
        return sorted(best, reverse=True)

    def _chosen(self, found: list[tuple[float, int]], count: int) -> list[int]:
        """Of nearest-first nodes, those nearer to the centre than to any chosen before;
        the rest fill up."""
        if len(found) <= count:
            return [x for _, x in found]
        nodes = np.array([x for _, x in found])
        between = self.vectors[nodes] @ self.vectors[nodes].T
        chosen, left, most = [], [], np.full(len(nodes), -np.inf)
        for i, (s, _) in enumerate(found):
            if s > most[i]:
                chosen.append(i)
                if len(chosen) == count:
                    break
                np.maximum(most, between[i], out=most)
            else:
                left.append(i)
        return nodes[(chosen + left)[:count]].tolist()

    def _insert(self, node: int) -> None:
        level = int(self.levels[node])
        if self.entry < 0:
            self.entry = node
            return
        query = self.vectors[node]
        at = [(float(self.vectors[self.entry] @ query), self.entry)]
        top = int(self.levels[self.entry])
        for high in range(top, level, -1):
            at = self._search(query, at, 1, high)[:1]
        for low in range(min(top, level), -1, -1):
            found = self._search(query, at, BUILD_BREADTH, low)
            links, rows = self.links[low], self.rows[low]
            chosen = self._chosen(found, LINKS)
            links[rows[node], : len(chosen)] = chosen
            for other in chosen:
                mine = links[rows[other]]
                free = int((mine >= 0).sum())
                if free < len(mine):
                    mine[free] = node
                    continue
                around = np.append(mine, node)
                scores = self.vectors[around] @ self.vectors[other]
                order = np.argsort(-scores)
                mine[:] = self._chosen([(float(scores[i]), int(around[i])) for i in order], len(mine))
            at = found
        if level > top:
            self.entry = node

    def nearest(self, query: np.ndarray, breadth: int) -> list[int]:
        if self.entry < 0:
            return []
        at = [(float(self.vectors[self.entry] @ query), self.entry)]
        for high in range(int(self.levels[self.entry]), 0, -1):
            at = self._search(query, at, 1, high)[:1]
        return [x for _, x in self._search(query, at, breadth, 0)]


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), -1)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<float>) of the rows that take part: those with a vec_id and a
    vector that is not null, empty or zero, holds no null or non-finite component and
    has the most common length (the longer one if two are as common)."""
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("v")).where("vec_id is not null and size(v) > 0")
    fine = source.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).where(F.exists("v", lambda x: x != 0))
    sizes = fine.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return fine.where(F.size("v") == (sizes["n"] if sizes else 0))


def distinct_points(rows: DataFrame, keep: int) -> DataFrame:
    """(key, ids, v): one row for each different vector, with its ``keep`` smallest
    vec_ids in order; the key is the smallest.

    Repeats meet first within an Arrow batch, then within salted groups of batches, so
    no task gathers more than a few ids for each batch of a vector that is everywhere.
    """

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            v = _matrix(batch.column(1)) + np.float32(0)  # -0.0 becomes 0.0
            ids = batch.column(0).to_numpy()
            whole = np.ascontiguousarray(v).view(np.dtype((np.void, v.shape[1] * 4))).ravel()
            _, first, inverse = np.unique(whole, return_index=True, return_inverse=True)
            order = np.lexsort((ids, inverse))
            groups = np.split(ids[order], np.flatnonzero(np.diff(inverse[order])) + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([v[i].tobytes() for i in first], pa.binary()), pa.array([g[:keep] for g in groups], pa.list_(pa.int64())), pa.array(np.full(len(first), number % 16, np.int32))],
                names=["v", "ids", "salt"],
            )

    def merged(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, keep).alias("ids"))

    parts = rows.select("vec_id", "v").mapInArrow(reduce, "v binary, ids array<long>, salt int")
    salted = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)) * 16 + F.col("salt"))
    return merged(merged(salted, "v", "salt"), "v").select(F.col("ids")[0].alias("key"), "ids", "v")


def _lifted(v: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(longest * longest - (v.astype(np.float64) ** 2).sum(1), 0))
    return np.concatenate([v, rest[:, None].astype(np.float32)], axis=1)


GRAPH = pa.schema([("shard", pa.int32()), ("longest", pa.float64()), ("dims", pa.int64()), ("entry", pa.int64()), ("levels", pa.binary()), ("links", pa.list_(pa.binary())), ("vectors", pa.binary()), ("ids", pa.list_(pa.list_(pa.int64())))])
GRAPH_SQL = "shard int, longest double, dims long, entry long, levels binary, links array<binary>, vectors binary, ids array<array<long>>"


def built(points: DataFrame) -> DataFrame:
    """The index of ``distinct_points``: a row for each shard, written once."""
    total = points.count()
    shards = max(1, min(width(points.sparkSession), -(-total // LEAST_POINTS)), -(-total // SHARD_POINTS))

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            squares = [float((np.frombuffer(x, np.float32).astype(float) ** 2).sum()) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"x": pa.array([max(squares, default=0.0)], pa.float64())})

    longest = float(np.sqrt(points.select("v").mapInArrow(lengths, "x double").agg(F.max("x")).first()[0] or 0.0))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches), pa.schema([("shard", pa.int32()), ("key", pa.int64()), ("ids", pa.list_(pa.int64())), ("v", pa.binary())]))
        if not rows.num_rows:
            return
        rows = rows.sort_by("key")
        v = np.stack([np.frombuffer(x, np.float32) for x in rows.column("v").to_pylist()])
        graph = Graph(_lifted(v, longest)).build()
        row = {
            "shard": rows.column("shard")[0].as_py(), "longest": longest, "dims": v.shape[1], "entry": graph.entry, "levels": graph.levels.astype(np.int8).tobytes(),
            "links": [x.tobytes() for x in graph.links], "vectors": v.tobytes(), "ids": rows.column("ids").to_pylist(),
        }
        yield pa.RecordBatch.from_pylist([row], schema=GRAPH)

    dealt = points.select(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), "key", "ids", "v").repartitionById(shards, "shard")
    return stored(dealt.mapInArrow(build, GRAPH_SQL), "graphs")


def _opened(row: dict) -> tuple[Graph, np.ndarray]:
    v = np.frombuffer(row["vectors"], np.float32).reshape(-1, row["dims"])
    graph = Graph(_lifted(v, row["longest"]))
    graph.levels = np.frombuffer(row["levels"], np.int8).astype(np.int64)
    graph.links = [np.frombuffer(x, np.int32).reshape(-1, LINKS * (2 if i == 0 else 1)) for i, x in enumerate(row["links"])]
    graph.rows = [np.where(graph.levels >= i, np.cumsum(graph.levels >= i) - 1, -1).astype(np.int32) for i in range(len(row["links"]))]
    graph.entry = row["entry"]
    return graph, v


def searched(graphs: DataFrame, queries: DataFrame, k: int, breadth: int = SEARCH_BREADTH) -> DataFrame:
    """(key, found array<struct<score, vec_id>>): for each query point (key, v binary) its
    k + 1 nearest rows found, nearest first, ties to the smaller vec_id."""
    shards = graphs.agg(F.max("shard")).first()[0]
    shards = 0 if shards is None else shards + 1
    # A partition is a shard: its graph comes first, and then the queries stream by.
    index = graphs.select("shard", F.lit(0).alias("kind"), F.struct(*GRAPH.names).alias("graph"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("binary").alias("v"))
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(max(0, shards - 1)))).alias("shard"), F.lit(1).alias("kind"), F.lit(None).cast(index.schema["graph"].dataType).alias("graph"), "key", "v")
    both = index.unionByName(asked).repartitionById(max(1, shards), "shard").sortWithinPartitions("shard", "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = None
        for batch in batches:
            keys, scores, ids = [], [], []
            for i, kind in enumerate(batch.column(1).to_pylist()):
                if kind == 0:
                    row = batch.column(2)[i].as_py()
                    opened = (*_opened(row), row["ids"])
                    continue
                if opened is None:
                    continue
                graph, v, owners = opened
                query = np.frombuffer(batch.column(4)[i].as_py(), np.float32)
                found = graph.nearest(np.append(query, np.float32(0)), max(breadth, k + 1))
                exact = (v[found].astype(np.float64) * query.astype(np.float64)).sum(axis=1)
                nearest = sorted((-s, x) for s, n in zip(exact.tolist(), found, strict=True) for x in owners[n])[: k + 1]
                keys += [batch.column(3)[i].as_py()] * len(nearest)
                scores += [-s for s, _ in nearest]
                ids += [x for _, x in nearest]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(scores, pa.float64()), pa.array(ids, pa.int64())], names=["key", "score", "vec_id"])

    found = both.mapInArrow(search, "key long, score double, vec_id long")
    # At most k + 1 rows from each shard.
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("away"), "vec_id")))
    top = found.groupBy("key").agg(F.slice(ranked, 1, k + 1).alias("top"))
    return top.select("key", F.transform("top", lambda x: F.struct((-x["away"]).alias("score"), x["vec_id"].alias("vec_id"))).alias("found"))


def nearest(vectors: DataFrame, asks, k: int = 20, breadth: int = SEARCH_BREADTH) -> DataFrame:
    """query_id, rank, vec_id, score: for each row for which the condition ``asks`` (on
    vec_id) holds, the k nearest other rows found, or all of them if there are fewer.

    Rows that are not usable (see ``usable``; so vectors of a less common length) neither
    ask nor are found; an empty table gives no row.  Rows that repeat a vec_id are
    candidates each, but none of them for a query of that vec_id.
    """
    rows = usable(vectors)
    points = stored(distinct_points(rows, k + 1), "points")
    graphs = built(points)
    asking = rows.where(asks).select("vec_id", "v").distinct()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(1)) + np.float32(0) if batch.num_rows else np.zeros((0, 1), np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in v], pa.binary())], names=["query_id", "v"])

    keyed = asking.mapInArrow(coded, "query_id long, v binary").join(points.select("key", "v"), "v")
    keyed = stored(keyed.select("query_id", "key"), "queries")
    different = keyed.select("key").distinct().join(points.select("key", "v"), "key")
    found = searched(graphs, different, k, breadth)
    best = keyed.join(found, "key").select("query_id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    ranked = best.select("query_id", F.posexplode("found").alias("at", "f"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "f.vec_id", "f.score")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
