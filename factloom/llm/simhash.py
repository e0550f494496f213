"""Operator 10: SimHash near-duplicates, linked through vantage-point trees.

1. Each text's 64-bit fingerprint is computed where the text lies (no shuffle).
2. Distinct fingerprints are dealt to shards by a vantage-point tree that is fitted
   on a bounded sample: each node compares the Hamming distance to its vantage
   point with a radius.  A fingerprint has one home shard, and also visits each
   shard that the triangle inequality cannot rule out within the link radius.
3. Each shard searches its own points with a local vantage-point tree and returns
   stars (member, smallest linked fingerprint), never all pairs.
4. Shards that stay large because their points are too close together to be told
   apart by distances go another exact way: two fingerprints differ in 2 bits or
   fewer exactly if they share one of the 65 values within one bit of each.
5. Stars become components by alternating large-star and small-star rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import stored, table
from factloom.operators.graph import shuffled

#: Differing bits up to which fingerprints link.
RADIUS = 2
SHINGLE_WORDS = 3
#: Fingerprints that fit the shard tree, and points wanted in a shard.
TREE_SAMPLE = 16_384
SHARD_POINTS = 4_096
#: Rows (points and visitors) above which a shard takes the one-bit-neighbour way.  Both
#: ways find the same links.  Distances alone would leave one task a shard of any size
#: (points that all lie near each other); the other way alone costs 65 rows a point.
HOT_ROWS = 200_000
#: Points that are compared directly.
BLOCK_POINTS = 256
SEED = 42
#: Copies of each fingerprint's component that its documents are joined to.
SALTS = 16


def fingerprint_of(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of one text (see ``fingerprints``)."""
    import xxhash

    token = (text or "").encode().lower().split()
    if not token:
        return 0
    hash_of = xxhash.xxh64_intdigest
    if len(token) < words:
        found = [hash_of(b" ".join(token), SEED)]
    else:
        found = [hash_of(b" ".join(x), SEED) for x in zip(*(token[i:] for i in range(words)), strict=False)]
    total = np.zeros(64, np.int64)
    for low in range(0, len(found), 16_384):
        part = np.array(found[low : low + 16_384], "<u8")
        total += np.add.reduce(np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64), axis=0, dtype=np.int32)
    return int(np.packbits(total * 2 > len(found), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of every text.

    A-Z are lower-cased; words are runs without ASCII white space; a text of fewer
    words than a shingle is one shingle; null, empty and blank texts have 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint_of(x.as_py()) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


@dataclass
class ShardTree:
    """Node i compares with vantage[i]: within radius[i] to near[i], else to far[i];
    a negative child is the shard -1 - child."""

    vantage: list[int] = field(default_factory=list)
    radius: list[int] = field(default_factory=list)
    near: list[int] = field(default_factory=list)
    far: list[int] = field(default_factory=list)
    shards: int = 0


def _split(points: np.ndarray) -> tuple[int, int] | None:
    """A vantage point and radius: of a few tried, those that split best, where points
    within the link radius of the border count against a split."""
    best = None
    for vantage in points[:: max(1, len(points) // 8)][:8]:
        distance = np.bitwise_count(points ^ vantage)
        counts = np.bincount(distance, minlength=65).astype(float)
        inside = np.cumsum(counts)
        total = inside[-1]
        for radius in np.flatnonzero((inside >= total / 8) & (inside <= total * 7 / 8)):
            border = inside[min(64, radius + RADIUS)] - (inside[radius - RADIUS] if radius >= RADIUS else 0)
            share = inside[radius] / total
            bits = -(share * np.log2(share) + (1 - share) * np.log2(1 - share))
            cost = np.log2(1 + border / total) / bits
            if best is None or cost < best[0]:
                best = (cost, int(vantage), int(radius))
    return None if best is None or best[0] > 0.95 else best[1:]


def fitted_tree(sample: np.ndarray, shards_wanted: float) -> ShardTree:
    """A tree over a sample of distinct fingerprints, with about that many shards."""
    tree = ShardTree()
    least = max(16, len(sample) / max(1.0, shards_wanted))

    def grow(points: np.ndarray) -> int:
        found = _split(points) if len(points) > least else None
        if found is None:
            tree.shards += 1
            return -tree.shards
        me = len(tree.vantage)
        for values, value in ((tree.vantage, found[0]), (tree.radius, found[1]), (tree.near, 0), (tree.far, 0)):
            values.append(value)
        inside = np.bitwise_count(points ^ np.uint64(found[0])) <= found[1]
        tree.near[me] = grow(points[inside])
        tree.far[me] = grow(points[~inside])
        return me

    grow(sample)
    return tree


def routes(tree: ShardTree, points: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of point, shard) for every shard that may hold a point within ``reach``."""
    if not tree.vantage:
        return np.arange(len(points)), np.zeros(len(points), np.int64)
    index, shard = [], []
    stack = [(0, np.arange(len(points)))]
    while stack:
        node, rows = stack.pop()
        if not len(rows):
            continue
        if node < 0:
            index.append(rows)
            shard.append(np.full(len(rows), -1 - node))
            continue
        distance = np.bitwise_count(points[rows] ^ np.uint64(tree.vantage[node])).astype(np.int64)
        stack.append((tree.near[node], rows[distance - reach <= tree.radius[node]]))
        stack.append((tree.far[node], rows[distance + reach > tree.radius[node]]))
    return np.concatenate(index), np.concatenate(shard)


def _stars(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components of the links a-b between indices of values, as (value, smallest value)."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = flat[: len(a)], flat[len(a) :]
    order = np.argsort(values[nodes])
    rank = np.empty(len(nodes), np.int64)
    rank[order] = np.arange(len(nodes))
    label = rank.copy()
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, order[label], new)  # hook the old roots, not only their members
        new = np.minimum(new, new[order[new]])
        if (new == label).all():
            break
        label = new
    member = values[nodes]
    root = member[order[label]]
    return member[member != root], root[member != root]


def _neighbour_links(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all indices whose values share a value within one bit of each."""
    flips = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])
    keys = (values[:, None] ^ flips[None, :]).ravel()
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    return order[1:][same] // 65, order[:-1][same] // 65


def shard_stars(points: np.ndarray, visitors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars of all links between points, and between points and visitors, of a shard."""
    values = np.concatenate([points, visitors])
    left, right = [], []
    stack = [(np.arange(len(points)), np.arange(len(values)))]
    while stack:
        home, guests = stack.pop()
        if not len(home):
            continue
        found = _split(values[home]) if len(home) > BLOCK_POINTS else None
        if found is None and len(home) > BLOCK_POINTS:
            a, b = _neighbour_links(values[guests])
            left.append(guests[a])
            right.append(guests[b])
            continue
        if found is None:
            for low in range(0, len(guests), 16_384):
                part = guests[low : low + 16_384]
                i, j = np.nonzero(np.bitwise_count(values[home][:, None] ^ values[part][None, :]) <= RADIUS)
                keep = home[i] != part[j]
                left.append(home[i[keep]])
                right.append(part[j[keep]])
            continue
        vantage, radius = np.uint64(found[0]), found[1]
        inside = np.bitwise_count(values[home] ^ vantage) <= radius
        distance = np.bitwise_count(values[guests] ^ vantage).astype(np.int64)
        stack.append((home[inside], guests[distance - RADIUS <= radius]))
        stack.append((home[~inside], guests[distance + RADIUS > radius]))
    if not left:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return _stars(np.concatenate(left), np.concatenate(right), values)


def links(nodes: DataFrame) -> DataFrame:
    """(a, b) with a and b in one component of ``nodes.fp`` (distinct longs) under the
    link radius; enough links to connect every component."""
    total = nodes.count()
    sample = nodes.orderBy(F.xxhash64("fp"), "fp").limit(TREE_SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    tree = fitted_tree(sample, total / SHARD_POINTS)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            at, home = routes(tree, points, 0)
            own = np.empty(len(points), np.int64)
            own[at] = home
            for low in range(0, len(points), 20_000):
                index, shard = routes(tree, points[low : low + 20_000], RADIUS)
                index = index + low
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(points[index].view(np.int64)), pa.array(own[index] == shard)], names=["shard", "fp", "home"])

    dealt = nodes.select("fp").mapInArrow(deal, "shard long, fp long, home boolean")
    sizes = dealt.groupBy("shard").count().where(F.col("count") > HOT_ROWS).select("shard").collect()
    hot = [r["shard"] for r in sizes]  # at most one number for each shard of the tree

    def search(group: pa.Table) -> pa.Table:
        points = group.column("fp").to_numpy().view(np.uint64)
        home = group.column("home").to_numpy()
        a, b = shard_stars(points[home], points[~home])
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    cold = dealt.where(~F.col("shard").isin(hot)) if hot else dealt
    found = cold.groupBy("shard").applyInArrow(search, "a long, b long")
    if hot:
        flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
        # A point has 65 rows, which Spark sizes as one: neither side may be broadcast.
        keyed = dealt.where(F.col("shard").isin(hot)).select("fp").distinct().select("fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("key"))
        least = keyed.groupBy("key").agg(F.min("fp").alias("b"))
        found = found.unionByName(keyed.join(shuffled(least), "key").where("fp != b").select(F.col("fp").alias("a"), "b").distinct())
    return found.distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable over the edges, for nodes with edges.

    Alternates large-star and small-star rounds until nothing changes; each round's
    edges are written to the shared folder.  A hot node costs one row for each of its
    edges: its smallest neighbour comes from a pre-aggregated group by, whose one row for
    each node may be broadcast where it is small: no file has a node in less than its bytes.
    """

    def sides(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))

    def least(both: DataFrame) -> DataFrame:
        return both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))

    def state(e: DataFrame) -> tuple:
        row = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)")).alias("s")).first()
        return row["n"], row["x"], row["s"]

    now = stored(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a != b").distinct(), "links")
    was, is_now = None, state(now)
    while was != is_now and is_now[0]:
        both = sides(now)
        large = both.join(least(both), "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        down = large.where("a != b").distinct().select(F.col("a").alias("u"), F.col("b").alias("v"))
        low = least(down)
        small = down.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = stored(small.where("a != b").distinct(), "links")
        was, is_now = is_now, state(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Every row has a row, repeated rows too; a row of null doc_id is linked like any
    other but never names a component while another doc_id is there.  Null, empty and blank
    texts have the fingerprint 0; texts are read whole, however long; an empty table gives
    none; columns besides doc_id and text are ignored.
    """
    marked = stored(fingerprints(docs), "fingerprints")
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = components(links(nodes))
    rooted = nodes.join(shuffled(found.withColumnRenamed("node", "fp")), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = rooted.join(shuffled(named), "root").select("fp", "component_id")
    # A fingerprint that a third of all documents share is no single key.
    salted = ids.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = marked.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return dealt.join(shuffled(salted), ["fp", "salt"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component.

    Rows that repeat a doc_id are one document and stay or go together; rows without a
    doc_id cannot be named and stay.  All texts without words are one group; an empty table
    stays empty; texts are read whole and all columns stay as they are.
    """
    kept = near_duplicates(docs).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
