"""Joins that plain keys do not give: nearest ancestor, longest prefix, ranges, unique
matches, differences of snapshots.  Each is rewritten to equi-joins, so none plans as a
nested loop; none needs a side to be small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import paths


def nearest_ancestor(items: DataFrame, roots: DataFrame, item_dir: str, root_dir: str, order: list | None = None, strict: bool = False, extra: list[str] | None = None) -> DataFrame:
    """``items`` with the columns of the deepest root at or above each item's directory
    (null without one).  Ties of equal depth go by ``order``; ``extra`` columns must be
    equal on both sides.  Rows of items may repeat."""
    extra = extra or []
    # Keyed by the different folders, so nothing rests on the order in which rows come.
    places = items.select(F.col(item_dir).alias("_dir"), *extra).distinct()
    chain = places.select("_dir", *extra, F.explode(paths.ancestors(F.col("_dir"), strict=strict)).alias("_at"))
    hits = chain.join(roots.withColumn("_at", F.col(root_dir)), ["_at", *extra])
    kept = [c for c in roots.columns if c not in extra]
    w = Window.partitionBy("_dir", *extra).orderBy(paths.depth(F.col("_at")).desc(), *(order or [F.struct(*[F.col(c) for c in kept]).desc()]))
    best = hits.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("_dir", *extra, *kept)
    return items.withColumn("_dir", F.col(item_dir)).join(best, ["_dir", *extra], "left").drop("_dir").select(*items.columns, *kept)


def longest_prefix(items: DataFrame, prefixes: DataFrame, path: str, prefix: str, separator: str = "/") -> DataFrame:
    """``items`` with the longest prefix (whole segments) of ``path`` found in
    ``prefixes``, null without one."""
    parts = F.split(F.col(path), F.lit("\\Q" + separator + "\\E"))
    chain = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), separator))
    exploded = items.select(path).distinct().select(path, F.explode(chain).alias(prefix))
    best = exploded.join(prefixes.select(prefix).distinct(), prefix).groupBy(path).agg(F.max_by(prefix, F.length(prefix)).alias(prefix))
    return items.join(best, path, "left")


def range_overlap(intervals: DataFrame, points: DataFrame, keys: list[str], low: str, high: str, point: str, width: int) -> DataFrame:
    """Rows of ``intervals`` that hold at least one of ``points`` (same keys, low <= point
    <= high).  Both are cut to buckets of ``width``, so a long interval costs its buckets."""
    bucket = lambda c: F.floor(F.col(c) / width)
    cut = intervals.withColumn("_b", F.explode(F.sequence(bucket(low), bucket(high))))
    marks = points.select(*keys, F.col(point).alias("_p")).distinct().withColumn("_b", F.floor(F.col("_p") / width))
    return cut.join(marks, [*keys, "_b"]).where(F.col("_p").between(F.col(low), F.col(high))).drop("_b", "_p").distinct()


def prefix_listed(items: DataFrame, name: Column, exact: list[str], prefixes: list[str]) -> DataFrame:
    """``items`` whose name is listed exactly or starts with a listed prefix."""
    hit = name.isin(*exact) if exact else F.lit(False)
    for p in prefixes:
        hit = hit | F.startswith(name, F.lit(p))
    return items.where(hit)


def unique_match(items: DataFrame, candidates: DataFrame, key: str, value: str) -> DataFrame:
    """``items`` with ``value`` where the key has exactly one different value, else null."""
    one = candidates.groupBy(key).agg(F.count_distinct(value).alias("_n"), F.min(value).alias(value)).where("_n = 1").drop("_n")
    return items.join(one, key, "left")


def snapshot_diff(base: DataFrame, head: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, change (added, removed or changed), before and after of two snapshots with
    unique keys; null equals null."""
    old = base.select(*keys, F.struct(value).alias("_old"))
    new = head.select(*keys, F.struct(value).alias("_new"))
    both = old.join(new, keys, "full_outer")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return both.select(*keys, change.alias("change"), F.col(f"_old.{value}").alias("before"), F.col(f"_new.{value}").alias("after")).where("change is not null")


def moved_pairs(diff: DataFrame, name: str, kind: str) -> DataFrame:
    """name, from and to of removals and additions of one name under different kinds,
    paired in the order of the kinds."""
    w = Window.partitionBy(name).orderBy(kind)
    ranked = lambda change, out: diff.where(F.col("change") == change).select(name, F.col(kind).alias(out), F.row_number().over(w).alias("_r"))
    return ranked("removed", "from_kind").join(ranked("added", "to_kind"), [name, "_r"]).drop("_r")


def symmetric_mismatch(left: DataFrame, right: DataFrame, key: str, left_says: str, right_says: str) -> DataFrame:
    """key and side of keys that only one side has."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    only = lambda x, y, says: x.join(y, key, "left_anti").withColumn("side", F.lit(says))
    return only(a, b, left_says).unionByName(only(b, a, right_says))
