"""Fixpoints over dependency graphs; cycles are fine."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: spark.checkpoint.dir, or what setCheckpointDir named.

    Where neither is set, a temporary folder is, but only if driver and tasks are one
    process (a local master); on a cluster, executors would not see it, so that fails.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        known = named.get() if named.isDefined() else None
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/") + "/factloom"


def stored(df: DataFrame) -> DataFrame:
    """Written once to the shared folder and read back, which cuts the lineage."""
    path = f"{scratch_dir(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join that deals out both sides and broadcasts neither.

    Spark takes a table for as large as its compressed files, and what is exploded or comes
    from Python for as large as what it was made of.  Either may be many times more, and a
    side that it therefore broadcasts goes through the driver whole.
    """
    return df.hint("merge")


def closure(edges: DataFrame, source: str = "src", target: str = "dst", starts: DataFrame | None = None) -> DataFrame:
    """(source, target) for every target reachable from a source over one edge or more,
    without the source itself; only from ``starts`` (column source), if given.

    Distances double: round k knows the pairs nearer than 2**k edges and those exactly as
    far, and goes on from both over the latter.  A shortest path of up to 2**(k + 1) edges
    is such a pair and then one of exactly 2**k, so nothing is missed, and a path of n
    edges takes as many rounds as n has binary digits.  Cycles end by themselves, as no
    pair is found twice.  All sources are walked, so give the edges that matter.
    """
    step = edges.select(F.col(source).alias("_a"), F.col(target).alias("_b")).where("_a != _b").distinct()
    rounds = [stored(step.withColumn("_far", F.lit(True)))]
    while True:
        last = rounds[-1]
        near = last.where("not _far")
        for before in rounds[:-1]:
            near = near.unionByName(before)
        known = near.withColumn("_far", F.lit(False)).unionByName(last.where("_far"))
        hop = last.where("_far").select(F.col("_a").alias("_b"), F.col("_b").alias("_c"))
        ahead = known.join(shuffled(hop), "_b").where("_a != _c").groupBy("_a", F.col("_c").alias("_b")).agg(F.bool_and("_far").alias("_far"))
        rounds.append(stored(ahead.join(shuffled(known.select("_a", "_b")), ["_a", "_b"], "left_anti")))
        if rounds[-1].where("_far").isEmpty():
            break
    found = rounds[0]
    for more in rounds[1:]:
        found = found.unionByName(more)
    found = found.select(F.col("_a").alias(source), F.col("_b").alias(target))
    return found if starts is None else found.join(shuffled(starts.select(source).distinct()), source, "left_semi")


def exclusive_reach(reach: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """source, transitive and exclusive: how many it reaches, and how many of them no
    other source reaches and are not sources themselves."""
    sources = reach.select(F.col(source).alias(target)).distinct()
    by = reach.groupBy(target).agg(F.count("*").alias("_reach"))
    alone = by.where("_reach = 1").join(sources, target, "left_anti").select(target, F.lit(1).alias("_alone"))
    return reach.join(alone, target, "left").groupBy(source).agg(F.count("*").alias("transitive"), F.count("_alone").alias("exclusive"))


def reached_by(reach: DataFrame, names: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """For each of ``names`` (column target) the first other source that reaches it."""
    first = reach.join(names.select(target).distinct(), target, "left_semi").where(F.col(source) != F.col(target))
    return first.groupBy(target).agg(F.min(source).alias("required_by"))
