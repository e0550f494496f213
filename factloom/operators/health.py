"""Registry facts of direct dependencies, by the one version that is locked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def locked_version(dependencies: DataFrame, nodes: DataFrame) -> DataFrame:
    """ecosystem, project, name, version, origin of direct dependencies with exactly one
    locked pair of version and origin."""
    key = ["ecosystem", "project", "name"]
    pairs = nodes.select(*key, F.struct("version", "origin").alias("p"))
    one = pairs.groupBy(*key).agg(F.count_distinct("p").alias("n"), F.min("p").alias("p")).where("n = 1").select(*key, "p.version", "p.origin")
    return dependencies.select(*key).distinct().join(one, key)


def facts(locked: DataFrame, registry: DataFrame) -> DataFrame:
    """signal and statement rows: deprecated, archived, published.  A version that the
    registry table answers twice is not believed."""
    key = ["ecosystem", "name", "version"]
    sure = registry.join(registry.groupBy(*key).count().where("count = 1").select(*key), key, "left_semi")
    both = locked.join(sure, key)
    valid = F.col("published").rlike(r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$")
    signals = F.array_compact(
        F.array(
            F.when(F.col("deprecated"), F.struct(F.lit("registry-deprecated").alias("signal"), F.concat("name", F.lit(" is marked as deprecated")).alias("statement"))),
            F.when(F.col("archived"), F.struct(F.lit("repository-archived").alias("signal"), F.concat(F.lit("the repository of "), "name", F.lit(" is archived")).alias("statement"))),
            F.when(valid, F.struct(F.lit("locked-version-published").alias("signal"), F.concat("name", F.lit("@"), "version", F.lit(" was published on "), "published").alias("statement"))),
        )
    )
    return both.select("ecosystem", "project", "name", F.explode(signals).alias("s")).select("ecosystem", "project", "name", "s.signal", "s.statement")
