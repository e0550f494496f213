"""Aggregates over facts: caps with a remainder, graphs, impact, footprints, overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Packages of one capability, by ecosystem; the last flag says whether the
# same capability in two ecosystems is worth a note.
CAPABILITIES = {
    "http-client": ({"javascript-typescript": ["axios", "got", "node-fetch", "cross-fetch", "superagent", "undici", "ky", "request"], "python": ["requests", "httpx", "aiohttp", "urllib3"]}, True),
    "date-time": ({"javascript-typescript": ["moment", "dayjs", "date-fns", "luxon"], "python": ["arrow", "pendulum", "python-dateutil"]}, True),
    "schema-validation": ({"javascript-typescript": ["zod", "joi", "yup", "ajv", "valibot"], "python": ["pydantic", "marshmallow", "jsonschema", "cerberus"]}, True),
    "logging": ({"javascript-typescript": ["winston", "pino", "bunyan", "loglevel"], "python": ["loguru", "structlog"]}, True),
    "yaml": ({"javascript-typescript": ["js-yaml", "yaml"], "python": ["pyyaml", "ruamel-yaml"]}, True),
    "test-runner": ({"javascript-typescript": ["jest", "mocha", "vitest", "ava", "tap"], "python": ["pytest", "nose2"]}, False),
}


def capability_catalogue(spark) -> DataFrame:
    rows = [(c, e, n, across) for c, (by, across) in CAPABILITIES.items() for e, names in by.items() for n in names]
    return spark.createDataFrame(rows, "cluster string, ecosystem string, name string, across boolean")


def capped(rows: DataFrame, order: list[str], limit: int, text: str) -> DataFrame:
    """The first ``limit`` different rows by ``order`` (a top-k report) and, if there are
    more, one row whose ``text`` counts them."""
    different = rows.select(*order).distinct()
    top = different.orderBy(*order).limit(limit)
    more = different.agg((F.count("*") - limit).alias("_n")).where("_n > 0")
    rest = more.select(*[(F.concat(F.col("_n").cast("string"), F.lit(" more")) if c == text else F.lit(None).cast(dict(rows.dtypes)[c])).alias(c) for c in order])
    return top.unionByName(rest)


def first_values(rows: DataFrame, keys: list[str], value: str, limit: int, out: str) -> DataFrame:
    """keys, total and the ``limit`` smallest different values joined by commas.

    Values are ranked within their group by Spark's sort, so a group of any size costs
    no array of all its values."""
    different = rows.select(*keys, value).where(F.col(value).isNotNull()).distinct()
    ranked = different.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(value))).where(F.col("_r") <= limit)
    totals = rows.groupBy(*keys).agg(F.count("*").alias("total"))
    shown = ranked.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.col(value).cast("string"))), ",").alias(out))
    return totals.join(shown, keys, "left")


def finding_summary(findings: DataFrame, columns: list[str]) -> DataFrame:
    """Counts for the whole and for each value of each column: columns and n."""
    by = findings.groupingSets([[], *([c] for c in columns)], *columns)
    return by.agg(F.grouping_id().alias("gid"), F.count("*").alias("n"))


def graph_completeness(projects: DataFrame, graphs: DataFrame, keys: list[str], group: str) -> DataFrame:
    """group and none, partial or complete: complete only if every project has a graph and
    no graph says it is incomplete."""
    state = projects.join(graphs.select(*keys, F.col("incomplete")), keys, "left")
    by = state.groupBy(group).agg(F.count("*").alias("n"), F.count("incomplete").alias("known"), F.count_if(F.col("incomplete")).alias("open"))
    return by.select(group, F.when(F.col("known") == 0, "none").when((F.col("known") < F.col("n")) | (F.col("open") > 0), "partial").otherwise("complete").alias("completeness"))


def unified_graph(nodes: DataFrame, node: list[str], member: str, dev: str, direct: str, limit: int) -> DataFrame:
    """One row for each node: members, whether all say dev, whether any is direct; the
    first ``limit`` by direct first, then by name (a top-k cap)."""
    merged = nodes.groupBy(*node).agg(F.count_distinct(member).alias("members"), F.min(member).alias("first_member"), F.bool_and(dev).alias("dev"), F.bool_or(direct).alias("direct"))
    return merged.orderBy(F.col("direct").desc(), *node).limit(limit)


def footprint(members: DataFrame, entry: str, name: str, size: str) -> DataFrame:
    """entry, bytes, sized and total: a name counts with its smallest size, and only if
    all its versions are sized; so bytes is a lower bound."""
    by = members.groupBy(entry, name).agg(F.count("*").alias("_n"), F.count(size).alias("_s"), F.min(F.col(size).cast("decimal(18,2)")).alias("_m"))
    least = F.when(F.col("_n") == F.col("_s"), F.col("_m"))
    return by.groupBy(entry).agg(F.sum(least).alias("bytes"), F.count(least).alias("sized"), F.count("*").alias("total"))


def overlaps(declared: DataFrame, cluster: str, side: str, name: str, across: bool = True) -> DataFrame:
    """Rows of ``declared`` (distinct) of clusters that are declared on two sides or more;
    with across=False, of clusters with two names or more on the row's own side."""
    rows = declared.select(cluster, side, name).distinct()
    if across:
        many = rows.groupBy(cluster).agg(F.count_distinct(side).alias("_n")).where("_n >= 2").select(cluster)
        return rows.join(many, cluster, "left_semi")
    many = rows.groupBy(cluster, side).agg(F.count_distinct(name).alias("_n")).where("_n >= 2").select(cluster, side)
    return rows.join(many, [cluster, side], "left_semi")


def detection_score(lockfile: Column, settings: Column, sources: Column, conflict: Column) -> Column:
    """0.7, 0.1 more for a lockfile, settings and five sources, 0.1 less for a conflict;
    in decimals, so sums are exact."""
    step = lambda c: F.when(c, F.lit(0.1).cast("decimal(4,2)")).otherwise(F.lit(0).cast("decimal(4,2)"))
    return (F.lit(0.7).cast("decimal(4,2)") + step(lockfile) + step(settings) + step(sources >= 5) - step(conflict)).cast("decimal(4,2)")


def usage_attribution(usages: DataFrame, ecosystem: str, complete: str) -> DataFrame:
    return usages.groupBy(ecosystem).agg(F.count("*").alias("usages"), F.bool_and(complete).alias("complete"))


def keep_latest(access: DataFrame, key: str, item: str, at: str, limit: int) -> DataFrame:
    """The ``limit`` items of each key that were used last, most recent first."""
    last = access.groupBy(key, item).agg(F.max(at).alias("last_used"))
    w = Window.partitionBy(key).orderBy(F.col("last_used").desc(), F.col(item))
    return last.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)
