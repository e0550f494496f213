"""Repository listings: a folder tree, or a table of entries, to files and skipped ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import paths
from factloom.operators.budgets import prefix_cut


@dataclass(frozen=True)
class Limits:
    """Ceilings of a scan, in bytes, characters and counts."""

    files: int = 100_000
    depth: int = 32
    path_chars: int = 1_024
    file_bytes: int = 2 << 20
    lockfile_bytes: int = 32 << 20
    total_bytes: int = 512 << 20

    def __post_init__(self):
        for name, value in vars(self).items():
            if not isinstance(value, int) or isinstance(value, bool) or value < 0:
                raise ValueError(f"{name} must be a whole number of 0 or more")


def tree(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), size and content of every file below a folder of any store."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    # The reader names files with their full address; what follows the root's path is kept.
    plain = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    return rows.select(F.substring(plain, F.locate(base, plain) + len(base), F.lit(1 << 20)).alias("path"), F.col("length").alias("size"), "content")


def skip_reason(limits: Limits = Limits()):  # noqa: B008
    """Why an entry (path, size, kind) is not read; null if it is."""
    path, size = F.col("path"), F.col("size")
    lock = paths.is_lockfile(path)
    return (
        F.when(F.col("kind") == "symlink", "symlink")
        .when(F.col("kind") != "file", "special-file")
        .when(~paths.is_safe(path), "unsafe-name")
        .when(F.length(path) > limits.path_chars, "path-too-long")
        .when(F.size(F.split(path, "/")) > limits.depth, "too-deep")
        .when(paths.has_excluded_segment(paths.directory(path)), "excluded-directory")
        .when(~lock & paths.is_generated(path), "generated-file")
        .when(size > F.when(lock, limits.lockfile_bytes).otherwise(limits.file_bytes), "file-too-large")
    )


def scanned(entries: DataFrame, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """(files, skipped) of entries(path, size, kind).

    Files come by path until the count or the total would first exceed its ceiling; what
    follows is skipped as truncated.
    """
    judged = entries.withColumn("reason", skip_reason(limits))
    fine = judged.where("reason is null").drop("reason")
    ranked = with_rank(fine, "path")
    kept = prefix_cut(ranked.where(F.col("_rank") <= limits.files), "_rank", "size", limits.total_bytes)
    cut = ranked.join(kept.select("_rank"), "_rank", "left_anti").select("path", F.lit("truncated").alias("reason"))
    return kept.drop("_rank"), judged.where("reason is not null").select("path", "reason").unionByName(cut)


def with_rank(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with _rank, 1 for the smallest of ``order`` (unique strings).

    Ranges of the order are ranked by themselves and shifted by the sizes of those before.
    """
    from pyspark.sql import Window

    from factloom.operators.graph import stored

    # The ranges are written once: their borders come from a sample, and both reads below
    # must see the same ones.
    ranged = stored(rows.repartitionByRange(order).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").count()
    before = sizes.select("_p", (F.sum("count").over(Window.orderBy("_p")) - F.col("count")).alias("_before"))  # a row for each range
    local = ranged.withColumn("_l", F.row_number().over(Window.partitionBy("_p").orderBy(order)))
    return local.join(F.broadcast(before), "_p").withColumn("_rank", F.col("_before") + F.col("_l")).drop("_p", "_l", "_before")


def reasons(skipped: DataFrame, examples: int = 5) -> DataFrame:
    """reason, total and the first paths of each."""
    from factloom.operators.aggregates import first_values

    return first_values(skipped, ["reason"], "path", examples, "examples")


def scope_counts(files: DataFrame, roots: DataFrame) -> DataFrame:
    """root, matched, files and manifests: what lies under each scope root (column root)."""
    chain = files.select("path", F.explode(paths.ancestors(paths.directory(F.col("path")))).alias("root"))
    manifest = paths.file_name(F.col("path")).isin(*paths.MANIFESTS)
    by = chain.join(roots, "root").groupBy("root").agg(F.count("*").alias("files"), F.count_if(manifest).alias("manifests"))
    return roots.join(by, "root", "left").select("root", F.col("files").isNotNull().alias("matched"), F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("manifests", F.lit(0)).alias("manifests"))


def outside(rows: DataFrame, roots: DataFrame, path: str = "path") -> DataFrame:
    """``rows`` whose path lies under none of the scope roots."""
    chain = rows.select(path).distinct().select(path, F.explode(paths.ancestors(paths.directory(F.col(path)))).alias("root"))
    return rows.join(chain.join(roots, "root").select(path).distinct(), path, "left_anti")
