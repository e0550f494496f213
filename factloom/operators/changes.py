"""Changes between two states: dependencies, their manifests, and what an analysis of a
pull request did not cover."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import names, paths
from factloom.operators.joins import moved_pairs, snapshot_diff


def dependency_changes(base: DataFrame, head: DataFrame) -> DataFrame:
    """ecosystem, project, name, change, kinds and constraints of declared dependencies.

    A name that left one kind and came under another is one change, not two.
    """
    keys = ["ecosystem", "project", "name", "kind"]
    one = lambda d: d.groupBy(*keys).agg(F.min("constraint").alias("constraint"))
    diff = snapshot_diff(one(base), one(head), keys, "constraint")
    owner = F.concat_ws("\u0000", "ecosystem", "project", "name")
    moves = moved_pairs(diff.withColumn("_o", owner), "_o", "kind")
    left = diff.withColumn("_o", owner).join(moves.select("_o", F.col("from_kind").alias("kind"), F.lit("removed").alias("change")), ["_o", "kind", "change"], "left_anti")
    left = left.join(moves.select("_o", F.col("to_kind").alias("kind"), F.lit("added").alias("change")), ["_o", "kind", "change"], "left_anti")
    parts = F.split("_o", "\u0000")
    before, after = diff.withColumn("_o", owner).where("change = 'removed'"), diff.withColumn("_o", owner).where("change = 'added'")
    paired = moves.join(before.select("_o", F.col("kind").alias("from_kind"), "before"), ["_o", "from_kind"]).join(after.select("_o", F.col("kind").alias("to_kind"), "after"), ["_o", "to_kind"])
    moved = paired.select(parts[0].alias("ecosystem"), parts[1].alias("project"), parts[2].alias("name"), F.lit("changed").alias("change"), F.col("from_kind").alias("kind_before"), F.col("to_kind").alias("kind_after"), "before", "after")
    stayed = left.select("ecosystem", "project", "name", "change", F.when(F.col("change") != "added", F.col("kind")).alias("kind_before"), F.when(F.col("change") != "removed", F.col("kind")).alias("kind_after"), "before", "after")
    return stayed.unionByName(moved)


def uncovered_manifests(changed: DataFrame) -> DataFrame:
    """Changed manifests (path) with no changed lockfile of their ecosystem at or above."""
    kinds = changed.select("path", paths.dependency_file(F.col("path")).alias("d"), paths.directory(F.col("path")).alias("folder")).where("d is not null")
    locks = kinds.where("d.role = 'lockfile'").select("d.ecosystem", "folder").distinct()
    manifests = kinds.where("d.role = 'manifest'").select("path", "d.ecosystem", F.explode(paths.ancestors(F.col("folder"))).alias("folder"))
    covered = manifests.join(locks, ["ecosystem", "folder"]).select("path").distinct()
    return kinds.where("d.role = 'manifest'").select("path").join(covered, "path", "left_anti")


def coverage(changes: DataFrame, dependencies: DataFrame, ecosystems: DataFrame) -> DataFrame:
    """Added and changed dependencies that no analysis saw, and why: their ecosystem was
    not detected, or their manifest does not list them now."""
    new = changes.where("change in ('added', 'changed')")
    unseen = new.join(ecosystems.select("ecosystem").distinct(), "ecosystem", "left_anti").withColumn("reason", F.lit("ecosystem not analysed"))
    seen = new.join(ecosystems.select("ecosystem").distinct(), "ecosystem", "left_semi")
    unlisted = seen.join(dependencies.select("ecosystem", "project", "name").distinct(), ["ecosystem", "project", "name"], "left_anti").withColumn("reason", F.lit("not listed"))
    return unseen.unionByName(unlisted).select("ecosystem", "project", "name", "reason")


def verified_lines(dependencies: DataFrame, lines: DataFrame) -> DataFrame:
    """``dependencies`` whose declared_line is kept only if that line of declared_in holds
    the name as a whole token; Python names are compared in their normal form."""
    text = lines.select(F.col("path").alias("declared_in"), F.col("line").alias("declared_line"), F.col("text").alias("_text"))
    both = dependencies.join(text, ["declared_in", "declared_line"], "left")
    tokens = F.split(F.col("_text"), r"[^A-Za-z0-9@/._-]+")
    python = F.exists(tokens, lambda x: names.python_name(F.regexp_replace(x, r"^[._-]+|[._-]+$", "")) == names.python_name(F.col("name")))
    good = F.when(F.col("ecosystem") == "python", python).otherwise(F.array_contains(tokens, F.col("name")))
    return both.withColumn("declared_line", F.when(F.coalesce(good, F.lit(False)), F.col("declared_line"))).select(*dependencies.columns)


def is_source_only(changed: DataFrame, complete: bool) -> bool:
    """Whether a change has source files and neither manifests nor lockfiles; False if the
    list of files is not complete."""
    source = F.col("path").rlike(r"\.(?:[cm]?[jt]sx?|vue|svelte|astro|py|rs|go)$")
    row = changed.agg(F.count_if(paths.dependency_file(F.col("path")).isNotNull()).alias("d"), F.count_if(source).alias("s")).first()
    return complete and row["d"] == 0 and row["s"] > 0
