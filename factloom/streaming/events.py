"""Webhook deliveries to jobs: which events are analysed, and which are left.

deliveries(delivery, event, payload) are judged by expressions over the parsed payload,
so the same plan runs over a finished log and over a stream.  Files come from a push's
payload if it lists them all, else from a static table of changed files; without either
a delivery is analysed, as a wanted change missed is worse than a job in vain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import paths

# Fixed values.
PULL_REQUEST_ACTIONS = ("opened", "synchronize", "reopened")
PUSH_COMMITS = 20
#: The scope settings of this engine.
SCOPE_FILE = r"(^|/)\.fixture-scope\.json$"
SOURCE = r"\.(?:[cm]?[jt]s|[jt]sx|pyw?|go|rs)$"
PAYLOAD = """struct<action:string,number:bigint,before:string,after:string,ref:string,deleted:boolean,installation:struct<id:bigint>,
repository:struct<id:bigint,name:string,default_branch:string,owner:struct<login:string>>,pull_request:struct<number:bigint,head:struct<sha:string>,base:struct<sha:string>>,
commits:array<struct<added:array<string>,modified:array<string>,removed:array<string>>>>"""


def _zero(sha: Column) -> Column:
    return sha.rlike("^0+$")


def job_key(repository: Column, head: Column) -> Column:
    return F.concat_ws(":", repository.cast("string"), head)


def judged(deliveries: DataFrame) -> DataFrame:
    """delivery, event, key, repository, number, head, before, files (null unless the payload
    lists them all) and skip (why not, or null)."""
    p = F.col("p")
    rows = deliveries.withColumn("p", F.from_json("payload", PAYLOAD))
    pull, push = F.col("event") == "pull_request", F.col("event") == "push"
    nobody = p["repository"]["id"].isNull() | p["repository"]["name"].isNull() | p["repository"]["owner"]["login"].isNull()
    number = F.coalesce(p["pull_request"]["number"], p["number"])
    missing = p["pull_request"]["head"]["sha"].isNull() | p["pull_request"]["base"]["sha"].isNull() | number.isNull()
    skip = (
        F.when(~pull & ~push, F.concat(F.lit("event "), "event", F.lit(" is not analysed")))
        .when(pull & ~F.coalesce(p["action"].isin(*PULL_REQUEST_ACTIONS), F.lit(False)), F.concat(F.lit("pull_request."), F.coalesce(p["action"], F.lit("?")), F.lit(" is not analysed")))
        .when(nobody, "payload missing repository")
        .when(p["installation"]["id"].isNull(), "payload missing installation")
        .when(pull & missing, "pull_request payload missing number or SHAs")
        .when(push & (p["ref"].isNull() | p["after"].isNull()), "push payload missing ref or after")
        .when(push & (F.coalesce(p["deleted"], F.lit(False)) | _zero(p["after"])), "branch deletion")
        .when(push & ~p["ref"].startswith("refs/heads/"), "tag or non-branch push")
        .when(push & ~F.coalesce(p["ref"] == F.concat(F.lit("refs/heads/"), p["repository"]["default_branch"]), F.lit(False)), "push to a non-default branch")
        .when(push & (p["before"].isNull() | _zero(p["before"])), "new branch push has no diff")
    )
    head = F.when(pull, p["pull_request"]["head"]["sha"]).otherwise(p["after"])
    before = F.when((push | (p["action"] == "synchronize")) & ~_zero(p["before"]), p["before"])
    listed = F.array_distinct(F.flatten(F.transform(p["commits"], lambda c: F.concat(*[F.coalesce(c[k], F.array().cast("array<string>")) for k in ("added", "modified", "removed")]))))
    whole = push & (F.size(p["commits"]) > 0) & (F.size(p["commits"]) < PUSH_COMMITS)
    return rows.select("delivery", "event", job_key(p["repository"]["id"], head).alias("key"), p["repository"]["id"].alias("repository"), number.alias("number"), head.alias("head"), before.alias("before"), F.when(whole, listed).alias("files"), skip.alias("skip"))


def _any(files: Column, holds) -> Column:
    return F.exists(files, holds)


def decided(deliveries: DataFrame, changed: DataFrame, source_trigger: bool = False) -> DataFrame:
    """The judged deliveries with analyse, source_only and reason.

    changed(key, files array, complete) answers for those whose payload does not; a stream
    of deliveries may be joined with a static table of it.
    """
    rows = judged(deliveries).join(changed.select("key", F.col("files").alias("_looked"), F.col("complete").alias("_complete")), "key", "left")
    files = F.coalesce("files", "_looked")
    known = F.col("files").isNotNull() | F.col("_looked").isNotNull()
    complete = F.col("files").isNotNull() | F.coalesce("_complete", F.lit(False))
    dependency = _any(files, lambda f: paths.dependency_file(f).isNotNull() | paths.file_name(f).isin(*paths.MANIFESTS))
    scope = _any(files, lambda f: f.rlike(SCOPE_FILE))
    source = _any(files, lambda f: f.rlike(SOURCE) & ~paths.has_excluded_segment(f) & ~paths.is_generated(f))
    wants_source = F.lit(source_trigger) & (F.col("event") == "pull_request")
    nothing = known & complete & ~dependency & ~scope & ~(wants_source & source)
    reason = F.when(F.col("skip").isNotNull(), F.col("skip")).when(nothing, "no dependency manifest, lockfile, scope config" + (" or analysable source" if source_trigger else "") + " changed")
    only = wants_source & known & complete & source & ~dependency & ~scope
    return rows.select("delivery", "event", "key", "repository", "number", "head", "before", reason.isNull().alias("analyse"), (reason.isNull() & F.coalesce(only, F.lit(False))).alias("source_only"), reason.alias("reason"))
