"""Verdict rules, severities and groups of findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The order of severities and confidences, and the worst of each kind.
SEVERITIES = ("critical", "high", "medium", "low", "info")
CONFIDENCES = ("low", "medium", "high")
CEILINGS = {"unused": "medium", "should-be-dev": "medium", "type-only": "medium", "duplicate-capability": "medium", "potentially-unnecessary": "low", "maintenance-risk": "low", "footprint": "low", "info": "info"}
UNUSED_CONFIDENCE_CAP = "medium"
RULE_ORDER = ("ambient-types-unverified", "removed-last-usage", "unused", "unverified-no-imports", "type-only", "should-be-dev")


def rank(value: Column, order: Sequence[str]) -> Column:
    """1-based place in the order, 0 for anything else."""
    return F.array_position(F.array(*[F.lit(x) for x in order]), value).cast("int")


def named(place: Column, order: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in order]), place)


def severity(kind: Column, confidence: Column) -> Column:
    """The kind's ceiling, one rung lower for each step that confidence is below high."""
    ceiling = F.lit(len(SEVERITIES))
    for k, worst in CEILINGS.items():
        ceiling = F.when(kind == k, SEVERITIES.index(worst) + 1).otherwise(ceiling)
    drop = F.lit(len(CONFIDENCES)) - rank(confidence, CONFIDENCES)
    return named(F.least(ceiling + drop, F.lit(len(SEVERITIES))), SEVERITIES)


def capped_confidence(confidence: Column, cap: Column) -> Column:
    return named(F.least(rank(confidence, CONFIDENCES), rank(cap, CONFIDENCES)), CONFIDENCES)


def at_or_above(value: Column, threshold: str) -> Column:
    return (rank(value, SEVERITIES) > 0) & (rank(value, SEVERITIES) <= SEVERITIES.index(threshold) + 1)


def detection_confidence(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.5, "medium").otherwise("low")


def finding_group(kind: Column, fact: Column, awareness: Column, note: Column) -> Column:
    """verdict unless the kind is info; then fact, awareness, note, else incomplete: a
    missing mark never counts as set."""
    said = lambda c: F.coalesce(c, F.lit(False))
    return F.when(kind != "info", "verdict").when(said(fact), "fact").when(said(awareness), "awareness").when(said(note), "note").otherwise("incomplete")


def first_match(rows: DataFrame, rules: Sequence[tuple[str, Column]], out: str = "rule") -> DataFrame:
    """``rows`` with the name of the first rule that holds; rows without one go."""
    chosen = F.coalesce(*[F.when(holds, name) for name, holds in rules])
    return rows.withColumn(out, chosen).where(F.col(out).isNotNull())


def findings(dependencies: DataFrame, usages: DataFrame, closure: DataFrame, peers: DataFrame, unresolved_peers: DataFrame, ecosystems: DataFrame, allowlisted: Column, non_shipped: Column, pull_request: bool = False, gaps: DataFrame | None = None) -> DataFrame:
    """One finding at most for each declared dependency.

    dependencies(ecosystem, project, name, kind, declared_in, specifier_type), usages(
    dependency, file, form, via, type_only, removed_in_pr), closure and the peers tables
    (ecosystem, project, direct, member), ecosystems(ecosystem, usages_analysed,
    references_analysed).  A usage counts for every ecosystem that declares its name.
    ``gaps`` (ecosystem, project) are projects of which something went unread: absence
    cannot be told there, so what seems unused is noted for review.
    """
    use = usages.withColumn("removed_in_pr", F.coalesce("removed_in_pr", F.lit(False)))
    imported = F.coalesce(F.col("via"), F.lit("import")) == "import"
    here, gone = ~F.col("removed_in_pr"), F.col("removed_in_pr")
    per = use.groupBy(F.col("dependency").alias("name")).agg(
        F.count_if(here).alias("used"), F.count_if(gone).alias("removed"), F.count_if(here & imported).alias("imports"),
        F.coalesce(F.bool_and(F.when(here, imported & F.coalesce(F.col("type_only"), F.lit(False)))), F.lit(False)).alias("all_types"),
        F.coalesce(F.bool_and(F.when(here, imported & non_shipped)), F.lit(False)).alias("all_non_shipped"),
    )
    key = ["ecosystem", "project", "name"]
    host = lambda t, out: t.where("direct != member").groupBy("ecosystem", "project", F.col("member").alias("name")).agg(F.min("direct").alias(out))
    directs = dependencies.select("ecosystem", "project", F.col("name").alias("direct")).distinct()
    declared = dependencies.select("ecosystem", "project", F.col("name").alias("_n")).distinct()
    target = F.coalesce(_types_target(F.col("name")), F.lit(None).cast("string"))
    facts = (
        dependencies.join(per, "name", "left").join(ecosystems, "ecosystem", "left")
        .join(host(closure.join(directs, ["ecosystem", "project", "direct"], "left_semi"), "required_by"), key, "left")
        .join(host(peers, "peer_host"), key, "left").join(host(unresolved_peers, "open_peer"), key, "left")
        .withColumn("_t", target).join(declared.withColumnRenamed("_n", "_t").withColumn("companion", F.lit(True)), ["ecosystem", "project", "_t"], "left")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    if gaps is not None:
        facts = facts.join(gaps.select("ecosystem", "project").distinct().withColumn("_gap", F.lit(True)), ["ecosystem", "project"], "left")
    analysed = F.coalesce("usages_analysed", F.lit(False))
    referenced = F.coalesce("references_analysed", F.lit(False)) & (F.col("_gap").isNull() if gaps is not None else F.lit(True))
    types = (F.col("ecosystem") == "javascript-typescript") & F.col("name").startswith("@types/")
    companion = F.coalesce("companion", F.lit(False))
    plain = ~F.col("kind").isin("peer", "optional") & (F.coalesce("specifier_type", F.lit("registry")) == "registry")
    unseen = analysed & plain & (zero("used") == 0) & ~allowlisted & ~types
    needed = F.coalesce("required_by", "peer_host", "open_peer").isNotNull()
    rules = [
        ("ambient-types-unverified", types & ~companion & (zero("used") == 0) & analysed & ~allowlisted),
        ("removed-last-usage", F.lit(pull_request) & (zero("removed") > 0) & unseen & referenced & ~needed),
        ("unused", unseen & referenced & ~needed),
        ("unverified-no-imports", unseen & (needed | ~referenced)),
        ("type-only", analysed & plain & (F.col("kind") == "runtime") & (zero("used") > 0) & F.coalesce("all_types", F.lit(False))),
        ("should-be-dev", analysed & plain & (F.col("kind") == "runtime") & (zero("imports") > 0) & F.coalesce("all_non_shipped", F.lit(False))),
    ]
    rule = F.col("rule")
    kind = F.when(rule.isin("unused", "removed-last-usage"), "unused").when(rule.isin("type-only", "should-be-dev"), rule).otherwise("info")
    sure = F.when(kind == "unused", "high").when(kind == "info", "low").otherwise("medium")
    found = first_match(facts, rules).withColumn("finding", kind).withColumn("computed", sure)
    # Severity comes from the confidence as computed; only what is shown is capped.
    shown = F.when(F.col("finding") == "unused", capped_confidence(F.col("computed"), F.lit(UNUSED_CONFIDENCE_CAP))).otherwise(F.col("computed"))
    return found.select("ecosystem", "project", F.col("name").alias("dependency"), "declared_in", F.col("finding").alias("kind"), "rule", severity(F.col("finding"), F.col("computed")).alias("severity"), shown.alias("confidence"), F.coalesce("peer_host", "open_peer", "required_by").alias("host"))


def _types_target(name: Column) -> Column:
    from factloom.functions.names import types_target

    return types_target(name)
