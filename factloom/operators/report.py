"""Reports: canonical order and JSON, summaries, and the outcome of a check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.rules import SEVERITIES, rank

#: Annotations of a check at most; the rest are counted.
ANNOTATIONS = 50


def canonical_json(columns: list[str]) -> Column:
    """JSON of the columns with keys in order and nulls left out."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "true"})


def ordered(findings: DataFrame) -> DataFrame:
    """Findings in their canonical order: severity, kind, rule, names, then all else."""
    rest = canonical_json(findings.columns)
    return findings.orderBy(rank(F.col("severity"), SEVERITIES), "kind", "rule", "dependency", rest)


def written(findings: DataFrame, path: str) -> None:
    """The report as JSON lines in canonical order."""
    ordered(findings).select(canonical_json(findings.columns).alias("value")).write.mode("overwrite").text(path)


def annotated(findings: DataFrame, added: DataFrame, limit: int = ANNOTATIONS) -> DataFrame:
    """High-confidence findings (with file and line) whose evidence lies on an added line
    (path, line), the first ``limit`` of them (a cap of the report)."""
    sure = findings.where("confidence = 'high'")
    hits = sure.join(added.select(F.col("path").alias("file"), "line").distinct(), ["file", "line"], "left_semi")
    return hits.orderBy("file", "line", "dependency").limit(limit)


def outcome(findings: DataFrame, threshold: str) -> DataFrame:
    """One row: conclusion, verdicts, failing and the worst severity.  Facts and notes do
    not count; what is incomplete keeps a check from success."""
    place = rank(F.col("severity"), SEVERITIES)
    verdict = F.col("finding_group") == "verdict"
    counted = findings.agg(
        F.count_if(verdict).alias("verdicts"), F.count_if(verdict & (place <= SEVERITIES.index(threshold) + 1)).alias("failing"), F.count_if(F.col("finding_group") == "incomplete").alias("open"), F.min(F.when(verdict, place)).alias("worst")
    )
    conclusion = F.when(F.col("failing") + F.col("open") + F.col("verdicts") > 0, "neutral").otherwise("success")
    return counted.select(conclusion.alias("conclusion"), "verdicts", "failing", F.when(F.col("verdicts") > 0, F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("worst"))).alias("worst"))
