"""Lists of human corrections, their review, and what applied ones teach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repair import Canon

# What a review may decide.
STATUSES = ("pending", "reviewed", "applied", "rejected")


def _of_issues(corrections: DataFrame, canon: Canon) -> DataFrame:
    """Corrections with their issue's number and its series' title and year, null where there is none."""
    series = canon.series.select(F.col("id").alias("series_id"), "title", "start_year")
    issues = canon.issues.select("issue_id", "number", "series_id").join(series, "series_id", "left").drop("series_id")
    return corrections.join(issues, "issue_id", "left")


def recent(corrections: DataFrame, canon: Canon, limit: int | None = 50, status: str | None = None, platform: str | None = None) -> DataFrame:
    """The newest corrections of a status and platform, with their issue; ties go to the greatest id.

    Each task keeps its first ``limit`` rows, and only those meet their issues.
    """
    kept = corrections
    if status:
        kept = kept.where(F.col("review_status") == status)
    if platform:
        kept = kept.where(F.col("source") == platform)
    if limit is not None:
        kept = kept.orderBy(F.desc("created_at"), F.desc("correction_id")).limit(limit)
    return _of_issues(kept, canon)


def reviewed(corrections: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Corrections after the reviews of ``requests``, and what became of each request.

    ``requests`` has ``request_id, correction_id, status, reviewed_by, notes, at``; they
    are carried out in the order of ``request_id``, so the last valid one of a
    correction stays. Outcomes are ``done``, ``not_found`` and ``invalid_status``; a
    correction that is absent is looked for first.
    """
    valid = F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))
    fields = F.struct("request_id", F.col("status").alias("review_status"), "reviewed_by", F.col("notes").alias("review_notes"), F.col("at").alias("reviewed_at"))
    last = requests.where(valid).groupBy("correction_id").agg(F.max(fields).alias("r"))
    made = ("review_status", "reviewed_by", "review_notes", "reviewed_at")
    old = {c: F.col(c) if c in corrections.columns else F.lit(None) for c in made}
    joined = corrections.join(last, "correction_id", "left")
    after = joined.select(*(F.col(c) for c in corrections.columns if c not in made), *(F.when(F.col("r").isNotNull(), F.col(f"r.{c}")).otherwise(old[c]).alias(c) for c in made))
    known = corrections.select("correction_id", F.lit(True).alias("known")).distinct()
    outcome = F.when(F.col("known").isNull(), "not_found").when(~valid, "invalid_status").otherwise("done")
    return after, requests.join(known, "correction_id", "left").select("request_id", "correction_id", outcome.alias("outcome"))


def seeds(corrections: DataFrame, canon: Canon, platform: str | None = None) -> DataFrame:
    """Applied corrections with a right id, of issues that exist: what a matcher may learn."""
    kept = corrections.where((F.col("review_status") == "applied") & F.col("correct_source_issue_id").isNotNull())
    if platform:
        kept = kept.where(F.col("source") == platform)
    known = kept.join(canon.issues.select("issue_id"), "issue_id", "left_semi")
    return _of_issues(known, canon).select("correction_id", "issue_id", "title", "start_year", "number", "source", "correct_source_issue_id", "original_source_issue_id", "correction_type")
