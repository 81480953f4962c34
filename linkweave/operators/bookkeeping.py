"""What an import has done so far: progress, errors, health, series keys, and reconciliation of issues with platforms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Words of an error and its category, in the order in which they are looked for, and what each means.
CATEGORIES = (
    (("year",), "missing_series_year"), (("multiple rows were found",), "duplicate_data"), (("validation error",), "validation_error"), (("resolution error",), "resolution_failed"), (("network", "connection"), "network_error"), (("timeout",), "timeout"),
)
DESCRIPTIONS = {
    "missing_series_year": "CSV rows with empty Year field - cannot determine which series year", "duplicate_data": "Database has duplicate issues/series - needs cleanup", "validation_error": "Invalid data format or required fields missing",
    "resolution_failed": "Could not match to existing canonical issue/series", "network_error": "Failed to fetch data from external platform", "timeout": "Request timed out", "other": "Uncategorized error",
}
# How a title names its volume.
VOLUMES = (r"(?i)\bvol\.?\s*(\d+)", r"(?i)\bvolume\s*(\d+)", r"(?i)\bseries\s*(\d+)")


def series_key(title: Column, year: Column, cover_year: Column) -> Column:
    """Title, volume and year of a collection row's series, joined by bars; null without a title."""
    name, filled = F.trim(title), lambda c: F.nullif(c, F.lit(""))
    volume = F.coalesce(*(filled(F.regexp_extract(name, p, 1)) for p in VOLUMES), F.lit(""))
    when = F.trim(F.coalesce(filled(year), filled(cover_year), F.lit("")))
    return F.when(name != "", F.concat_ws("|", name, volume, when))


def series_groups(rows: DataFrame) -> DataFrame:
    """Collection rows (``row_index, series, year, cover_year``) per series key: how many, first and last."""
    keyed = rows.select("row_index", series_key(F.col("series"), F.col("year"), F.col("cover_year")).alias("series_key")).where("series_key is not null")
    return keyed.groupBy("series_key").agg(F.count("*").alias("n"), F.min("row_index").alias("first_row"), F.max("row_index").alias("last_row"))


def category(error: Column) -> Column:
    """What kind of error a message tells of."""
    text, out = F.lower(error), F.lit("other")
    for words, name in reversed(CATEGORIES):
        hit = F.contains(text, F.lit(words[0]))
        for word in words[1:]:
            hit = hit | F.contains(text, F.lit(word))
        out = F.when(hit, name).otherwise(out)
    return out


def progress(runs: DataFrame, active: DataFrame, results: DataFrame) -> DataFrame:
    """Per run: rows processed, failed, active and pending, and how it is being run.

    ``runs``: run_id, total_rows, resume_count, retry_failed_count; ``active``: run_id,
    row_key; ``results``: run_id, row_key, resolved, a row per key. An active
    row that has a result is not active; what is neither is pending.
    """
    done = results.groupBy("run_id").agg(F.count("*").alias("processed"), F.count_if(~F.col("resolved")).alias("failed"))
    busy = active.where("row_key <> ''").select("run_id", "row_key").distinct().join(results.select("run_id", "row_key"), ["run_id", "row_key"], "left_anti").groupBy("run_id").agg(F.count("*").alias("active"))
    x = runs.join(done, "run_id", "left").join(busy, "run_id", "left").fillna(0, ["processed", "failed", "active"])
    mode = F.when(F.coalesce("retry_failed_count", F.lit(0)) > 0, "retry_failed_only").when(F.coalesce("resume_count", F.lit(0)) > 0, "resume").otherwise("fresh")
    return x.select("run_id", "total_rows", "processed", "failed", "active", F.greatest(F.col("total_rows") - F.col("processed") - F.col("active"), F.lit(0)).alias("pending"), mode.alias("mode"))


def error_report(results: DataFrame) -> DataFrame:
    """Per run and category of error: how many, the first five rows, and what it means.

    The window's limit is applied before the shuffle, so a common error is not collected.
    """
    failed = results.where("error is not null").select("run_id", "row_index", category(F.col("error")).alias("category"))
    counts = failed.groupBy("run_id", "category").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("run_id", "category").orderBy("row_index"))
    first = failed.withColumn("place", place).where("place <= 5").groupBy("run_id", "category").agg(F.array_sort(F.collect_list("row_index")).alias("rows"))
    meaning = F.create_map(*(F.lit(x) for pair in DESCRIPTIONS.items() for x in pair))
    return counts.join(first, ["run_id", "category"]).select("run_id", "category", "n", F.array_join(F.transform("rows", lambda r: r.cast("string")), ",").alias("sample_rows"), meaning[F.col("category")].alias("description"))


def reconciled(issues: DataFrame, mappings: DataFrame, platforms: Sequence[str]) -> DataFrame:
    """Per issue: platforms checked, those with a mapping (updated), those without, and a line of text."""
    found = mappings.where(F.col("source").isin(*platforms)).groupBy("issue_id").agg(F.collect_set("source").alias("found"))
    every = F.array(*map(F.lit, platforms))
    x = issues.select("issue_id").join(found, "issue_id", "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    n = len(platforms)
    text = F.format_string(f"Reconciled issue %s across {n} platforms. Created 0 new mappings, updated %d. 0 errors.", F.col("issue_id").cast("string"), F.size("found"))
    return x.select("issue_id", F.lit(n).cast("long").alias("checked"), F.size("found").cast("long").alias("updated"), F.array_join(F.filter(every, lambda p: ~F.array_contains("found", p)), ",").alias("missing"), text.alias("summary"))
