"""Reports over mappings, corrections, results and the operation log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .staging import written

# The outside sources.
PLATFORMS = ("click", "error", "purchase", "signup", "view")


def share(part: Column, whole: Column, digits: int) -> Column:
    """Percentage, 0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(100.0 * part / whole, digits))


def strategy_counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy("strategy").agg(F.count("*").alias("n"))


def likely_false(matches: DataFrame, gap: int = 2, most: int = 50) -> DataFrame:
    """Matches not by barcode whose years are far apart: the widest first."""
    far = matches.where((F.col("confidence") > 0) & ~F.col("strategy").startswith("barcode") & (F.col("year_distance") > gap))
    return far.orderBy(F.desc("year_distance"), "row_id").limit(most).select("row_id", "strategy", "issue_id", "year_distance")


def correction_totals(corrections: DataFrame) -> DataFrame:
    """Totals over all corrections and by source, type and status, in one pass."""
    cube = corrections.groupingSets([[], ["source"], ["correction_type"], ["review_status"]], "source", "correction_type", "review_status")
    return cube.agg(F.count("*").alias("n"), F.count_if(F.col("review_status") == "pending").alias("pending"), F.count_if(F.col("review_status") == "applied").alias("applied"), F.grouping_id("source", "correction_type", "review_status").cast("long").alias("grouped"))


def platform_accuracy(mappings: DataFrame, corrections: DataFrame) -> DataFrame:
    """Per known source: mappings, accurate ones, corrected ones, and both as percentages."""
    names = mappings.sparkSession.createDataFrame([(p,) for p in PLATFORMS], "source string")
    m = mappings.groupBy("source").agg(F.count("*").alias("total"), F.count_if("is_accurate").alias("accurate"))
    c = corrections.groupBy("source").agg(F.count("*").alias("corrected"))
    x = F.broadcast(names).join(m, "source", "left").join(c, "source", "left").fillna(0)
    return x.select("source", "total", "accurate", (F.col("total") - F.col("accurate")).alias("inaccurate"), "corrected", share(F.col("accurate"), F.col("total"), 2).alias("accuracy"), share(F.col("corrected"), F.col("total"), 2).alias("correction_rate"))


def confusion(corrections: DataFrame, most: int = 5) -> DataFrame:
    """Issues most often corrected, by type, with their three first corrections."""
    top = Window.partitionBy("correction_type").orderBy(F.desc("n"), "issue_id")
    counted = corrections.groupBy("correction_type", "issue_id").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("correction_id")), 1, 3).alias("examples"))
    return counted.withColumn("place", F.row_number().over(top)).where(F.col("place") <= most).select("correction_type", "issue_id", "n", F.array_join(F.transform("examples", lambda x: x.cast("string")), ",").alias("examples"), "place")


def coverage(mappings: DataFrame, total_issues: int | None = None) -> DataFrame:
    """Distinct issues mapped per source and their share of all mapped issues."""
    whole = mappings.agg(F.count_distinct("issue_id").alias("whole"))
    per = mappings.groupBy("source").agg(F.count_distinct("issue_id").alias("issues"))
    return per.crossJoin(F.broadcast(whole)).select("source", "issues", share(F.col("issues"), F.col("whole"), 1).alias("percent"))  # one row


def issue_stages(mappings: DataFrame) -> DataFrame:
    """Per issue: mapping rows, distinct and missing sources, and how far it is resolved."""
    every = F.array(*map(F.lit, PLATFORMS))
    per = mappings.groupBy("issue_id").agg(F.count("*").alias("n"), F.collect_set("source").alias("found"))
    stage = F.when(F.col("n") >= 5, "resolved").when(F.col("n") > 0, "partial").otherwise("source_only")
    return per.select("issue_id", "n", F.size("found").alias("sources"), F.array_join(F.array_except(every, "found"), ",").alias("missing"), stage.alias("stage"))


def latest(log: DataFrame, key: str, moment: str, tie: str) -> DataFrame:
    """Last row of each key, as a map-side combined maximum."""
    return log.groupBy(key).agg(F.max(F.struct(moment, tie, *(c for c in log.columns if c not in (key, moment, tie)))).alias("x")).select(key, "x.*")


def timeline(mappings: DataFrame) -> DataFrame:
    """Per source: first and last event, seconds from the first event of all, last event's k, distinct ks."""
    per = mappings.groupBy("source").agg(F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), F.max_by("k", F.struct("created_at", "mapping_id")).alias("last_k"), F.count_distinct("k").alias("kinds"))
    start = mappings.agg(F.min("created_at").alias("start"))
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    return per.crossJoin(F.broadcast(start)).select("source", "last_k", "kinds", (seconds("first_at") - seconds("start")).alias("offset_s"), (seconds("last_at") - seconds("first_at")).alias("span_s"))  # one row


def per_hour(events: DataFrame, moment: str = "created_at") -> DataFrame:
    """Completions per hour and source."""
    return events.groupBy(F.date_trunc("hour", moment).alias("hour"), "source").agg(F.count("*").alias("n"), F.count_if("is_accurate").alias("accurate"))


def error_summary(results: DataFrame) -> DataFrame:
    """Per error category: rows, and the five first of them, without gathering a category's rows."""
    results = written(results.select("row_id", "category"))  # read twice
    first = Window.partitionBy("category", "part").orderBy("row_id")
    parts = results.withColumn("part", F.pmod(F.xxhash64("row_id"), F.lit(64))).withColumn("r", F.row_number().over(first)).where("r <= 5")
    sample = parts.groupBy("category").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list("row_id")), 1, 5), lambda x: x.cast("string")), ",").alias("sample_rows"))
    return results.groupBy("category").agg(F.count("*").alias("n")).join(sample, "category")
