"""Look-ups of many canonical rows at once, as semi joins on distinct keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .repair import Canon


def issues_of_pairs(canon: Canon, pairs: DataFrame) -> DataFrame:
    """Issues with their series' title and year whose title and number are among ``pairs`` (``title, number``); each once.

    A pair with a null finds nothing; a pair may find issues of several series.
    """
    asked = pairs.select("title", "number").where("title is not null and number is not null").distinct()
    series = canon.series.select(F.col("id").alias("series_id"), "title", "start_year")
    return canon.issues.join(series, "series_id").join(asked, ["title", "number"], "left_semi").select("issue_id", "series_id", "title", "start_year", "number")


def mappings_of_ids(mappings: DataFrame, source: str, ids: DataFrame) -> DataFrame:
    """Mappings of a platform whose id there is among ``ids`` (``source_issue_id``); each once. The platform's filter reaches the scan."""
    return mappings.where(F.col("source") == source).join(ids.select("source_issue_id").distinct(), "source_issue_id", "left_semi").select(*mappings.columns)


def issues_in_order(canon: Canon) -> DataFrame:
    """Every issue with its place in its series, by number as text, then id; null numbers come last."""
    order = Window.partitionBy("series_id").orderBy(F.asc_nulls_last("number"), "issue_id")
    return canon.issues.select("series_id", "issue_id", "number", F.row_number().over(order).alias("place"))
