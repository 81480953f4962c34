"""The inventory of canonical issues: display rows, filters, search, pages and totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .matching import names_within
from .repair import Canon
from .staging import staged


def issue_rows(canon: Canon, platforms: Sequence[str]) -> DataFrame:
    """A display row per issue of a known series: its fields, mappings as ``source:id`` in order, and platforms found of all."""
    found = canon.mappings.groupBy("issue_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "source", "source_issue_id"))), ",").alias("maps"), F.count_distinct("source").alias("platforms_found"))
    series = canon.series.select(F.col("id").alias("series_id"), "title", "start_year", "publisher")
    x = canon.issues.join(series, "series_id").join(found, "issue_id", "left")
    return x.select("issue_id", "title", "number", "start_year", "publisher", "cover_date", "upc", F.coalesce("maps", F.lit("")).alias("maps"), F.coalesce("platforms_found", F.lit(0)).cast("long").alias("platforms_found"), F.lit(len(platforms)).cast("long").alias("platforms_total"))


def complete_issues(mappings: DataFrame, platforms: Sequence[str]) -> DataFrame:
    """Issues with a mapping on every one of ``platforms``."""
    return mappings.where(F.col("source").isin(*platforms)).groupBy("issue_id").agg(F.count_distinct("source").alias("n")).where(F.col("n") == len(set(platforms))).select("issue_id")


def filtered(canon: Canon, title: str | None = None, number: str | None = None, publisher: str | None = None, platform: str | None = None, on_all: Sequence[str] | None = None) -> Canon:
    """The canon with the issues that pass all filters given; title and publisher hold the text in any case, ``%`` and ``_`` being wildcards.

    Filters reach the scans of their own tables; an issue is kept by semi joins, so mappings never multiply it.
    """
    series, issues = canon.series, canon.issues
    for column, text in (("title", title), ("publisher", publisher)):
        if text:
            series = series.where(F.col(column).ilike(f"%{text}%"))
    if number:
        issues = issues.where(F.col("number") == number)
    issues = issues.join(series.select(F.col("id").alias("series_id")), "series_id", "left_semi")
    if platform:
        issues = issues.join(canon.mappings.where(F.col("source") == platform).select("issue_id"), "issue_id", "left_semi")
    if on_all:
        issues = issues.join(complete_issues(canon.mappings, on_all), "issue_id", "left_semi")
    return Canon(series, issues.select(*canon.issues.columns), canon.mappings, canon.variants)


def numbered(rows: DataFrame, *order: Column | str) -> DataFrame:
    """``rows`` with ``place``, their position from 0 in ``order``, without a sort in one task.

    Rows are dealt to ranges, sorted there, and counted per range; a range's places
    start at the sum of those before it. ``order`` has to be of columns and to tell rows apart.
    """
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    k = F.monotonically_increasing_id()
    held = staged(ranged.select("*", F.shiftright(k, 33).alias("__range"), k.bitwiseAND(F.lit((1 << 33) - 1)).alias("__k")))
    counts = held.groupBy("__range").agg(F.count("*").alias("n"), F.min("__k").alias("low"))
    before = counts.select("__range", (F.sum("n").over(Window.orderBy("__range")) - F.col("n") - F.col("low")).alias("first"))  # a row per range
    return held.join(before, "__range").select(*rows.columns, (F.col("__k") + F.col("first")).alias("place"))


def paged(rows: DataFrame, size: int = 50) -> DataFrame:
    """Display rows in the inventory's order (title, number, id), each with its page and place from 0."""
    made = numbered(rows, "title", "number", "issue_id")
    return made.withColumn("page", F.floor(F.col("place") / size).cast("long"))


def page(rows: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page; each task keeps its first ``offset + limit`` rows only."""
    return rows.orderBy("title", "number", "issue_id").offset(offset).limit(limit)


def search(queries: DataFrame, canon: Canon, limit: int | None = 50) -> DataFrame:
    """Issues that each distinct ``query`` finds: text in the title or in a platform's id, in any case, or the very number or UPC.

    Returns ``query, place, issue_id`` in the inventory's order, the first ``limit``
    of each query (a window's limit is applied before the shuffle), or all. Texts
    are looked up by their rarest 4 letters in the distinct titles and ids, so many
    queries are answered at once. Null and empty queries find nothing.
    """
    asked = queries.select("query").where("query <> ''").distinct()
    low = asked.select("query", F.lower("query").alias("text"))
    terms = low.select(F.col("text").alias("name"))
    within = lambda names: low.join(names_within(terms, names).select(F.col("small").alias("text"), F.col("large").alias("name")), "text").select("query", "name")
    titles = canon.series.select("id", F.lower("title").alias("name"))
    ids = canon.mappings.select("issue_id", F.lower("source_issue_id").alias("name"))
    issues = canon.issues.select("issue_id", "series_id", "number", "upc")
    by_title = within(titles).join(titles, "name").select("query", F.col("id").alias("series_id")).join(issues, "series_id").select("query", "issue_id")
    by_id = within(ids).join(ids, "name").select("query", "issue_id")
    by_number = asked.join(issues.withColumnRenamed("number", "query"), "query").select("query", "issue_id")
    by_upc = asked.join(issues.withColumnRenamed("upc", "query"), "query").select("query", "issue_id")
    hits = by_title.unionByName(by_id).unionByName(by_number).unionByName(by_upc).distinct()
    sorted_by = canon.issues.join(canon.series.select(F.col("id").alias("series_id"), "title"), "series_id").select("issue_id", "title", "number")
    order = Window.partitionBy("query").orderBy("title", "number", "issue_id")
    placed = hits.join(sorted_by, "issue_id").withColumn("place", F.row_number().over(order))
    return (placed if limit is None else placed.where(F.col("place") <= limit)).select("query", "place", "issue_id")


def stats(canon: Canon, platforms: Sequence[str]) -> DataFrame:
    """Per platform: issues mapped, of all, and the share in percent; with the totals of series and mappings."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    totals = one(canon.issues, "total_issues").crossJoin(one(canon.series, "total_series")).crossJoin(one(canon.mappings, "total_mappings"))  # one row each
    mapped = canon.mappings.groupBy(F.col("source").alias("platform")).agg(F.count_distinct("issue_id").alias("mapped"))
    named = canon.series.sparkSession.createDataFrame([(name,) for name in platforms], "platform string")
    share = F.when(F.col("total_issues") > 0, F.round(F.col("mapped") / F.col("total_issues") * 100, 1)).otherwise(0.0)
    return named.join(mapped, "platform", "left").fillna(0, ["mapped"]).crossJoin(F.broadcast(totals)).select("platform", "mapped", "total_issues", "total_series", "total_mappings", share.alias("percentage"))
