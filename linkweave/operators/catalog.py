"""Catalog preparation: preferred issues, barcode table, name groups and the name index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkweave.functions import names, numbers


# Fixed value: the catalog's number for English.
ENGLISH = 25


def usable_series(series: DataFrame, publishers: DataFrame, this_year: int, language: int = ENGLISH) -> DataFrame:
    """Series of a catalog dump that matching may use, with their publisher's name.

    Not deleted, in ``language``, begun by ``this_year`` and not ended before 1950
    (null: still open). A deleted or unknown publisher counts as none. The
    filters are on plain columns, so they reach the scan.
    """
    kept = series.where((F.col("deleted") == 0) & (F.col("language_id") == language) & (F.col("year_began") <= this_year) & (F.col("year_ended").isNull() | (F.col("year_ended") >= 1950)))
    named = publishers.where("deleted = 0").select("publisher_id", F.col("name").alias("publisher"))
    return kept.join(named, "publisher_id", "left").select("series_id", "name", F.coalesce("publisher", F.lit("")).alias("publisher"), "year_began", "year_ended", "issue_count")


def labelled_issues(issues: DataFrame) -> DataFrame:
    """Issues of a catalog dump, not deleted, with their kind and cover year.

    An issue is ``newsstand`` by its variant name, ``canonical`` if it is a variant
    of none, else ``variant``. The year is the first of four digits in the publication
    date, else the key date's.
    """
    label = F.when(F.col("variant_name") == "Newsstand", "newsstand").when(F.col("variant_of_id").isNull(), "canonical").otherwise("variant")
    return issues.where("deleted = 0").select("issue_id", "series_id", "number", label.alias("label"), numbers.cover_year(F.col("publication_date"), F.col("key_date")).alias("cover_year"), "barcode")


def preferred_issues(issues: DataFrame) -> DataFrame:
    """One issue per series and number: first newsstand, else first canonical, else last variant; its last accepted cover year.

    A group's rows are folded in one aggregate with map-side combine, so a hot
    series and number never meets in one sort.
    """
    rank = F.when(F.col("label") == "newsstand", 0).when(F.col("label") == "canonical", 1).otherwise(2)
    order = F.when(F.col("label") == "variant", -F.col("issue_id")).otherwise(F.col("issue_id"))
    best = F.struct(rank.alias("rank"), order.alias("order"), "issue_id", "label", "cover_year")
    return issues.groupBy("series_id", "number").agg(F.min(best).alias("best"), F.count("*").alias("n_issues")).select("series_id", "number", "best.issue_id", "best.label", "best.cover_year", "n_issues")


def barcodes(issues: DataFrame) -> DataFrame:
    """First and last issue of each usable barcode."""
    return issues.where("barcode is not null and barcode <> ''").groupBy("barcode").agg(F.max("issue_id").alias("last_id"), F.min("issue_id").alias("first_id"))


def name_index(series: DataFrame, preferred: DataFrame, key: Column) -> DataFrame:
    """Per name key, publisher, number and year: how many series have the issue, and the first.

    The year is the issue's cover year, else the one in which its series began;
    ``dated`` says that it is a cover year other than 0. Names repeat over many
    series, so the index is aggregated before any join: a collection row meets
    years, not series.
    """
    named = series.select("series_id", "year_began", names.publisher(F.col("publisher")).alias("publisher"), key.alias("key")).where("key is not null and key <> ''")
    first = F.min(F.struct("series_id", "issue_id"))
    held = named.join(preferred.select("series_id", "number", "issue_id", "cover_year"), "series_id").withColumns({"year": F.coalesce("cover_year", "year_began"), "dated": F.coalesce(F.col("cover_year") != 0, F.lit(False))})
    return held.groupBy("key", "publisher", "number", F.col("year").alias("near"), "dated").agg(F.count("*").alias("n"), first.alias("first"))


def name_forms(series: DataFrame, form: Column) -> DataFrame:
    """Per form of the exact names and publisher: number of series and the first.

    Series of one exact name count together, under the publisher of their first.
    """
    grouped = representatives(series).select("n", "series_id", names.publisher(F.col("publisher")).alias("publisher"), form.alias("key")).where("key is not null and key <> ''")
    return grouped.groupBy("key", "publisher").agg(F.sum("n").alias("n"), F.min("series_id").alias("series_id"))


def name_groups(series: DataFrame, key: Column) -> DataFrame:
    """Per name key and publisher: number of series and the first."""
    named = series.select("series_id", names.publisher(F.col("publisher")).alias("publisher"), key.alias("key")).where("key is not null and key <> ''")
    return named.groupBy("key", "publisher").agg(F.count("*").alias("n"), F.min("series_id").alias("series_id"))


def any_publisher(index: DataFrame) -> DataFrame:
    """An index per publisher, with rows of a blank publisher that stand for all: rows without one meet these by the same equi-join."""
    values = {"n": F.sum("n"), "first": F.min("first"), "series_id": F.min("series_id")}
    keys = [c for c in index.columns if c not in values and c != "publisher"]
    # a copy of each row, so that the index is made once
    both = index.withColumn("publisher", F.explode(F.array_distinct(F.array("publisher", F.lit("")))))
    return both.groupBy("publisher", *keys).agg(*(values[c].alias(c) for c in index.columns if c in values)).select(*index.columns)


def representatives(series: DataFrame) -> DataFrame:
    """Per exact name (``name_key``): its first series, with name and publisher, and how many there are."""
    return series.groupBy(names.key(F.col("name")).alias("name_key")).agg(F.min(F.struct("series_id", "publisher", "name")).alias("r"), F.count("*").alias("n")).select("name_key", "r.series_id", "r.publisher", "r.name", "n")


def representative(series: DataFrame) -> DataFrame:
    """First series of each exact name, whose publisher stands for the group."""
    return representatives(series).select("name_key", "series_id", "publisher")


def active_in(series: DataFrame, collection: DataFrame) -> DataFrame:
    """Number of series active in each collection year: begun by then, and not ended before it.

    A series counts from the year it began to the one it ended (null or 0: still
    open). Starts and ends are summed per year before they are summed up over
    the years, so the window is over years, not series.
    """
    ended = F.nullif("year_ended", F.lit(0))
    spans = series.select("year_began", ended.alias("year_ended")).where("year_began is not null and (year_ended is null or year_ended >= year_began)")
    events = spans.select(F.explode(F.array(F.struct(F.col("year_began").alias("year"), F.lit(1).alias("n")), F.struct((F.col("year_ended") + 1).alias("year"), F.lit(-1).alias("n")))).alias("e")).select("e.year", "e.n")
    years = collection.groupBy("year").agg(F.count("*").alias("rows"))
    steps = events.where("year is not null").groupBy("year").agg(F.sum("n").alias("n"), F.lit(None).cast("long").alias("rows")).unionByName(years.where("year is not null").select("year", F.lit(0).cast("long").alias("n"), "rows"))
    running = steps.withColumn("active", F.sum("n").over(Window.orderBy("year")))  # a row per year
    return running.where("rows is not null").select("year", "rows", "active").unionByName(years.where("year is null").select("year", "rows", F.lit(0).cast("long").alias("active")))
