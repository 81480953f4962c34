"""Duplicate canonical series and issues: report, and merge at three levels with their mappings and variants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import staged

SERIES_KEY = ("title", "start_year")
ISSUE_KEY = (*SERIES_KEY, "number")


@dataclass(frozen=True)
class Canon:
    """The canonical tables.

    ``series``: id, title, start_year, publisher, created_at; ``issues``: issue_id,
    series_id, number, cover_date, upc, created_at; ``mappings``: mapping_id,
    source, source_issue_id, issue_id; ``variants``: variant_id, issue_id, suffix, name.
    """

    series: DataFrame
    issues: DataFrame
    mappings: DataFrame
    variants: DataFrame


@dataclass(frozen=True)
class Repaired:
    """Tables after the merge, what was merged (``level, merged_id, winner_id``), and what needs a look (``conflicts``)."""

    canon: Canon
    merged: DataFrame
    conflicts: DataFrame


def _age(created: str, key: str) -> Column:
    """Earlier rows first, those without a time last, then the least id."""
    return F.struct(F.col(created).isNull().alias("unknown"), F.col(created).alias("at"), F.col(key).alias("id"))


def _keyed(canon: Canon) -> DataFrame:
    """Issues with their series' key; issues without a series, or of one without title or year, are in no group."""
    keys = canon.series.where("title is not null and start_year is not null").select(F.col("id").alias("series_id"), *SERIES_KEY, _age("created_at", "id").alias("series_age"))
    return canon.issues.where("number is not null").join(keys, "series_id").withColumn("age", _age("created_at", "issue_id"))


def _groups(rows: DataFrame, key: tuple[str, ...], age: str) -> DataFrame:
    """Keys held more than once, and the id of the first."""
    return rows.groupBy(*key).agg(F.count("*").alias("members"), F.min(age).alias("first")).where("members > 1").select(*key, "members", F.col("first.id").alias("winner"))


def _touched(groups: DataFrame, rows: DataFrame, key: tuple[str, ...], series_ids: DataFrame | None, issue_ids: DataFrame | None) -> DataFrame:
    """The groups that hold a selected series or issue; all where nothing is selected."""
    if series_ids is None and issue_ids is None:
        return groups
    hit = None
    for ids, column in ((series_ids, "series_id"), (issue_ids, "issue_id")):
        if ids is not None:
            some = rows.join(ids.select(F.col("id").alias(column)).distinct(), column, "left_semi").select(*key)
            hit = some if hit is None else hit.unionByName(some)
    return groups.join(hit.distinct(), list(key), "left_semi")


def _series_groups(canon: Canon, keyed: DataFrame, series_ids: DataFrame | None, issue_ids: DataFrame | None) -> DataFrame:
    named = canon.series.where("title is not null and start_year is not null")
    groups = _groups(named.withColumn("age", _age("created_at", "id")), SERIES_KEY, "age")
    held = named.select(F.col("id").alias("series_id"), *SERIES_KEY).join(keyed.select("series_id", "issue_id"), "series_id", "left")
    return _touched(groups, held, SERIES_KEY, series_ids, issue_ids)


def series_duplicates(canon: Canon, series_ids: DataFrame | None = None, issue_ids: DataFrame | None = None) -> DataFrame:
    """Each member of the series groups: proposed winner, its place, issue count and numbers, mappings and their sources."""
    keyed = _keyed(canon)
    groups = _series_groups(canon, keyed, series_ids, issue_ids)
    maps = canon.mappings.groupBy("issue_id").agg(F.count("*").alias("n_maps"), F.collect_set("source").alias("sources"))
    held = canon.issues.join(maps, "issue_id", "left").groupBy(F.col("series_id").alias("id")).agg(F.count("*").alias("n_issues"), F.array_sort(F.collect_list("number")).alias("numbers"), F.sum("n_maps").alias("n_maps"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"))
    text = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return canon.series.join(groups, list(SERIES_KEY)).join(held, "id", "left").select(*SERIES_KEY, "winner", "members", "id", "publisher", (F.col("id") == F.col("winner")).alias("is_winner"), zero("n_issues"), text("numbers").alias("numbers"), zero("n_maps"), text("sources").alias("sources"))


def issue_duplicates(canon: Canon, series_ids: DataFrame | None = None, issue_ids: DataFrame | None = None) -> DataFrame:
    """Each member of the issue groups: proposed winner, fields, variants' suffixes, and mappings."""
    keyed = _keyed(canon)
    groups = _touched(_groups(keyed, ISSUE_KEY, "age"), keyed, ISSUE_KEY, series_ids, issue_ids)
    maps = canon.mappings.groupBy("issue_id").agg(F.array_sort(F.collect_list(F.concat_ws(":", "source", "source_issue_id"))).alias("maps"))
    kinds = canon.variants.groupBy("issue_id").agg(F.array_sort(F.collect_list("suffix")).alias("suffixes"))
    text = lambda c: F.coalesce(F.array_join(c, ","), F.lit("")).alias(c)
    return keyed.join(groups, list(ISSUE_KEY)).join(maps, "issue_id", "left").join(kinds, "issue_id", "left").select(*ISSUE_KEY, "winner", "members", "issue_id", "series_id", "cover_date", "upc", text("suffixes"), text("maps"))


def _first(value: str, order: Column) -> Column:
    """The first known value, with its place."""
    return F.min(F.when(F.col(value).isNotNull(), F.struct(order.alias("o"), F.col(value).alias("v"))))


def _conflicts(rows: DataFrame, level: str, winner: str, loser: str, field: str, kept: str) -> DataFrame:
    """Losers whose value differs from the one kept; empty values conflict with none."""
    differ = (F.col(kept) != "") & (F.col(field) != "") & (F.col(kept) != F.col(field))
    return rows.where(differ & (F.col(winner) != F.col(loser))).select(F.lit(level).alias("level"), F.col(winner).cast("long").alias("winner_id"), F.col(loser).cast("long").alias("merged_id"), F.col(kept).alias("kept"), F.col(field).alias("dropped"))


def _merge_issues(issues: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Issues after the groups of ``places`` (issue_id, winner, place) are merged, the moved ids, and conflicting codes.

    The winner takes the first known date and code where it has none.
    """
    grouped = staged(issues.join(places, "issue_id"))
    fields = grouped.groupBy("winner").agg(_first("cover_date", F.col("place")).alias("date"), _first("upc", F.col("place")).alias("code")).select("winner", F.col("date.v").alias("kept_date"), F.col("code.v").alias("kept_upc"))
    whole = grouped.join(fields, "winner")
    kept = whole.where("issue_id = winner").withColumns({"cover_date": F.col("kept_date"), "upc": F.col("kept_upc")}).select(*issues.columns)
    after = issues.join(places.select("issue_id"), "issue_id", "left_anti").unionByName(kept)
    moved = grouped.where("issue_id <> winner").select("issue_id", "winner")
    return after, moved, _conflicts(whole, "issue", "winner", "issue_id", "upc", "kept_upc")


def _merge_variants(variants: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Variants of merged issues under the winner, one per suffix; the first takes the first name where it has none."""
    order = F.struct("place", "variant_id")
    met = staged(variants.join(places, "issue_id").withColumn("order", order))
    named = F.min(F.when(F.col("name") != "", F.struct("order", "name")))
    best = met.groupBy("winner", "suffix").agg(F.min(F.struct("order", "variant_id", "name", "issue_id")).alias("f"), named.alias("n"))
    best = best.select("winner", "suffix", F.col("f.variant_id").alias("kept_id"), F.coalesce("f.name", "n.name").alias("kept_name"))
    same = met.join(best.withColumnRenamed("suffix", "kept_suffix"), (met["winner"] == best["winner"]) & met["suffix"].eqNullSafe(F.col("kept_suffix"))).drop(best["winner"])
    kept = best.select(F.col("kept_id").alias("variant_id"), F.col("winner").alias("issue_id"), "suffix", F.col("kept_name").alias("name"))
    after = variants.join(places.select("issue_id"), "issue_id", "left_anti").select(*variants.columns).unionByName(kept.select(*variants.columns))
    return after, same.where("variant_id <> kept_id").select("variant_id", F.col("kept_id").alias("winner")), _conflicts(same, "variant", "kept_id", "variant_id", "name", "kept_name")


def _pointed(rows: DataFrame, moved: DataFrame, column: str) -> DataFrame:
    """Rows with a foreign key of a merged row set to its winner."""
    to = moved.select(F.col(moved.columns[0]).alias(column), F.col("winner").alias("__to"))
    return rows.join(to, column, "left").withColumn(column, F.coalesce("__to", column)).select(*rows.columns)


def repair(canon: Canon, series_ids: DataFrame | None = None, issue_ids: DataFrame | None = None) -> Repaired:
    """Merge duplicate issues, then duplicate series, and the issues of one number that then meet.

    A group's winner is its earliest row (no time: last; then the least id). With
    a selection (``id`` columns) only groups that hold a selected series or issue
    are merged. Foreign keys follow level by level; winners, first known values and
    maps of ids are map-side combined aggregates, so a large group needs no sort in
    one task. A second run of the result changes nothing.
    """
    keyed = staged(_keyed(canon))
    runs = staged(_series_groups(canon, keyed, series_ids, issue_ids))
    first = _touched(_groups(keyed, ISSUE_KEY, "age"), keyed, ISSUE_KEY, series_ids, issue_ids)
    places = staged(keyed.join(first, list(ISSUE_KEY)).select("issue_id", F.col("winner"), F.col("age").alias("place")))
    issues, moved, codes = _merge_issues(canon.issues, places)
    issues, moved = staged(issues), staged(moved)
    variants, gone, names = _merge_variants(canon.variants, places)
    variants, gone = staged(variants), staged(gone)
    mappings = staged(_pointed(canon.mappings, moved, "issue_id"))

    # series: issues of one number meet now, in the order of their series
    members = staged(canon.series.withColumn("age", _age("created_at", "id")).join(runs, list(SERIES_KEY)))
    met = issues.join(members.select(F.col("id").alias("series_id"), F.col("winner").alias("run"), F.col("age").alias("series_age")), "series_id")
    met = met.where("number is not null").select("issue_id", "run", "number", F.struct("series_age", _age("created_at", "issue_id").alias("own")).alias("place"))
    again = met.groupBy("run", "number").agg(F.count("*").alias("n"), F.min("place").alias("f")).where("n > 1").select("run", "number", F.col("f.own.id").alias("winner"))
    second = staged(met.join(again, ["run", "number"]).select("issue_id", "winner", "place"))
    issues, moved2, codes2 = _merge_issues(issues, second)
    variants, gone2, names2 = _merge_variants(variants, second)
    moved2 = staged(moved2)
    mappings = _pointed(mappings, moved2, "issue_id")
    losers = members.where("id <> winner").select("id", "winner")
    issues = _pointed(issues, losers, "series_id")

    known = members.groupBy("winner").agg(_first("publisher", F.col("age")).alias("p")).select("winner", F.col("p.v").alias("kept_publisher"))
    whole = members.join(known, "winner")
    winners = whole.where("id = winner").withColumn("publisher", F.col("kept_publisher")).select(*canon.series.columns)
    series = canon.series.join(members.select("id"), "id", "left_anti").unionByName(winners)
    publishers = _conflicts(whole, "series", "winner", "id", "publisher", "kept_publisher")

    log = lambda df, level: df.select(F.lit(level).alias("level"), F.col(df.columns[0]).cast("long").alias("merged_id"), F.col("winner").cast("long").alias("winner_id"))
    merged = log(moved, "issue").unionByName(log(moved2, "issue")).unionByName(log(losers, "series")).unionByName(log(gone, "variant")).unionByName(log(gone2, "variant"))
    conflicts = publishers
    for more in (codes, codes2, names, names2):
        conflicts = conflicts.unionByName(more)
    return Repaired(Canon(series, issues, mappings, variants), merged, conflicts)


def repair_summary(repaired: Repaired) -> DataFrame:
    """Rows merged and conflicts per level; a level with conflicts needs a manual review."""
    counts = repaired.merged.groupBy("level").agg(F.count("*").alias("merged")).withColumn("conflicts", F.lit(0).cast("long"))
    clashes = repaired.conflicts.groupBy("level").agg(F.count("*").alias("conflicts")).withColumn("merged", F.lit(0).cast("long"))
    return counts.unionByName(clashes).groupBy("level").agg(F.sum("merged").alias("merged"), F.sum("conflicts").alias("conflicts")).withColumn("review", F.col("conflicts") > 0)
