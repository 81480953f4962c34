"""The first-hit cascade of series lookups, layered name lookup and catalog browsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.functions import names, numbers

from . import catalog, matching
from .similar import alike_pairs
from .staging import staged

#: Years between which a series or issue counts as of the row's era.
ERA = 5
#: Gap in years from which a series group is tried as well.
LARGE_GAP = 6


def _when(condition: Column, *fields: Column | str) -> Column:
    return F.min(F.when(condition, F.struct(*fields)))


def find_series(rows: DataFrame, series: DataFrame, preferred: DataFrame, issues: DataFrame) -> DataFrame:
    """Series of each row (``row_id, name, number, year, publisher``), and how it was found.

    Candidates have the row's name, with or without its article, with a comma for
    a colon, or its base name. Those of another era go unless all would. The only
    candidate wins, else the only one with the issue, else the one with the closest
    cover year; without any, the reverse lookup, else the first candidate.

    Rows are reduced to distinct names, numbers and years; candidates are counted
    per name, number and years before they meet the rows.
    """
    asked = rows.select("name", "number", "year").distinct()
    forms = F.array_distinct(F.array_compact(F.array(names.key(F.col("name")), names.article_key(F.col("name")), names.comma_key(F.col("name")), names.key(names.base_name(F.col("name"))))))
    tried = asked.select("name", "number", "year", F.posexplode(forms).alias("level", "key")).where("key <> ''")
    named = series.select("series_id", "year_began", F.nullif("year_ended", F.lit(0)).alias("year_ended"), names.key(F.col("name")).alias("key"))
    met = tried.select("key", "number").distinct().join(named, "key").join(preferred.select("series_id", "number", "issue_id", "cover_year"), ["series_id", "number"], "left")
    has, dated = F.col("issue_id").isNotNull(), F.col("cover_year").isNotNull()
    spots = met.groupBy("key", "number", has.alias("has"), "cover_year", F.when(~dated, F.col("year_began")).alias("began"), F.when(~dated, F.col("year_ended")).alias("ended")).agg(F.count("*").alias("n"), F.min("series_id").alias("series_id"))
    inside = F.when(F.col("cover_year").isNotNull(), F.abs(F.col("cover_year") - F.col("year")) <= ERA).otherwise((F.col("began") <= F.col("year") + ERA) & (F.col("ended").isNull() | (F.col("ended") >= F.col("year") - ERA)))
    x = tried.join(spots, ["key", "number"]).withColumn("inside", F.coalesce(inside, F.lit(True))).withColumn("d", F.abs(F.coalesce("cover_year", "began") - F.col("year")))
    near, with_issue = F.col("inside"), F.col("has")
    counted = x.groupBy("name", "number", "year").agg(
        F.sum("n").alias("n_all"), F.sum(F.when(near, F.col("n")).otherwise(0)).alias("n_in"), F.sum(F.when(near & with_issue, F.col("n")).otherwise(0)).alias("has_in"), F.sum(F.when(with_issue, F.col("n")).otherwise(0)).alias("has_all"),
        _when(near & with_issue, "d", "level", "series_id").alias("best_in"), _when(with_issue, "d", "level", "series_id").alias("best_all"), _when(near, "level", "series_id").alias("first_in"), _when(F.lit(True), "level", "series_id").alias("first_all"),
    )
    some = F.col("n_in") > 0
    pick = lambda a: F.when(some, F.col(f"{a}_in")).otherwise(F.col(f"{a}_all"))
    n_has = pick("has")
    how = F.when(F.col("n_all") == 1, "only_series").when(n_has == 1, "only_one_with_issue").when((n_has > 1) & F.col("year").isNull(), "multiple_with_issue").when(n_has > 1, "closest_year_with_issue")
    found = counted.select("name", "number", "year", how.alias("how"), F.when(F.col("n_all") == 1, F.col("first_all.series_id")).when(n_has > 0, pick("best")["series_id"]).alias("found"), pick("first")["series_id"].alias("first"), pick("n").alias("n_series"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("name", "number", "year")]
    placed = staged(rows.alias("r").join(found.alias("f"), same[0] & same[1] & same[2], "left").select("r.*", "how", "found", "first", "n_series"))
    back = matching.by_reverse(placed.where("found is null").withColumn("raw", names.key(F.col("name"))), series, issues).select("row_id", F.col("series_id").alias("back"), "strategy")
    last = F.when(F.col("first").isNotNull(), F.concat(F.lit("no_issue_in_"), F.col("n_series"), F.lit("_series")))
    return placed.join(back, "row_id", "left").select("row_id", F.coalesce("found", "back", "first").alias("series_id"), F.coalesce("how", "strategy", last).alias("how"))


def cascade(collection: DataFrame, series: DataFrame, issues: DataFrame) -> DataFrame:
    """First hit of each collection row: barcode, then series name, then series group.

    The group is also tried when the name's issue is six years off or more, and
    wins if it is closer. ``match_type`` tells the series step and the issue's label.
    ``collection`` has a column ``series_group``, ``series`` a column ``year_ended``.
    """
    rows = matching.standardise(collection).drop("raw").join(collection.select("row_id", "series_group"), "row_id")
    preferred, codes = staged(catalog.preferred_issues(issues)), catalog.barcodes(issues)
    hits = matching.by_barcode(rows, codes).select("row_id", F.col("issue_id").alias("code_issue"))
    rows = staged(rows.join(hits, "row_id", "left"))
    hits, rest = rows.where("code_issue is not null").select("row_id", "code_issue"), rows.where("code_issue is null").drop("code_issue")
    label = preferred.select("series_id", "number", "issue_id", "label", "cover_year")

    def tried(source: DataFrame, c: str) -> DataFrame:
        asked = source.select("row_id", names.strip_volume(F.col(c)).alias("name"), "number", "year", "publisher")
        found = find_series(asked, series, preferred, issues).where("series_id is not null")
        return asked.select("row_id", "number", "year").join(found, "row_id").join(label, ["series_id", "number"], "left").select("row_id", "series_id", "issue_id", "label", "how", F.abs(F.col("cover_year") - F.col("year")).alias("gap"))

    own = staged(tried(rest, "series_name"))
    again = rest.where("series_group <> ''").join(own.where(f"coalesce(gap, 0) < {LARGE_GAP}").select("row_id"), "row_id", "left_anti")
    group = tried(again, "series_group").select("row_id", *(F.col(c).alias(f"g_{c}") for c in ("series_id", "issue_id", "label", "how", "gap")))
    x = collection.select("row_id").join(hits, "row_id", "left").join(own, "row_id", "left").join(group, "row_id", "left")
    use = F.col("g_series_id").isNotNull() & (F.col("series_id").isNull() | F.coalesce(F.col("g_gap") < F.col("gap"), F.lit(False)))
    best = lambda c: F.when(use, F.col(f"g_{c}")).otherwise(F.col(c))
    how = F.when(use & F.col("series_id").isNull(), F.concat("g_how", F.lit("_from_series_group"))).when(use, F.concat("g_how", F.lit("_fallback_from_series"))).otherwise(F.col("how"))
    kind = F.when(F.col("code_issue").isNotNull(), "barcode").when(how.isNull(), "no_series").otherwise(F.concat(how, F.lit(":"), F.coalesce(best("label"), F.lit("no_issue"))))
    return x.select("row_id", F.coalesce("code_issue", best("issue_id")).alias("issue_id"), best("series_id").alias("series_id"), kind.alias("match_type"))


def layered(rows: DataFrame, series: DataFrame, aliases: DataFrame, least: float = 0.85) -> DataFrame:
    """Series of each row (``row_id, name, year``) by the first layer that has any, closest in year.

    Layers: manual alias (1), exact (2), remembered alias (3; a null name is a known
    miss and ends the search), changed forms (4), fuzzy within -10 and +5 years (5).
    ``aliases`` has ``alias, target, layer``. One table of forms meets the catalog in
    one join; only names without a hit are compared fuzzily.
    """
    asked = rows.select("name", "year").distinct()
    name = F.col("name")
    forms = F.array(F.struct(F.lit(2).alias("layer"), names.key(name).alias("key")), *(F.struct(F.lit(4).alias("layer"), names.key(c).alias("key")) for c in (names.normalized(name), names.strip_volume(name), F.regexp_replace(name, r"\s*\([^)]+\)$", ""), F.regexp_replace(name, r"(?i)^The\s+", ""))))
    direct = asked.select("name", "year", F.explode(F.array_distinct(forms)).alias("f")).select("name", "year", "f.layer", "f.key")
    known = asked.join(aliases.select(F.col("alias").alias("name"), "target", "layer"), "name")
    tried = direct.unionByName(known.where("target is not null").select("name", "year", "layer", names.key(F.col("target")).alias("key"))).where("key <> ''")
    index = series.groupBy(names.key(F.col("name")).alias("key"), "year_began").agg(F.min("series_id").alias("series_id"))
    gap = F.abs(F.col("year_began") - F.col("year"))
    misses = known.where("target is null").select("name", "year", "layer", F.lit(0).alias("gap"), F.lit(None).cast("long").alias("series_id"))
    hits = tried.join(index, "key").select("name", "year", "layer", gap.alias("gap"), "series_id").unionByName(misses)
    best = F.min(F.struct("layer", "gap", "series_id")).alias("b")
    first = hits.groupBy("name", "year").agg(best)
    rest = asked.alias("a").join(first.alias("f"), F.col("a.name").eqNullSafe(F.col("f.name")) & F.col("a.year").eqNullSafe(F.col("f.year")), "left_anti").withColumn("key", names.key(name))
    alike = alike_pairs(rest.select(F.col("key").alias("name")), series.select(names.key(name).alias("name")), least)
    near = rest.join(alike, rest["key"] == alike["title"]).drop("key").join(index.withColumnRenamed("key", "known"), "known").where(F.col("year").isNull() | F.col("year_began").between(F.col("year") - 10, F.col("year") + 5))
    fuzzy = near.groupBy("name", "year").agg(F.min(F.struct((-F.col("alike")).alias("a"), gap.alias("gap"), "series_id")).alias("b")).select("name", "year", F.lit(5).alias("layer"), F.col("b.series_id").alias("series_id"), (-F.col("b.a")).alias("alike"))
    found = first.select("name", "year", "b.layer", "b.series_id", F.lit(None).cast("double").alias("alike")).unionByName(fuzzy)
    score = F.when(F.col("series_id").isNull(), 0.0).when(F.col("layer") <= 2, 1.0).when(F.col("layer") == 3, 0.85).when(F.col("layer") == 4, 0.95).otherwise(F.col("alike"))
    joined = rows.alias("r").join(found.alias("f"), F.col("r.name").eqNullSafe(F.col("f.name")) & F.col("r.year").eqNullSafe(F.col("f.year")), "left")
    return joined.select("row_id", F.coalesce("layer", F.lit(0)).alias("layer"), "series_id", score.alias("score"))


def browse_title(c: Column) -> Column:
    """Lower case without article, volume, punctuation and repeated blanks."""
    c = F.regexp_replace(F.lower(F.trim(c)), r"^(the|a|an)\s+", "")
    return names.squeeze(F.regexp_replace(F.regexp_replace(c, r"(?U),?\s*\bvol(ume)?\.?\s*\d+", ""), r"(?U)[^\w\s]", " "))


# Spellings of the same issue number.
NUMBER_ALIASES = {"-1": ("−1", "negative 1"), "1/2": ("½", "0.5"), "1/4": ("¼", "0.25"), "0": ("#0", "no. 0")}


def number_class(c: Column) -> Column:
    """One spelling for each class of issue numbers."""
    t = F.lower(F.trim(c))
    pairs = [F.lit(x) for name, spellings in NUMBER_ALIASES.items() for s in spellings for x in (s, name)]
    return F.coalesce(F.create_map(*pairs)[t], t)


def title_pairs(terms: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct titles of which one contains the other, equal short ones included (columns ``term, name``)."""
    short = lambda df, c: df.where("name <> '' and length(name) < 4").select(F.col("name").alias(c)).distinct()
    equal = short(terms, "term").join(short(known, "name"), F.col("term") == F.col("name"))
    return matching.substring_names(terms, known).unionByName(equal.select("term", "name"))


def browse(queries: DataFrame, series: DataFrame, issues: DataFrame) -> DataFrame:
    """Best catalog issue of each query (``row_id, title, publisher, number, year``) by points.

    Publisher 30 (must agree), title 30 if equal or 25 if contained, number 30 if
    equal or 25 by its class, year within one 10; 90 and more is a high match.
    Contained titles are found between distinct titles first, then the join is on
    title, publisher and number.
    """
    asked = queries.select("row_id", browse_title(F.col("title")).alias("title"), names.publisher(F.col("publisher")).alias("publisher"), number_class(F.col("number")).alias("class"), "number", "year")
    named = series.select("series_id", browse_title(F.col("name")).alias("name"), names.publisher(F.col("publisher")).alias("publisher"))
    index = issues.join(named, "series_id").groupBy("publisher", "name", number_class(F.col("number")).alias("class"), F.col("number").alias("own"), "cover_year").agg(F.min("issue_id").alias("issue_id"))
    pairs = title_pairs(asked.select(F.col("title").alias("name")), named.select("name"))
    key = ["title", "publisher", "class", "number", "year"]
    met = asked.select(*key).distinct().join(pairs, F.col("title") == F.col("term")).join(index, ["publisher", "name", "class"])
    points = 30 + F.when(F.col("title") == F.col("name"), 30).otherwise(25) + F.when(F.col("number") == F.col("own"), 30).otherwise(25) + F.when(F.abs(F.col("cover_year") - F.col("year")) <= 1, 10).otherwise(0)
    best = met.groupBy(*key).agg(F.min(F.struct((-points).alias("p"), "issue_id")).alias("b"))
    same = F.lit(True)
    for c in key:
        same &= F.col(f"q.{c}").eqNullSafe(F.col(f"b.{c}"))
    score = F.coalesce(-F.col("b.b.p"), F.lit(0))
    return asked.alias("q").join(best.alias("b"), same, "left").select("row_id", F.col("b.b.issue_id").alias("issue_id"), score.alias("score"), (score >= 90).alias("high"))
