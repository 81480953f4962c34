"""Matching strategies of collection rows against the catalog, and their contest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.functions import names, numbers

from . import catalog
from .staging import staged, written

# Confidence of each strategy, in the order in which ties are decided.
LADDER = {
    "barcode_exact": 100, "barcode_prefix": 100, "exact_one_issue_group": 90, "exact_closest_year_group": 85, "exact_one_issue": 90, "exact_closest_year": 85, "exact_series": 80, "strict_series": 75, "word_order": 70, "colon_comma": 68,
    "article_variant": 60, "substring": 50, "base_name": 45, "date_based": 40, "reverse_one": 65, "reverse_similarity": 55,
}
# An article variant with the issue, and any issue found by its full number.
WITH_ISSUE = 90
# Gaps in years from which a group's match is compared with the name's, and above which it is dropped.
RETRY_GAP, GROUP_GAP = 4, 15
#: Most names of a word by which names meet one by one in the reverse lookup.
RARE = 32
#: Stands for a distance that is not known.
FAR = 10**6
RESULT = ("row_id", "issue_id", "series_id", "strategy", "confidence", "year_distance")


def standardise(collection: DataFrame) -> DataFrame:
    """Match input: keys, number, checked year and usable barcode of each collection row.

    ``series_group`` and ``number_full`` may be absent. ``group_key`` is null where
    the group is blank or the series itself; ``full`` where the full number has
    not both letters and digits or is the number.
    """
    extra = lambda c: F.col(c) if c in collection.columns else F.lit(None).cast("string")
    # names repeat over rows, so each is cut and folded once; step by step, for all columns that are made of it
    x = collection.select("series_name").distinct().withColumn("name", names.collection_name(F.col("series_name"))).withColumn("base", names.base_name(F.col("name")))
    x = x.withColumns({"key": names.key(F.col("name")), "base": names.key(F.col("base"))})
    base, key = F.col("base"), F.col("key")
    named = x.select(
        "series_name", "key", names.key(F.col("series_name")).alias("raw"), names.strict(F.col("name")).alias("strict"), names.word_key(F.col("series_name")).alias("words"), names.comma_key(F.col("name")).alias("comma"), names.article_key(F.col("name")).alias("article"),
        F.when((base != "") & (base != key), base).alias("base"),
    )
    owner, full = extra("series_group"), F.trim(extra("number_full"))
    rows = collection.select(
        "row_id", "series_name", numbers.catalog_number(F.col("number")).alias("number"), numbers.year(F.col("year").cast("string"), 1950, 2026).alias("year"), names.publisher(F.col("publisher")).alias("publisher"), numbers.barcode(F.col("barcode")).alias("barcode"),
        F.when(F.trim(owner) != "", names.collection_name(owner)).alias("group"), full.alias("full"),
    ).withColumn("group", names.key(F.col("group")))
    group, full = F.col("group"), F.col("full")
    return rows.join(named, "series_name", "left").select(
        "row_id", "series_name", "key", "raw", "strict", "words", "comma", "article", "base", "number", "year", "publisher", "barcode",
        F.when(group != key, group).alias("group_key"), F.when(full.rlike("[A-Za-z]") & full.rlike("[0-9]") & (full != F.col("number")), full).alias("full"),
    )


def _result(df: DataFrame, strategy: Column | str, issue: Column | None, series: Column | None, distance: Column | None, confidence: Column | None = None) -> DataFrame:
    strategy = F.lit(strategy) if isinstance(strategy, str) else strategy
    ladder = F.create_map(*(F.lit(x) for pair in LADDER.items() for x in pair))
    none = F.lit(None).cast("long")
    return df.select("row_id", (issue if issue is not None else none).alias("issue_id"), (series if series is not None else none).alias("series_id"), strategy.alias("strategy"), (confidence if confidence is not None else ladder[strategy]).alias("confidence"), (distance if distance is not None else F.lit(None)).cast("int").alias("year_distance"))


def coded(collection: DataFrame) -> DataFrame:
    """Usable barcode of each collection row, without what matching by name needs."""
    return collection.select("row_id", numbers.barcode(F.col("barcode")).alias("barcode"))


def by_barcode(rows: DataFrame, barcodes: DataFrame) -> DataFrame:
    """Equal barcode: the last issue that has it."""
    return _result(rows.join(barcodes, "barcode"), "barcode_exact", F.col("last_id"), None, None)


def by_barcode_prefix(rows: DataFrame, barcodes: DataFrame) -> DataFrame:
    """Barcodes that begin with the row's, or whose first 13 digits begin it: the one first listed, its last issue.

    Prefixes of every length are equi-join keys: of at most 13 digits on either
    side, as a row's longer barcode can only begin one whose first 13 digits it has.
    """
    first = F.min(F.struct("first_id", "last_id")).alias("b")
    heads = written(barcodes.groupBy(F.substring("barcode", 1, 13).alias("head")).agg(first))
    asked = rows.where("barcode <> ''").select("barcode").distinct()
    # only lengths that the other side has, at most 13 of them, not a prefix of every length
    lengths = lambda df, c: F.broadcast(df.select(F.length(c).alias("digits")).where("digits <= 13").distinct())
    cut = lambda c: F.substring(F.col(c), F.lit(1), F.col("digits"))
    begun = asked.join(lengths(heads, "head"), F.length("barcode") >= F.col("digits")).select("barcode", cut("barcode").alias("head")).join(heads, "head")
    short = asked.where("length(barcode) < 13")
    longer = heads.join(lengths(short, "barcode"), F.length("head") >= F.col("digits")).groupBy(cut("head").alias("barcode")).agg(F.min("b").alias("b"))
    met = begun.select("barcode", "b").unionByName(short.join(longer, "barcode")).groupBy("barcode").agg(F.min("b").alias("b"))
    return _result(rows.join(met, "barcode"), "barcode_prefix", F.col("b.last_id"), None, None)


def by_exact_name(rows: DataFrame, index: DataFrame, key: str = "key", suffix: str = "") -> DataFrame:
    """Equal name and publisher with the issue: the only series, else the closest in year if the row has one."""
    met = rows.where(f"{key} is not null").select("row_id", F.col(key).alias("key"), "publisher", "number", "year").join(index, ["key", "publisher", "number"])
    distance = F.abs(F.col("near") - F.col("year"))
    found = met.groupBy("row_id", "year").agg(F.sum("n").alias("n"), F.min(F.struct("first.series_id", "first.issue_id", F.when(F.col("dated"), distance).alias("d"))).alias("f"), F.min(F.struct(F.coalesce(distance, F.lit(FAR)).alias("d"), "first.series_id", "first.issue_id")).alias("c"))
    one = F.col("n") == 1
    pick = lambda c: F.when(one, F.col(f"f.{c}")).otherwise(F.col(f"c.{c}"))
    return _result(found.where(one | F.col("year").isNotNull()), F.when(one, "exact_one_issue" + suffix).otherwise("exact_closest_year" + suffix), pick("issue_id"), pick("series_id"), F.nullif(pick("d"), F.lit(FAR)))


def by_series_only(rows: DataFrame, key: str, groups: DataFrame, strategy: str) -> DataFrame:
    """Exactly one series with the name and publisher, whether or not it has the issue."""
    met = rows.where(f"{key} is not null").select("row_id", F.col(key).alias("key"), "publisher").join(groups.where("n = 1"), ["key", "publisher"])
    return _result(met, strategy, None, F.col("series_id"), None)


def by_word_order(rows: DataFrame, series: DataFrame) -> DataFrame:
    """Exactly one series among the names that have the row's words and are spelt another way than its key."""
    groups = catalog.representatives(series).select("n", "series_id", F.col("name").alias("spelt"), names.publisher(F.col("publisher")).alias("own"), names.word_key(F.col("name")).alias("words"))
    gated = groups.select("n", "series_id", "spelt", "words", F.explode(F.array_distinct(F.array("own", F.lit("")))).alias("publisher"))
    asked = rows.where("words is not null").select("words", "publisher", "key").distinct()
    only = asked.join(gated, ["words", "publisher"]).where(F.col("spelt") != F.col("key")).groupBy("words", "publisher", "key").agg(F.sum("n").alias("n"), F.min("series_id").alias("series_id")).where("n = 1")
    return _result(rows.join(only, ["words", "publisher", "key"]), "word_order", None, F.col("series_id"), None)


def by_article(rows: DataFrame, groups: DataFrame, preferred: DataFrame) -> DataFrame:
    """The only series of the name with or without its article: sure if it has the issue."""
    met = rows.select("row_id", F.col("article").alias("key"), "publisher", "number", "year").join(groups.where("n = 1"), ["key", "publisher"])
    held = met.join(preferred.select("series_id", "number", "issue_id", "cover_year"), ["series_id", "number"], "left")
    sure = F.col("issue_id").isNotNull()
    return _result(held, "article_variant", F.col("issue_id"), F.col("series_id"), F.abs(F.nullif("cover_year", F.lit(0)) - F.col("year")), F.when(sure, WITH_ISSUE).otherwise(LADDER["article_variant"]))


def by_base_name(rows: DataFrame, series: DataFrame, preferred: DataFrame) -> DataFrame:
    """Names with the row's base name: the issue closest in cover year, else the first with the issue, else the only series."""
    form, publisher = names.key(names.base_name(F.col("name"))), names.publisher(F.col("publisher"))
    heads = catalog.representatives(series).select("name_key", F.col("series_id").alias("head"), publisher.alias("publisher"), form.alias("base")).where("base <> ''")
    # written before any filter: one on a derived column would derive it again for every place it has in it
    unknown = F.coalesce("year", F.lit(0)).alias("at")
    asked = written(rows.select("row_id", "base", "publisher", "number", "year", unknown)).where("base is not null")
    heads = heads.join(asked.select("base").distinct(), "base", "left_semi")
    members = series.select("series_id", names.key(F.col("name")).alias("name_key")).join(heads, "name_key")
    total = catalog.any_publisher(members.groupBy("base", "publisher").agg(F.count("*").alias("n"), F.min("series_id").alias("series_id")))
    held = members.join(preferred.select("series_id", "number", "issue_id", F.nullif("cover_year", F.lit(0)).alias("cover_year")), "series_id").groupBy("base", "publisher", "number", "cover_year").agg(F.min(F.struct("head", "series_id", "issue_id")).alias("first"))
    distance = F.abs(F.col("cover_year") - F.col("year"))
    # rows repeat names, numbers and years, so those meet the cover years, not rows
    by = ["base", "publisher", "number"]
    issue = asked.select(*by, "at", "year").distinct().join(catalog.any_publisher(held), by).groupBy(*by, "at").agg(F.min("first").alias("f"), F.min(F.when(distance.isNotNull(), F.struct(distance.alias("d"), "first.head", "first.series_id", "first.issue_id"))).alias("c"))
    met = asked.join(total, ["base", "publisher"]).join(issue, [*by, "at"], "left").where("f is not null or n = 1")
    return _result(met, "base_name", F.coalesce("c.issue_id", "f.issue_id"), F.coalesce("c.series_id", "f.series_id", "series_id"), F.col("c.d"))


def by_reverse(rows: DataFrame, series: DataFrame, issues: DataFrame) -> DataFrame:
    """Any issue of the number within five years: of the only series, else the row's publisher's only one, else the name most alike (above 0).

    Where no series found has the row's publisher, all count. Ties go to the least
    series; of its issues the first by year and id is taken. Names are held once per
    number and publisher, with the years of their issues; a series counts as the only
    one where the least and the greatest are equal. ``rows`` has ``raw``, ``number``,
    ``year`` and ``publisher``.
    """
    named = series.select("series_id", names.key(F.col("name")).alias("name"), names.publisher(F.col("publisher")).alias("publisher"))
    spots = issues.where("cover_year between 1950 and 2025").groupBy("series_id", "number", "cover_year").agg(F.min("issue_id").alias("issue_id"))
    kept = written(spots.join(named, "series_id"))
    inputs = written(rows.where("year is not null").select("number", "year", "publisher", "raw").distinct())
    ends = lambda *by: (F.min("low").alias("low"), F.max("high").alias("high"))
    scoped = kept.select("number", "cover_year", "name", F.col("series_id").alias("low"), F.col("series_id").alias("high"), F.explode(F.array_distinct(F.array("publisher", F.lit("")))).alias("scope"))
    table = scoped.groupBy("number", "scope", "name", "cover_year").agg(*ends()).groupBy("number", "scope", "name").agg(F.collect_list(F.struct("cover_year", "low", "high")).alias("spots"))  # at most 76
    held = written(table.join(inputs.select("number").distinct(), "number"))
    near = F.filter("spots", lambda s: F.abs(s["cover_year"] - F.col("year")) <= 5)
    at = lambda df: df.withColumn("near", near).where("size(near) > 0").withColumns({"low": F.array_min(F.transform("near", lambda s: s["low"])), "high": F.array_max(F.transform("near", lambda s: s["high"]))}).drop("near", "spots")
    # a cover year counts for the years around it; names and classes are summed up per cover year before that
    around = F.explode(F.sequence(F.col("cover_year") - 5, F.col("cover_year") + 5)).alias("year")
    whole = scoped.groupBy("number", "scope", "cover_year").agg(*ends()).select("number", "scope", "low", "high", around).groupBy("number", "year", "scope").agg(*ends())
    own = whole.where("scope <> ''").withColumnRenamed("scope", "publisher")
    alone = whole.where("scope = ''").select("number", "year", F.col("low").alias("all_low"), F.col("high").alias("all_high"))
    x = inputs.join(alone, ["number", "year"]).join(own, ["number", "year", "publisher"], "left")
    only = F.when(F.col("all_low") == F.col("all_high"), F.col("all_low")).when(F.col("low") == F.col("high"), F.col("low"))
    placed = written(x.select("number", "year", "publisher", "raw", only.alias("only"), F.when(F.col("low").isNotNull(), F.col("publisher")).otherwise("").alias("scope")))
    # an equal name, or one with the same words, can't be beaten
    open_ = placed.where("only is null").drop("only")
    bag = lambda c: F.array_join(F.sort_array(names.words(F.col(c))), " ")
    same = open_.withColumn("bag", bag("raw")).join(held.select("number", "scope", "name", "spots", bag("name").alias("bag")).hint("merge"), ["number", "scope", "bag"])
    same = same.where((F.col("raw") == F.col("name")) | ~(F.contains("raw", F.col("name")) | F.contains("name", F.col("raw"))))
    equal = written(at(same).groupBy("number", "year", "publisher", "raw").agg(F.min("low").alias("series_id")))
    other = written(open_.join(equal.drop("series_id"), ["number", "year", "publisher", "raw"], "left_anti"))
    best = _most_alike(other, held, named, at, around).unionByName(equal)
    chosen = placed.where("only is not null").select("number", "year", "publisher", "raw", F.col("only").alias("series_id"), F.lit("reverse_one").alias("reverse_how")).unionByName(best.select("number", "year", "publisher", "raw", "series_id", F.lit("reverse_similarity").alias("reverse_how")))
    found = chosen.join(kept.select("series_id", "number", "cover_year", "issue_id"), ["series_id", "number"]).where(F.col("cover_year").between(F.col("year") - 5, F.col("year") + 5)).groupBy("number", "year", "publisher", "raw", "series_id", "reverse_how").agg(F.min(F.struct("cover_year", "issue_id")).alias("i"))
    return _result(rows.join(found, ["number", "year", "publisher", "raw"]), F.col("reverse_how"), F.col("i.issue_id"), F.col("series_id"), None)


def _most_alike(other: DataFrame, held: DataFrame, named: DataFrame, at: Callable[[DataFrame], DataFrame], around: Column) -> DataFrame:
    """The name of each row's window most alike, then the least series.

    A pair's similarity is compared letter by letter only if one name contains the
    other or they share a word that few names have. All other pairs share
    common words only, so theirs depends on the common words and the number of
    words: such classes of names are compared instead, by the least series of
    each in a window. A class may rank a name that contains the row's (or is contained),
    which the first way has judged; where such a name would win, the
    class's names are looked at one by one.
    """
    row, kind = ["number", "year", "scope", "publisher", "raw"], ("common", "size")
    known, raws = (df.where("text <> ''").distinct() for df in (held.select(F.col("name").alias("text")), other.select(F.col("raw").alias("text"))))
    split = lambda df: df.select("text", F.explode(names.words(F.col("text"))).alias("word"))
    n_names = staged(split(known).groupBy("word").agg(F.count("*").alias("n")))
    rare, often = n_names.where(F.col("n") <= RARE).select("word"), n_names.where(F.col("n") > RARE).select("word")
    by_word = split(raws).join(rare, "word").select("word", F.col("text").alias("term")).join(split(known).withColumnRenamed("text", "name").hint("merge"), "word").select("term", "name")
    pairs = by_word.unionByName(substring_names(raws.select(F.col("text").alias("name")), known.select(F.col("text").alias("name")), 1)).distinct()
    alike = F.round(names.similarity(F.col("raw"), F.col("name")), 6)
    pairs = pairs.withColumnRenamed("term", "raw").withColumn("alike", alike).where("alike > 0")
    scoped = pairs.join(other.select("raw", "scope").distinct().hint("merge"), "raw").join(held.select("scope", "name").distinct().hint("merge"), ["scope", "name"])
    met = at(other.join(scoped.hint("merge"), ["raw", "scope"]).join(held.select("number", "scope", "name", "spots").hint("merge"), ["number", "scope", "name"]))
    place = F.min(F.struct((-F.col("alike")).alias("a"), "low")).alias("b")
    sure = written(other.join(met.groupBy(*row).agg(place).hint("merge"), row, "left"))

    classes = lambda df: split(df).join(often, "word").groupBy("text").agg(F.array_join(F.sort_array(F.collect_list("word")), " ").alias("common")).withColumn("size", F.size(names.words(F.col("text"))))
    of_name, of_raw = written(classes(known).withColumnRenamed("text", "name")), written(classes(raws).withColumnRenamed("text", "raw"))
    sort = lambda df, side: df.select(*(F.col(c).alias(side + c) for c in kind)).distinct()
    words = lambda side: F.explode(F.split(side + "common", " ")).alias("word")
    two = sort(of_raw, "x_").select("*", words("x_")).join(sort(of_name, "y_").select("*", words("y_")).hint("merge"), "word").groupBy("x_common", "x_size", "y_common", "y_size").agg(F.count("*").alias("shared"))
    two = staged(two.withColumn("alike", F.round(F.col("shared") / (F.col("x_size") + F.col("y_size") - F.col("shared")), 6)).drop("shared"))
    members = written(held.join(of_name.hint("merge"), "name").withColumnsRenamed({c: "y_" + c for c in kind}))
    cell = ["number", "scope", "y_common", "y_size"]
    seen = members.select(*cell, F.explode("spots").alias("s")).groupBy(*cell, "s.cover_year").agg(F.min("s.low").alias("low"))
    cells = seen.select(*cell, "low", around).groupBy(*cell, "year").agg(F.min("low").alias("low"))
    asked = sure.join(of_raw.withColumnsRenamed({c: "x_" + c for c in kind}).hint("merge"), "raw")
    spot = ["number", "year", "scope", "x_common", "x_size"]
    # the least series by similarity first, which is a plain aggregate; then the best similarity
    levels = asked.select(*spot).distinct().join(two, ["x_common", "x_size"]).join(cells.hint("merge"), ["number", "year", "scope", "y_common", "y_size"]).groupBy(*spot, "alike").agg(F.min("low").alias("low"))
    tops = levels.groupBy(*spot).agg(F.min(F.struct((-F.col("alike")).alias("a"), "low")).alias("c"))
    tops = tops.join(named.select(F.col("series_id").alias("__low"), "name"), F.col("c.low") == F.col("__low")).drop("__low")
    within = F.contains("raw", F.col("name")) | F.contains("name", F.col("raw"))
    ranked = written(asked.join(tops.hint("merge"), spot).where(F.col("b").isNull() | (F.col("c") < F.col("b"))).withColumn("within", within))
    doubtful = ranked.where("within").select(*row, "x_common", "x_size", "b").join(two, ["x_common", "x_size"]).where(F.col("b").isNull() | (-F.col("alike") <= F.col("b.a")))
    singly = at(doubtful.join(members.hint("merge"), cell).where(~within)).groupBy(*row).agg(place)
    won = sure.where("b is not null").select(*row, "b").unionByName(ranked.where("not within").select(*row, F.col("c").alias("b"))).unionByName(singly)
    return won.groupBy(*row).agg(F.min("b").alias("b")).select("number", "year", "publisher", "raw", F.col("b.low").alias("series_id"))


def by_date(rows: DataFrame, series: DataFrame, issues: DataFrame) -> DataFrame:
    """Any issue of an equal name and publisher within a year of the row's: the closest, then first."""
    named = series.select("series_id", names.key(F.col("name")).alias("key"), names.publisher(F.col("publisher")).alias("publisher"))
    named = named.join(rows.where("year is not null").select("key").distinct(), "key", "left_semi")
    table = issues.where("cover_year between 1950 and 2026").join(named, "series_id").groupBy("key", "publisher", "cover_year").agg(F.min(F.struct("series_id", "issue_id")).alias("first"))
    table = catalog.any_publisher(table)
    wide = rows.where("year is not null").select("row_id", "key", "publisher", "year", F.explode(F.array(F.col("year") - 1, F.col("year"), F.col("year") + 1)).alias("cover_year"))
    best = wide.join(table, ["key", "publisher", "cover_year"]).groupBy("row_id").agg(F.min(F.struct(F.abs(F.col("cover_year") - F.col("year")).alias("d"), F.col("first.series_id").alias("s"), "cover_year", F.col("first.issue_id").alias("i"))).alias("b"))
    return _result(best, "date_based", F.col("b.i"), F.col("b.s"), F.col("b.d"))


def names_within(terms: DataFrame, known: DataFrame, shortest: int = 1) -> DataFrame:
    """Pairs of distinct names (``small`` of ``terms``, ``large`` of ``known``) of which the second contains the first.

    Names are split into character grams; the contained one is looked up by its
    rarest 4-gram only, or whole if it is shorter than that. Both have a column
    ``name``; only names of ``shortest`` characters and more count.
    """
    grams = lambda c, w: F.when(F.length(c) >= w, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - (w - 1))), lambda i: F.substring(c, i, F.lit(w)))))
    side = lambda df: df.where(F.length("name") >= shortest).select("name").distinct()
    small, large = side(terms), side(known)
    spread = lambda df, as_, w: df.select(F.col("name").alias(as_), F.explode(grams(F.col("name"), w)).alias("gram"))
    long = spread(large, "large", 4)
    often = long.groupBy("gram").count()
    rare = spread(small, "small", 4).join(often.hint("merge"), "gram").groupBy("small").agg(F.min_by("gram", F.struct("count", "gram")).alias("gram"))
    found = rare.join(long.hint("merge"), "gram").where(F.contains("large", F.col("small"))).select("small", "large")
    for w in range(shortest, 4):
        short = small.where(F.length("name") == w).select(F.col("name").alias("small"), F.col("name").alias("gram"))
        found = found.unionByName(short.join(spread(large, "large", w).hint("merge"), "gram").select("small", "large"))
    return found


def substring_names(terms: DataFrame, known: DataFrame, shortest: int = 4) -> DataFrame:
    """Pairs of distinct names of which one contains the other (``shortest`` characters at least)."""
    one = names_within(terms, known, shortest).select(F.col("small").alias("term"), F.col("large").alias("name"))
    return one.unionByName(names_within(known, terms, shortest).select(F.col("large").alias("term"), F.col("small").alias("name"))).distinct()


def by_substring(rows: DataFrame, series: DataFrame, preferred: DataFrame) -> DataFrame:
    """The only series whose name contains the row's, or is contained in it, for names of four characters and more.

    Names count by their first series' publisher. Where series found have the issue within five years,
    only those count. Series are counted per name, and per name, number and year, before rows meet them;
    an empty name meets nothing.
    """
    asked = written(rows.where("length(series_name) >= 4").select("row_id", names.search_term(F.col("key")).alias("term"), "publisher", "number", "year"))
    terms = written(asked.select("term", "publisher").distinct())
    key = names.key(F.col("name"))
    groups = written(series.groupBy(key.alias("name")).agg(F.count("*").alias("n"), F.min(F.struct("series_id", "publisher")).alias("r")))
    own = names.publisher(F.col("r.publisher"))
    gated = groups.select("name", "n", F.col("r.series_id").alias("series_id"), F.explode(F.array_distinct(F.array(own, F.lit("")))).alias("publisher"))
    pairs = substring_names(terms.select(F.col("term").alias("name")), groups.select("name"), 1)
    # names meet terms and publishers, whose counts then meet the rows: numbers and years would multiply the pairs
    met = written(terms.join(pairs, "term").join(gated, ["name", "publisher"]))
    wide = met.groupBy("term", "publisher").agg(F.sum("n").alias("n"), F.min("series_id").alias("s"))
    dated = preferred.where("cover_year <> 0").join(series.select("series_id", key.alias("name")).join(met.select("name").distinct(), "name", "left_semi"), "series_id").groupBy("name", "number", "cover_year").agg(F.count("*").alias("m"), F.min("series_id").alias("near"))
    by = ["term", "publisher", "number"]
    close = met.select("term", "publisher", "name").join(dated, "name").groupBy(*by, "cover_year").agg(F.sum("m").alias("m"), F.min("near").alias("near"))
    close = close.groupBy(*by).agg(F.collect_list(F.struct("cover_year", "m", "near")).alias("spots"))  # a year each
    within = F.filter("spots", lambda s: F.abs(s["cover_year"] - F.col("year")) <= 5)
    x = asked.join(wide, ["term", "publisher"]).join(close, by, "left").select("row_id", "n", "s", within.alias("spots"))
    # counted as one where a single year has a single series
    years, spot = F.when(F.col("spots").isNull(), 0).otherwise(F.size("spots")), F.get("spots", F.lit(0))
    only = F.when((years == 1) & (spot["m"] == 1), spot["near"]).when((years == 0) & (F.col("n") == 1), F.col("s"))
    return _result(x.withColumn("only", only).where("only is not null"), "substring", None, F.col("only"), None)


def _order() -> Column:
    """The least wins a row."""
    place = F.create_map(*(F.lit(x) for i, s in enumerate(LADDER) for x in (s, i)))
    return F.struct((-F.col("confidence")).alias("c"), F.coalesce("year_distance", F.lit(FAR)).alias("d"), place[F.col("strategy")].alias("p"), *RESULT[1:])


def by_name_alone(rows: DataFrame, series: DataFrame, groups: DataFrame) -> DataFrame:
    """The best of the strategies that need a row's name and publisher only: those meet the catalog once, not row by row."""
    known = ("series_name", "publisher")
    titles = written(rows.select(*known, "key", "strict", "words", "comma").distinct().withColumn("row_id", F.monotonically_increasing_id()))
    forms = catalog.any_publisher(catalog.name_forms(series, names.strict(F.col("name"))))
    found = by_series_only(titles, "key", groups, "exact_series").unionByName(by_series_only(titles, "strict", forms, "strict_series")).unionByName(by_word_order(titles, series)).unionByName(by_series_only(titles, "comma", groups, "colon_comma"))
    best = found.groupBy("row_id").agg(F.min(_order()).alias("b")).join(titles.select("row_id", *known), "row_id").select(*known, *(f"b.{c}" for c in RESULT[1:]))
    return rows.select("row_id", *known).join(best, list(known)).select(*RESULT)


def contest(results: DataFrame) -> DataFrame:
    """Winner of each row: most confidence, least year distance (unknown last), first listed; and ``named``, the best of its exact name."""
    exact, order = F.col("strategy").isin("exact_one_issue", "exact_closest_year"), _order()
    best = results.groupBy("row_id").agg(F.min(order).alias("b"), F.min(F.when(exact, order)).alias("named"))
    return best.select("row_id", *(f"b.{c}" for c in RESULT[1:]), F.struct(*(F.col(f"named.{c}") for c in RESULT[1:])).alias("named"))


def reconsidered(won: DataFrame, rows: DataFrame, preferred: DataFrame) -> DataFrame:
    """Winners of rows with a group, compared with the name's own, and without those too far off in years.

    A winner at least ``RETRY_GAP`` years off gives way to the exact name's issue
    if that is closer; a group's winner more than ``GROUP_GAP`` years off goes. Years
    are those of the number in the winner's series, whatever issue was found.
    """
    dated = preferred.select("series_id", "number", "cover_year")
    asked = rows.where("group_key is not null and year is not null").select("row_id", "number", "year")
    plain = won.join(asked, "row_id", "left_anti").drop("named")
    of = lambda name: dated.select(F.col("series_id").alias(f"{name}_series"), "number", F.col("cover_year").alias(f"{name}_year"))
    x = won.join(asked, "row_id").withColumns({"best_series": F.col("series_id"), "name_series": F.col("named.series_id")})
    x = x.join(of("best"), ["best_series", "number"], "left").join(of("name"), ["name_series", "number"], "left")
    gap, near = F.abs(F.col("best_year") - F.col("year")), F.abs(F.col("name_year") - F.col("year"))
    is_match = F.col("issue_id").isNotNull() & (F.col("confidence") < 100)
    swap = F.coalesce(is_match & (gap >= RETRY_GAP) & F.col("named.issue_id").isNotNull() & (near < gap), F.lit(False))
    after = {c: F.when(swap, F.col(f"named.{c}")).otherwise(F.col(c)) for c in RESULT[1:]}
    y = x.withColumn("gap", F.when(swap, near).otherwise(gap)).withColumns(after)
    far = F.coalesce(F.col("issue_id").isNotNull() & F.col("strategy").endswith("_group") & (F.col("gap") > GROUP_GAP), F.lit(False))
    return plain.unionByName(y.where(~far).select(*plain.columns))


def full_numbers(won: DataFrame, rows: DataFrame, preferred: DataFrame) -> DataFrame:
    """Winners with a series but no issue, with the issue of the row's full number where the series has it."""
    asked = rows.where("full is not null").select("row_id", F.col("full").alias("number"), "year")
    held = preferred.select("series_id", "number", F.col("issue_id").alias("full_issue"), F.nullif("cover_year", F.lit(0)).alias("full_year"))
    x = won.join(asked, "row_id", "left").join(held, ["series_id", "number"], "left")
    use = F.col("issue_id").isNull() & F.col("full_issue").isNotNull()
    after = {"issue_id": F.col("full_issue"), "strategy": F.concat("strategy", F.lit("_variant")), "confidence": F.lit(WITH_ISSUE), "year_distance": F.abs(F.col("full_year") - F.col("year"))}
    return x.select(*(F.when(use, after[c]).otherwise(F.col(c)).alias(c) if c in after else F.col(c) for c in won.columns))


def match(collection: DataFrame, series: DataFrame, issues: DataFrame) -> DataFrame:
    """Every collection row with its best match, or ``no_match`` with confidence 0.

    Rows with a barcode hit skip the other strategies. A result without an issue
    may win the contest; then the full number is tried in its series, else it is
    reported with its series only. A row without a publisher meets all publishers.
    ``collection`` may have ``series_group`` and ``number_full``. Tables that several
    strategies read are written once.
    """
    issues = written(issues)
    preferred, codes = written(catalog.preferred_issues(issues)).hint("merge"), written(catalog.barcodes(issues))
    own = written(coded(collection)).where("barcode is not null")
    hits = written(by_barcode(own, codes).unionByName(by_barcode_prefix(own, codes)))
    rest = written(standardise(collection.join(hits.select("row_id"), "row_id", "left_anti")))
    key = names.key(F.col("name"))
    exact = written(catalog.any_publisher(catalog.name_index(series, preferred, key))).hint("merge")
    groups = written(catalog.any_publisher(catalog.name_groups(series, key)))
    surely = by_exact_name(rest, exact, "group_key", "_group").unionByName(by_exact_name(rest, exact)).unionByName(by_name_alone(rest, series, groups)).unionByName(by_article(rest, groups, preferred))
    first = written(contest(surely))
    # a row goes on only to strategies that could still win it; an exact name's result is above all that follow
    beaten = F.col("confidence") <= max(LADDER[s] for s in ("reverse_one", "reverse_similarity"))
    weak = first.where(beaten).select(*RESULT)
    rest_1 = written(rest.join(first.where(~beaten).select("row_id"), "row_id", "left_anti"))
    reverse = written(by_reverse(rest_1, series, issues))
    # what is left has no result: all those found have more confidence than the last strategies
    rest_2 = written(rest_1.join(weak.select("row_id").unionByName(reverse.select("row_id")), "row_id", "left_anti"))
    last = by_substring(rest_2, series, preferred).unionByName(by_base_name(rest_2, series, preferred)).unionByName(by_date(rest_2, series, issues))
    won = written(first.where(~beaten).unionByName(contest(hits.unionByName(weak).unionByName(reverse).unionByName(last))))
    final = full_numbers(reconsidered(won, rest, preferred), rest, preferred)
    return collection.select("row_id").join(final, "row_id", "left").select("row_id", "issue_id", "series_id", F.coalesce("strategy", F.lit("no_match")).alias("strategy"), F.coalesce("confidence", F.lit(0)).alias("confidence"), "year_distance")


def enriched(collection: DataFrame, matches: DataFrame, series: DataFrame, preferred: DataFrame, address: str = "https://www.comics.org/issue/") -> DataFrame:
    """Every collection row with what was matched: issue, its address, series and name, the number's cover year in it, and how.

    ``match_type`` is the strategy and its confidence where an issue was found, else ``no_match``.
    """
    named = series.select("series_id", F.col("name").alias("matched_series"))
    dated = preferred.select("series_id", "number", F.col("cover_year").alias("matched_cover_year"))
    held = matches.select(*RESULT).join(named, "series_id", "left")
    x = collection.withColumn("__number", numbers.catalog_number(F.col("number"))).join(held, "row_id", "left").join(dated.withColumnRenamed("number", "__number"), ["series_id", "__number"], "left")
    found = F.col("issue_id").isNotNull()
    kind = F.when(found, F.concat_ws(":", "strategy", F.col("confidence").cast("string"))).otherwise("no_match")
    address_ = F.when(found, F.concat(F.lit(address), F.col("issue_id").cast("string"), F.lit("/")))
    return x.select(*(F.col(f"`{c}`") for c in collection.columns), F.col("issue_id").alias("matched_issue_id"), address_.alias("matched_url"), kind.alias("match_type"), "strategy", F.col("series_id").alias("matched_series_id"), "matched_series", "matched_cover_year")
