"""The engine's inputs derived from the given tables; ``SQL`` has the same rows for checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.operators import repair


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog series: one per part."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("series_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("publisher"), (F.col("p_size") + 1950).alias("year_began"))


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog issues: one per order, line number and part."""
    # the greatest flag as a number of its class, as an aggregate of strings is sorted instead of hashed
    flag = F.col("l_returnflag")
    place = F.when(flag > "R", 4).when(flag == "R", 3).when(flag > "N", 2).when(flag == "N", 1).otherwise(0)
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.max(place).alias("flag"), F.min("l_shipdate").alias("shipped"))
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return lines.select(
        (k * 1000000 + F.col("l_partkey")).alias("issue_id"),
        F.col("l_partkey").alias("series_id"),
        F.col("l_linenumber").cast("string").alias("number"),
        F.when(F.col("flag") == 3, "newsstand").when(F.col("flag") == 1, "canonical").otherwise("variant").alias("label"),
        F.year("shipped").alias("cover_year"),
        F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.lpad(k.cast("string"), 13, "0"), F.lpad((F.col("l_partkey") % 100000).cast("string"), 5, "0"))).alias("barcode"),
    )


def collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collection rows: one per order, with a part's name in one of eight spellings."""
    orders, part = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    n = part.agg(F.count("*").alias("n"))
    x = orders.crossJoin(F.broadcast(n)).withColumn("pk", F.col("o_orderkey") % F.col("n")).join(part, F.col("pk") == F.col("p_partkey"))  # n is one row
    name, kind = F.col("p_name"), F.col("o_orderkey") % 8
    words = F.split(name, " ")
    spelt = (
        F.when(kind == 1, F.concat(F.lit("The "), name)).when(kind == 2, F.concat(name, F.lit(", Vol. 2"))).when(kind == 3, F.concat(name, F.lit(": Part One")))
        .when(kind == 4, F.concat(words[1], F.lit(" "), words[0])).when(kind == 5, F.concat(name, F.lit(" & Co"))).when(kind == 6, F.upper(name)).when(kind == 7, F.translate(name, "ei", "éî")).otherwise(name)
    )
    code = F.lpad((F.col("o_orderkey") * 8 + 1).cast("string"), 13, "0")
    return x.select(
        F.col("o_orderkey").alias("row_id"), spelt.alias("series_name"), (F.col("o_orderkey") % 7 + 1).cast("string").alias("number"), F.year("o_orderdate").alias("year"), F.col("p_brand").alias("publisher"),
        F.when(F.col("o_orderkey") % 9 == 0, code).when(F.col("o_orderkey") % 9 == 3, F.concat(code, F.lpad(F.lit("1"), 5, "0"))).alias("barcode"),
    )


def titled_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog series, five twelfths of them with a subtitle or a title of their own."""
    s, k = series(spark, sf_dir), F.col("series_id") % 12
    own = F.concat(F.col("name"), F.lit(" "), F.col("series_id").cast("string"))
    title = F.when(k == 0, F.concat("name", F.lit(": New World"))).when(k == 1, F.concat(F.lit("The "), own)).when(k == 2, own).when(k == 3, F.concat(own, F.lit(", Part One"))).when(k == 4, F.concat(own, F.lit(": Old World"))).otherwise(F.col("name"))
    return s.withColumn("name", title)


def dated_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog issues, some with letters in their number, without a cover year, with year 0 or of another era."""
    i, k = issues(spark, sf_dir), F.col("issue_id") % 23
    number = F.when(F.col("issue_id") % 7 == 3, F.concat("number", F.lit("AU"))).otherwise(F.col("number"))
    return i.withColumns({"number": number, "cover_year": F.when(k == 5, None).when(k == 6, 0).when(F.col("series_id") % 6 == 2, F.col("cover_year") - 20).otherwise(F.col("cover_year"))})


def shelf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collection rows that reach every branch of matching: groups, full numbers, blank years and publishers, short barcodes."""
    # few bytes of orders become many of rows, so they are dealt out before that
    orders, part = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey"), table(spark, sf_dir, "part")
    n = part.agg(F.count("*").alias("n"))
    other = part.select(F.col("p_partkey").alias("g_key"), F.col("p_name").alias("g_name"))
    o = F.col("o_orderkey")
    x = orders.crossJoin(F.broadcast(n)).withColumn("pk", o % F.col("n")).join(part, F.col("pk") == F.col("p_partkey")).join(other, F.col("pk") - F.col("pk") % 12 + 2 == F.col("g_key"), "left")  # n is one row
    own = (F.col("pk") % 12).between(1, 4)
    stem = F.when(own, F.concat("p_name", F.lit(" "), F.col("pk").cast("string"))).otherwise(F.col("p_name"))
    words, kind = F.split("p_name", " "), o % 8
    turned = F.concat(words[1], F.lit(" "), words[0], F.when(own, F.concat(F.lit(" "), F.col("pk").cast("string"))).otherwise(""))
    spelt = (
        F.when(kind == 1, F.concat(F.lit("The "), stem)).when(kind == 2, F.concat(stem, F.lit(", Vol. 2"))).when(kind == 3, F.concat(stem, F.lit(": Part One")))
        .when(kind == 4, turned).when(kind == 5, F.concat(stem, F.lit(" & Co"))).when(kind == 6, F.upper(stem)).when(kind == 7, F.translate(stem, "ei", "éî")).otherwise(stem)
    )
    number, code = (o % 7 + 1).cast("string"), F.lpad((o * 8 + 1).cast("string"), 13, "0")
    return x.select(
        o.alias("row_id"), spelt.alias("series_name"), number.alias("number"), F.when(o % 19 != 4, F.year("o_orderdate")).alias("year"), F.when(o % 29 != 3, F.col("p_brand")).alias("publisher"),
        F.when(o % 9 == 0, code).when(o % 9 == 3, F.concat(code, F.lit("00001"))).when(o % 27 == 6, F.substring(code, 1, 11)).alias("barcode"),
        F.when(o % 10 == 1, F.concat("g_name", F.lit(" "), F.col("g_key").cast("string"))).when(o % 10 == 6, stem).alias("series_group"), F.when(o % 4 == 1, F.concat(number, F.lit("AU"))).otherwise(number).alias("number_full"),
    )


def canon(spark: SparkSession, sf_dir: str) -> repair.Canon:
    """Canonical tables with duplicates at all levels: series of customers, issues of orders, mappings of events, variants of order lines."""
    c, o, e, line = (table(spark, sf_dir, t) for t in ("customer", "orders", "events", "lineitem"))
    k, n, v = F.col("c_custkey"), F.col("o_orderkey"), F.col("l_orderkey") * 8 + F.col("l_linenumber")
    series = c.select(k.alias("id"), F.concat_ws(" ", "c_mktsegment", (k % 50).cast("string")).alias("title"), (F.col("c_nationkey") % 3 + 1950).alias("start_year"), F.when(k % 3 != 0, F.concat(F.lit("House "), (k % 4).cast("string"))).alias("publisher"), F.when(k % 17 != 0, (F.col("c_acctbal") * 100).cast("long")).alias("created_at"))
    issues_ = o.select(n.alias("issue_id"), F.col("o_custkey").alias("series_id"), (n % 5 + 1).cast("string").alias("number"), F.when(n % 4 != 0, F.col("o_orderdate").cast("date")).alias("cover_date"), F.when(n % 3 == 0, F.lpad((n % 40).cast("string"), 12, "0")).alias("upc"), F.when(n % 19 != 0, F.col("o_custkey") * 7 + n % 11).alias("created_at"))
    maps = e.select(F.col("event_id").alias("mapping_id"), F.col("event_type").alias("source"), F.col("event_id").cast("string").alias("source_issue_id"), F.col("event_id").alias("issue_id"))
    kinds = line.where("l_linenumber <= 4").groupBy(v.alias("variant_id"), F.col("l_orderkey").alias("issue_id"), F.element_at(F.array(*map(F.lit, "ABCD")), F.col("l_linenumber").cast("int")).alias("suffix")).agg(F.min("l_partkey").alias("k"))
    return repair.Canon(series, issues_, maps, kinds.select("variant_id", "issue_id", "suffix", F.when(F.col("k") % 3 == 1, "").when(F.col("k") % 3 == 2, F.concat(F.lit("Cover "), (F.col("k") % 5).cast("string"))).alias("name")))


#: Forms of links to platforms; {u}, {s} and {n} stand for numbers, {g} for 12 digits.
LINKS = (
    "https://www.comics.org/issue/{u}/", "http://comics.org:8080/series/{s}?x=1", "https://leagueofcomicgeeks.com/comic/{s}/x-men-{n}?variant={u}", "https://leagueofcomicgeeks.com/comic/{s}/{u}", "https://leagueofcomicgeeks.com/comic/{u}/x-force-{n}",
    "https://leagueofcomicgeeks.com/comics/series/{s}/x-men", "https://www.comiccollectorlive.com/issue/comic-books/X-Men-1991/-1/98ab98c9-a87a-4cd2-b49a-{g}", "https://comiccollectorlive.com/issue/{s}", "https://atomicavenue.com/atomic/item/{u}/1/X-Men-{n}",
    "https://atomicavenue.com/atomic/item/{u}/{n}/X-Men", "https://atomicavenue.com/atomic/series/{s}", "https://www.comicspriceguide.com/titles/x-men/{n}/{u}abc", "https://www.comicspriceguide.com/titles/x-men/{n}-B/p{u}", "https://comicspriceguide.com/titles/x-men/-1{n}C/p{u}",
    "https://comicspriceguide.com/titles/x-men-{s}", "https://www.hipcomic.com/price-guide/us/marvel/comic/x-men-{s}/{n}-1/", "https://hipcomic.com/price-guide/us/marvel/comic/x-men-{s}/{n}/news-stand_b/?q=/comic/z", "https://hipcomic.com/price-guide/us/marvel/comic/x-men-{s}",
    "https://comicbookdb.com/issue/{u}", "https://example.com/comics.org/issue/{u}", "comics.org/issue/{u}", "  HTTPS://comics.org/issue/{u}", "https://comics.org/creator/{u}", " https://user@docs.comics.org/issue/{u} ",
)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to platforms, one per event, in each of ``LINKS``; every 100th event has none."""
    e = table(spark, sf_dir, "events")
    text = F.element_at(F.array(*map(F.lit, LINKS)), (F.col("event_id") % len(LINKS) + 1).cast("int"))
    values = {"{u}": F.col("user_id").cast("string"), "{s}": (F.col("user_id") % 97).cast("string"), "{n}": (F.col("event_id") % 3 + 1).cast("string"), "{g}": F.lpad(F.col("user_id").cast("string"), 12, "0")}
    for name, value in values.items():
        text = F.replace(text, F.lit(name), value)
    return e.select(F.col("event_id").alias("link_id"), F.when(F.col("event_id") % 100 != 99, text).alias("url"))


def link_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Platforms' ids of canonical issues: those of customers, on some platforms each."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    sources = F.array(F.lit("gcd"), F.lit("locg"), F.lit("aa"))
    return c.select(F.explode(sources).alias("source"), k).where((k + F.length("source")) % 3 != 0).select("source", k.cast("string").alias("source_issue_id"), k.alias("issue_id"))


def dump(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A catalog dump as it comes: series of parts, issues of order lines, publishers of suppliers; with deleted rows, languages and variants."""
    part, line, supplier = (table(spark, sf_dir, t) for t in ("part", "lineitem", "supplier"))
    k, n = F.col("p_partkey"), F.col("l_orderkey") * 8 + F.col("l_linenumber")
    series_ = part.select(
        k.alias("series_id"), F.col("p_name").alias("name"), (F.col("p_size") + F.when(k % 9 == 0, 1985).otherwise(1945)).alias("year_began"), F.when(k % 4 == 0, F.col("p_size") + 1948).alias("year_ended"), (F.col("p_size") * 3).alias("issue_count"),
        (k % 12).alias("publisher_id"), F.when(k % 5 == 0, 30).otherwise(25).alias("language_id"), (k % 13 == 0).cast("int").alias("deleted"),
    )
    rows = line.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_returnflag", "l_shipdate")).alias("m"))
    shipped, kind = F.to_date("m.l_shipdate"), n % 5
    text = F.when(kind == 0, F.date_format(shipped, "MMMM yyyy")).when(kind == 1, F.concat(F.lit("Fall "), F.year(shipped).cast("string"), F.lit(" (2001)"))).when(kind == 2, "soon").when(kind == 3, "")
    issues_ = rows.select(
        n.alias("issue_id"), F.col("m.l_partkey").alias("series_id"), F.col("l_linenumber").cast("string").alias("number"), F.when(F.col("m.l_returnflag") == "R", "Newsstand").when(F.col("m.l_returnflag") == "A", "Second print").alias("variant_name"),
        F.when(F.col("l_linenumber") > 2, F.col("l_orderkey") * 8 + 1).alias("variant_of_id"), text.alias("publication_date"), F.when(n % 7 != 0, F.concat(F.date_format(shipped, "yyyy-MM"), F.lit("-00"))).alias("key_date"), F.lpad(n.cast("string"), 13, "0").alias("barcode"), (F.col("l_orderkey") % 17 == 0).cast("int").alias("deleted"),
    )
    publishers = supplier.select(F.col("s_suppkey").alias("publisher_id"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 7 == 0).cast("int").alias("deleted"))
    return series_, issues_, publishers


#: Issue pages of three platforms; names in braces stand for a part's values.
SITE_PAGES = {
    "aa": """<html><body><h2 class="dropLeftMargin"><a href="/atomic/series/{id}/1">{title} {title}</a></h2><div class="dropLeftMargin">Issues</div><div class="dropLeftMargin">Press House, {year}-1999</div><ul><li>Copies<li class="issueSearchIssueNum">{number}</ul></body></html>""",
    "hip": """<html><head><title>Guide</title></head><body><h1>{title} ({year})</h1><a href="/price-guide/us/comic/{slug}/{id}/">open</a><div class="r-detail-attribute"><span class="r-detail-attribute__label">Issue</span> <span>#{number}</span></div>
<div class="r-detail-attribute"><span class="r-detail-attribute__label">Publisher</span><a>{house}</a><a>{house}</a></div><p class="x cover-date">{year}-05-00</p><div><b class="price">${price}</b><i class="page-count">{pages} pages</i><i class="barcode">{code}</i></div></body></html>""",
    "locg": """<html><head><title>{title} #{digits} | League of Comic Geeks</title></head><body><h1 class="main-title">{title}</h1><a href="/comic/{id}/{slug}">x</a><p class="publisher-name">{house}</p><p>({year}–Present) Cover price: ${price}</p><span class="upc">{code}</span><em>{year}-12-31</em></body></html>""",
}


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of each part on each of the platforms of ``SITE_PAGES``; some have no title, or no html at all."""
    # a small file of many pages: its rows are dealt out before pages are made of them
    part, k = table(spark, sf_dir, "part").repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey"), F.col("p_partkey")
    digits = (k % 60).cast("string")
    values = {
        "{id}": k.cast("string"), "{title}": F.when(k % 31 != 3, F.initcap("p_name")).otherwise(""), "{year}": (F.col("p_size") + 1950).cast("string"), "{slug}": F.replace("p_name", F.lit(" "), F.lit("-")), "{digits}": digits,
        "{number}": F.when(k % 7 == 1, F.concat(digits, F.lit("B"))).when(k % 7 == 2, F.concat(digits, F.lit("-"), digits)).otherwise(digits), "{house}": F.col("p_brand"), "{price}": F.concat((k % 9).cast("string"), F.lit(".95")), "{pages}": (k % 40 + 8).cast("string"), "{code}": F.lpad(k.cast("string"), 12, "7"),
    }
    made = []
    for place, (platform, html) in enumerate(SITE_PAGES.items()):
        text = F.lit(html)
        for name, value in values.items():
            text = F.replace(text, F.lit(name), value)
        made.append(F.struct((k * 3 + place).alias("page_id"), F.lit(platform).alias("platform"), F.when(k % 37 != 5, text).alias("html")))
    return part.select(F.explode(F.array(*made)).alias("p")).select("p.*")


def mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outside ids of canonical issues: source, outside id, issue, and whether it is accurate."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(F.col("event_id").alias("mapping_id"), F.col("event_type").alias("source"), F.col("event_id").cast("string").alias("source_issue_id"), F.col("user_id").alias("issue_id"), (k % 5 != 0).alias("is_accurate"), F.col("ts").alias("created_at"), k.alias("k"))


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human corrections: those events whose k is a multiple of five."""
    status = F.element_at(F.array(*map(F.lit, ("pending", "reviewed", "applied", "rejected"))), F.col("k") % 4 + 1)
    kind = F.element_at(F.array(*map(F.lit, ("wrong_series", "wrong_issue", "other"))), F.col("k") % 3 + 1)
    m = mappings(spark, sf_dir).where("k % 5 = 0")
    return m.select(F.col("mapping_id").alias("correction_id"), "source", "issue_id", kind.alias("correction_type"), status.alias("review_status"), "created_at")


def reviewable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections with the id that was given and, for half of them, the right one."""
    given = mappings(spark, sf_dir).select(F.col("mapping_id").alias("correction_id"), F.col("source_issue_id").alias("original_source_issue_id"), F.when(F.col("k") % 2 == 0, F.concat("source_issue_id", F.lit("x"))).alias("correct_source_issue_id"))
    return corrections(spark, sf_dir).join(given, "correction_id")


def review_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of every third event, a correction or not, in two rounds; some with a status that doesn't exist."""
    e = table(spark, sf_dir, "events").where("event_id % 3 = 0").select(F.col("event_id").alias("k"), F.explode(F.array(F.lit(0), F.lit(1))).alias("turn"))
    status = F.element_at(F.array(*map(F.lit, ("reviewed", "applied", "rejected", "done", "pending"))), ((F.col("k") + F.col("turn")) % 5 + 1).cast("int"))
    return e.select((F.col("k") * 2 + F.col("turn")).alias("request_id"), F.col("k").alias("correction_id"), status.alias("status"), F.concat(F.lit("reviewer "), (F.col("k") % 4).cast("string")).alias("reviewed_by"), F.when(F.col("turn") == 1, "again").alias("notes"), F.col("k").alias("at"))


#: Messages of errors; {n} stands for a number.
ERRORS = ("Source series start YEAR missing", "Multiple rows were found when one was expected", "Validation error: {n}", "Resolution error in row {n}", "Connection refused", "network is down", "Timeout after {n} s", "strange")


def import_state(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Imports of orders, one per nation of 20: their runs, rows being worked on, and results so far."""
    o, k, run = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey") % 20
    runs = o.groupBy(run.alias("run_id")).agg((F.count("*") - F.when(run % 7 == 3, 50).otherwise(0)).alias("total_rows")).withColumns({"resume_count": F.when(F.col("run_id") % 3 != 0, F.col("run_id") % 2), "retry_failed_count": F.when(F.col("run_id") % 4 == 1, 2)})
    active = o.where(k % 7 == 0).select(run.alias("run_id"), k.cast("string").alias("row_key"))
    error = F.when(k % 6 == 1, F.replace(F.element_at(F.array(*map(F.lit, ERRORS)), (k % len(ERRORS) + 1).cast("int")), F.lit("{n}"), k.cast("string")))
    results = o.where(k % 5 != 0).select(run.alias("run_id"), k.cast("string").alias("row_key"), k.alias("row_index"), error.isNull().alias("resolved"), error.alias("error"))
    return runs, active, results


def masters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical series with many repeated keys: title by segment, year by nation."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.concat_ws(" ", "c_mktsegment", (F.col("c_custkey") % 50).cast("string")).alias("title"), (F.col("c_nationkey") + 1950).alias("start_year"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("publisher"), (F.col("c_acctbal") * 100).cast("long").alias("created_at"))


def master_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical issues: one per order, in the series of its customer; every third has a UPC."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("issue_id"), F.col("o_custkey").alias("series_id"), (k % 7 + 1).cast("string").alias("number"), F.when(k % 3 == 0, F.lpad((k * 8 + 1).cast("string"), 13, "0")).alias("upc"))


SQL = {
    "series": "select p_partkey as series_id, p_name as name, p_brand as publisher, p_size + 1950 as year_began from part",
    "issues": """select (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey as issue_id, l_partkey as series_id, cast(l_linenumber as varchar) as number,
      case max(l_returnflag) when 'R' then 'newsstand' when 'N' then 'canonical' else 'variant' end as label, cast(year(min(l_shipdate)) as int) as cover_year,
      case when l_orderkey % 3 = 0 then lpad(cast(l_orderkey * 8 + l_linenumber as varchar), 13, '0') || lpad(cast(l_partkey % 100000 as varchar), 5, '0') end as barcode
      from lineitem group by l_orderkey, l_linenumber, l_partkey""",
    "collection": """select o_orderkey as row_id, case o_orderkey % 8 when 1 then 'The ' || p_name when 2 then p_name || ', Vol. 2' when 3 then p_name || ': Part One'
      when 4 then split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) when 5 then p_name || ' & Co' when 6 then upper(p_name) when 7 then translate(p_name, 'ei', 'éî') else p_name end as series_name,
      cast(o_orderkey % 7 + 1 as varchar) as number, cast(year(o_orderdate) as int) as year, p_brand as publisher,
      case o_orderkey % 9 when 0 then lpad(cast(o_orderkey * 8 + 1 as varchar), 13, '0') when 3 then lpad(cast(o_orderkey * 8 + 1 as varchar), 13, '0') || '00001' end as barcode
      from orders join part on p_partkey = o_orderkey % (select count(*) from part)""",
    "mappings": """select event_id as mapping_id, event_type as source, cast(event_id as varchar) as source_issue_id, user_id as issue_id,
      cast(props->>'$.k' as int) % 5 <> 0 as is_accurate, ts as created_at, cast(props->>'$.k' as int) as k from events""",
    "masters": """select c_custkey as id, c_mktsegment || ' ' || cast(c_custkey % 50 as varchar) as title, c_nationkey + 1950 as start_year,
      case when c_custkey % 3 <> 0 then c_name end as publisher, cast(trunc(c_acctbal * 100) as bigint) as created_at from customer""",
    "master_issues": """select o_orderkey as issue_id, o_custkey as series_id, cast(o_orderkey % 7 + 1 as varchar) as number,
      case when o_orderkey % 3 = 0 then lpad(cast(o_orderkey * 8 + 1 as varchar), 13, '0') end as upc from orders""",
}
SQL["corrections"] = f"""select mapping_id as correction_id, source, issue_id, case k % 3 when 0 then 'wrong_series' when 1 then 'wrong_issue' else 'other' end as correction_type,
  case k % 4 when 0 then 'pending' when 1 then 'reviewed' when 2 then 'applied' else 'rejected' end as review_status, created_at from ({SQL["mappings"]}) where k % 5 = 0"""


SQL["titled_series"] = f"""select series_id, case series_id % 12 when 0 then name || ': New World' when 1 then 'The ' || name || ' ' || series_id when 2 then name || ' ' || series_id
  when 3 then name || ' ' || series_id || ', Part One' when 4 then name || ' ' || series_id || ': Old World' else name end as name, publisher, year_began from ({SQL["series"]})"""
SQL["dated_issues"] = f"""select issue_id, series_id, case when issue_id % 7 = 3 then number || 'AU' else number end as number, label,
  case when issue_id % 23 = 5 then null when issue_id % 23 = 6 then 0 when series_id % 6 = 2 then cover_year - 20 else cover_year end as cover_year, barcode from ({SQL["issues"]})"""
SQL["shelf"] = """select row_id, case row_id % 8 when 1 then 'The ' || stem when 2 then stem || ', Vol. 2' when 3 then stem || ': Part One' when 4 then split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) || substr(stem, length(p_name) + 1)
    when 5 then stem || ' & Co' when 6 then upper(stem) when 7 then translate(stem, 'ei', 'éî') else stem end as series_name,
    cast(row_id % 7 + 1 as varchar) as number, case when row_id % 19 <> 4 then cast(year(o_orderdate) as int) end as year, case when row_id % 29 <> 3 then p_brand end as publisher,
    case when row_id % 9 = 0 then code when row_id % 9 = 3 then code || '00001' when row_id % 27 = 6 then substr(code, 1, 11) end as barcode,
    case when row_id % 10 = 1 then g_name || ' ' || g_key when row_id % 10 = 6 then stem end as series_group, (row_id % 7 + 1) || case when row_id % 4 = 1 then 'AU' else '' end as number_full
  from (select o_orderkey as row_id, o_orderdate, p.p_name, p.p_brand, g.p_name as g_name, g.p_partkey as g_key, lpad(cast(o_orderkey * 8 + 1 as varchar), 13, '0') as code,
      case when p.p_partkey % 12 between 1 and 4 then p.p_name || ' ' || p.p_partkey else p.p_name end as stem
    from orders join part p on p.p_partkey = o_orderkey % (select count(*) from part) left join part g on g.p_partkey = p.p_partkey - p.p_partkey % 12 + 2)"""


SQL["site_candidates"] = """select page_id, platform, case when error is null then x end as x, error, k, title, year, brand, digits, name from (
  select k * 3 + site as page_id, ['aa', 'hip', 'locg'][site + 1] as platform, site as x, *, case when k % 37 = 5 then 'empty_page' when site <> 2 and title = '' then 'no_title' when k % 7 = 2 and site = 0 then 'no_number' when site = 1 and k % 7 = 2 then 'MULTI_ISSUE_RANGE' end as error
  from (select p_partkey as k, p_name as name, case when p_partkey % 31 <> 3 then array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') else '' end as title, p_size + 1950 as year, p_brand as brand, (p_partkey % 60)::varchar as digits from part), (select unnest(range(3)) as site))"""
SQL["dump_issues"] = """select l_orderkey * 8 + l_linenumber as issue_id, m.p as series_id, l_linenumber::varchar as number, case m.f when 'R' then 'Newsstand' when 'A' then 'Second print' end as variant_name, case when l_linenumber > 2 then l_orderkey * 8 + 1 end as variant_of_id,
  case (l_orderkey * 8 + l_linenumber) % 5 when 0 then strftime(m.d::date, '%B %Y') when 1 then 'Fall ' || year(m.d::date) || ' (2001)' when 2 then 'soon' when 3 then '' end as publication_date, case when (l_orderkey * 8 + l_linenumber) % 7 <> 0 then strftime(m.d::date, '%Y-%m') || '-00' end as key_date,
  lpad((l_orderkey * 8 + l_linenumber)::varchar, 13, '0') as barcode, l_orderkey % 17 = 0 as deleted from (select l_orderkey, l_linenumber, min({'p': l_partkey, 'f': l_returnflag, 'd': l_shipdate}) as m from lineitem group by 1, 2)"""
SQL["reviewable"] = f"""select c.*, m.source_issue_id as original_source_issue_id, case when m.k % 2 = 0 then m.source_issue_id || 'x' end as correct_source_issue_id from ({SQL["corrections"]}) c join ({SQL["mappings"]}) m on m.mapping_id = c.correction_id"""
SQL["review_requests"] = """select event_id * 2 + turn as request_id, event_id as correction_id, ['reviewed', 'applied', 'rejected', 'done', 'pending'][((event_id + turn) % 5 + 1)::int] as status, 'reviewer ' || (event_id % 4) as reviewed_by, case when turn = 1 then 'again' end as notes, event_id as at
  from events, (select unnest([0, 1]) as turn) where event_id % 3 = 0"""
SQL["import_results"] = "select o_custkey % 20 as run_id, o_orderkey::varchar as row_key, o_orderkey as row_index, o_orderkey % 6 <> 1 as resolved, case when o_orderkey % 6 = 1 then replace(list_extract([" + ", ".join(f"'{x}'" for x in ERRORS) + f"], o_orderkey % {len(ERRORS)} + 1), '{{n}}', o_orderkey::varchar) end as error from orders where o_orderkey % 5 <> 0"
SQL["canon_series"] = "select c_custkey as id, c_mktsegment || ' ' || (c_custkey % 50) as title, c_nationkey % 3 + 1950 as start_year, case when c_custkey % 3 <> 0 then 'House ' || (c_custkey % 4) end as publisher, case when c_custkey % 17 <> 0 then cast(trunc(c_acctbal * 100) as bigint) end as created_at from customer"
SQL["canon_issues"] = """select o_orderkey as issue_id, o_custkey as series_id, (o_orderkey % 5 + 1)::varchar as number, case when o_orderkey % 4 <> 0 then o_orderdate::date end as cover_date,
  case when o_orderkey % 3 = 0 then lpad((o_orderkey % 40)::varchar, 12, '0') end as upc, case when o_orderkey % 19 <> 0 then o_custkey * 7 + o_orderkey % 11 end as created_at from orders"""
SQL["canon_mappings"] = "select event_id as mapping_id, event_type as source, event_id::varchar as source_issue_id, event_id as issue_id from events"
SQL["canon_variants"] = """select variant_id, issue_id, suffix, case k % 3 when 1 then '' when 2 then 'Cover ' || (k % 5) end as name from (
  select l_orderkey * 8 + l_linenumber as variant_id, l_orderkey as issue_id, substr('ABCD', l_linenumber::int, 1) as suffix, min(l_partkey) as k from lineitem where l_linenumber <= 4 group by 1, 2, 3)"""
SQL["links"] = "select event_id as link_id, case when event_id % 100 <> 99 then replace(replace(replace(replace(list_extract([" + ", ".join(f"'{x}'" for x in LINKS) + f"], event_id % {len(LINKS)} + 1), '{{u}}', user_id::varchar), '{{s}}', (user_id % 97)::varchar), '{{n}}', (event_id % 3 + 1)::varchar), '{{g}}', lpad(user_id::varchar, 12, '0')) end as url from events"
SQL["link_mappings"] = "select source, c_custkey::varchar as source_issue_id, c_custkey as issue_id from customer, (values ('gcd'), ('locg'), ('aa')) s(source) where (c_custkey + length(source)) % 3 <> 0"


def with_sql(*names: str) -> str:
    """CTEs of the named inputs."""
    return "with " + ", ".join(f"{n} as ({SQL[n]})" for n in names)
