"""URL and page rules: platform, ids and links of pages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Domains and the platform each stands for.
DOMAINS = (("example.com", "com"), ("example.net", "net"), ("example.org", "org"))


def parse_urls(pages: DataFrame) -> DataFrame:
    """Platform, section, item id and error of every url; subdomains count, ports don't."""
    url = F.col("url")
    host = F.lower(F.regexp_extract(url, r"^https?://([^/?#:]*)", 1))
    platform = F.lit(None).cast("string")
    for domain, name in DOMAINS:
        platform = F.when((host == domain) | host.endswith("." + domain), F.lit(name)).otherwise(platform)
    shape = r"^https?://[^/]*/([a-z]{2})/([0-9]+)(?:\.html)?/?(?:[?#].*)?$"
    item = F.regexp_extract(url, shape, 2)
    error = F.when(url.isNull() | ~F.coalesce(url.rlike("^https?://"), F.lit(False)), "not_http").when(platform.isNull(), "unsupported_host").when(item == "", "no_item")
    return pages.select("page_id", platform.alias("platform"), F.when(item != "", F.regexp_extract(url, shape, 1)).alias("section"), F.when(item != "", item).alias("item_id"), error.alias("error"))


def resolve_urls(pages: DataFrame) -> DataFrame:
    """Per platform: urls, those with an item, and distinct items."""
    return parse_urls(pages).groupBy("platform").agg(F.count("*").alias("total"), F.count("item_id").alias("resolved"), F.count_distinct("section", "item_id").alias("items"))


def page_candidates(pages: DataFrame) -> DataFrame:
    """Title, heading and links of every page, by native expressions."""
    html = F.col("html")
    unescaped = lambda c: F.replace(F.replace(c, F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    links = F.regexp_extract_all(html, F.lit('<a href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", unescaped(F.regexp_extract(html, "<title>([^<]*)</title>", 1)).alias("title"), unescaped(F.regexp_extract(html, "<h1>([^<]*)</h1>", 1)).alias("heading"), F.size(links).alias("n_links"), F.coalesce(F.get(links, F.lit(0)), F.lit("")).alias("first_link"))


def page_links(pages: DataFrame) -> DataFrame:
    """How many pages have each distinct link."""
    links = F.regexp_extract_all(F.col("html"), F.lit('<a href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", F.explode(F.array_distinct(links)).alias("link")).groupBy("link").agg(F.count("*").alias("pages"))


@dataclass(frozen=True)
class UrlRule:
    """One form of a platform's urls: the groups of ``pattern`` that are the issue and the series (0: none).

    ``part`` is what the pattern is looked for in, the whole url or its path;
    ``suffix`` names the rule by which a variant is read; ``whole`` keeps the url.
    """

    platform: str
    domain: str
    pattern: str
    issue: int
    series: int = 0
    part: str = "url"
    suffix: str = ""
    whole: bool = False


# The platforms' url forms, in the order in which they are tried. The first of a host's that is found counts.
URL_RULES = (
    UrlRule("gcd", "comics.org", r"comics\.org/issue/(\d+)", 1),
    UrlRule("gcd", "comics.org", r"comics\.org/series/(\d+)", 1, 1),
    UrlRule("locg", "leagueofcomicgeeks.com", r"/comic/(\d+).*?variant=(\d+)", 2, 1),
    UrlRule("locg", "leagueofcomicgeeks.com", r"variant=(\d+).*?/comic/(\d+)", 1, 2),
    UrlRule("locg", "leagueofcomicgeeks.com", r"/comics/series/(\d+)/", 1, 1),
    UrlRule("locg", "leagueofcomicgeeks.com", r"/comic/(\d+)/(\d+)(?:/|$)", 2, 1),
    UrlRule("locg", "leagueofcomicgeeks.com", r"/comic/(\d+)(?:/.*)?$", 1),
    UrlRule("ccl", "comiccollectorlive.com", r"([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})", 1),
    UrlRule("aa", "atomicavenue.com", r"/atomic/item/(\d+)", 1, suffix="copy", whole=True),
    UrlRule("aa", "atomicavenue.com", r"/atomic/series/(\d+)", 1, 1),
    UrlRule("cpg", "comicspriceguide.com", r"/titles/[^/]+/([^/]+)/([a-z0-9]+)", 2, suffix="number"),
    UrlRule("cpg", "comicspriceguide.com", r"/titles/([^/]+)", 1, 1),
    UrlRule("hip", "hipcomic.com", r"/comic/([^/]+)/([^/]+)", 2, 1, part="path", suffix="last", whole=True),
    UrlRule("hip", "hipcomic.com", r"/comic/([^/]+)", 1, 1, part="path", whole=True),
)
# Fixed value: the platform that is read from files only.
FILES_ONLY = "comicbookdb.com"


def _suffix(how: str, part: Column, issue: Column) -> Column:
    """The variant that a url names, by its form's rule, or null."""
    copy = F.regexp_extract(part, r"/item/\d+/(\d+)", 1)  # the number after the item's, if it isn't the first copy
    number = F.regexp_extract(part, r"/titles/[^/]+/([^/]+)/[a-z0-9]+", 1)  # letters behind the number and a hyphen, or all behind a number of -1
    tail = F.substring_index(number, "-", -1)
    lettered = F.when(number.rlike("^-1."), F.substring(number, 3, 1 << 30)).when(number.rlike(r"^[^-].*-\p{L}+$"), tail)
    last = F.substring_index(F.regexp_replace(part, "/+$", ""), "/", -1)  # a path's last part behind the issue
    return {"copy": F.when(~copy.isin("", "1"), copy), "number": lettered, "last": F.when((last != issue) & ~last.isin("", "keywords"), F.translate(last, "-_", ""))}[how]


def platform_urls(urls: DataFrame, column: str = "url") -> DataFrame:
    """Every row of ``urls`` with platform, issue and series id, variant, kept url and error of its url.

    Urls are trimmed, and ports dropped. ``error`` is ``empty``, ``not_http``,
    ``files_only``, ``unsupported_host`` or ``bad_format``; nothing else is set
    then, but for the platform of a bad format. Subdomains count. The first of
    ``URL_RULES`` of its host that fits decides. Patterns are literals, so each is
    compiled once and not for every row.
    """
    url = F.regexp_replace(F.trim(F.col(column)), r"^(https?://[^/?#:]*):[0-9]+(?=[/?#]|$)", "$1")
    host = F.lower(F.regexp_extract(F.col("__url"), r"^https?://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract(F.col("__url"), r"^https?://[^/?#]*([^?#]*)", 1)
    mine = lambda r: (F.col("__host") == r.domain) | F.endswith(F.col("__host"), F.lit("." + r.domain))
    part = lambda r: F.col("__path" if r.part == "path" else "__url")
    place, platform = F.lit(None).cast("int"), F.lit(None).cast("string")
    for k, r in reversed([*enumerate(URL_RULES)]):
        place, platform = F.when(mine(r) & F.regexp_like(part(r), F.lit(r.pattern)), k).otherwise(place), F.when(mine(r), r.platform).otherwise(platform)
    x = urls.withColumn("__url", url).withColumns({"__host": host, "__path": path}).withColumns({"__rule": place, "__platform": platform})

    def by_rule(value: Callable[[UrlRule], Column | None]) -> Column:
        """What the rule that decides gives, if it gives anything."""
        out = F.lit(None).cast("string")
        for k, r in enumerate(URL_RULES):
            found = value(r)
            out = out if found is None else F.when(F.col("__rule") == k, found).otherwise(out)
        return out

    error = (
        F.when(F.col("__url").isNull() | (F.col("__url") == ""), "empty").when(~F.col("__url").rlike("^https?://"), "not_http").when(F.contains(F.lower("__url"), F.lit(FILES_ONLY)), "files_only")
        .when(F.col("__platform").isNull(), "unsupported_host").when(F.col("__rule").isNull(), "bad_format")
    )
    x = x.withColumn("error", error)
    good = F.col("error").isNull()
    group = lambda which: F.when(good, by_rule(lambda r: F.regexp_extract(part(r), r.pattern, getattr(r, which)) if getattr(r, which) else None))
    x = x.withColumns({"source_issue_id": group("issue"), "source_series_id": group("series"), "platform": F.when(good | (F.col("error") == "bad_format"), F.col("__platform"))})
    suffix = F.when(good, by_rule(lambda r: _suffix(r.suffix, part(r), F.col("source_issue_id")) if r.suffix else None))
    made = {"variant_suffix": suffix, "full_url": F.when(good, by_rule(lambda r: F.col("__url") if r.whole else None))}
    return x.select(*(F.col(f"`{c}`") for c in urls.columns), "platform", "source_issue_id", "source_series_id", *(c.alias(name) for name, c in made.items()), "error")


def resolve_platform_urls(urls: DataFrame, mappings: DataFrame, column: str = "url") -> DataFrame:
    """Every url with the canonical issue that its platform's id is mapped to: ``resolved``, ``not_found`` or ``failed``.

    ``mappings`` has ``source, source_issue_id, issue_id``; of repeated ids the
    least issue counts. Urls are parsed once; one without an id gets a key of its
    own, so that such rows don't meet in one task.
    """
    own = F.concat(F.lit("none:"), F.monotonically_increasing_id().cast("string"))
    parsed = platform_urls(urls, column).withColumn("__id", F.coalesce("source_issue_id", own)).withColumn("__site", F.coalesce("platform", F.lit("")))
    known = mappings.groupBy(F.col("source").alias("__site"), F.col("source_issue_id").alias("__id")).agg(F.min("issue_id").alias("issue_id"))
    found = parsed.join(known, ["__site", "__id"], "left").withColumn("issue_id", F.when(F.col("source_issue_id").isNotNull(), F.col("issue_id")))
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("issue_id").isNull(), "not_found").otherwise("resolved")
    return found.select(*(F.col(f"`{c}`") for c in urls.columns), "platform", "source_issue_id", "issue_id", status.alias("status"), "error")


def resolve_summary(resolved: DataFrame) -> DataFrame:
    """Totals of ``resolve_platform_urls`` per platform (``unknown`` where none is) and for ``all``, with a line of text."""
    done = F.count_if(F.col("status") == "resolved")
    counts = (F.count("*").alias("total"), done.alias("resolved"), F.count_if(F.col("status") == "not_found").alias("not_found"), F.count_if(F.col("status") == "failed").alias("failed"))
    text = F.concat(F.lit("Processed "), F.col("total").cast("string"), F.lit(" URLs: "), (F.col("total") - F.col("failed")).cast("string"), F.lit(" succeeded, "), F.col("failed").cast("string"), F.lit(" failed"))
    return resolved.rollup("platform").agg(F.grouping_id().alias("all"), *counts).select(F.when(F.col("all") == 1, "all").otherwise(F.coalesce("platform", F.lit("unknown"))).alias("platform"), "total", "resolved", "not_found", "failed", text.alias("summary"))
