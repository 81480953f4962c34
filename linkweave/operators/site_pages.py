"""Issue pages of platforms to candidates: elements by selectors, everything else by native expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.functions import names, numbers
from linkweave.sources import markup

# Where the platforms' pages have their fields, in the order in which places are tried.
SITE_RULES = [
    ("aa", "title", "#ctl00_ContentPlaceHolder1_lblIssueName a", "text"),
    ("aa", "title", "h2.dropLeftMargin a", "text"),
    ("aa", "title", "h2.dropLeftMargin", "text"),
    ("aa", "about", "div.dropLeftMargin", "text"),
    ("aa", "number", "#ctl00_ContentPlaceHolder1_lblIssueName", "text"),
    ("aa", "number", ".issueSearchIssueNum", "text"),
    ("aa", "series", "h2.dropLeftMargin a", "@href"),
    ("hip", "title", "h1", "text"),
    ("hip", "details", ".r-detail-attribute", "pairs:.r-detail-attribute__label"),
    ("hip", "number", ".issue-number, [class*='issue-number']", "text"),
    ("hip", "publisher", ".publisher, [class*='publisher-name'], [class*='publisher-info']", "text"),
    ("hip", "date", ".cover-date, [class*='cover-date'], [class*='publication-date']", "text"),
    ("hip", "variant", ".variant, [class*='variant-']", "text"),
    ("hip", "price", ".price, [class*='price-'], [class*='pricing']", "text"),
    ("hip", "pages", ".page-count, [class*='page-count-']", "text"),
    ("hip", "upc", ".upc, .barcode, [class*='upc-'], [class*='barcode-']", "text"),
]
# Patterns of the site that is read without selectors; the first that is found counts.
LOCG_TITLE = (r"(?i)<title>([^<]+?)\s*\|\s*League of Comic Geeks</title>", r"(?i)<title>([^<]+?)\s*Reviews</title>")
LOCG_NUMBER = (r"(?i)<h1[^>]*>[^<]+?\s+#(\d+)", r"(?i)<title>[^<]+?\s+#(\d+)\s+Reviews", r"<title>[^<]+?#([\d./-]+)(?:\s*\||\s*$)")
LOCG_PUBLISHER = tuple(rf'(?i)<{tag}[^>]*class="[^"]*publisher[^"]*"[^>]*>([^<]+)</{tag}>' for tag in ("p", "span", "div"))
LOCG_PUBLISHER_LINK = (r'(?i)<a[^>]*href="/publishers/[^"]*"[^>]*>([^<]+)</a>', r'(?i)<a[^>]*href="/comics/(?:dc|marvel|image|dark-horse|idw)[^"]*"[^>]*>([^<]+)</a>', r'(?i)<a[^>]*href="/comics/([a-z]+)"[^>]*>')
LOCG_PUBLISHERS = ("DC Comics", "Image Comics", "Dark Horse Comics", "Marvel Comics", "Marvel", "IDW Publishing", "IDW")
LOCG_YEAR = (r"\((\d{4})[–-]", r"(\d{4})\s*Series", r"Published\s+(\d{4})")
LOCG_SUFFIX = (r"(?i)variant[^:]*:\s*([A-Z]{1,2})(?:\s|<|$)", r"(?i)cover\s+([A-Z])(?:\s|<)", r"(?i)edition\s*:\s*([A-Z])")
LOCG_VARIANT = (r'(?i)<span[^>]*class="[^"]*variant[^"]*"[^>]*>([^<]+)</span>', r"(?i)variant[^:]*:\s*([^<\n]+?)<")
LOCG_PRICE = (r"\$(\d+\.\d{2})",)
LOCG_UPC = (r'(?i)<span[^>]*class="[^"]*upc[^"]*"[^>]*>(\d{12,})</span>', r"(?i)barcode[^:]*:\s*(\d{12,})", r"(?i)UPC[^<]*</[^>]+>\s*(\d{12,})", r"(?i)UPC[^:]*:\s*(\d{12,})", r"(?i)isbn[^:]*:\s*([\d-]{12,})", r">(\d{12,})<")

FIELDS = ("series_title", "source_series_id", "start_year", "publisher", "number", "variant_suffix", "variant_name", "cover_date", "price", "page_count", "upc")


def _text(c: Column) -> Column:
    """Trimmed, null if nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def _first(c: Column, patterns: Sequence[str], keep=_text) -> Column:
    """The first pattern's group that is found and kept."""
    return F.coalesce(*(keep(F.regexp_extract(c, p, 1)) for p in patterns))


def _value(field: str) -> Column:
    """A field's first value; null without an element, and perhaps empty with one."""
    return F.get(F.col("fields")[field], F.lit(0))["value"]


def _detail(label: str) -> Column:
    return F.element_at(F.map_from_entries(F.filter(F.col("details"), lambda d: d["label"] == label)), label)


def _undoubled(c: Column) -> Column:
    """A title that is written twice, once."""
    words = F.split(names.squeeze(c), " ")
    half = F.floor(F.size(words) / 2).cast("int")
    twice = (F.size(words) % 2 == 0) & (F.slice(words, F.lit(1), half) == F.slice(words, half + 1, half))
    return F.when(twice, F.array_join(F.slice(words, F.lit(1), half), " ")).otherwise(F.array_join(words, " "))


def _capitals(c: Column) -> Column:
    """Each run of letters with a capital first."""
    return F.array_join(F.transform(F.split(c, "(?<=[^A-Za-z])"), F.initcap), "")


def _locg() -> dict[str, Column]:
    html = F.col("html")
    tag, head = _first(html, LOCG_TITLE), _first(html, (r'(?i)<h1[^>]*class="[^"]*title[^"]*"[^>]*>([^<]+)</h1>',))
    title = F.when(tag.rlike(r"\(\d{4}\)|#\d+") | (F.length(head) <= F.length(tag)) | head.isNull(), tag).otherwise(head)
    heading = _first(html, (r"(?i)<h1[^>]*>([^<]+)</h1>",))
    numbered = _first(F.regexp_extract(html, r'(?i)<h2[^>]*class="[^"]*issue[^"]*"[^>]*>([^<]+)</h2>', 1), (r"#?([\d./-]+)",))
    named = F.coalesce(*(F.when(F.contains(html, F.lit(p)), F.lit(p)) for p in LOCG_PUBLISHERS))
    iso = F.regexp_extract(html, r"(\d{4}-\d{1,2}-\d{1,2})", 1)
    spoken = r"([A-Za-z0-9_]+)\s+(\d{1,2}),?\s+(\d{4})"
    written = F.concat_ws(" ", *(F.regexp_extract(html, spoken, k) for k in (1, 2, 3)))
    upc = lambda c: F.when(F.length(F.replace(c, F.lit("-"), F.lit(""))) >= 12, c)
    return {
        "series_title": F.coalesce(title, heading), "source_series_id": F.regexp_extract(html, r"/comic/(\d+)", 1), "start_year": _first(html, LOCG_YEAR).cast("int"),
        "publisher": F.coalesce(_first(html, LOCG_PUBLISHER), _capitals(_first(html, LOCG_PUBLISHER_LINK)), named), "raw": F.coalesce(_first(html, LOCG_NUMBER), numbered), "suffix": F.upper(_first(html, LOCG_SUFFIX)),
        "variant_name": _first(html, LOCG_VARIANT, lambda c: F.when(~F.trim(c).isin("", "Standard", "None"), F.trim(c))), "cover_date": F.coalesce(F.try_to_date(iso, "yyyy-M-d"), F.try_to_date(written, "MMMM d yyyy"), F.try_to_date(written, "MMM d yyyy")),
        "price": _first(html, LOCG_PRICE).cast("double"), "page_count": F.lit(None).cast("int"), "upc": _first(html, LOCG_UPC, upc),
    }


def _aa() -> dict[str, Column]:
    about = F.transform(F.coalesce(F.col("fields")["about"], F.array().cast("array<struct<label:string,value:string>>")), lambda a: a["value"])
    last = lambda c: F.try_element_at(F.filter(c, lambda v: v.isNotNull()), F.lit(-1))
    capital = r"([A-ZÀ-ſ][A-Za-zÀ-ſ\s]+),"
    house = F.transform(about, lambda t: F.coalesce(_text(F.regexp_extract(t, capital + r"\s*\d{4}", 1)), _text(F.regexp_extract(t, "^" + capital, 1))))
    year = F.transform(about, lambda t: _text(F.regexp_extract(t, r"(\d{4})(?:-(\d{4}))?", 1)))
    text = _value("number")
    plain = F.when(~text.rlike(r"\d+\s*-\s*\d+"), _text(F.regexp_extract(text, r"(-?\d+(?:\.\d+)?(?:\.?[A-Za-z]+)?)", 1)))
    none = F.lit(None)
    return {
        "series_title": _text(_undoubled(F.regexp_replace(_value("title"), r"(?s)\s*#\d+.*$", ""))), "source_series_id": F.coalesce(F.regexp_extract(_value("series"), r"/series/(\d+)", 1), F.lit("")), "start_year": last(year).cast("int"), "publisher": last(house),
        "raw": F.coalesce(_text(F.regexp_extract(text, r"#(\S+)", 1)), plain), "suffix": none.cast("string"), "variant_name": none.cast("string"), "cover_date": none.cast("date"), "price": none.cast("double"), "page_count": none.cast("int"), "upc": none.cast("string"),
    }


def _hip() -> dict[str, Column]:
    years = r"\((\d{4})(?:-\d{4})?\)"
    head = _text(_value("title"))
    cut = lambda c: _text(F.regexp_extract(c, r"(?s)^(.*?)" + years, 1))
    titled = lambda c: F.when(c.rlike(years), cut(c)).otherwise(c)
    began = lambda c: _text(F.regexp_extract(c, years, 1)).cast("int")
    series = _text(_detail("series"))
    clean = lambda c: F.when(F.trim(c) == "1-1", "-1").otherwise(F.trim(F.regexp_replace(F.trim(c), r"^#?\s*(?=.)", "")))
    upc, variant = _value("upc"), _value("variant")
    late = titled(head).isNull()
    return {
        "series_title": F.coalesce(titled(head), titled(series)), "source_series_id": F.regexp_extract(F.col("html"), r"/comic/([^/]+)/", 1), "start_year": F.when(late, F.coalesce(began(series), began(head))).otherwise(began(head)),
        "publisher": F.coalesce(_value("publisher"), _detail("publisher")), "raw": _text(F.coalesce(clean(_value("number")), clean(_detail("issue")))), "suffix": _text(F.upper(F.translate(variant, "-_ ", ""))), "variant_name": variant,
        "cover_date": numbers.date(_value("date")), "price": numbers.price(_value("price")), "page_count": numbers.pages(_value("pages")), "upc": F.when(F.length(upc) > 8, upc),
    }


def page_candidates(pages: DataFrame) -> DataFrame:
    """Candidate of every issue page (``page_id, platform, html``): its fields, or why there is none.

    ``error`` is ``empty_page``, ``unknown_site``, ``no_title``, ``no_number`` or what
    the number grammar says; then no field is set. The number is the canonical
    one; a variant's suffix is the page's, else the number's. What was read of
    a page stays beside its html, so that no join is needed.
    """
    html = F.col("html")
    read = markup.read_fields(pages, SITE_RULES, keep=("platform", "html")).withColumn("details", F.col("fields")["details"])
    # of a label that occurs twice the last counts
    read = read.withColumn("details", F.filter("details", lambda d, k: ~F.exists(F.slice(F.col("details"), k + 2, F.size("details")), lambda e: e["label"] == d["label"])))
    made = {"locg": _locg(), "aa": _aa(), "hip": _hip()}
    columns = {}
    for name in (*(f for f in FIELDS if f not in ("number", "variant_suffix")), "raw", "suffix"):
        value = F.lit(None)
        for site, fields in made.items():
            value = F.when(F.col("platform") == site, fields[name]).otherwise(value)
        columns[name] = value
    y = read.select("page_id", "platform", F.coalesce(html == "", F.lit(True)).alias("empty"), *(c.alias(n) for n, c in columns.items())).withColumn("parsed", numbers.parsed(F.col("raw")))
    error = (
        F.when(~F.coalesce(F.col("platform").isin(*made), F.lit(False)), "unknown_site").when(F.col("empty"), "empty_page").when(F.col("series_title").isNull(), "no_title")
        .when(F.col("raw").isNull(), "no_number").otherwise(F.col("parsed.error_code"))
    )
    y = y.withColumns({"error": error, "number": F.col("parsed.canonical"), "variant_suffix": F.coalesce("suffix", F.when(F.col("platform") != "locg", F.col("parsed.suffix")))})
    return y.select("page_id", "platform", *(F.when(F.col("error").isNull(), F.col(f)).alias(f) for f in FIELDS), "error")
