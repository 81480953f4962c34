"""Platforms' urls and their look-up."""

from linkweave.operators import urls

GUID = "98ab98c9-a87a-4cd2-b49a-ee5232abc0ad"
CASES = {
    "https://www.comics.org/issue/125295/": ("gcd", "125295", None, None, None),
    "https://www.comics.org/series/4254/": ("gcd", "4254", "4254", None, None),
    "http://comics.org:8080/issue/7?x=1": ("gcd", "7", None, None, None),
    "https://leagueofcomicgeeks.com/comic/111275/x-men-1?variant=6930677": ("locg", "6930677", "111275", None, None),
    "https://leagueofcomicgeeks.com/comic/111275/1169529": ("locg", "1169529", "111275", None, None),
    "https://leagueofcomicgeeks.com/comic/9092122/x-force-47": ("locg", "9092122", None, None, None),
    "https://leagueofcomicgeeks.com/comics/series/5/x": ("locg", "5", "5", None, None),
    "https://leagueofcomicgeeks.com/comics/series/5": ("locg", None, None, None, "bad_format"),
    f"https://www.comiccollectorlive.com/issue/comic-books/X-Men-1991/-1/{GUID}": ("ccl", GUID, None, None, None),
    "https://comiccollectorlive.com/issue/12": ("ccl", None, None, None, "bad_format"),
    "https://atomicavenue.com/atomic/item/217255/1/x": ("aa", "217255", None, None, None),
    "https://atomicavenue.com/atomic/item/217255/3/x": ("aa", "217255", None, "3", None),
    "https://atomicavenue.com/atomic/series/16287": ("aa", "16287", "16287", None, None),
    "https://www.comicspriceguide.com/titles/x-men/-1/phvpiu": ("cpg", "phvpiu", None, None, None),
    "https://www.comicspriceguide.com/titles/x-men/-1B/phvpiu": ("cpg", "phvpiu", None, "B", None),
    "https://www.comicspriceguide.com/titles/x-men/12-NS/phvpiu": ("cpg", "phvpiu", None, "NS", None),
    "https://www.comicspriceguide.com/titles/x-men/12-2/phvpiu": ("cpg", "phvpiu", None, None, None),
    "https://www.comicspriceguide.com/titles/x-men": ("cpg", "x-men", "x-men", None, None),
    "https://www.hipcomic.com/price-guide/us/marvel/comic/x-men-1991/1-1/": ("hip", "1-1", "x-men-1991", None, None),
    "https://www.hipcomic.com/price-guide/us/marvel/comic/x-men-1991/1-1/variant-b_2/": ("hip", "1-1", "x-men-1991", "variantb2", None),
    "https://www.hipcomic.com/price-guide/us/marvel/comic/x-men-1991": ("hip", "x-men-1991", "x-men-1991", None, None),
    "https://comicbookdb.com/issue/1": (None, None, None, None, "files_only"),
    "https://notcomics.org/issue/1": (None, None, None, None, "unsupported_host"),
    "ftp://comics.org/issue/1": (None, None, None, None, "not_http"),
    "   ": (None, None, None, None, "empty"),
    None: (None, None, None, None, "empty"),
}


def test_every_form_of_url(spark):
    df = spark.createDataFrame([(u,) for u in CASES], "url string")
    found = {r.url: (r.platform, r.source_issue_id, r.source_series_id, r.variant_suffix, r.error) for r in urls.platform_urls(df).collect()}
    assert found == CASES
    kept = {r.url for r in urls.platform_urls(df).where("full_url is not null").collect()}
    assert kept == {u for u, c in CASES.items() if c[0] == "hip" or (c[0] == "aa" and c[2] is None)}


def test_urls_meet_mappings(spark):
    rows = ["https://comics.org/issue/1"] * 3 + ["https://comics.org/issue/2", "https://atomicavenue.com/atomic/item/1/1", "nothing", None]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(rows)], "platform_row int, url string")
    known = spark.createDataFrame([("gcd", "1", 50), ("gcd", "1", 40), ("locg", "2", 60)], "source string, source_issue_id string, issue_id long")
    found = urls.resolve_platform_urls(df, known)
    assert [(r.issue_id, r.status) for r in found.orderBy("platform_row").collect()] == [(40, "resolved")] * 3 + [(None, "not_found")] * 2 + [(None, "failed")] * 2
    total = {r.platform: r for r in urls.resolve_summary(found).collect()}
    assert total["all"].summary == "Processed 7 URLs: 5 succeeded, 2 failed" and (total["gcd"].total, total["gcd"].resolved, total["unknown"].failed) == (4, 3, 2)
    assert urls.resolve_platform_urls(df.limit(0), known).count() == 0


def test_urls_are_parsed_once_and_meet_the_mappings_once(spark):
    links = spark.createDataFrame([(1, "https://comics.org/issue/5"), (2, None), (3, "https://comics.org/creator/5"), (4, "https://comics.org/issue/6")], "link_id int, url string")
    known = spark.createDataFrame([("gcd", "5", 70), ("gcd", None, 8), (None, None, 9)], "source string, source_issue_id string, issue_id int")
    df = urls.resolve_platform_urls(links, known)
    assert {r.link_id: (r.issue_id, r.status) for r in df.collect()} == {1: (70, "resolved"), 2: (None, "failed"), 3: (None, "failed"), 4: (None, "not_found")}
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
