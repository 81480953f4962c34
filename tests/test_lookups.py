"""Lookups, listings, payloads and imports on small rows."""

from linkweave.operators import cascade, listings


def test_issue_tokens_and_titles(spark):
    texts = ["X-Men #-1", "X-Men (1991) 2-B", "Batman 300", "Batman #1/2", "Batman", None, "#AU"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(listings.issue_token(df.t)).collect()] == ["-1", "2", "300", "1/2", None, None, None]
    assert df.select(listings.search_title(df.t)).first()[0] == "x men"


def test_number_classes_and_browse_titles(spark):
    df = spark.createDataFrame([("½", "The X-Men, Vol. 2"), ("−1", "A  Batman: Year One"), ("no. 0", "Ünder"), ("7", "")], "n string, t string")
    assert [tuple(r) for r in df.select(cascade.number_class(df.n), cascade.browse_title(df.t)).collect()] == [("1/2", "x men"), ("-1", "batman year one"), ("0", "ünder"), ("7", "")]


def test_payloads(spark):
    rows = [
        (1, '{"series_name": "X-Men (1991 series)", "series": "https://x/api/series/42/", "number": "-1", "descriptor": "-1 [Direct Edition]", "price": "1.95 USD; 2.75 CAD"}'),
        (2, '{"series_name": "Plain", "number": "5 & 6", "descriptor": "5 [B]"}'),
        (3, "broken"),
        (4, None),
        (5, '{"series_name": "Batman (1940 series)", "number": "#1A", "descriptor": "1 [Adams cover]"}'),
    ]
    found = {r.id: r for r in listings.payload_candidates(spark.createDataFrame(rows, "id int, payload string")).collect()}
    assert tuple(found[1])[1:] == ("X-Men", 1991, "-1", None, 42, 1.95, None)
    assert (found[2].start_year, found[2].variant_suffix, found[2].error_code) == (None, "B", "MULTI_ISSUE_RANGE")
    assert found[3].error_code == found[4].error_code == "missing_title"
    assert (found[5].number, found[5].variant_suffix) == ("1", "VARIANT")


def test_layers(spark):
    series = spark.createDataFrame([(1, "X-Men", 1963), (2, "X-Men", 1991), (3, "Uncanny X-Men", 1981), (4, "Batman", 1940)], "series_id long, name string, year_began int")
    aliases = spark.createDataFrame([("Mutants", "X-Men", 1), ("Bats", "Batman", 3), ("Nobody", None, 3)], "alias string, target string, layer int")
    asked = [(1, "X-Men", 1990), (2, "Mutants", 1964), (3, "Bats", 1950), (4, "Nobody", 1950), (5, "The Batman, Vol. 3", None), (6, "Uncany X-Men", 1983), (7, "Zzz", 1990), (8, None, None), (9, "The Batman", 1939)]
    rows = spark.createDataFrame(asked, "row_id long, name string, year int")
    found = {r.row_id: (r.layer, r.series_id) for r in cascade.layered(rows, series, aliases).collect()}
    assert found == {1: (2, 2), 2: (1, 1), 3: (3, 4), 4: (3, None), 5: (0, None), 6: (5, 3), 7: (0, None), 8: (0, None), 9: (4, 4)}


def test_import_outcomes_and_missing_platforms(spark):
    rows = spark.createDataFrame([(1, "A", "1", None), (2, " ", "1", None), (3, "A", "", None), (4, "A", None, "TPB"), (5, "A", "1", None), (6, "A", "1", None)], "row_id int, series_name string, number string, format string")
    matches = spark.createDataFrame([(1, 10), (2, 10), (3, 10), (4, 10), (5, 10), (6, None)], "row_id int, issue_id int")
    held = spark.createDataFrame([(4, 10), (5, 11)], "row_id int, issue_id int")
    results = listings.import_results(rows, matches, held)
    assert {r.row_id: (r.outcome, r.error, r.issue_id) for r in results.collect()} == {1: ("created", None, 10), 2: ("rejected", "missing_series", None), 3: ("rejected", "missing_issue", None), 4: ("reused", None, 10), 5: ("conflict", None, 11), 6: ("unresolved", None, None)}
    assert listings.import_summary(results).first().success_rate == 50.0
    issues, have = spark.createDataFrame([(1,), (2,)], "issue_id int"), spark.createDataFrame([(1, "click"), (1, "view"), (1, None)], "issue_id int, source string")
    assert {(r.issue_id, r.platform) for r in listings.refresh_missing(issues, have).collect()} == {(1, "error"), (1, "purchase"), (1, "signup")} | {(2, s) for s in listings.PLATFORMS}
