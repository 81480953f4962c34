"""Steps of matching whose size followed rows, numbers and years: results, and what is read, met and written."""

from pyspark.sql import functions as F

from linkweave.functions import names
from linkweave.operators import catalog, matching, reports

ROWS = "row_id long, series_name string, number string, year int, publisher string, barcode string"
SERIES = "series_id long, name string, publisher string, year_began int"
ISSUES = "issue_id long, series_id long, number string, label string, cover_year int, barcode string"


def test_substrings_meet_before_numbers_and_years(spark, monkeypatch):
    tables = []
    for name in ("staged", "written"):
        if f := getattr(matching, name, None):
            monkeypatch.setattr(matching, name, lambda df, f=f: (out := f(df), tables.append((set(out.columns), out.count())))[0])
    series = spark.createDataFrame([(k, f"Alpha Beta {k}", "P", 1990) for k in range(3)] + [(9, "Gamma Rays", "P", 1990)], SERIES)
    issues = spark.createDataFrame([(10, 0, "1", "canonical", 1990, None), (20, 1, "1", "canonical", 1990, None), (30, 2, "2", "canonical", 1990, None)], ISSUES)
    asked = [(k, n, str(number), year, None, None) for k, (n, number, year) in enumerate((n, number, year) for n in ("Alpha Beta", "Gamma") for number in range(1, 5) for year in (1960, 1990, 1995, None))]
    found = matching.by_substring(matching.standardise(spark.createDataFrame(asked, ROWS)), series, catalog.preferred_issues(issues))
    want = {k: 2 if n == "Alpha Beta" else 9 for k, n, number, year, _, _ in asked if n == "Gamma" or number == "2" and year in (1990, 1995)}
    assert {r.row_id: r.series_id for r in found.collect()} == want
    pairs = [n for columns, n in tables if {"term", "name"} <= columns]
    assert pairs and max(pairs) <= 4  # pairs of names, once each


def test_rows_skip_strategies_that_cannot_win(spark, monkeypatch):
    seen = {}
    for name in ("by_reverse", "by_substring", "by_base_name", "by_date"):
        f = getattr(matching, name)
        monkeypatch.setattr(matching, name, lambda rows, *a, f=f, name=name: (seen.update({name: {r.row_id for r in rows.select("row_id").collect()}}), f(rows, *a))[1])
    series = spark.createDataFrame([(1, "Zorro", "P", 1990), (2, "The Omega", "P", 1990), (3, "Alpha Flight", "P", 1990)], SERIES)
    issues = spark.createDataFrame([(10, 1, "1", "canonical", 1990, None), (30, 3, "7", "canonical", 1990, None)], ISSUES)
    rows = [(1, "Zorro", "1", 1990, "P", None), (2, "Omega", "7", 1991, "P", None), (3, "Omega", "9", 1960, "P", None), (4, "Alpha Flight Saga", "9", 1960, "P", None)]
    found = {r.row_id: (r.issue_id, r.series_id, r.strategy) for r in matching.match(spark.createDataFrame(rows, ROWS), series, issues).collect()}
    assert found == {1: (10, 1, "exact_one_issue"), 2: (30, 3, "reverse_one"), 3: (None, 2, "article_variant"), 4: (None, 3, "substring")}
    assert seen == {"by_reverse": {2, 3, 4}, "by_substring": {4}, "by_base_name": {4}, "by_date": {4}}


def test_an_index_for_any_publisher_is_read_once(spark):
    index = spark.createDataFrame([("a", "p", 1), ("a", "q", 2), ("b", "", 4)], "key string, publisher string, n long").where(F.col("key") != "marker")
    found = catalog.any_publisher(index)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("marker") == 1
    assert {tuple(r) for r in found.collect()} == {("a", "p", 1), ("a", "q", 2), ("a", "", 3), ("b", "", 4)}


def test_prefixes_only_of_lengths_that_occur(spark):
    codes = spark.createDataFrame([("1234567890123", 1, 5), ("123456789012399", 2, 6), ("12345", 3, 7)], "barcode string, first_id long, last_id long")
    rows = spark.createDataFrame([(1, "12345678"), (2, "1234567890123444"), (3, "123"), (4, "9"), (5, None)], "row_id long, barcode string")
    found = matching.by_barcode_prefix(rows, codes)
    assert "explode(sequence" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.row_id: r.issue_id for r in found.collect()} == {1: 5, 2: 5, 3: 5}


def test_error_summary_makes_its_results_once(spark):
    results = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(15)], "row_id long, category string").where(F.col("category") != "marker")
    found = reports.error_summary(results)
    assert "marker" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {("a", 8, "0,2,4,6,8"), ("b", 7, "1,3,5,7,9")}


def test_clean_and_odd_names_follow_the_same_rules(spark):
    texts = ["", " ", "A  b", " A b", "A b ", "A\tb", "A b\n", "A b", "Ab́", "X-Men & Co", "Vol. 2 of it, VOLUME 3", "ABC iii", "Ab ANNUAL", "Ab (Marvel x)", "Ab (1990)", "Bolt And Co", "Z comics", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    c, cut = F.col("t"), F.col("t")
    for ending in names.ENDINGS:
        cut = F.regexp_replace(cut, ending, "")
    key = F.lower(names.fold(names.squeeze(c)))
    strict = names.squeeze(F.regexp_replace(F.regexp_replace(F.lower(names.fold(c)), "&", "and"), r"[^a-z0-9\s]", ""))
    for r in df.select(c, names.key(c), key, names.collection_name(c), F.trim(cut), names.strict(c), strict).collect():
        assert r[1] == r[2] and r[3] == r[4] and r[5] == r[6], r[0]


def test_barcodes_are_read_without_names(spark):
    rows = spark.createDataFrame([(1, "A", "1", 1990, "P", " 12-3 "), (2, "B", "1", 1990, "P", "x")], ROWS)
    found = matching.coded(rows)
    assert "series_name" not in found._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0]
    assert [tuple(r) for r in found.collect()] == [(1, "123"), (2, None)]
