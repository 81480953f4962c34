"""Inventory filters, search and pages on small tables with nulls, repeats and odd queries."""

import pytest

from linkweave.operators import inventory, lookups, master, repair

PLATFORMS = ("a", "b")


@pytest.fixture(scope="module")
def canon(spark):
    series = spark.createDataFrame([(1, "X-Men", 1991, "Marvel", None), (2, "The X-Men", 1963, None, None), (3, None, 2000, "DC", None), (4, "100%_Real", 2000, "DC", None)], "id long, title string, start_year int, publisher string, created_at long")
    issues = spark.createDataFrame([(10, 1, "1", None, "u1", 1), (11, 1, "2", None, None, 1), (12, 2, "1", None, "men", 1), (13, 3, "men", None, None, 1), (14, 4, None, None, None, 1), (15, 99, "1", None, None, 1)], "issue_id long, series_id long, number string, cover_date date, upc string, created_at long")
    mappings = spark.createDataFrame([(1, "a", "ab123", 10), (2, "b", "B123c", 10), (3, "a", "zz", 10), (4, "a", None, 12), (5, "c", "123", 14)], "mapping_id long, source string, source_issue_id string, issue_id long")
    return repair.Canon(series, issues, mappings, spark.createDataFrame([], "variant_id long, issue_id long, suffix string, name string"))


def ids(df):
    return sorted(r.issue_id for r in df.collect())


def test_filters(canon):
    kept = lambda **f: ids(inventory.filtered(canon, **f).issues)
    assert kept() == [10, 11, 12, 13, 14] and kept(title="x-m") == [10, 11, 12] and kept(title="0%_r") == [14] and kept(title="x_men") == [10, 11, 12] and kept(publisher="marv") == [10, 11]
    assert kept(number="1") == [10, 12] and kept(platform="a") == [10, 12] and kept(on_all=PLATFORMS) == [10] and kept(title="men", platform="a", number="2") == []
    assert ids(inventory.complete_issues(canon.mappings, PLATFORMS)) == [10]


def test_rows_and_pages(canon):
    rows = inventory.issue_rows(canon, PLATFORMS)
    first = {r.issue_id: r for r in rows.collect()}
    assert (first[10].maps, first[10].platforms_found, first[10].platforms_total) == ("a:ab123,a:zz,b:B123c", 2, 2) and first[11].maps == "" and 15 not in first
    paged = inventory.paged(rows, 2).collect()
    assert [(r.place, r.page, r.issue_id) for r in sorted(paged, key=lambda r: r.place)] == [(0, 0, 13), (1, 0, 14), (2, 1, 12), (3, 1, 10), (4, 2, 11)]
    assert [r.issue_id for r in inventory.page(rows, 2, 1).collect()] == [14, 12] and inventory.paged(rows.limit(0)).count() == 0


def test_search(spark, canon):
    asked = spark.createDataFrame([(q,) for q in ["MEN", "1", "u1", "123", "%", "", None, "nothing", "MEN", "x-men"]], "query string")
    found = {}
    for r in inventory.search(asked, canon).collect():
        found.setdefault(r["query"], []).append((r.place, r.issue_id))
    assert {q: sorted(hits) for q, hits in found.items()} == {"MEN": [(1, 12), (2, 10), (3, 11)], "1": [(1, 14), (2, 12), (3, 10)], "u1": [(1, 10)], "123": [(1, 14), (2, 10)], "%": [(1, 14)], "x-men": [(1, 12), (2, 10), (3, 11)]}
    assert inventory.search(asked, canon, 1).count() == 6 and inventory.search(asked.limit(0), canon).count() == 0


def test_best_five(spark):
    series = spark.createDataFrame([(k, f"Batman {k}", 1990) for k in range(10)] + [(20, "Batman", 1940), (21, None, 1)], "id long, title string, start_year int")
    issues = spark.createDataFrame([(100 + k, k, "1") for k in range(8)], "issue_id long, series_id long, number string")
    asked = spark.createDataFrame([(1, "BATMAN", None), (2, "batman 3", " 1 "), (3, "zzz", "1"), (4, None, "1"), (5, "Batman", "")], "candidate_id long, title string, number string")
    found = {}
    for r in master.best_fuzzy(asked, series, issues).collect():
        found.setdefault(r.candidate_id, []).append((r.place, r.series_id, r.issue_id, round(r.confidence, 3)))
    assert sorted(found[1])[:2] == [(1, 20, None, 0.7), (2, 0, None, 0.665)] and len(found[1]) == len(found[5]) == 5
    assert sorted(found[2])[0] == (1, 3, 103, 0.7) and {r[2] for r in found[2]} == {103, 100, 101, 102, 104} and set(found) == {1, 2, 5}


def test_bulk_lookups(spark, canon):
    pairs = spark.createDataFrame([("X-Men", "1"), ("X-Men", "1"), ("The X-Men", "1"), ("X-Men", "9"), (None, "men"), ("100%_Real", None)], "title string, number string")
    assert ids(lookups.issues_of_pairs(canon, pairs)) == [10, 12] and lookups.issues_of_pairs(canon, pairs.limit(0)).count() == 0
    asked = spark.createDataFrame([("ab123",), ("ab123",), (None,), ("123",)], "source_issue_id string")
    assert [r.mapping_id for r in lookups.mappings_of_ids(canon.mappings, "a", asked).collect()] == [1]
    assert sorted((r.series_id, r.place, r.issue_id) for r in lookups.issues_in_order(canon).collect()) == [(1, 1, 10), (1, 2, 11), (2, 1, 12), (3, 1, 13), (4, 1, 14), (99, 1, 15)]


def test_best_five_of_a_title_with_many_series(spark):
    series = spark.range(3000).selectExpr("id", "concat('Batman', if(id % 2 = 0, '', 's')) title", "1990 start_year")
    issues = spark.range(3000).selectExpr("id + 10000 issue_id", "id series_id", "cast(id % 3 as string) number")
    asked = spark.range(1000).selectExpr("id candidate_id", "'BATMANS' title", "if(id % 2 = 0, null, '1') number")
    df = master.best_fuzzy(asked, series, issues)
    # ranking all series for each candidate made candidates times series rows
    assert "windowspecdefinition(candidate_id" not in df._jdf.queryExecution().analyzed().toString()
    found = {}
    for r in df.collect():
        found.setdefault(r.candidate_id, []).append((r.place, r.series_id, r.issue_id))
    assert len(found) == 1000 and sorted(found[0]) == [(k + 1, 2 * k + 1, None) for k in range(5)] and sorted(found[1]) == [(k + 1, 6 * k + 1, 6 * k + 10001) for k in range(5)]
    assert all(sorted(v) == sorted(found[k % 2]) for k, v in found.items())
