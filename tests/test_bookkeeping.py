"""Progress, errors and keys of imports, and reviews of corrections, on small tables with nulls and repeats."""

import pytest

from linkweave.operators import bookkeeping, repair, review


def test_series_keys(spark):
    rows = [(1, " X-Men, Vol. 2 ", "1991", None), (2, "X-Men Volume 3", "", "1992"), (3, "X Series 4", None, None), (4, "", "1", "1"), (5, None, "1", "1"), (6, "Revolution 9", " 1990 ", "2"), (7, "X-Men, Vol. 2", "1991", "7")]
    df = spark.createDataFrame(rows, "row_index int, series string, year string, cover_year string")
    found = {r.series_key: (r.n, r.first_row, r.last_row) for r in bookkeeping.series_groups(df).collect()}
    assert found == {"X-Men, Vol. 2|2|1991": (2, 1, 7), "X-Men Volume 3|3|1992": (1, 2, 2), "X Series 4|4|": (1, 3, 3), "Revolution 9||1990": (1, 6, 6)}


def test_progress_and_errors(spark):
    runs = spark.createDataFrame([(1, 10, None, None), (2, 1, 1, 0), (3, 5, 1, 2)], "run_id int, total_rows long, resume_count int, retry_failed_count int")
    active = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (1, ""), (1, None)], "run_id int, row_key string")
    results = spark.createDataFrame([(1, "b", 2, True, None)] + [(2, f"k{k}", k, False, e) for k, e in enumerate(["Bad YEAR", "Network timeout", "timeout", "Connection", "x", "", None] + ["year"] * 9)], "run_id int, row_key string, row_index int, resolved boolean, error string")
    found = {r.run_id: tuple(r)[2:] for r in bookkeeping.progress(runs, active, results).collect()}
    assert found == {1: (1, 0, 1, 8, "fresh"), 2: (16, 16, 0, 0, "resume"), 3: (0, 0, 0, 5, "retry_failed_only")}
    errors = {r.category: (r.n, r.sample_rows) for r in bookkeeping.error_report(results).collect()}
    assert errors == {"missing_series_year": (10, "0,7,8,9,10"), "network_error": (2, "1,3"), "timeout": (1, "2"), "other": (2, "4,5")}


def test_reconciled(spark):
    issues = spark.createDataFrame([(1,), (2,)], "issue_id long")
    mappings = spark.createDataFrame([(1, "a"), (1, "a"), (1, "z"), (3, "a")], "issue_id long, source string")
    assert sorted((r.issue_id, r.checked, r.updated, r.missing) for r in bookkeeping.reconciled(issues, mappings, ("a", "b")).collect()) == [(1, 2, 1, "b"), (2, 2, 0, "a,b")]


@pytest.fixture(scope="module")
def corrections(spark):
    rows = [(1, 10, "a", "applied", 5, "o1", "c1"), (2, 11, "a", "applied", 6, "o2", None), (3, 99, "b", "applied", 7, "o3", "c3"), (4, 10, "b", "pending", None, "o4", "c4"), (5, None, "a", "pending", 6, "o5", None)]
    return spark.createDataFrame(rows, "correction_id long, issue_id long, source string, review_status string, created_at long, original_source_issue_id string, correct_source_issue_id string").selectExpr("*", "'t' as correction_type")


def test_reviews(spark, corrections):
    series = spark.createDataFrame([(1, "T", 1990, None, None)], "id long, title string, start_year int, publisher string, created_at long")
    issues = spark.createDataFrame([(10, 1, "7"), (11, 5, "8")], "issue_id long, series_id long, number string")
    canon = repair.Canon(series, issues, None, None)
    assert [(r.correction_id, r.title, r.number) for r in review.recent(corrections, canon, 3).orderBy("correction_id").collect()] == [(2, None, "8"), (3, None, None), (5, None, None)]
    assert [r.correction_id for r in review.recent(corrections, canon, None, "applied", "a").orderBy("correction_id").collect()] == [1, 2]
    assert [tuple(r)[:5] for r in review.seeds(corrections, canon).collect()] == [(1, 10, "T", 1990, "7")] and review.seeds(corrections, canon, "b").count() == 0
    asked = spark.createDataFrame([(1, 4, "rejected", "me", None, 1), (2, 4, "applied", "you", "n", 2), (3, 4, "wrong", "x", None, 3), (4, 77, "wrong", "x", None, 4), (5, 5, None, "x", None, 5)], "request_id long, correction_id long, status string, reviewed_by string, notes string, at long")
    after, outcomes = review.reviewed(corrections, asked)
    state = {r.correction_id: (r.review_status, r.reviewed_by, r.review_notes, r.reviewed_at) for r in after.collect()}
    assert state[4] == ("applied", "you", "n", 2) and state[1] == ("applied", None, None, None) and state[5] == ("pending", None, None, None) and len(state) == 5
    assert {r.request_id: r.outcome for r in outcomes.collect()} == {1: "done", 2: "done", 3: "invalid_status", 4: "not_found", 5: "invalid_status"}
