"""Column rules, catalog folds, sources and streams on small rows."""

import itertools

import pytest
from pyspark.sql import functions as F

from linkweave.functions import names, numbers
from linkweave.operators import catalog, master, matching, similar
from linkweave.sources import tables
from linkweave.streaming import imports


def column(spark, values, rule):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(rule(F.col("v"))).collect()]


def test_issue_number_grammar(spark):
    cases = {"0.5": ("0.5", None, None), "1/2": ("1/2", None, None), "0001": ("0001", None, None), "#-1": ("-1", None, None), "-1A": ("-1", "A", None), "1000.DE": ("1000", "DE", None), "-1.WIZ.SIGNED": ("-1", "WIZ.SIGNED", None), "1.5A": ("1.5", "A", None), "": (None, None, "EMPTY_INPUT"), None: (None, None, "EMPTY_INPUT"), "#": (None, None, "ONLY_SEPARATOR"), "ABC": (None, None, "INVALID_FORMAT"), "1..2": (None, None, "INVALID_FORMAT"), "1-3": (None, None, "MULTI_ISSUE_RANGE"), "5 & 6": (None, None, "MULTI_ISSUE_RANGE"), "1A-1C": (None, None, "MULTI_ISSUE_RANGE")}
    assert [tuple(x) for x in column(spark, list(cases), numbers.parsed)] == list(cases.values())


def test_names_and_values(spark):
    assert column(spark, ["X-Men, Vol. 1", "Vol. 1 Special"], names.strip_volume) == ["X-Men", "Vol. 1 Special"]
    assert column(spark, ["X-Men (Marvel Comics)", "X-Men II", "X-Men Annual", "X-Men (1991)"], names.normalized) == ["X-Men"] * 4
    assert column(spark, ["Cloak & Dagger", "WildC.A.T.s", "X  Men", "Rōnin"], names.strict) == ["cloak and dagger", "wildcats", "x men", "ronin"]
    assert column(spark, ["Marvel Comics and DC Comics", "Image Publishing", "Marvel (US)", None], names.publisher) == ["marvel", "image", "marvel", ""]
    assert column(spark, ["B.P.R.D.: Hell on Earth", ""], names.base_name) == ["B.P.R.D.", ""]
    assert column(spark, ["", "42.0", "½", "Annual", "AU", "1AU", "1.5"], numbers.catalog_number) == ["1", "42", "0.5", "Annual", "AU", "1AU", "1"]
    assert column(spark, ["1991", "1991.0", "1900", "words", None], lambda c: numbers.year(c, 1950, 2026)) == [1991, 1991, None, None, None]
    assert column(spark, ["1.95 USD; 2.75 CAD", "$1,200.50", None], numbers.price) == [1.95, 1200.5, None]
    assert [str(d) for d in column(spark, ["July 1997", "1997-07-00", "Spring 1940"], numbers.date)] == ["1997-07-01", "1997-07-01", "None"]
    assert column(spark, ["7 5960-6", "0" * 14, "x1", None], numbers.barcode) == ["759606", None, None, None]


def fold(rows):
    """The preferred issue by looking at rows one by one."""
    held = None
    for row in sorted(rows):
        if held is None or held[1] == "variant" or held[1] == "canonical" and row[1] == "newsstand":
            held = row
    return held


def test_folding_equals_unicode_decomposition(spark):
    import unicodedata

    texts = [chr(k) for k in range(0x20, 0x3100) if unicodedata.category(chr(k)) not in ("Cn", "Cs")] + ["Rōnin", "Español", "ő š č ř ž Ș ţ", "e\u0301\u0323x", "Ǘ ệ Ắ ё й ά", "漢字 かが", "한글", "plain"]
    def plain(t):
        return "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")

    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", names.fold(F.col("t")).alias("f"))
    # characters of several letters, and Hangul, stay whole
    assert {r.t: r.f for r in df.collect()} == {t: plain(t) if len(t) > 1 and not any(0xAC00 <= ord(c) <= 0xD7A3 for c in t) or len(plain(t)) <= 1 else t for t in texts}


def test_preferred_issue_equals_the_fold(spark):
    labels = ("variant", "canonical", "newsstand")
    groups = list(itertools.product(labels, repeat=3))
    rows = [(k * 10 + i, k, "1", label, 1990 + i, None) for k, g in enumerate(groups) for i, label in enumerate(g)]
    df = spark.createDataFrame(rows, "issue_id long, series_id long, number string, label string, cover_year int, barcode string")
    found = {r.series_id: (r.issue_id, r.label) for r in catalog.preferred_issues(df).collect()}
    assert found == {k: fold([(k * 10 + i, label) for i, label in enumerate(g)]) for k, g in enumerate(groups)}


def test_substring_equals_brute_force(spark):
    terms, known = ["batman", "the batman", "x-men", "abc", "spider"], ["batman", "batman and robin", "uncanny x-men", "spider-man", "man"]
    frame = lambda v: spark.createDataFrame([(x,) for x in v], "name string")
    found = {(r.term, r.name) for r in matching.substring_names(frame(terms), frame(known)).collect()}
    assert found == {(t, k) for t in terms for k in known if min(len(t), len(k)) >= 4 and (t in k or k in t)}


def test_jaro_winkler_and_merge(spark):
    assert similar.similarities(["martha", "", "same"], ["marhta", "a", "same"]).tolist() == pytest.approx([0.961111, 0, 1], abs=1e-6)
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (4, "e"), (4, "f")], "id int, v string")
    snapshot, rejected = tables.merge_snapshot(old, new, ["id"])
    assert sorted(map(tuple, snapshot.collect())) == [(1, "a"), (2, "c"), (3, "d")] and rejected.count() == 2


def test_collection_file_and_row_keys(spark, tmp_path):
    file = tmp_path / "c.csv"
    file.write_text('﻿Series,Core ComicID,Issue\n"X, Men",7,1\nBatman,,2\nShort,9\n', encoding="utf-8")
    rows = tables.row_keys(tables.read_collection(spark, str(file), ["Series", "Core ComicID", "Issue"]), "Core ComicID")
    assert [(r.Series, r.row_key, r.Issue) for r in rows.orderBy("row_index").collect()] == [("X, Men", "7:1", "1"), ("Batman", "row-2:2", "2"), ("Short", "9:3", None)]
    assert tables.fingerprint(spark, str(file)).first().length == file.stat().st_size
    (tmp_path / "e.csv").write_text("Series\n")
    with pytest.raises(ValueError):
        tables.read_collection(spark, str(tmp_path / "e.csv"), ["Series"])
    with pytest.raises(ValueError):
        tables.export(rows, str(tmp_path / "out"), "xml")


def test_resumable_import_gives_one_result_per_key(spark, tmp_path):
    work = lambda df: df.withColumn("done", F.lit(True))
    out, checkpoint, source = (str(tmp_path / x) for x in ("out", "checkpoint", "in"))
    schema = "row_id long"
    for first in (0, 5):
        spark.range(first, first + 10).withColumnRenamed("id", "row_id").write.mode("append").parquet(source)
        imports.resumable_import(spark.readStream.schema(schema).parquet(source), out, checkpoint, work).awaitTermination()
    assert sorted(r.row_id for r in spark.read.parquet(out).collect()) == list(range(15))


def test_streamed_counts_per_hour(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.sql("select timestamp'2024-01-01 00:30:00' + make_interval(0,0,0,0,id,0,0) as created_at, 'view' as source from range(5)").write.parquet(source)
    stream = spark.readStream.schema("created_at timestamp, source string").parquet(source)
    imports.per_hour(stream).writeStream.format("memory").queryName("per_hour").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert {r.n for r in spark.table("per_hour").collect()} == {1} and spark.table("per_hour").count() == 5


def test_resolve_steps_and_conflicts(spark):
    series = spark.createDataFrame([(1, "Alpha", 1990), (2, "Alpha", 1980), (3, "Alphas", 1970)], "id long, title string, start_year int")
    issues = spark.createDataFrame([(10, 1, "1", "u10"), (20, 2, "1", None), (21, 2, "2", "u21"), (30, 3, "7", None)], "issue_id long, series_id long, number string, upc string")
    mapped = spark.createDataFrame([("s", "m", 30), ("s", "gone", 99)], "source string, source_issue_id string, issue_id long")
    rows = [
        (1, "s", "m", "other", "Alpha", 1990, "1", None, None), (2, "s", "gone", "u21", "Alpha", 1990, "1", None, None), (3, "s", "x", None, "Alpha", 1990, "1", None, None), (4, "s", "x", None, "Alpha", 1991, "1", None, None),
        (5, "s", "x", None, "Alpha", None, "7", None, None), (6, "s", "x", "zz", "Alpha", 1990, "1", None, None), (7, "s", "x", "zz", "Alpha", 1990, "1", " B ", None), (8, None, None, None, "Zebra", 2000, "1", None, None),
        (9, "s", "x", None, "unknown series", 2000, "1", None, None), (10, "s", "x", None, None, None, None, None, None), (11, None, None, "", "Zebra", 2000, "1", None, None),
    ]
    asked = spark.createDataFrame(rows, "candidate_id long, source string, source_issue_id string, upc string, title string, start_year int, number string, suffix string, cover_date date")
    found = {r.candidate_id: r for r in master.resolve(asked, mapped, series, issues).collect()}
    assert len(found) == len(rows)
    assert {k: (r.how, r.issue_id, r.outcome, r.variant) for k, r in found.items()} == {
        1: ("mapping", 30, "matched", None), 2: ("upc", 21, "matched", None), 3: ("title_year", 10, "matched", None), 4: ("title", 20, "matched", None), 5: ("fuzzy", 30, "matched", None), 6: ("title_year", 10, "rejected", None),
        7: ("title_year", 10, "variant", "B"), 8: ("none", None, "created", None), 9: ("none", None, "invalid", None), 10: ("none", None, "invalid", None), 11: ("none", None, "created", None),
    }
    assert found[8].new_key == found[11].new_key and found[5].confidence == pytest.approx(0.7 * similar.similarities(["alpha"], ["alphas"])[0], abs=1e-6)
    assert master.resolve(asked.limit(0), mapped, series, issues).count() == 0


def test_short_substrings_and_blank_publishers(spark):
    terms, known = ["x", "ab", "xab", "the abc", "", "qqqq"], ["x", "xab x", "abc", "b", "", "zz"]
    frame = lambda v: spark.createDataFrame([(x,) for x in v], "name string")
    found = {(r.term, r.name) for r in matching.substring_names(frame(terms), frame(known), 1).collect()}
    assert found == {(t, k) for t in terms for k in known if t and k and (t in k or k in t)}
    series = spark.createDataFrame([(1, "Alpha", "One", 1990), (2, "Omega", "One", 1990), (3, "Omega", "Two", 1990), (4, "Northern Lights", "Two", 1990)], "series_id long, name string, publisher string, year_began int")
    issues = spark.createDataFrame([(10, 1, "1", "canonical", 1990, None), (20, 2, "1", "canonical", 1990, None), (30, 3, "1", "canonical", 1999, None)], "issue_id long, series_id long, number string, label string, cover_year int, barcode string")
    rows = [(1, "Alpha", "1", 1990, None, None), (2, "Omega", "1", 1999, None, None), (3, "Omega", "1", 1999, "One", None), (4, "Northern Lights Saga", "9", 1960, None, None), (5, None, None, None, None, None), (6, "Northern Lights Saga", "9", None, "Two", None)]
    asked = spark.createDataFrame(rows, "row_id long, series_name string, number string, year int, publisher string, barcode string")
    found = {r.row_id: (r.issue_id, r.series_id, r.strategy) for r in matching.match(asked, series, issues).collect()}
    assert found == {1: (10, 1, "exact_one_issue"), 2: (30, 3, "exact_closest_year"), 3: (20, 2, "exact_one_issue"), 4: (None, 4, "substring"), 5: (None, None, "no_match"), 6: (None, 4, "substring")}


def test_every_branch_of_matching(spark):
    """Exact names by year, articles, base names, groups with retry and veto, full numbers, reverse lookup, prefixes."""
    names_ = [
        (1, "Beta", 1990), (2, "Beta", 2005), (3, "The Gamma", 1990), (4, "Delta", 1990), (5, "Delta", 1991), (6, "The Omega", 1990), (7, "Zeta: New World", 2001), (8, "Kappa Saga", 1960), (9, "Kappa Tales", 1999), (10, "Sigma", 1950),
        (11, "Tau: One", 1980), (12, "Tau: Two", 1981), (13, "Iota Nu", 1970),
    ]
    series = spark.createDataFrame([(i, n, "Pub", y) for i, n, y in names_], "series_id long, name string, publisher string, year_began int")
    made = [
        (10, 1, "1", None), (20, 2, "1", 2001), (11, 1, "2", None), (21, 2, "2", 0), (30, 3, "1", 1990), (40, 4, "1", 1990), (50, 5, "1", 1992), (70, 7, "5", 2001), (80, 8, "1", 1960), (90, 9, "1", 1999), (100, 10, "1", 1950),
        (101, 10, "3AU", 1951), (110, 11, "4", None), (120, 12, "4", None), (130, 13, "77", 1970), (131, 13, "77", 1971),
    ]
    issues = spark.createDataFrame([(i, s, n, "canonical", y, "0012345678" if i == 10 else "123456789012399999" if i == 20 else None) for i, s, n, y in made], "issue_id long, series_id long, number string, label string, cover_year int, barcode string")
    asked = {
        "no year, two series": ("Beta", "1", None, None, None, None), "began year stands for no cover year": ("Beta", "1", 1990, None, None, None), "a cover year beats none": ("Beta", "1", 2001, None, None, None), "year 0 counts": ("Beta", "2", 1995, None, None, None),
        "article with the issue": ("Gamma", "1", 1992, None, None, None), "article of two series": ("The Delta", "1", None, None, None, None), "article without the issue": ("Omega", "9", None, None, None, None), "base name": ("Zeta: Old World", "5", 1995, None, None, None),
        "base name, first issue": ("Tau: Three", "4", None, None, None, None), "base name, several series": ("Tau: Three", "9", None, None, None, None), "group retried": ("Kappa Tales", "1", 1999, "Kappa Saga", None, None), "group too far": ("Unknown Name", "1", 1999, "Kappa Saga", None, None),
        "group near": ("Unknown Name", "1", 1962, "Kappa Saga", None, None), "full number": ("Sigma", "3", 1953, None, "3AU", None), "full number equal": ("Sigma", "3", 1953, None, "3", None), "reverse": ("Anything", "77", 1973, None, None, None),
        "short prefix": ("Anything", "9", None, None, None, "00123"), "row begins with the head": ("Anything", "9", None, None, None, "123456789012377777"), "no such prefix": ("Anything", "9", None, None, None, "0012399"),
    }
    rows = spark.createDataFrame([(k, n, num, y, "Pub", b, g, full) for k, (n, num, y, g, full, b) in enumerate(asked.values())], "row_id long, series_name string, number string, year int, publisher string, barcode string, series_group string, number_full string")
    found = {r.row_id: (r.issue_id, r.series_id, r.strategy, r.confidence, r.year_distance) for r in matching.match(rows, series, issues).collect()}
    assert {name: found[k] for k, name in enumerate(asked)} == {
        "no year, two series": (None, None, "no_match", 0, None), "began year stands for no cover year": (10, 1, "exact_closest_year", 85, 0), "a cover year beats none": (20, 2, "exact_closest_year", 85, 0), "year 0 counts": (11, 1, "exact_closest_year", 85, 5),
        "article with the issue": (30, 3, "article_variant", 90, 2), "article of two series": (None, None, "no_match", 0, None), "article without the issue": (None, 6, "article_variant", 60, None), "base name": (70, 7, "base_name", 45, 6),
        "base name, first issue": (110, 11, "base_name", 45, None), "base name, several series": (None, None, "no_match", 0, None), "group retried": (90, 9, "exact_one_issue", 90, 0), "group too far": (None, None, "no_match", 0, None),
        "group near": (80, 8, "exact_one_issue_group", 90, 2), "full number": (101, 10, "exact_series_variant", 90, 2), "full number equal": (None, 10, "exact_series", 80, None), "reverse": (130, 13, "reverse_one", 65, None),
        "short prefix": (10, None, "barcode_prefix", 100, None), "row begins with the head": (20, None, "barcode_prefix", 100, None), "no such prefix": (None, None, "no_match", 0, None),
    }


@pytest.mark.parametrize("rare", [0, 2])
def test_reverse_lookup_by_classes_equals_pairs(spark, monkeypatch, rare):
    import random

    from linkweave.operators import matching

    def score(a, b):
        short, long = sorted((a, b), key=len)
        x, y = set(a.split(" ")), set(b.split(" "))
        ratio = len(short) / len(long)
        return 1.0 if a == b else min(0.9, 1.4 * ratio) if long.startswith(short) else 0.8 * ratio if short in long else len(x & y) / len(x | y)

    monkeypatch.setattr(matching, "RARE", rare, raising=False)
    rnd = random.Random(5)
    made = lambda: " ".join(rnd.choice(["red", "red", "old", "a", "bolt", "redder", "b", "longestword"]) for _ in range(rnd.randint(1, 4)))
    held, asked = [made() for _ in range(60)], [made() for _ in range(40)]
    series = spark.createDataFrame([(k, n, "P") for k, n in enumerate(held)], "series_id long, name string, publisher string")
    issues = spark.createDataFrame([(k, k, "1", 1990) for k in range(len(held))], "issue_id long, series_id long, number string, cover_year int")
    rows = spark.createDataFrame([(k, n, "1", 1992, "p" if k % 2 else "") for k, n in enumerate(asked)], "row_id long, raw string, number string, year int, publisher string")
    want = {}
    for k, n in enumerate(asked):
        best = min((-round(score(n, h), 6), s) for s, h in enumerate(held))
        if best[0] < 0:
            want[k] = best[1]
    assert {r.row_id: r.series_id for r in matching.by_reverse(rows, series, issues).collect()} == want


def test_row_columns_are_derived_once(spark):
    """Filters on a derived column were pushed to the scan, where every place of the column derived it again."""
    rows = matching.standardise(spark.createDataFrame([(1, "Red Axe: Part One", "1", 1990, "House", None), (2, "Red Axe: Part Two", "1", None, None, None), (3, "Red Axe", "2", 1991, "", None)], "row_id long, series_name string, number string, year int, publisher string, barcode string"))
    series = spark.createDataFrame([(7, "Red Axe", "House", 1980), (8, "Red Axe", "House", 1990)], "series_id long, name string, publisher string, year_began int")
    issues = spark.createDataFrame([(70, 7, "1", "canonical", 1985, None), (80, 8, "1", "canonical", 1991, None)], "issue_id long, series_id long, number string, label string, cover_year int, barcode string")
    based, dated = matching.by_base_name(rows, series, catalog.preferred_issues(issues)), matching.by_date(rows, series, issues)
    assert "Cartoon Books" not in based._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in based.collect()) == [(1, 80, 8, "base_name", 45, 1), (2, 70, 7, "base_name", 45, None)]
    assert [tuple(r) for r in dated.collect()] == [(3, 80, 8, "date_based", 40, 0)]
