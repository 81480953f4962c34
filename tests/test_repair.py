"""Merging duplicates at three levels, against a merge of one group after the other."""

import random
from datetime import date

import pytest

from linkweave.operators import repair


def plain_merge(series, issues, mappings, variants, picked_series=None, picked_issues=None):
    """Groups merged one by one, in memory; returns the four tables and the conflicts."""
    age = lambda r: (r["created_at"] is None, r["created_at"] or 0, r.get("id", r.get("issue_id")))
    series, issues, mappings, variants = ({next(iter(r.values())): dict(r) for r in t} for t in (series, issues, mappings, variants))
    conflicts = set()

    def merge(winner, loser):
        w, x = issues[winner], issues[loser]
        w["cover_date"] = x["cover_date"] if w["cover_date"] is None else w["cover_date"]
        if w["upc"] is None:
            w["upc"] = x["upc"]
        elif w["upc"] and x["upc"] and w["upc"] != x["upc"]:
            conflicts.add(("issue", winner, loser, w["upc"], x["upc"]))
        for m in mappings.values():
            m["issue_id"] = winner if m["issue_id"] == loser else m["issue_id"]
        for v in sorted((v for v in variants.values() if v["issue_id"] == loser), key=lambda v: v["variant_id"]):
            old = next((o for o in variants.values() if o["issue_id"] == winner and o["suffix"] == v["suffix"]), None)
            if old is None:
                v["issue_id"] = winner
                continue
            if old["name"] is None and v["name"]:
                old["name"] = v["name"]
            elif old["name"] and v["name"] and old["name"] != v["name"]:
                conflicts.add(("variant", old["variant_id"], v["variant_id"], old["name"], v["name"]))
            del variants[v["variant_id"]]
        del issues[loser]

    chosen = lambda ss, ii: (picked_series is None and picked_issues is None) or bool(ss & (picked_series or set()) or ii & (picked_issues or set()))
    key = lambda i: (series[i["series_id"]]["title"], series[i["series_id"]]["start_year"])
    runs, groups = {}, {}
    for s in series.values():
        if s["title"] is not None and s["start_year"] is not None:
            runs.setdefault((s["title"], s["start_year"]), []).append(s)
    for i in issues.values():
        if i["series_id"] in series and None not in key(i) and i["number"] is not None:
            groups.setdefault((*key(i), i["number"]), []).append(i)
    run_lists = [r for r in runs.values() if len(r) > 1 and chosen({s["id"] for s in r}, {i["issue_id"] for i in issues.values() if i["number"] is not None and i["series_id"] in {s["id"] for s in r}})]
    for group in groups.values():
        if len(group) > 1 and chosen({i["series_id"] for i in group}, {i["issue_id"] for i in group}):
            first, *rest = sorted(group, key=age)
            for other in rest:
                merge(first["issue_id"], other["issue_id"])
    for run in run_lists:
        first, *rest = sorted(run, key=age)
        held = {}
        for s in [first, *rest]:
            if s is not first:
                if first["publisher"] is None:
                    first["publisher"] = s["publisher"]
                elif first["publisher"] and s["publisher"] and first["publisher"] != s["publisher"]:
                    conflicts.add(("series", first["id"], s["id"], first["publisher"], s["publisher"]))
            for i in sorted((i for i in issues.values() if i["series_id"] == s["id"]), key=age):
                if i["number"] is not None and i["number"] in held:
                    merge(held[i["number"]], i["issue_id"])
                else:
                    held.setdefault(i["number"], i["issue_id"])
                    i["series_id"] = first["id"]
            if s is not first:
                del series[s["id"]]
    return *({tuple(r.values()) for r in t.values()} for t in (series, issues, mappings, variants)), conflicts


def made(seed):
    rnd = random.Random(seed)
    pick = rnd.choice
    series = [{"id": k, "title": pick(["A", "B", None]), "start_year": pick([1990, 1991, None, 1990]), "publisher": pick([None, "", "P", "Q"]), "created_at": pick([None, 1, 2, 3])} for k in range(30)]
    issues = [{"issue_id": k, "series_id": rnd.randrange(32), "number": pick(["1", "2", "3", None]), "cover_date": pick([None, date(2000, 1, 1), date(2001, 1, 1)]), "upc": pick([None, "", "u", "v"]), "created_at": pick([None, 5, 6, 7])} for k in range(120)]
    mappings = [{"mapping_id": k, "source": "s", "source_issue_id": str(k), "issue_id": rnd.randrange(125)} for k in range(150)]
    kinds = sorted({(rnd.randrange(120), pick("ABC")) for _ in range(150)})
    variants = [{"variant_id": k, "issue_id": i, "suffix": s, "name": pick([None, "", "x", "y"])} for k, (i, s) in enumerate(kinds)]
    return series, issues, mappings, variants


SCHEMAS = (
    "id long, title string, start_year int, publisher string, created_at long", "issue_id long, series_id long, number string, cover_date date, upc string, created_at long",
    "mapping_id long, source string, source_issue_id string, issue_id long", "variant_id long, issue_id long, suffix string, name string",
)


def frames(spark, tables):
    return repair.Canon(*(spark.createDataFrame([tuple(r.values()) for r in t], s) for t, s in zip(tables, SCHEMAS, strict=True)))


def rows(canon):
    return [sorted(map(tuple, t.collect()), key=str) for t in (canon.series, canon.issues, canon.mappings, canon.variants)]


@pytest.mark.parametrize(("seed", "picked_series", "picked_issues"), [(1, None, None), (2, {3, 9}, None), (3, None, {4, 50, 51}), (4, {1}, {7})])
def test_repair_equals_one_by_one(spark, seed, picked_series, picked_issues):
    tables = made(seed)
    *want, conflicts = plain_merge(*tables, picked_series, picked_issues)
    ids = lambda s: None if s is None else spark.createDataFrame([(i,) for i in s], "id long")
    done = repair.repair(frames(spark, tables), ids(picked_series), ids(picked_issues))
    assert rows(done.canon) == [sorted(t, key=str) for t in want]
    assert {tuple(r) for r in done.conflicts.collect()} == conflicts
    if picked_series is None and picked_issues is None:
        again = repair.repair(done.canon)
        assert rows(again.canon) == rows(done.canon) and again.merged.count() == 0


def test_repair_of_nothing(spark):
    empty = repair.Canon(*(spark.createDataFrame([], s) for s in SCHEMAS))
    done = repair.repair(empty)
    assert rows(done.canon) == [[], [], [], []] and done.conflicts.count() == 0 and repair.series_duplicates(empty).count() == 0 and repair.issue_duplicates(empty).count() == 0
