"""Queries of the entity-resolution operators over the given tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.functions import names, numbers
from linkweave.operators import bookkeeping, catalog, inventory, lookups, master, matching, repair, reports, review, similar, site_pages, urls
from linkweave.plans import projection as p
from linkweave.sources import markup

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- SQL building blocks ---------------------------------------------------------

_KEY = "strip_accents(lower({0}))"
_BASE = p.with_sql("series", "issues", "collection") + r""",
preferred as (
  select series_id, number, issue_id, label, cover_year, n_issues from (
    select *, count(*) over (partition by series_id, number) as n_issues, row_number() over (partition by series_id, number
      order by case label when 'newsstand' then 0 when 'canonical' then 1 else 2 end, case when label = 'variant' then -issue_id else issue_id end) as r from issues) where r = 1
), codes as (select barcode, max(issue_id) as last_id, min(issue_id) as first_id from issues where barcode is not null group by barcode),
inputs as (
  select row_id, series_name, regexp_replace(series_name, ',\s*[Vv]ol\.?\s*\d+\s*$', '') as name, number, year, lower(publisher) as publisher, barcode from collection
), rows as (
  select row_id, series_name, strip_accents(lower(name)) as key, trim(regexp_replace(regexp_replace(replace(strip_accents(lower(name)), '&', 'and'), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) as strict,
    case when len(list_distinct(string_split(strip_accents(lower(name)), ' '))) >= 2 then array_to_string(list_sort(list_distinct(string_split(strip_accents(lower(name)), ' '))), ' ') end as words,
    case when contains(name, ': ') then replace(strip_accents(lower(name)), ': ', ', ') end as comma,
    case when starts_with(strip_accents(lower(name)), 'the ') then substr(strip_accents(lower(name)), 5) else 'the ' || strip_accents(lower(name)) end as article,
    trim(split_part(strip_accents(lower(name)), ':', 1)) as base, number, year, publisher, barcode from inputs
), named as (select series_id, year_began, lower(publisher) as publisher, strip_accents(lower(name)) as key,
    array_to_string(list_sort(list_distinct(string_split(strip_accents(lower(name)), ' '))), ' ') as words from series),
idx as (select key, publisher, number, cover_year, count(*) as n, min({'s': series_id, 'i': issue_id}) as first from named join preferred using (series_id) group by all)
"""  # fmt: skip


# Matching is checked on a collection that reaches every branch; its SQL looks at candidates one by one.
_FOLD = "strip_accents(lower(trim(regexp_replace({0}, '\\s+', ' ', 'g'))))"
_CUT = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\s*\((?:Marvel|Comic Books|Cartoon Books)[^)]*\)\s*$', '', 'i'), ',?\s*(?:Vol\.?|Volume)\s*\d+(\s+|$)', '\1', 'gi'), '\s+(?:II|III)\s*$', '', 'i'), ',?\s*Annual\s*$', '', 'i'), '\s*\(\d{{4}}\)\s*$', ''))"
_STRICT = "trim(regexp_replace(regexp_replace(replace({0}, '&', 'and'), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))"
_WORDSET = "list_sort(list_distinct(string_split({0}, ' ')))"
_SHELF = "with " + ", ".join(f"{name} as ({p.SQL[source]})" for name, source in (("series", "titled_series"), ("issues", "dated_issues"), ("collection", "shelf"))) + rf""",
preferred as (
  select series_id, number, issue_id, label, cover_year, n_issues from (
    select *, count(*) over (partition by series_id, number) as n_issues, row_number() over (partition by series_id, number
      order by case label when 'newsstand' then 0 when 'canonical' then 1 else 2 end, case when label = 'variant' then -issue_id else issue_id end) as r from issues) where r = 1
), codes as (select barcode, max(issue_id) as last_id, min(issue_id) as first_id from issues where barcode is not null group by barcode),
cut as (select *, {_FOLD.format(_CUT.format("series_name"))} as key, {_FOLD.format("series_name")} as raw, {_FOLD.format(_CUT.format("series_group"))} as gkey from collection),
rows as (select row_id, series_name, key, raw, {_STRICT.format("key")} as strict, case when len({_WORDSET.format("raw")}) >= 2 then {_WORDSET.format("raw")} end as words, case when contains(key, ': ') then replace(key, ': ', ', ') end as comma,
    case when starts_with(key, 'the ') then substr(key, 5) else 'the ' || key end as article, case when regexp_replace(key, '\s*[:—–].+$', '') not in ('', key) then regexp_replace(key, '\s*[:—–].+$', '') end as base,
    number, year, coalesce(lower(publisher), '') as publisher, barcode, case when trim(series_group) <> '' and gkey <> key then gkey end as gkey, case when number_full <> number and number_full ~ '.*[A-Za-z].*' then number_full end as full_number from cut),
named as (select series_id, year_began, lower(publisher) as publisher, strip_accents(lower(name)) as key, name from series),
heads as (select key, min(series_id) as head, arg_min(publisher, series_id) as publisher, arg_min(name, series_id) as name from named group by key),
members as (select n.series_id, n.key, h.head, h.publisher, h.name from named n join heads h using (key))
"""


def _exactly(key: str, suffix: str = "") -> str:
    """Series of the name and publisher that have the issue: one, or several if the row has a year."""
    return f"""select row_id, case when n = 1 then f.i else c.i end as issue_id, case when n = 1 then f.s else c.s end as series_id, case when n = 1 then 'exact_one_issue{suffix}' else 'exact_closest_year{suffix}' end as strategy,
      case when n = 1 then 90 else 85 end as confidence, cast(case when n = 1 then f.d else c.d end as int) as year_distance from (
      select row_id, year, count(*) as n, min({{'s': s.series_id, 'i': issue_id, 'd': case when cover_year <> 0 then abs(cover_year - year) end}}) as f, min({{'d': abs(coalesce(cover_year, year_began) - year), 's': s.series_id, 'i': issue_id}}) as c
      from rows r join named s on s.key = r.{key} and r.publisher in ('', s.publisher) join preferred q on q.series_id = s.series_id and q.number = r.number group by row_id, year) where n = 1 or year is not null"""


def _single(candidates: str, strategy: str, confidence: int) -> str:
    """The only series of each row among candidates ``row_id, series_id``."""
    return f"select row_id, cast(null as bigint) as issue_id, min(series_id) as series_id, '{strategy}' as strategy, {confidence} as confidence, cast(null as int) as year_distance from ({candidates}) group by row_id having count(*) = 1"


_OWN = "select r.row_id, s.series_id from rows r join named s on s.key = r.{0} and r.publisher in ('', s.publisher)"
_GATED = "select r.row_id, m.series_id from rows r join members m on {0} and r.publisher in ('', m.publisher)"
_CODE = "select row_id, last_id as issue_id, cast(null as bigint) as series_id, 'barcode_exact' as strategy, 100 as confidence, cast(null as int) as year_distance from rows join codes using (barcode)"
_HEAD = """select row_id, arg_min(c.last_id, c.first_id) as issue_id, cast(null as bigint) as series_id, 'barcode_prefix' as strategy, 100 as confidence, cast(null as int) as year_distance
  from rows r join codes c on starts_with(c.barcode, r.barcode) or starts_with(r.barcode, left(c.barcode, 13)) group by row_id"""
_ARTICLE = f"""select row_id, q.issue_id, o.series_id, 'article_variant' as strategy, case when q.issue_id is not null then 90 else 60 end as confidence, cast(case when cover_year <> 0 then abs(cover_year - year) end as int) as year_distance
  from ({_single(_OWN.format("article"), "article_variant", 60)}) o join rows r using (row_id) left join preferred q on q.series_id = o.series_id and q.number = r.number"""
_BASES = r"""select row_id, coalesce(c.i, f.i) as issue_id, coalesce(c.s, f.s, lone) as series_id, 'base_name' as strategy, 45 as confidence, cast(c.d as int) as year_distance from (
  select row_id, count(*) as n, min(m.series_id) as lone, min({'h': m.head, 's': m.series_id, 'i': q.issue_id}) filter (q.issue_id is not null) as f,
    min({'d': abs(cover_year - year), 'h': m.head, 's': m.series_id, 'i': q.issue_id}) filter (cover_year <> 0 and year is not null) as c
  from rows r join members m on regexp_replace(strip_accents(lower(m.name)), '\s*[:—–].+$', '') = r.base and r.publisher in ('', m.publisher) left join preferred q on q.series_id = m.series_id and q.number = r.number group by row_id) where f is not null or n = 1"""
_ALIKE = """round(case when {0} = {1} then 1.0
      when starts_with(case when length({0}) <= length({1}) then {1} else {0} end, case when length({0}) <= length({1}) then {0} else {1} end) then least(0.9, 1.4 * least(length({0}), length({1})) / greatest(length({0}), length({1})))
      when contains(case when length({0}) <= length({1}) then {1} else {0} end, case when length({0}) <= length({1}) then {0} else {1} end) then 0.8 * least(length({0}), length({1})) / greatest(length({0}), length({1}))
      else len(list_intersect(list_distinct(string_split({0}, ' ')), list_distinct(string_split({1}, ' ')))) / len(list_distinct(list_concat(string_split({0}, ' '), string_split({1}, ' ')))) end, 6)"""


def reverse_sql(rows: str) -> str:
    """Reverse lookup of ``rows`` (row_id, raw, number, year, publisher): series of the number within five years, all of them or those of the row's publisher."""
    return f"""(with ask as (select distinct raw, number, year, publisher from {rows} where year is not null),
    spots as (select i.series_id, i.number, i.cover_year, min(i.issue_id) as issue_id, any_value(n.key) as key, any_value(n.publisher) as publisher from issues i join named n using (series_id) where i.cover_year between 1950 and 2025 group by 1, 2, 3),
    seen as (select distinct a.number, a.year, s.series_id, s.key, s.publisher from (select distinct number, year from ask) a join spots s on s.number = a.number and s.cover_year between a.year - 5 and a.year + 5),
    alln as (select number, year, count(*) as n, min(series_id) as one from seen group by 1, 2), pubn as (select number, year, publisher, count(*) as n, min(series_id) as one from seen group by 1, 2, 3),
    scope as (select a.*, case when l.n = 1 then l.one when o.n = 1 then o.one end as one, case when o.n is not null then a.publisher end as own from ask a join alln l using (number, year) left join pubn o on o.number = a.number and o.year = a.year and o.publisher = a.publisher),
    alike as (select raw, key, {_ALIKE.format("raw", "key")} as alike from (select distinct raw from scope where one is null), (select distinct key from seen)),
    best as (select c.raw, c.number, c.year, c.publisher, min({{'a': -alike, 's': s.series_id}}) as b from scope c join seen s on s.number = c.number and s.year = c.year and (own is null or s.publisher = own) join alike k on k.raw = c.raw and k.key = s.key where one is null and alike > 0 group by all),
    picked as (select raw, number, year, publisher, one as series_id, 'reverse_one' as how from scope where one is not null union all select raw, number, year, publisher, b.s, 'reverse_similarity' from best),
    held as (select k.*, arg_min(s.issue_id, {{'y': s.cover_year, 'i': s.issue_id}}) as issue_id from picked k join spots s on s.series_id = k.series_id and s.number = k.number and s.cover_year between k.year - 5 and k.year + 5 group by all)
    select row_id, h.issue_id, h.series_id, h.how as strategy, case when h.how = 'reverse_one' then 65 else 55 end as confidence, cast(null as int) as year_distance from {rows} r join held h on h.raw = r.raw and h.number = r.number and h.year = r.year and h.publisher = r.publisher)"""


_DATE = """select row_id, b.i as issue_id, b.s as series_id, 'date_based' as strategy, 40 as confidence, cast(b.d as int) as year_distance from (
  select r.row_id, min({'d': abs(i.cover_year - r.year), 's': i.series_id, 'y': i.cover_year, 'i': i.issue_id}) as b from rows r join named s on s.key = r.key and r.publisher in ('', s.publisher)
  join issues i on i.series_id = s.series_id and i.cover_year between r.year - 1 and r.year + 1 and i.cover_year between 1950 and 2026 group by r.row_id)"""
_SUBSTRING = r"""with terms as (select row_id, publisher, number, year, regexp_replace(regexp_replace(key, '^(the|a|an) ', ''), '[ the]+$', '') as term from rows where length(series_name) >= 4),
    heads as (select key as name, count(*) as n, min(series_id) as sid, arg_min(publisher, series_id) as publisher from named where key <> '' group by key),
    pairs as (select t.term, h.* from (select distinct term from terms where term <> '') t join heads h on contains(h.name, t.term) or contains(t.term, h.name)),
    dated as (select key as name, number, cover_year, count(*) as m, min(series_id) as near from preferred join named using (series_id) where cover_year <> 0 group by all),
    met as (select t.row_id, t.number, t.year, p.name, p.n, p.sid from terms t join pairs p on p.term = t.term and t.publisher in ('', p.publisher)),
    wide as (select row_id, sum(n) as n, min(sid) as sid from met group by 1),
    close as (select m.row_id, sum(d.m) as m, min(d.near) as near from met m join dated d on d.name = m.name and d.number = m.number and abs(d.cover_year - m.year) <= 5 group by 1)
  select row_id, cast(null as bigint) as issue_id, case when m is not null then near else sid end as series_id, 'substring' as strategy, 50 as confidence, cast(null as int) as year_distance
  from wide left join close using (row_id) where coalesce(m, n) = 1"""
_PARTS = {
    "hits": f"select * from ({_CODE}) union all select * from ({_HEAD})", "grouped": _exactly("gkey", "_group"), "exact": _exactly("key"), "one": _single(_OWN.format("key"), "exact_series", 80), "strictly": _single(_GATED.format(_STRICT.format("m.key") + " = r.strict"), "strict_series", 75),
    "wordly": _single(_GATED.format(_WORDSET.format("m.key") + " = r.words and m.name <> r.key"), "word_order", 70), "commas": _single(_OWN.format("comma"), "colon_comma", 68), "articles": _ARTICLE, "substrings": _SUBSTRING, "bases": _BASES, "dates": _DATE, "reverses": reverse_sql("rows"),
}
_MATCH = (
    _SHELF + "".join(f", {n} as ({s})" for n, s in _PARTS.items())
    + ", everything as (select * from hits" + "".join(f" union all select * from {n} where row_id not in (select row_id from hits)" for n in list(_PARTS)[1:]) + ")"
    + ", ladder(strategy, place) as (values " + ", ".join(f"('{s}', {i})" for i, s in enumerate(matching.LADDER)) + ")"
    + """, best as (select * from (select e.*, row_number() over (partition by row_id order by confidence desc, year_distance nulls last, place) as r from everything e join ladder using (strategy)) where r = 1),
    own as (select * from exact), years as (select series_id, number, cover_year as cy from preferred),
    seen as (select b.*, w.year, w.number, w.gkey, w.full_number, abs(y.cy - w.year) as gap, o.issue_id as oi, o.series_id as os, o.strategy as ot, o.confidence as oc, o.year_distance as od, abs(z.cy - w.year) as ogap
      from best b join rows w using (row_id) left join years y on y.series_id = b.series_id and y.number = w.number left join own o on o.row_id = b.row_id left join years z on z.series_id = o.series_id and z.number = w.number),
    retried as (select *, coalesce(gkey is not null and confidence < 100 and issue_id is not null and gap >= 4 and oi is not null and ogap < gap, false) as swap from seen),
    swapped as (select row_id, case when swap then oi else issue_id end as issue_id, case when swap then os else series_id end as series_id, case when swap then ot else strategy end as strategy, case when swap then oc else confidence end as confidence,
      case when swap then od else year_distance end as year_distance, case when swap then ogap else gap end as gap, year, full_number from retried),
    kept as (select * from swapped where not coalesce(issue_id is not null and strategy like '%\\_group' escape '\\' and gap > 15, false)),
    full_ as (select k.*, q.issue_id as fi, case when q.cover_year <> 0 then abs(q.cover_year - k.year) end as fd from kept k left join preferred q on k.issue_id is null and q.series_id = k.series_id and q.number = k.full_number),
    won as (select row_id, coalesce(issue_id, fi) as issue_id, series_id, case when fi is not null then strategy || '_variant' else strategy end as strategy, case when fi is not null then 90 else confidence end as confidence, cast(case when fi is not null then fd else year_distance end as int) as year_distance from full_),
    matches as (select c.row_id, w.issue_id, w.series_id, coalesce(w.strategy, 'no_match') as strategy, coalesce(w.confidence, 0) as confidence, w.year_distance from collection c left join won w on w.row_id = c.row_id) """
)


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return matching.standardise(p.shelf(spark, sf_dir)), p.titled_series(spark, sf_dir), p.dated_issues(spark, sf_dir)


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match(p.shelf(spark, sf_dir), p.titled_series(spark, sf_dir), p.dated_issues(spark, sf_dir))


# --- matching ----------------------------------------------------------------------


@query(_MATCH + "select * from matches")
def k1_match_collection(spark, sf_dir):
    return _matches(spark, sf_dir)


@query(p.with_sql("dated_issues") + " select * from dated_issues")
def a6_catalog_issues(spark, sf_dir):
    return p.dated_issues(spark, sf_dir)


@query(_SHELF + "select row_id, key, raw, strict, array_to_string(words, ' ') as words, comma, article, base, number, year, publisher, barcode, gkey as group_key, full_number as full from rows")
def h2_standardise_collection(spark, sf_dir):
    return matching.standardise(p.shelf(spark, sf_dir)).drop("series_name")


@query(_SHELF + "select series_id, number, issue_id, label, cover_year, n_issues from preferred")
def w1_preferred_issues(spark, sf_dir):
    return catalog.preferred_issues(p.dated_issues(spark, sf_dir))


@query(_SHELF + "select * from codes")
def d2_barcode_table(spark, sf_dir):
    return catalog.barcodes(p.dated_issues(spark, sf_dir))


@query(_SHELF + "select key as name_key, min(series_id) as series_id, arg_min(s.publisher, series_id) as publisher from named join series s using (series_id) group by key")
def w2_name_representatives(spark, sf_dir):
    return catalog.representative(p.titled_series(spark, sf_dir))


@query(_SHELF + _CODE)
def c1_barcode_exact(spark, sf_dir):
    return matching.by_barcode(matching.coded(p.shelf(spark, sf_dir)), catalog.barcodes(p.dated_issues(spark, sf_dir)))


@query(_SHELF + _HEAD)
def c2_barcode_prefix(spark, sf_dir):
    return matching.by_barcode_prefix(matching.coded(p.shelf(spark, sf_dir)), catalog.barcodes(p.dated_issues(spark, sf_dir)))


def _index(series: DataFrame, issues: DataFrame) -> DataFrame:
    return catalog.any_publisher(catalog.name_index(series, catalog.preferred_issues(issues), names.key(F.col("name"))))


def _groups(series: DataFrame) -> DataFrame:
    return catalog.any_publisher(catalog.name_groups(series, names.key(F.col("name"))))


@query(_SHELF + _PARTS["grouped"])
def c3_exact_group(spark, sf_dir):
    rows, series, issues = _inputs(spark, sf_dir)
    return matching.by_exact_name(rows, _index(series, issues), "group_key", "_group")


@query(_SHELF + _PARTS["one"])
def c3_exact_series(spark, sf_dir):
    rows, series, _ = _inputs(spark, sf_dir)
    return matching.by_series_only(rows, "key", _groups(series), "exact_series")


@query(_SHELF + _PARTS["exact"])
def c3_exact_name(spark, sf_dir):
    rows, series, issues = _inputs(spark, sf_dir)
    return matching.by_exact_name(rows, _index(series, issues))


@query(_SHELF + _PARTS["strictly"])
def c4_strict_name(spark, sf_dir):
    rows, series, _ = _inputs(spark, sf_dir)
    return matching.by_series_only(rows, "strict", catalog.any_publisher(catalog.name_forms(series, names.strict(F.col("name")))), "strict_series")


@query(_SHELF + _PARTS["commas"])
def c5_colon_comma(spark, sf_dir):
    rows, series, _ = _inputs(spark, sf_dir)
    return matching.by_series_only(rows, "comma", _groups(series), "colon_comma")


@query(_SHELF + _PARTS["articles"])
def c6_article_variant(spark, sf_dir):
    rows, series, issues = _inputs(spark, sf_dir)
    return matching.by_article(rows, _groups(series), catalog.preferred_issues(issues))


@query(_SHELF + _PARTS["wordly"])
def c7_word_order(spark, sf_dir):
    rows, series, _ = _inputs(spark, sf_dir)
    return matching.by_word_order(rows, series)


@query(_SHELF + ", t as (select distinct key from rows where length(key) >= 4), k as (select distinct key from named where length(key) >= 4) select t.key as term, k.key as name from t, k where contains(t.key, k.key) or contains(k.key, t.key)")
def c8_substring_names(spark, sf_dir):
    rows, series, _ = _inputs(spark, sf_dir)
    return matching.substring_names(rows.select(F.col("key").alias("name")), series.select(names.key(F.col("name")).alias("name")))


@query(_SHELF + "select * from (" + _SUBSTRING + ")")
def c8_substring_series(spark, sf_dir):
    rows, series, issues = _inputs(spark, sf_dir)
    return matching.by_substring(rows, series, catalog.preferred_issues(issues))


@query(_SHELF + _PARTS["bases"])
def c9_base_name(spark, sf_dir):
    rows, series, issues = _inputs(spark, sf_dir)
    return matching.by_base_name(rows, series, catalog.preferred_issues(issues))


@query(_SHELF + _DATE)
def c11_date_band(spark, sf_dir):
    return matching.by_date(*_inputs(spark, sf_dir))


@query(_SHELF + "select * from " + _PARTS["reverses"])
def c12_reverse_lookup(spark, sf_dir):
    return matching.by_reverse(*_inputs(spark, sf_dir))


@query(_SHELF + "select y.year, y.n as rows, (select count(*) from series where year_began <= y.year and (series_id % 4 <> 0 or year_began + 3 >= y.year)) as active from (select year, count(*) as n from collection group by year) y")
def c13_active_series(spark, sf_dir):
    series = p.titled_series(spark, sf_dir).withColumn("year_ended", F.when(F.col("series_id") % 4 == 0, F.col("year_began") + 3))
    return catalog.active_in(series, p.shelf(spark, sf_dir))


@query(_SHELF + """, t as (select distinct key from rows), k as (select distinct key from named) select t.key as title, k.key as known, round(jaro_winkler_similarity(t.key, k.key), 6) as alike from t, k
  where t.key <> '' and k.key <> '' and round(jaro_winkler_similarity(t.key, k.key), 6) >= 0.85""")  # fmt: skip
def c15_fuzzy_titles(spark, sf_dir):
    rows, series, _ = _inputs(spark, sf_dir)
    return similar.alike_pairs(rows.select(F.col("key").alias("name")), series.select(names.key(F.col("name")).alias("name")))


@query(_SHELF + "select (select count(*) from series) as series, (select count(*) from preferred) as issues, (select count(*) from codes) as barcodes")
def k18_catalog_stats(spark, sf_dir):
    _, series, issues = _inputs(spark, sf_dir)
    one = lambda df, n: df.agg(F.count("*").alias(n))
    return one(series, "series").crossJoin(one(catalog.preferred_issues(issues), "issues")).crossJoin(one(catalog.barcodes(issues), "barcodes"))  # one row each


@query(_MATCH + "select strategy, count(*) as n from matches group by strategy")
def d1_strategy_counts(spark, sf_dir):
    return reports.strategy_counts(_matches(spark, sf_dir))


@query(_MATCH + "select row_id, strategy, issue_id, year_distance from matches where confidence > 0 and strategy not like 'barcode%' and year_distance > 2 order by year_distance desc, row_id limit 50")
def f9_likely_false(spark, sf_dir):
    return reports.likely_false(_matches(spark, sf_dir))


@query(_MATCH + """, x as (select row_id, strategy || '' as category from matches where issue_id is null) select category, count(*) as n,
  (select string_agg(row_id, ',' order by row_id) from (select row_id from x y where y.category = x.category order by row_id limit 5)) as sample_rows from x group by category""")  # fmt: skip
def d15_unmatched_summary(spark, sf_dir):
    return reports.error_summary(_matches(spark, sf_dir).where("issue_id is null").select("row_id", F.col("strategy").alias("category")))


# --- mappings, corrections, master ------------------------------------------------

_MAP = p.with_sql("mappings", "corrections", "masters")
_NAMES = "(values " + ", ".join(f"('{x}')" for x in reports.PLATFORMS) + ") p(source)"


@query(_MAP + """ select source, correction_type, review_status, count(*) as n, count(*) filter (review_status = 'pending') as pending, count(*) filter (review_status = 'applied') as applied,
  cast(grouping_id(source, correction_type, review_status) as bigint) as grouped from corrections group by grouping sets ((), (source), (correction_type), (review_status))""")  # fmt: skip
def d5_correction_totals(spark, sf_dir):
    return reports.correction_totals(p.corrections(spark, sf_dir))


@query(_MAP + f""" select source, total, accurate, total - accurate as inaccurate, corrected, round(100.0 * accurate / total, 2) as accuracy, round(100.0 * corrected / total, 2) as correction_rate from (
  select p.source, count(m.source) as total, count(*) filter (is_accurate) as accurate, (select count(*) from corrections c where c.source = p.source) as corrected from {_NAMES} left join mappings m on m.source = p.source group by p.source)""")  # fmt: skip
def d6_platform_accuracy(spark, sf_dir):
    return reports.platform_accuracy(p.mappings(spark, sf_dir), p.corrections(spark, sf_dir))


@query(_MAP + """ select correction_type, issue_id, n, examples, place from (select correction_type, issue_id, count(*) as n, array_to_string(list_slice(list_sort(list(correction_id)), 1, 3), ',') as examples,
  row_number() over (partition by correction_type order by count(*) desc, issue_id)::int as place from corrections group by 1, 2) where place <= 5""")  # fmt: skip
def d7_confusion_patterns(spark, sf_dir):
    return reports.confusion(p.corrections(spark, sf_dir))


@query(_MAP + " select title, start_year, count(*) as members, arg_min(id, {'c': created_at, 'i': id}) as winner, count(distinct publisher) as publishers from masters group by 1, 2 having count(*) > 1")
def d10_duplicate_report(spark, sf_dir):
    return master.duplicate_report(p.masters(spark, sf_dir))


@query(_MAP + """ select (min(w)).i as id, title, start_year, coalesce((min(w)).p, (min(w) filter (publisher is not null)).p) as publisher, count(*) as merged
  from (select *, {'c': created_at, 'i': id, 'p': publisher} as w from masters) group by title, start_year""")  # fmt: skip
def k9_repair_duplicates(spark, sf_dir):
    return master.repaired(p.masters(spark, sf_dir))


@query(_MAP + """, win as (select title, start_year, arg_min(id, {'c': created_at, 'i': id}) as winner from masters group by 1, 2)
  select mapping_id, source, winner as issue_id, winner <> m.issue_id as moved from mappings m join masters t on t.id = m.issue_id join win using (title, start_year)""")  # fmt: skip
def w10_moved_mappings(spark, sf_dir):
    return master.moved(p.mappings(spark, sf_dir), p.masters(spark, sf_dir))


def _requests(mappings: DataFrame) -> DataFrame:
    k = F.col("k")
    return mappings.where("k % 5 = 0").select(F.col("mapping_id").alias("request_id"), F.when(k % 3 == 0, -F.col("mapping_id") - 1).otherwise(F.col("mapping_id")).alias("mapping_id"), F.when(k % 2 == 0, (F.col("mapping_id") + k).cast("string")).alias("new_id"))


@query(_MAP + """, req as (select mapping_id as request_id, case when k % 3 = 0 then -mapping_id - 1 else mapping_id end as mapping_id, case when k % 2 = 0 then cast(mapping_id + k as varchar) end as new_id from mappings where k % 5 = 0),
  x as (select r.request_id, r.mapping_id, r.new_id, m.source_issue_id as own, case when m.source is null then 404 when h.mapping_id is not null and h.mapping_id <> r.mapping_id then 409 else 200 end as status
    from req r left join mappings m using (mapping_id) left join mappings h on h.source = m.source and h.source_issue_id = r.new_id)
  select request_id, mapping_id, status, case when status = 200 then coalesce(new_id, own) end as source_issue_id, case when status = 200 then new_id is not null end as is_accurate from x""")  # fmt: skip
def k10_apply_corrections(spark, sf_dir):
    m = p.mappings(spark, sf_dir)
    return master.apply_corrections(m, _requests(m))


def _to_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate per part: some with an outside id, a UPC, a misspelt or missing title, year or number."""
    k = F.col("p_partkey")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % 5 + 1).cast("int"))
    title = F.concat_ws(" ", pick(_SEGMENTS), (k % 50).cast("string"))
    return p.table(spark, sf_dir, "part").select(
        k.alias("candidate_id"), pick(reports.PLATFORMS).alias("source"), F.when(k % 8 == 0, k.cast("string")).otherwise("none").alias("source_issue_id"),
        F.when(k % 6 == 1, F.lpad((k * 24 + 1).cast("string"), 13, "0")).when(k % 6 == 2, F.lpad((k * 8 + 2).cast("string"), 13, "0")).alias("upc"),
        F.when(k % 53 == 0, "Unknown Series").when(k % 7 == 0, F.concat(title, F.lit("X"))).otherwise(title).alias("title"), F.when(k % 9 != 0, k % 25 + 1950).cast("int").alias("start_year"),
        F.when(k % 11 != 0, (k % 9 + 1).cast("string")).alias("number"), F.when(k % 4 == 1, "B").alias("suffix"), F.when(k % 10 < 5, F.date_add(F.lit("2000-01-01").cast("date"), (k % 3000).cast("int"))).alias("cover_date"),
    )


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "UNKNOWN")
_RESOLVE = p.with_sql("mappings", "masters", "master_issues") + f""", named as (select p_partkey as k, list_extract({list(_SEGMENTS)}, cast(p_partkey % 5 + 1 as int)) || ' ' || cast(p_partkey % 50 as varchar) as t from part),
  cand as (select k as candidate_id, list_extract({list(reports.PLATFORMS)}, cast(k % 5 + 1 as int)) as source, case when k % 8 = 0 then cast(k as varchar) else 'none' end as source_issue_id,
    case k % 6 when 1 then lpad(cast(k * 24 + 1 as varchar), 13, '0') when 2 then lpad(cast(k * 8 + 2 as varchar), 13, '0') end as upc,
    case when k % 53 = 0 then 'Unknown Series' when k % 7 = 0 then t || 'X' else t end as title, case when k % 9 <> 0 then cast(k % 25 + 1950 as int) end as start_year, case when k % 11 <> 0 then cast(k % 9 + 1 as varchar) end as number,
    case when k % 4 = 1 then 'B' end as suffix, case when k % 10 < 5 then date '2000-01-01' + cast(k % 3000 as int) end as cover_date from named),
  held as (select series_id, number, min(issue_id) as issue_id, arg_min(coalesce(upc, ''), issue_id) as upc from master_issues group by 1, 2),
  sy as (select title, start_year, min(id) as series_id from masters group by 1, 2), st as (select title, arg_min(id, {{'y': start_year, 'i': id}}) as series_id from masters group by 1),
  sure as (select c.*, m.issue_id as mapped, u.issue_id as coded, y.issue_id as by_year, y.upc as year_upc, t.issue_id as by_title, t.upc as title_upc from cand c
    left join (select source, source_issue_id, min(issue_id) as issue_id from mappings where issue_id in (select issue_id from master_issues) group by 1, 2) m using (source, source_issue_id)
    left join (select upc, min(issue_id) as issue_id from master_issues where upc is not null group by 1) u on u.upc = c.upc
    left join (select * from sy join held using (series_id)) y on y.title = c.title and y.start_year = c.start_year and y.number = c.number
    left join (select * from st join held using (series_id)) t on t.title = c.title and t.number = c.number),
  asked as (select distinct title, number from sure where coalesce(mapped, coded, by_year, by_title) is null and number is not null),
  alike as (select a.title, k.title as known, round(jaro_winkler_similarity(lower(a.title), lower(k.title)), 6) as alike from (select distinct title from asked) a, (select distinct title from masters) k
    where round(jaro_winkler_similarity(lower(a.title), lower(k.title)), 6) >= 0.85),
  near as (select a.title, a.number, min({{'a': -l.alike, 'y': s.start_year, 's': s.id, 'i': h.issue_id, 'u': h.upc}}) as n from asked a join alike l using (title) join masters s on s.title = l.known join held h on h.series_id = s.id and h.number = a.number group by 1, 2),
  x as (select u.*, n.n, case when mapped is not null then 'mapping' when coded is not null then 'upc' when by_year is not null then 'title_year' when by_title is not null then 'title' when n.n is not null then 'fuzzy' else 'none' end as how
    from sure u left join near n on n.title = u.title and n.number = u.number),
  z as (select *, case how when 'title_year' then year_upc when 'title' then title_upc when 'fuzzy' then n.u else '' end as own, coalesce(start_year, year(cover_date)) as made_year, coalesce(suffix, strftime(cover_date, '%Y-%m')) as tag from x),
  o as (select *, case when how = 'none' then case when lower(title) <> 'unknown series' and made_year is not null and number is not null then 'created' else 'invalid' end
    when own <> '' and own <> upc then case when tag is not null then 'variant' else 'rejected' end else 'matched' end as outcome from z)
"""  # fmt: skip


@query(_RESOLVE + """ select candidate_id, how, case how when 'mapping' then 1.0::double when 'upc' then 1.0::double when 'title_year' then 0.95::double when 'title' then 0.85::double when 'fuzzy' then 0.7::double * -n.a else 0.0::double end as confidence,
  case how when 'mapping' then mapped when 'upc' then coded when 'title_year' then by_year when 'title' then by_title when 'fuzzy' then n.i end as issue_id, outcome, case when outcome = 'variant' then tag end as variant,
  case when outcome = 'created' then md5(title || '|' || cast(made_year as varchar) || '|' || number) end as new_key from o""")  # fmt: skip
def k4_resolve_candidates(spark, sf_dir):
    return master.resolve(_to_resolve(spark, sf_dir), p.mappings(spark, sf_dir), p.masters(spark, sf_dir), p.master_issues(spark, sf_dir))


@query(_MAP + " select source, count(distinct issue_id) as issues, round(100.0 * count(distinct issue_id) / (select count(distinct issue_id) from mappings), 1) as percent from mappings group by source")
def d11_inventory_coverage(spark, sf_dir):
    return reports.coverage(p.mappings(spark, sf_dir))


@query(_MAP + """ select issue_id, n, cast(len(found) as int) as sources, array_to_string(list_filter(['click','error','purchase','signup','view'], lambda x: not list_contains(found, x)), ',') as missing,
  case when n >= 5 then 'resolved' else 'partial' end as stage from (select issue_id, count(*) as n, list(distinct source) as found from mappings group by issue_id)""")  # fmt: skip
def d17_issue_stages(spark, sf_dir):
    return reports.issue_stages(p.mappings(spark, sf_dir))


@query(_MAP + " select issue_id, created_at, mapping_id, source, k from (select *, row_number() over (partition by issue_id order by created_at desc, mapping_id desc) as r from mappings) where r = 1")
def w12_latest_mapping(spark, sf_dir):
    return reports.latest(p.mappings(spark, sf_dir).select("issue_id", "created_at", "mapping_id", "source", "k"), "issue_id", "created_at", "mapping_id")


@query(_MAP + """ select source, arg_max(k, {'t': created_at, 'i': mapping_id}) as last_k, count(distinct k) as kinds, cast(floor(epoch(min(created_at))) - floor(epoch((select min(created_at) from mappings))) as bigint) as offset_s,
  cast(floor(epoch(max(created_at))) - floor(epoch(min(created_at))) as bigint) as span_s from mappings group by source""")  # fmt: skip
def w13_platform_timeline(spark, sf_dir):
    return reports.timeline(p.mappings(spark, sf_dir))


@query(_MAP + " select date_trunc('hour', created_at) as hour, source, count(*) as n, count(*) filter (is_accurate) as accurate from mappings group by 1, 2")
def d20_completions_per_hour(spark, sf_dir):
    return reports.per_hour(p.mappings(spark, sf_dir))


@query(_MAP + " select title, start_year, id from masters order by title, start_year, id limit 100 offset 200")
def t2_inventory_page(spark, sf_dir):
    return p.masters(spark, sf_dir).select("title", "start_year", "id").orderBy("title", "start_year", "id").offset(200).limit(100)


# --- urls and pages ----------------------------------------------------------------

_URL = r"""with u as (select page_id, url, case when regexp_matches(url, '^https?://') then lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) end as host, nullif(regexp_extract(url, '^https?://[^/]*/([a-z]{2})/([0-9]+)(?:\.html)?/?(?:[?#].*)?$', 2), '') as item,
    nullif(regexp_extract(url, '^https?://[^/]*/([a-z]{2})/([0-9]+)(?:\.html)?/?(?:[?#].*)?$', 1), '') as section from pages),
  parsed as (select page_id, case when host = 'example.com' or host like '%.example.com' then 'com' when host = 'example.net' or host like '%.example.net' then 'net' when host = 'example.org' or host like '%.example.org' then 'org' end as platform, section, item as item_id, host from u) """  # fmt: skip


@query(_URL + "select page_id, platform, section, item_id, case when host is null then 'not_http' when platform is null then 'unsupported_host' when item_id is null then 'no_item' end as error from parsed")
def h4_parse_urls(spark, sf_dir):
    return urls.parse_urls(p.table(spark, sf_dir, "pages"))


@query(_URL + "select platform, count(*) as total, count(item_id) as resolved, count(distinct case when item_id is not null then section || '/' || item_id end) as items from parsed group by platform")
def k16_resolve_urls(spark, sf_dir):
    return urls.resolve_urls(p.table(spark, sf_dir, "pages"))


# Repair, group by group: every issue of a key in order of age, every variant of a suffix in order of its issue.
_CANON = p.with_sql("canon_series", "canon_issues", "canon_mappings", "canon_variants") + r""",
  runs as (select *, count(*) over r as members, first_value(id) over (r order by created_at nulls last, id rows between unbounded preceding and unbounded following) as winner, row_number() over (r order by created_at nulls last, id) as place from canon_series window r as (partition by title, start_year)),
  keyed as (select i.*, s.title, s.start_year, s.winner as run from canon_issues i join runs s on s.id = i.series_id),
  aged as (select *, count(*) over g as members, first_value(issue_id) over (g order by created_at nulls last, issue_id rows between unbounded preceding and unbounded following) as winner, row_number() over (g order by created_at nulls last, issue_id) as place,
    first_value(cover_date ignore nulls) over (g order by created_at nulls last, issue_id rows between unbounded preceding and unbounded following) as kept_date, first_value(upc ignore nulls) over (g order by created_at nulls last, issue_id rows between unbounded preceding and unbounded following) as kept_upc
    from keyed window g as (partition by title, start_year, number)),
  kinds as (select v.*, a.winner, first_value(variant_id) over (w order by a.place, variant_id rows between unbounded preceding and unbounded following) as kept_id, row_number() over (w order by a.place, variant_id) as nth,
    first_value(nullif(v.name, '') ignore nulls) over (w order by a.place, variant_id rows between unbounded preceding and unbounded following) as first_name, first_value(v.name) over (w order by a.place, variant_id rows between unbounded preceding and unbounded following) as own_name
    from canon_variants v join aged a on a.issue_id = v.issue_id window w as (partition by a.winner, v.suffix)),
  named as (select *, coalesce(own_name, first_name) as kept_name from kinds),
  houses as (select *, first_value(publisher ignore nulls) over (partition by title, start_year order by place rows between unbounded preceding and unbounded following) as kept_publisher from runs),
  clashes as (select 'series' as level, winner as winner_id, id as merged_id, kept_publisher as kept, publisher as dropped from houses where id <> winner and publisher <> kept_publisher
    union all select 'issue', winner, issue_id, kept_upc, upc from aged where issue_id <> winner and upc <> kept_upc union all select 'variant', kept_id, variant_id, kept_name, name from named where variant_id <> kept_id and name <> kept_name and name <> '' and kept_name <> ''),
  gone as (select 'series' as level, id as merged_id, winner as winner_id from runs where id <> winner union all select 'issue', issue_id, winner from aged where issue_id <> winner union all select 'variant', variant_id, kept_id from named where variant_id <> kept_id)
"""  # fmt: skip


@query(_CANON + """ select s.title, s.start_year, s.winner, s.members, s.id, s.publisher, s.id = s.winner as is_winner, (select count(*) from canon_issues i where i.series_id = s.id) as n_issues, coalesce((select string_agg(number, ',' order by number) from canon_issues i where i.series_id = s.id), '') as numbers,
  (select count(*) from canon_issues i join canon_mappings m using (issue_id) where i.series_id = s.id) as n_maps, coalesce((select string_agg(distinct source, ',' order by source) from canon_issues i join canon_mappings m using (issue_id) where i.series_id = s.id), '') as sources from runs s where members > 1""")  # fmt: skip
def k8_series_duplicates(spark, sf_dir):
    return repair.series_duplicates(p.canon(spark, sf_dir))


_D9 = """ select a.title, a.start_year, a.number, a.winner, a.members, a.issue_id, a.series_id, a.cover_date, a.upc, coalesce((select string_agg(suffix, ',' order by suffix) from canon_variants v where v.issue_id = a.issue_id), '') as suffixes,
  coalesce((select string_agg(source || ':' || source_issue_id, ',' order by source || ':' || source_issue_id) from canon_mappings m where m.issue_id = a.issue_id), '') as maps from aged a where members > 1"""


@query(_CANON + _D9)
def d9_issue_duplicates(spark, sf_dir):
    return repair.issue_duplicates(p.canon(spark, sf_dir))


@query(_CANON + _D9 + " and exists (select 1 from aged b where b.title = a.title and b.start_year = a.start_year and b.number = a.number and (b.series_id % 50 = 7 or b.issue_id % 101 = 3))")
def f15_selected_issue_duplicates(spark, sf_dir):
    canon = p.canon(spark, sf_dir)
    return repair.issue_duplicates(canon, canon.series.where("id % 50 = 7").select("id"), canon.issues.where("issue_id % 101 = 3").select(F.col("issue_id").alias("id")))


@query(_CANON + " select id, title, start_year, kept_publisher as publisher, created_at from houses where id = winner")
def k9_repaired_series(spark, sf_dir):
    return repair.repair(p.canon(spark, sf_dir)).canon.series


@query(_CANON + " select issue_id, run as series_id, number, kept_date as cover_date, kept_upc as upc, created_at from aged where issue_id = winner")
def k9_repaired_issues(spark, sf_dir):
    return repair.repair(p.canon(spark, sf_dir)).canon.issues


@query(_CANON + " select mapping_id, source, source_issue_id, coalesce(a.winner, m.issue_id) as issue_id from canon_mappings m left join aged a using (issue_id)")
def k9_repaired_mappings(spark, sf_dir):
    return repair.repair(p.canon(spark, sf_dir)).canon.mappings


@query(_CANON + " select variant_id, winner as issue_id, suffix, kept_name as name from named where variant_id = kept_id")
def k9_repaired_variants(spark, sf_dir):
    return repair.repair(p.canon(spark, sf_dir)).canon.variants


@query(_CANON + " select * from clashes")
def k9_repair_conflicts(spark, sf_dir):
    return repair.repair(p.canon(spark, sf_dir)).conflicts


@query(_CANON + " select level, (select count(*) from gone g where g.level = l.level) as merged, (select count(*) from clashes c where c.level = l.level) as conflicts, (select count(*) from clashes c where c.level = l.level) > 0 as review from (select distinct level from gone) l")
def k9_repair_summary(spark, sf_dir):
    return repair.repair_summary(repair.repair(p.canon(spark, sf_dir)))


@query('''select p_partkey as series_id, p_name as name, coalesce(s_name, '') as publisher, p_size + case when p_partkey % 9 = 0 then 1985 else 1945 end as year_began, case when p_partkey % 4 = 0 then p_size + 1948 end as year_ended, p_size * 3 as issue_count
  from part left join supplier on s_suppkey = p_partkey % 12 and s_suppkey % 7 <> 0 where p_partkey % 13 <> 0 and p_partkey % 5 <> 0 and p_size + case when p_partkey % 9 = 0 then 1985 else 1945 end <= 2026 and (p_partkey % 4 <> 0 or p_size + 1948 >= 1950)''')  # fmt: skip
def f1_usable_series(spark, sf_dir):
    series, _, publishers = p.dump(spark, sf_dir)
    return catalog.usable_series(series, publishers, 2026)


@query(p.with_sql("dump_issues") + ''' select issue_id, series_id, number, case when variant_name = 'Newsstand' then 'newsstand' when variant_of_id is null then 'canonical' else 'variant' end as label,
  coalesce(try_cast(nullif(regexp_extract(publication_date, '[0-9]{4}'), '') as int), try_cast(split_part(key_date, '-', 1) as int)) as cover_year, barcode from dump_issues where not deleted''')  # fmt: skip
def p1_labelled_issues(spark, sf_dir):
    return catalog.labelled_issues(p.dump(spark, sf_dir)[1])


@query(_MATCH + ''' select c.*, m.issue_id as matched_issue_id, 'https://www.comics.org/issue/' || m.issue_id || '/' as matched_url, case when m.issue_id is not null then m.strategy || ':' || m.confidence else 'no_match' end as match_type, m.strategy, m.series_id as matched_series_id, s.name as matched_series, q.cover_year as matched_cover_year
  from collection c join matches m using (row_id) left join series s on s.series_id = m.series_id left join preferred q on q.series_id = m.series_id and q.number = c.number''')  # fmt: skip
def a10_enriched_collection(spark, sf_dir):
    return matching.enriched(p.shelf(spark, sf_dir), _matches(spark, sf_dir), p.titled_series(spark, sf_dir), catalog.preferred_issues(p.dated_issues(spark, sf_dir)))


_REVIEW = p.with_sql("canon_series", "canon_issues", "reviewable", "review_requests")
_OF = "left join canon_issues i using (issue_id) left join canon_series s on s.id = i.series_id"


@query(_REVIEW + f" select c.*, i.number, s.title, s.start_year from (select * from reviewable where review_status = 'applied' and source = 'click' order by created_at desc, correction_id desc limit 50) c {_OF}")
def t3_recent_corrections(spark, sf_dir):
    return review.recent(p.reviewable(spark, sf_dir), p.canon(spark, sf_dir), status="applied", platform="click")


@query(_REVIEW + f" select c.*, i.number, s.title, s.start_year from reviewable c {_OF}")
def c27_corrections_of_issues(spark, sf_dir):
    return review.recent(p.reviewable(spark, sf_dir), p.canon(spark, sf_dir), limit=None)


@query(_REVIEW + ''', last as (select correction_id, max(request_id) as request_id from review_requests where status in ('pending', 'reviewed', 'applied', 'rejected') group by 1)
  select c.correction_id, c.source, c.issue_id, c.correction_type, c.created_at, c.original_source_issue_id, c.correct_source_issue_id, coalesce(r.status, c.review_status) as review_status, r.reviewed_by, r.notes as review_notes, r.at as reviewed_at
  from reviewable c left join last l using (correction_id) left join review_requests r on r.request_id = l.request_id''')  # fmt: skip
def k11_reviewed_corrections(spark, sf_dir):
    return review.reviewed(p.reviewable(spark, sf_dir), p.review_requests(spark, sf_dir))[0]


@query(_REVIEW + " select request_id, correction_id, case when correction_id not in (select correction_id from reviewable) then 'not_found' when status = 'done' then 'invalid_status' else 'done' end as outcome from review_requests")
def k11_review_outcomes(spark, sf_dir):
    return review.reviewed(p.reviewable(spark, sf_dir), p.review_requests(spark, sf_dir))[1]


@query(_REVIEW + f" select c.correction_id, issue_id, s.title, s.start_year, i.number, c.source, c.correct_source_issue_id, c.original_source_issue_id, c.correction_type from reviewable c {_OF} where review_status = 'applied' and correct_source_issue_id is not null and i.number is not null")
def f14_correction_seeds(spark, sf_dir):
    return review.seeds(p.reviewable(spark, sf_dir), p.canon(spark, sf_dir))


# --- bookkeeping of imports ------------------------------------------------------------


@query(p.with_sql("import_results") + ''' select r.run_id, r.total - case when r.run_id % 7 = 3 then 50 else 0 end as total_rows, d.processed, d.failed, coalesce(a.active, 0) as active, greatest(r.total - case when r.run_id % 7 = 3 then 50 else 0 end - d.processed - coalesce(a.active, 0), 0) as pending,
  case when r.run_id % 4 = 1 then 'retry_failed_only' when r.run_id % 3 <> 0 and r.run_id % 2 > 0 then 'resume' else 'fresh' end as mode from (select o_custkey % 20 as run_id, count(*) as total from orders group by 1) r
  left join (select run_id, count(*) as processed, count(*) filter (not resolved) as failed from import_results group by 1) d using (run_id) left join (select o_custkey % 20 as run_id, count(*) as active from orders where o_orderkey % 7 = 0 and o_orderkey % 5 = 0 group by 1) a using (run_id)''')  # fmt: skip
def d14_import_progress(spark, sf_dir):
    return bookkeeping.progress(*p.import_state(spark, sf_dir))


@query(p.with_sql("import_results") + ''', c as (select *, case when lower(error) like '%year%' then 'missing_series_year' when lower(error) like '%multiple rows were found%' then 'duplicate_data' when lower(error) like '%validation error%' then 'validation_error' when lower(error) like '%resolution error%' then 'resolution_failed'
    when lower(error) like '%network%' or lower(error) like '%connection%' then 'network_error' when lower(error) like '%timeout%' then 'timeout' else 'other' end as category from import_results where error is not null)
  select run_id, category, count(*) as n, array_to_string(list_slice(list(row_index order by row_index), 1, 5), ',') as sample_rows, d.description from c join (values ''' + ", ".join(f"('{k}', '{v}')" for k, v in bookkeeping.DESCRIPTIONS.items()) + ") d(category, description) using (category) group by all")  # fmt: skip
def d15_import_errors(spark, sf_dir):
    return bookkeeping.error_report(p.import_state(spark, sf_dir)[2])


@query(p.with_sql("collection") + r''', k as (select row_id, trim(series_name) || '|' || regexp_extract(series_name, '(?i)\bvol\.?\s*(\d+)', 1) || '|' || coalesce(year::varchar, '') as series_key from collection)
  select series_key, count(*) as n, min(row_id) as first_row, max(row_id) as last_row from k group by 1''')  # fmt: skip
def d16_series_groups(spark, sf_dir):
    rows = p.collection(spark, sf_dir).select(F.col("row_id").alias("row_index"), F.col("series_name").alias("series"), F.lit("").alias("year"), F.col("year").cast("string").alias("cover_year"))
    return bookkeeping.series_groups(rows)


@query(p.with_sql("mappings") + ''', i as (select c_custkey as issue_id from customer), s as (select unnest(['click', 'error', 'purchase', 'signup', 'view']) as source),
  m as (select distinct issue_id, source from mappings), u as (select i.issue_id, count(m.source) as updated, coalesce(string_agg(s.source, ',' order by s.source) filter (m.source is null), '') as missing from i cross join s left join m on m.issue_id = i.issue_id and m.source = s.source group by 1)
  select issue_id, 5::bigint as checked, updated, missing, 'Reconciled issue ' || issue_id || ' across 5 platforms. Created 0 new mappings, updated ' || updated || '. 0 errors.' as summary from u''')  # fmt: skip
def d18_reconciled_issues(spark, sf_dir):
    return bookkeeping.reconciled(p.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("issue_id")), p.mappings(spark, sf_dir), reports.PLATFORMS)


@query(p.with_sql("canon_series", "canon_issues") + ''', pairs as (select distinct title, (id % 6)::varchar as number from canon_series where id % 10 = 0) select i.issue_id, i.series_id, s.title, s.start_year, i.number from canon_issues i join canon_series s on s.id = i.series_id where (s.title, i.number) in (select title, number from pairs)''')
def c21_bulk_issues(spark, sf_dir):
    canon = p.canon(spark, sf_dir)
    return lookups.issues_of_pairs(canon, canon.series.where("id % 10 = 0").select("title", (F.col("id") % 6).cast("string").alias("number")))


@query(p.with_sql("canon_mappings") + " select * from canon_mappings where source = 'click' and source_issue_id in (select o_orderkey::varchar from orders where o_orderkey % 7 = 0)")
def c22_bulk_mappings(spark, sf_dir):
    ids = p.table(spark, sf_dir, "orders").where("o_orderkey % 7 = 0").select(F.col("o_orderkey").cast("string").alias("source_issue_id"))
    return lookups.mappings_of_ids(p.canon(spark, sf_dir).mappings, "click", ids)


@query(p.with_sql("canon_issues") + " select series_id, issue_id, number, row_number() over (partition by series_id order by number nulls last, issue_id)::int as place from canon_issues")
def t5_issues_in_order(spark, sf_dir):
    return lookups.issues_in_order(p.canon(spark, sf_dir))


# --- inventory -----------------------------------------------------------------------

_ITEMS = p.with_sql("canon_series", "canon_issues", "canon_mappings") + ''', found as (select issue_id, string_agg(source || ':' || source_issue_id, ',' order by source || ':' || source_issue_id) as maps, count(distinct source) as n from canon_mappings group by 1),
  items as (select i.issue_id, s.title, i.number, s.start_year, s.publisher, i.cover_date, i.upc, coalesce(f.maps, '') as maps, coalesce(f.n, 0) as platforms_found, 5::bigint as platforms_total from canon_issues i join canon_series s on s.id = i.series_id left join found f using (issue_id))'''
#: Texts that are searched for: parts of titles and ids, numbers, and UPCs.
_SEARCHES = ("BUILD", "ure 1", "7", "000000000015", "99", "machinery 1", "x", "")


@query(_ITEMS + " select * from items where title ilike '%mach%' and number = '2' and publisher ilike '%house 1%' and issue_id in (select issue_id from canon_mappings where source = 'click')")
def k13_issue_list(spark, sf_dir):
    return inventory.issue_rows(inventory.filtered(p.canon(spark, sf_dir), title="mach", number="2", publisher="house 1", platform="click"), reports.PLATFORMS)


@query(_ITEMS + ", placed as (select *, row_number() over (order by title, number, issue_id) - 1 as place from items) select *, place // 50 as page from placed")
def k13_issue_pages(spark, sf_dir):
    return inventory.paged(inventory.issue_rows(p.canon(spark, sf_dir), reports.PLATFORMS))


@query(_ITEMS + ", q as (select unnest(" + str(list(_SEARCHES)) + ''') as query), hits as (select distinct query, issue_id, title, number from q join items i on query <> '' and (contains(lower(title), lower(query)) or number = query or upc = query or issue_id in (select issue_id from canon_mappings m where contains(lower(source_issue_id), lower(query)))))
  select query, place, issue_id from (select *, row_number() over (partition by query order by title, number, issue_id)::int as place from hits) where place <= 50''')  # fmt: skip
def k13_search(spark, sf_dir):
    return inventory.search(spark.createDataFrame([(q,) for q in _SEARCHES], "query string"), p.canon(spark, sf_dir))


@query(_ITEMS + ''', n as (select p.source as platform, (select count(distinct issue_id) from canon_mappings m where m.source = p.source) as mapped, (select count(*) from canon_issues) as total_issues, (select count(*) from canon_series) as total_series, (select count(*) from canon_mappings) as total_mappings from ''' + _NAMES
    + ") select *, round(mapped / total_issues * 100, 1) as percentage from n")
def k13_inventory_stats(spark, sf_dir):
    return inventory.stats(p.canon(spark, sf_dir), reports.PLATFORMS)


@query(p.with_sql("mappings") + " select issue_id from mappings group by issue_id having count(distinct source) = 5")
def d12_complete_issues(spark, sf_dir):
    return inventory.complete_issues(p.mappings(spark, sf_dir), reports.PLATFORMS)


@query(_RESOLVE + ''', a as (select candidate_id, lower(title) as low, nullif(trim(number), '') as number from cand where title is not null), k as (select distinct lower(title) as known from masters),
  close_ as (select low, known, round(jaro_winkler_similarity(low, known), 6) as alike from (select distinct low from a where low <> ''), k where round(jaro_winkler_similarity(low, known), 6) >= 0.85),
  hits as (select a.candidate_id, m.id as series_id, m.title, l.alike, h.issue_id from a join close_ l using (low) join masters m on lower(m.title) = l.known left join (select series_id, number, min(issue_id) as issue_id from master_issues group by 1, 2) h on h.series_id = m.id and h.number = a.number where a.number is null or h.issue_id is not null)
  select candidate_id, place, series_id, issue_id, 0.7::double * alike as confidence, 'Fuzzy title match: ' || title || ' (similarity: ' || printf('%.2f', alike) || ')' as reason from (select *, row_number() over (partition by candidate_id order by alike desc, series_id)::int as place from hits) where place <= 5''')  # fmt: skip
def t1_best_fuzzy(spark, sf_dir):
    return master.best_fuzzy(_to_resolve(spark, sf_dir), p.masters(spark, sf_dir), p.master_issues(spark, sf_dir))


_LINKS = p.with_sql("links", "link_mappings") + r""",
  t as (select link_id, url, regexp_replace(trim(url), '^(https?://[^/?#:]*):[0-9]+', '\1') as u from links),
  h as (select *, lower(regexp_extract(u, '^https?://(?:[^/?#@]*@)?([^/?#:]*)', 1)) as host, regexp_extract(u, '^https?://[^/?#]*([^?#]*)', 1) as path from t),
  s as (select *, case when host = 'comics.org' or ends_with(host, '.comics.org') then 'gcd' when host = 'leagueofcomicgeeks.com' or ends_with(host, '.leagueofcomicgeeks.com') then 'locg' when host = 'comiccollectorlive.com' or ends_with(host, '.comiccollectorlive.com') then 'ccl'
    when host = 'atomicavenue.com' or ends_with(host, '.atomicavenue.com') then 'aa' when host = 'comicspriceguide.com' or ends_with(host, '.comicspriceguide.com') then 'cpg' when host = 'hipcomic.com' or ends_with(host, '.hipcomic.com') then 'hip' end as site from h),
  f as (select *, nullif(case site when 'gcd' then coalesce(nullif(regexp_extract(u, 'comics\.org/issue/(\d+)', 1), ''), regexp_extract(u, 'comics\.org/series/(\d+)', 1))
      when 'locg' then case when regexp_matches(u, 'variant=\d') and regexp_matches(u, '/comic/\d') then regexp_extract(u, 'variant=(\d+)', 1) when regexp_matches(u, '/comics/series/\d+/') then regexp_extract(u, '/comics/series/(\d+)/', 1)
        when regexp_matches(u, '/comic/\d+/\d+(/|$)') then regexp_extract(u, '/comic/\d+/(\d+)', 1) else regexp_extract(u, '/comic/(\d+)(?:/.*)?$', 1) end
      when 'ccl' then regexp_extract(u, '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}') when 'aa' then coalesce(nullif(regexp_extract(u, '/atomic/item/(\d+)', 1), ''), regexp_extract(u, '/atomic/series/(\d+)', 1))
      when 'cpg' then coalesce(nullif(regexp_extract(u, '/titles/[^/]+/[^/]+/([a-z0-9]+)', 1), ''), regexp_extract(u, '/titles/([^/]+)', 1)) when 'hip' then coalesce(nullif(regexp_extract(path, '/comic/[^/]+/([^/]+)', 1), ''), regexp_extract(path, '/comic/([^/]+)', 1)) end, '') as issue,
    nullif(case site when 'gcd' then case when not regexp_matches(u, 'comics\.org/issue/\d') then regexp_extract(u, 'comics\.org/series/(\d+)', 1) end
      when 'locg' then case when regexp_matches(u, 'variant=\d') and regexp_matches(u, '/comic/\d') then regexp_extract(u, '/comic/(\d+)', 1) when regexp_matches(u, '/comics/series/\d+/') then regexp_extract(u, '/comics/series/(\d+)/', 1)
        else regexp_extract(u, '/comic/(\d+)/\d+(?:/|$)', 1) end when 'aa' then case when not regexp_matches(u, '/atomic/item/\d') then regexp_extract(u, '/atomic/series/(\d+)', 1) end
      when 'cpg' then case when not regexp_matches(u, '/titles/[^/]+/[^/]+/[a-z0-9]+') then regexp_extract(u, '/titles/([^/]+)', 1) end when 'hip' then regexp_extract(path, '/comic/([^/]+)', 1) end, '') as series,
    regexp_extract(u, '/titles/[^/]+/([^/]+)/[a-z0-9]+', 1) as part, list_extract(string_split(rtrim(path, '/'), '/'), -1) as tail from s),
  parsed as (select link_id, url, site, case when coalesce(u, '') = '' then 'empty' when not regexp_matches(u, '^https?://') then 'not_http' when contains(lower(u), 'comicbookdb.com') then 'files_only' when site is null then 'unsupported_host' when issue is null then 'bad_format' end as error,
    issue, series, case site when 'aa' then nullif(nullif(regexp_extract(u, '/item/\d+/(\d+)', 1), ''), '1') when 'cpg' then case when part = '-1' or not contains(part, '-') then null when starts_with(part, '-1') then substr(part, 3)
      when not starts_with(part, '-') and regexp_matches(part, '-[A-Za-z]+$') then list_extract(string_split(part, '-'), -1) end
      when 'hip' then case when regexp_matches(path, '/comic/[^/]+/[^/]+') and tail <> issue and tail not in ('', 'keywords') then replace(replace(tail, '-', ''), '_', '') end end as suffix,
    case when site = 'hip' or (site = 'aa' and regexp_matches(u, '/atomic/item/\d')) then u end as whole from f),
  resolved as (select p.*, k.issue_id, case when error is not null then 'failed' when k.issue_id is null then 'not_found' else 'resolved' end as status from parsed p left join link_mappings k on error is null and k.source = p.site and k.source_issue_id = p.issue)
"""  # fmt: skip


@query(_LINKS + """select link_id, url, case when error is null or error = 'bad_format' then site end as platform, case when error is null then issue end as source_issue_id, case when error is null then series end as source_series_id,
  case when error is null then suffix end as variant_suffix, case when error is null then whole end as full_url, error from parsed""")  # fmt: skip
def h4_platform_urls(spark, sf_dir):
    return urls.platform_urls(p.links(spark, sf_dir))


@query(_LINKS + "select link_id, url, case when error is null or error = 'bad_format' then site end as platform, case when error is null then issue end as source_issue_id, issue_id, status, error from resolved")
def k16_resolve_platform_urls(spark, sf_dir):
    return urls.resolve_platform_urls(p.links(spark, sf_dir), p.link_mappings(spark, sf_dir))


@query(_LINKS + """, named as (select case when error is null or error = 'bad_format' then site end as s, status from resolved)
  select case when grouping(s) = 1 then 'all' else coalesce(s, 'unknown') end as platform, count(*) as total, count(*) filter (status = 'resolved') as resolved, count(*) filter (status = 'not_found') as not_found, count(*) filter (status = 'failed') as failed,
  'Processed ' || count(*) || ' URLs: ' || count(*) filter (status <> 'failed') || ' succeeded, ' || count(*) filter (status = 'failed') || ' failed' as summary from named group by rollup (s)""")  # fmt: skip
def d19_resolve_summary(spark, sf_dir):
    return urls.resolve_summary(urls.resolve_platform_urls(p.links(spark, sf_dir), p.link_mappings(spark, sf_dir)))


@query(p.with_sql("site_candidates") + ''' select page_id, platform, case x when 2 then case when title = '' then '#' || digits else title || ' #' || digits end else case when x is not null then title end end as series_title, case x when 0 then k::varchar when 1 then replace(name, ' ', '-') when 2 then k::varchar end as source_series_id,
  case when x is not null then year end as start_year, case x when 0 then 'Press House' when 1 then brand when 2 then brand end as publisher, case when x is not null then digits end as number, case when x in (0, 1) and k % 7 = 1 then 'B' end as variant_suffix, cast(null as varchar) as variant_name,
  case x when 1 then make_date(year, 5, 1) when 2 then make_date(year, 12, 31) end as cover_date, case when x > 0 then k % 9 + 0.95::double end as price, case when x = 1 then (k % 40 + 8)::int end as page_count, case when x > 0 then lpad(k::varchar, 12, '7') end as upc, error from site_candidates''')  # fmt: skip
def h6_site_candidates(spark, sf_dir):
    return site_pages.page_candidates(p.site_pages(spark, sf_dir))


# The given pages by selectors, where SQL reads them by their fixed form.
PAGE_RULES = [("page", "title", "head > title", "text"), ("page", "links", "a[href]", "@href")]


@query(r'''select page_id, trim(replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#x27;', chr(39)), '&amp;', '&')) as title, len(regexp_extract_all(html, '<a [^>]*href=', 0))::int as n_links,
  coalesce(trim(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)[-1]), '') as last_link from pages''')  # fmt: skip
def j4_page_fields(spark, sf_dir):
    read = markup.read_fields(p.table(spark, sf_dir, "pages").withColumn("platform", F.lit("page")), PAGE_RULES, closed=True)
    links = F.coalesce(F.col("fields")["links"], F.array().cast("array<struct<label:string,value:string>>"))
    return read.select("page_id", F.coalesce(F.get(F.col("fields")["title"], F.lit(0))["value"], F.lit("")).alias("title"), F.size(links).alias("n_links"), F.coalesce(F.try_element_at(links, F.lit(-1))["value"], F.lit("")).alias("last_link"))


@query("""select page_id, replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;', '"'), '&amp;', '&') as title, replace(replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&quot;', '"'), '&amp;', '&') as heading,
  cast(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as int) as n_links, coalesce(regexp_extract_all(html, '<a href="([^"]*)"', 1)[1], '') as first_link from pages""")  # fmt: skip
def h6_page_candidates(spark, sf_dir):
    return urls.page_candidates(p.table(spark, sf_dir, "pages"))


@query("""select link, count(*) as pages from (select distinct page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as link from pages) group by link""")
def a14_page_links(spark, sf_dir):
    return urls.page_links(p.table(spark, sf_dir, "pages"))


@query(r"""with x as (select event_id, case event_id % 6 when 0 then '#' || user_id when 1 then user_id || 'B' when 2 then '-' || user_id || 'A' when 3 then user_id || '-' || (user_id + 2) when 4 then user_id || '.5' else event_type end as raw from events),
  y as (select event_id, raw, regexp_replace(raw, '^#', '') as bare from x), e as (select *, case when regexp_matches(bare, '^-?\d+[A-Za-z]*-\d') then 'MULTI_ISSUE_RANGE' when not regexp_matches(bare, '^(-?\d+(?:[./]\d+)?)(?:\.?([A-Za-z][A-Za-z.]*))?$') then 'INVALID_FORMAT' end as error_code from y)
  select event_id, case when error_code is null then regexp_extract(bare, '^(-?\d+(?:[./]\d+)?)(?:\.?([A-Za-z][A-Za-z.]*))?$', 1) end as canonical, case when error_code is null then nullif(regexp_extract(bare, '^(-?\d+(?:[./]\d+)?)(?:\.?([A-Za-z][A-Za-z.]*))?$', 2), '') end as suffix, error_code from e""")  # fmt: skip
def h1_number_grammar(spark, sf_dir):
    e = p.table(spark, sf_dir, "events")
    u, kind = F.col("user_id").cast("string"), F.col("event_id") % 6
    raw = F.when(kind == 0, F.concat(F.lit("#"), u)).when(kind == 1, F.concat(u, F.lit("B"))).when(kind == 2, F.concat(F.lit("-"), u, F.lit("A"))).when(kind == 3, F.concat(u, F.lit("-"), (F.col("user_id") + 2).cast("string"))).when(kind == 4, F.concat(u, F.lit(".5"))).otherwise(F.col("event_type"))
    return e.select("event_id", numbers.parsed(raw).alias("x")).select("event_id", "x.*")
