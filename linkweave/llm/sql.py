"""DuckDB SQL of the operators on whole tables; written from their contracts, not from their methods."""

from __future__ import annotations

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: One row: the 256 remainders of the CRC-32 polynomial.
CRC_TABLE = "crc_table as (select list_transform(range(256), lambda i: list_reduce(range(8), lambda x, k: xor(x >> 1, case when x % 2 = 1 then 3988292384 else 0 end), i)) as tab)"


def crc32(codes: str) -> str:
    """Unsigned CRC-32 of a list of bytes."""
    return f"xor(list_reduce({codes}, lambda c, b: xor(c >> 8, tab[xor(c, b) % 256 + 1]), 4294967295::bigint), 4294967295::bigint)"


def _codes(text: str) -> str:
    """UTF-8 bytes of text below U+0100, as a list."""
    return f"flatten(list_transform(string_split({text}, ''), lambda c: case when ord(c) < 128 then [ord(c)::bigint] when ord(c) < 192 then [194::bigint, ord(c)::bigint] else [195::bigint, ord(c) - 64::bigint] end))"


def merkle(levels: int = 8, crown: int = 4) -> str:
    """Trees of up to ``8 ** levels`` leaves a language and ``8 ** crown`` languages."""
    value = "coalesce(octet_length(encode({0}))::varchar || ':' || {0}, '-')"
    fields = [value.format(c) for c in ("doc_id::varchar", "source", "lang", "n_chars::varchar")]
    ctes = [
        CRC_TABLE,
        f"""docs as (select doc_id, coalesce('=' || lang, '-') as tree, sha256({" || ".join([*fields, value.format("text")])}) as leaf,
          case when {crc32(_codes("doc_id::varchar"))} % 3 = 0 then sha256({" || ".join([*fields, value.format(LOWER.format("text"))])}) end as changed from documents cross join crc_table)""",
        "placed as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos from docs)",
        "up0 as (select tree, pos, leaf as node from placed)",
        "down0 as (select doc_id, tree, leaf, pos, coalesce(changed, leaf) as node, '' as proof from placed)",
    ]
    for stem, depth in (("", levels), ("c", crown)):
        up, down = f"up{stem}", f"down{stem}"
        if stem:
            ctes += [
                f"upc0 as (select '' as tree, row_number() over (order by encode(tree)) - 1 as pos, node, tree as of from up{levels})",
                f"downc0 as (select d.doc_id, '' as tree, d.leaf, u.pos, d.node, d.proof, u.node as subroot from down{levels} d join upc0 u on u.of = d.tree)",
            ]
        kept = ", subroot" if stem else ""
        for k in range(depth):
            ctes += [
                f"runs{stem}{k} as (select tree, pos // 8 as run, list(node order by pos) as nodes, max(size) as size from (select *, count(*) over (partition by tree) as size from {up}{k}) group by all)",
                f"{up}{k + 1} as (select tree, run as pos, case when size > 1 then sha256(array_to_string(nodes, '')) else nodes[1] end as node from runs{stem}{k})",
                f"""{down}{k + 1} as (select doc_id, d.tree, leaf, pos // 8 as pos, case when size > 1 then sha256(array_to_string(nodes[:pos % 8], '') || node || array_to_string(nodes[pos % 8 + 2:], '')) else node end as node,
                  proof || array_to_string(nodes[:pos % 8], '') || array_to_string(nodes[pos % 8 + 2:], '') as proof{kept} from {down}{k} d join runs{stem}{k} r on r.tree = d.tree and r.run = d.pos // 8)""",
            ]
    return f"""with {", ".join(ctes)} select doc_id, leaf, subroot, u.node as root, sha256(proof) as proof_sha256, d.node as folded_root, d.node = u.node as verified from downc{crown} d join upc{crown} u on true"""


_WORDS = rf"""{CRC_TABLE},
runs as (select doc_id, unnest(regexp_extract_all({LOWER.format("text")}, '[a-zÀ-ÿ]+')) as word from documents),
counted as (select doc_id, word, count(*) as n from runs where length(word) >= 7 group by all),
hashed as (select word, n, {crc32(_codes("doc_id::varchar || ':' || word"))} as h from counted cross join crc_table),
spelt as (select case when h % 31 = 0 then substr(word, 1, (h % length(word))::bigint) || substr(word, (h % length(word) + 2)::bigint) else word end as word, n from hashed),
words as (select word, sum(n)::bigint as n from spelt where length(word) >= 7 group by word having sum(n) >= 2)"""

SPELLING = rf"""with recursive {_WORDS},
less as (select word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as k from words)),
near as (
  select a.word, b.word as other, b.n as other_n from less a join less b on a.k = b.k and a.rest = b.rest and a.word <> b.word
  union select l.word, w.word, w.n from less l join words w on w.word = l.rest
  union select w.word, l.word, l.n from less l join words w on w.word = l.rest),
best as (select word, count(*) as n_near, arg_min(other, row(-other_n, encode(other))) as other, max(other_n) as other_n from near group by word),
forms as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when other_n >= 10 * w.n then other end as form, case when other_n >= 10 * w.n then other_n end as form_n from words w left join best b on b.word = w.word),
chain as (select word, word as root from forms union all select c.word, f.form from chain c join forms f on f.word = c.root where f.form is not null),
ends as (select c.word, c.root from chain c join forms f on f.word = c.root where f.form is null)
select f.word, f.form, e.root, f.n, f.n_near, f.form_n from forms f join ends e on e.word = f.word"""

SUBSTRING = r"""with split as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (select r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as h from (select r, doc_id, w, unnest(range(1, len(w) - 48)) as i from split)),
least as (select h, min(doc_id) as first from windows group by h having min(doc_id) < max(doc_id)),
gone as (select distinct r, unnest(range(i, i + 50)) as k from windows join least using (h) where first < doc_id),
words as (select r, unnest(w) as x, unnest(range(1, len(w) + 1)) as k from split),
kept as (select r, count(*) as n, string_agg(x, ' ' order by k) as t from words anti join gone using (r, k) group by r)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from split left join kept using (r)"""
