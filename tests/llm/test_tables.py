"""Merkle manifest, spelling variants and substring dedup against plain versions, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from linkweave.llm import merkle, queries, spelling, substring_dedup

from ..conftest import DATA
from ..test_queries import plain

LOWER = str.maketrans(queries.ASCII_UPPER, queries.ASCII_LOWER)


@pytest.mark.parametrize("name", [n for n in ("op11_merkle", "op12_spelling", "op13_substring_dedup") if n in queries.ORACLES])
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    found = duck.execute(queries.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    want = [dict(zip(names, r, strict=True)) for r in found.fetchall()]
    assert plain([r.asDict() for r in df.collect()], sorted(names)) == plain(want, sorted(names))


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_manifest(rows):
    """Leaf, subroot, root, proof, folded root of each row, by hashing whole runs."""

    def leaf(r):
        return h("".join("-" if r[c] is None else f"{len(str(r[c]).encode())}:{r[c]}" for c in ("doc_id", "source", "lang", "n_chars", "text")))

    def levels(nodes):
        found = [nodes]
        while len(nodes) > 1:
            nodes = [h("".join(nodes[k : k + 8])) for k in range(0, len(nodes), 8)]
            found.append(nodes)
        return found

    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append(r)
    keys = sorted(trees, key=lambda lang: b"" if lang is None else b"=" + lang.encode())
    grown = {}
    for key in keys:
        trees[key].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        grown[key] = levels([leaf(r) for r in trees[key]])
    crown, found = levels([grown[k][-1][0] for k in keys]), Counter()
    for place, key in enumerate(keys):
        for i, r in enumerate(trees[key]):
            node, proof = grown[key][0][i], []
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                node = leaf({**r, "text": None if r["text"] is None else r["text"].translate(LOWER)})
            for tree, at in ((grown[key], i), (crown, place)):
                for nodes in tree[:-1]:
                    run, slot = nodes[at // 8 * 8 : at // 8 * 8 + 8], at % 8
                    proof += run[:slot] + run[slot + 1 :]
                    node, at = h("".join([*run[:slot], node, *run[slot + 1 :]])), at // 8
            found[r["doc_id"], grown[key][0][i], grown[key][-1][0], crown[-1][0], h("".join(proof)), node, node == crown[-1][0]] += 1
    return found


def test_merkle_equals_whole_hashing(spark):
    made = queries.op11_merkle(spark, DATA).collect()
    rows = [r.asDict() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert Counter(map(tuple, made)) == plain_manifest(rows)


@pytest.mark.parametrize("height", [1, 2, 3])
def test_merkle_odd_rows(spark, height):
    """Null in every column, null and empty groups, ties, repeated rows, columns named like results."""
    langs = (None, "", "Ä", "en", "en")
    rows = [(i, None if i % 7 == 0 else f"S{i}", langs[i % 5] if i % 11 else f"x{i}", None if i % 6 == 0 else i, None if i % 4 == 0 else f"TeXt é {i}" * (i % 3), 7) for i in range(300)]
    rows += [(None, "a", None, 1, "T", 2)] * 3 + [(5, "a", "en", 1, "T", 2)] * 20
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string, leaf int")
    lowered = {"text": F.translate("text", queries.ASCII_UPPER, queries.ASCII_LOWER)}
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0
    made = merkle.manifest(df, changed=lowered, when=tampered, height=height).collect()
    assert Counter(map(tuple, made)) == plain_manifest([r.asDict() for r in df.collect()])
    assert merkle.manifest(df.limit(0), height=height).count() == 0
    lone = merkle.manifest(df.where("doc_id = 1"), height=height).first()
    assert lone.leaf == lone.subroot == lone.root == lone.folded_root and lone.verified and lone.proof_sha256 == h("")


def test_merkle_folding_reads_right_siblings_only():
    children = [bytes([k]) * 32 for k in range(8)]
    run = merkle.Run(children)
    for slot in range(8):
        new = children[:slot] + [b"n" * 32] + children[slot + 1 :]
        assert run.fold(slot, b"n" * 32) == merkle.Run(new).digest and len(run.tails[slot]) == 64 * (7 - slot)


def plain_variants(words, ratio=10):
    """Every word's form, root, near words; words that share a hole or leave one another."""
    holes, near, form = {}, {w: set() for w in words}, {}
    for w in words:
        for i in range(len(w)):
            holes.setdefault((i, w[:i] + w[i + 1 :]), []).append(w)
            if w[:i] + w[i + 1 :] in near:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
    for group in holes.values():
        for a in group:
            near[a].update(b for b in group if b != a)
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= ratio * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), words[w], len(near[w]), words[form[w]] if w in form else None) for w in words}


def plain_words(rows):
    total = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOWER)
            k = zlib.crc32(f"{doc}:{word}".encode())
            if k % 31 == 0:
                word = word[: k % len(word)] + word[k % len(word) + 1 :]
            total[word] += 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}


def collected(df):
    rows = df.collect()
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(found) == len(rows)
    return found


def test_spelling_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    found = collected(queries.op12_spelling(spark, DATA))
    assert found == plain_variants(plain_words(rows)) and any(r[0] for r in found.values())


@pytest.mark.parametrize("cfg", [spelling.Config(), spelling.Config(bucket=20), spelling.Config(first=2, second=3), spelling.Config(first=3, second=1, bucket=5)])
def test_spelling_crowded_buckets_chains_and_long_words(spark, cfg):
    rnd = random.Random(1)
    words = {"".join(rnd.choice("abé") for _ in range(rnd.randint(7, 9))): rnd.choice([2, 2, 3, 20, 200, 30, 300, 3000]) for _ in range(2000)}
    words |= {"a" * k: 2 * 10 ** (k - 7) for k in range(7, 14)}  # a chain of forms
    words |= {"v" * 64 + "w" * k: 2 * 10**k for k in range(4)}  # around the bound for long words
    words |= {"v" * k + "x" + "v" * (70 - k): 5 for k in range(0, 70, 7)}
    words |= {"xyz" * 500 + "q" * k: 5 * 20**k for k in range(3)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert collected(spelling.variants(df, cfg)) == plain_variants(words)
    assert spelling.variants(df.limit(0), cfg).count() == 0


def test_spelling_odd_rows(spark):
    """Nulls, empty and long texts, runs of other letters, a null id, clashing columns."""
    rows = [(1, None, "x"), (2, "", "x"), (3, "ÀÉÎÕÜßÿ×÷ Kirschkuchen кириллица", "x"), (3, "ÀÉÎÕÜßÿ×÷ KIRSCHKUCHEN", "x"), (None, "kirschkuchen kirschkucheN", "x"), (4, "Kirschküchen " * 50_000, "x"), (5, "z" * 300_000, "x"), (6, "z" * 300_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string")
    want = plain_words(rows_of(df))
    got = {r.word: r.n for r in spelling.count_words(df, spelling.Config(), misspelt=31).collect()}
    assert got == want
    assert spelling.count_words(df.limit(0), spelling.Config()).count() == 0


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def plain_removal(rows, length=50):
    first, found = {}, Counter()
    docs = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    for d, w in docs:
        for i in range(len(w) - length + 1 if d is not None else 0):
            key = tuple(w[i : i + length])
            first[key] = min(first.get(key, d), d)
    for d, w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1 if d is not None else 0):
            if first[tuple(w[i : i + length])] < d:
                gone[i : i + length] = [True] * length
        found[d, len(w), sum(gone), h(" ".join(x for x, g in zip(w, gone, strict=True) if not g))] += 1
    return found


def test_substring_dedup_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    made = Counter(map(tuple, queries.op13_substring_dedup(spark, DATA).collect()))
    assert made == plain_removal(rows_of(docs)) and any(r[2] for r in made)


@pytest.mark.parametrize("seed", [4, 16, 50])
def test_substring_dedup_passages_and_odd_rows(spark, seed):
    """Passages cut at both ends and edited, repeated and null ids, texts of one repeated word, empty and long ones."""
    rnd = random.Random(3)
    passages = [[f"p{j}w{i}" for i in range(rnd.randint(40, 150))] for j in range(8)]
    rows = []
    for d in range(150):
        w = []
        for _ in range(rnd.randint(0, 5)):
            w += [f"r{rnd.randint(0, 20000)}" for _ in range(rnd.randint(0, 30))]
            p = rnd.choice(passages)
            p = p[rnd.randint(0, 20) : len(p) - rnd.randint(0, 20)]
            if rnd.random() < 0.3:
                p[rnd.randrange(len(p))] = "edit"
            w += p
        rows.append((d if rnd.random() < 0.9 else rnd.choice([None, 3, 7]), " ".join(w)))
    rows += [(500 + k, "same word " * 100) for k in range(4)] + [(600, None), (601, ""), (602, " \t\n "), (7, "one"), (7, "one"), (700, "long\x0btext é " * 40_000), (701, "long\x0btext é " * 60)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, row string, n_words int")
    made = substring_dedup.remove(df, substring_dedup.Config(seed=seed))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in made.collect()) == plain_removal(rows)
    whole = substring_dedup.remove(df, rows=True).where("doc_id = 503").first()
    assert whole.kept == "" and whole.row.text == "same word " * 100 and whole.row.n_words == 1
    assert substring_dedup.remove(df.limit(0)).count() == 0


def test_every_window_has_an_anchor_and_equal_windows_the_same():
    import numpy as np

    rnd = np.random.default_rng(5)
    words = rnd.integers(0, 3, 400).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    cfg = substring_dedup.Config(length=20, seed=5)
    owner, start, m, anchor, _ = substring_dedup.spans(words, np.array([0, 150, 150, 400]), cfg)
    seen = {}
    for r, s, n, a in zip(owner, start, m, anchor, strict=True):
        for k in range(n):
            window = tuple(words[[0, 150, 150][r] + s + k :][:20].tolist())
            assert seen.setdefault(window, a) == a
    assert m.sum() == (150 - 19) + (250 - 19)


def test_html_of_hostile_pages_takes_linear_time():
    import time

    from linkweave.llm import html_extract

    start = time.time()
    for page in ("<b>" * 50_000 + "</i>" * 50_000, "<p>x</b>" * 50_000, "<div>text " * 20_000, "</div>" * 50_000):
        html_extract.main_text(page)
    assert time.time() - start < 20
