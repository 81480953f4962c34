"""Each operator against a plain version, and on nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import hashlib
import html
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from linkweave.llm import bpe, embedding_dedup, graph, html_extract, language_id, ngram_join, packing, pii, quality, queries, textkernel, toxicity, url_filter

from ..conftest import DATA

ODD = [None, "", "   ", "One.", "a  b\n c\td <|endoftext|> é ﬁ ½ \x1c x", "word " * 30_000, "same text of some words here", "same text of some words here", "Ünïcödé 漢字 кирилл x'll don't  ", "123 +1 (743) 555-3824 a.b@c.de 1.2.3.4 4539 1488 0343 6467"]


@pytest.fixture(scope="module")
def odd(spark):
    """Texts of all odd kinds, a null id, a repeated row, and columns named like results."""
    rows = [(i, t, "en" if i % 2 else None, i, "x") for i, t in enumerate(ODD)] + [(None, "no id", "en", 0, "x"), (3, "One.", "en", 3, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int, row string")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_language_id(spark, odd, documents):
    out = queries.op1_language_id(spark, DATA).collect()
    truth = {r.doc_id: r.lang for r in documents.collect()}
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    prototypes = language_id.train(odd)
    rows = language_id.identify(odd, prototypes).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.doc_id: r.lang_pred for r in rows}[1] == language_id.UNKNOWN
    assert language_id.train(odd.limit(0)) == {} and language_id.identify(odd.limit(0), {}).count() == 0


def plain_components(rows, width, percent):
    sets, low = {}, str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_ngram_join_equals_brute_force(spark, documents, width, percent):
    base = [f"w{i}" for i in range(60)]
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    rows += [(10_000 + k, " ".join([*base[:k], "edit", *base[k + 1 :]])) for k in range(40)]  # near copies of one text
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link(df, ngram_join.Config(width, percent)).collect()}
    assert out == plain_components(rows, width, percent)


def test_ngram_join_odd_rows(spark, odd):
    cfg = ngram_join.Config(4, 85)
    out = ngram_join.link(odd, cfg).collect()
    assert len(out) == odd.count()
    assert {(r.n_shingles, r.component_id) for r in out if r.doc_id in (0, 1)} == {(0, 0), (0, 1)}
    assert [r.component_id for r in out if r.doc_id == 7] == [6] and [r.component_id for r in out if r.doc_id is None] == [None]
    kept = ngram_join.keep_one(odd, cfg)
    assert kept.columns == odd.columns and Counter(r.doc_id for r in kept.collect()) == Counter([None, *(i for i in range(len(ODD)) if i != 7)])
    assert ngram_join.link(odd.limit(0), cfg).count() == 0


def test_components_of_a_path(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901), (5, 5), (None, 3)], "a long, b long")
    found = {r.node: r.component for r in graph.components(df).collect()}
    assert found == {i: 0 for i in range(201)} | {900: 900, 901: 900}


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(999, k) for k in range(400, 440)]  # a hub with the largest id
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    found = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == root


@pytest.mark.parametrize("what", ["filter", "sketch"])
def test_ngram_join_reads_its_blocks_in_few_jobs(spark, documents, what):
    """A job for each partition took minutes where tables are dealt over hundreds."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.sparkContext.setJobGroup(f"blocks of {what}", "")
    try:
        if what == "filter":
            found = ngram_join.may_contain(spark.range(3_000)).value
            assert found.perhaps(np.arange(3_000)).all() and found.perhaps(np.arange(10_000, 20_000)).mean() < 0.05
        else:
            assert ngram_join._sketch(documents.select("text"), ngram_join.Config()).max() > 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.sparkContext._jsc.clearJobGroup()
    assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"blocks of {what}")) < 10


def test_url_filter(spark):
    urls = ["https://A.Example.ORG/es/1?x#y", "http://x.com/fr/a", "http://x.com/de/", "http://x.net/", "ftp://example.org/en/12", "example.org/es/", None, "http://org", "https://sub.example.org/en/2", "http://xorg/", "://org/?a"]
    pages = spark.createDataFrame([(i, u, "v") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, queries.URL_RULES).collect()}
    assert out[0] == ("a.example.org", "/es/1", "example.org/es/", "block") and out[1][2:] == ("com/fr/", "allow") and out[2][2:] == ("com/de/", "block")
    assert out[4][2:] == ("example.org/en/1", "block") and out[5] == ("", "", None, "allow") == out[6] and out[7] == ("org", "", None, "allow") and out[8][2] == "org/" and out[9][2] is None
    rules = spark.createDataFrame(list(queries.URL_RULES), "action string, host string, path string")
    joined = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls_join(pages, rules).collect()}
    assert joined == out and url_filter.filter_urls(pages.limit(0), queries.URL_RULES).count() == 0


def test_bpe_equals_the_library(spark, odd, documents):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for df in (odd, documents.select("doc_id", "text")):
        want = Counter()
        for r in df.collect():
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            want[r.doc_id, len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)] += 1
        assert Counter(tuple(r) for r in bpe.encode_decode(df, path).collect()) == want
    assert bpe.encode_decode(odd.limit(0), path).count() == 0


def test_packing_is_whole_and_tight(spark, odd, documents):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    df = documents.select("doc_id", "text").unionByName(odd.where("doc_id is null or doc_id <> 3").select((odd.doc_id + 1_000_000).alias("doc_id"), "text"))
    out = packing.pack(df, path).collect()
    pieces, sequences, total = {}, {}, 0
    for r in out:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for r in df.collect():
        ids, at = [*library.encode(r.text or "", add_special_tokens=False).ids, packing.END], 0
        total += len(ids)
        for k, x in enumerate(sorted(pieces[r.doc_id], key=lambda x: x.piece)):
            assert (x.piece, x.start, x.ids_crc32) == (k, at, zlib.crc32(np.array(ids[at : at + x.length], "<u4").tobytes())) and (k == 0 or x.length == packing.CAPACITY)
            at += x.length
        assert at == len(ids)
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len(sequences) <= 1.02 * total / packing.CAPACITY + 1
    assert packing.pack(odd.limit(0), path).count() == 0


def test_html(spark):
    pages = ["<html><head><title>T</title><script>if (a<b) x='</p>'</script></head><body><nav><a href=x>Home</a></nav><header>Site</header><div class='ad'>Buy this now, please.</div><article><h1>Head</h1><p>First &amp; long   sentence, with\n words. And more.</p><p><b>Second<br>one.<p>Third.</article><div id='comments'><p>Me too, I say.</p></div><footer>&copy; x</footer>", "<div class=content><p>Only a long paragraph, of a page, without article.</p></div><div class=sidebar><p>Other things, and more, of a side bar.</p></div>", None, "", "<nav>menu</nav>", "<p", "plain text only."]
    df = spark.createDataFrame([(i, None, p, "t") for i, p in enumerate(pages)], "page_id long, url string, html string, text string")
    out = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert out[0] == "Head\nFirst & long sentence, with words. And more.\nSecond one.\nThird." and out[1] == "Only a long paragraph, of a page, without article."
    assert out[2] == out[3] == out[4] == "" and out[6] == "plain text only."
    real = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    for r, text in zip(real, (html_extract.main_text(r.html) for r in real), strict=True):
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        assert text.split() == html.unescape(re.sub(r"<[^>]+>", " ", article)).split()


def test_html_article_elements_do_not_decide_alone():
    long = "A long sentence of the story, with commas, and more of it. It goes on, and on, for some time." * 3
    card = "<article><h3>Teaser</h3><p>Short words, of a card.</p></article>"
    story = f"<p>{long}</p>" * 4
    want = "\n".join([long] * 4)
    assert html_extract.main_text(f"<body><div class=story>{story}</div><div class=cards>{card * 3}</div></body>") == want
    assert html_extract.main_text(f"<body>{card * 2}<article>{story}</article>{card}</body>") == want
    assert html_extract.main_text(f"<body><main><ul>{'<li>Print' * 12}</ul><div>{story}</div><ol>{'<li>Go up' * 12}</ol></main></body>") == want


def test_html_wrappers_and_links_keep_the_article():
    story = "<p>A long sentence of the story, with commas, and more of it. It goes on, and on, for some time.</p>" * 4
    want = html_extract.main_text(f"<body><article>{story}</article></body>")
    assert len(want.split("\n")) == 4
    side = "<div class=sidebar><p>Other things, and more, of a side bar.</p></div>"
    for wrapper in ("div class=content-with-sidebar", "div class='no-sidebar overflow-hidden'", "div id=elementor-widget-theme-post-content", "form"):
        end = wrapper.split()[0]
        for inner in (story, f"<article>{story}</article>"):
            assert html_extract.main_text(f"<body><{wrapper}>{inner}{side}</{end}>{side}</body>") == want
    assert html_extract.main_text(f"<body><div class=no-sidebar><article>{story}</article></div><div id=comments><article class=comment><p>Me too, I say, and more.</p></article></div></body>") == want
    linked = "<h1><a href=x>Title</a></h1>"
    assert html_extract.main_text(f"<body><article>{linked}{story}<p><a href=y>Read the source, in full.</a></article></body>") == f"Title\n{want}\nRead the source, in full."


def test_toxicity(spark, odd, documents):
    bad, good = "you are a vile zork today", "you are a fine friend today"
    rows = [(i, f"{bad if i % 3 == 0 else good} number {i}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(0, 600, 2)] + [(None, 1), (1, None)], "doc_id long, label int")
    out = toxicity.score(df, toxicity.train(df, labels)).collect()
    assert all(r.predicted == int(r.doc_id % 3 == 0) for r in out)
    none = toxicity.train(odd, labels.limit(0))
    assert {r.predicted for r in toxicity.score(odd, none).collect()} == {0} and toxicity.score(odd.limit(0), none).count() == 0
    assert toxicity.score(odd, none, rows=True).select("row.*").columns == odd.columns


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((400, 16))
    for k in range(60):
        v[300 + k] = v[k] + rng.normal(0, 0.02, 16)
    v[380:400] = v[5]
    rows = [(i, [float(x) for x in np.float32(a)], i % 2 if i < 300 else (i - 300) % 2 if i < 380 else 1) for i, a in enumerate(v)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, rows[0][1], None), (904, [], 0), (905, [1.0, None], 0), (906, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.link(df).collect()}
    u = np.array([r[1] for r in rows[:400]])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows[:400]])
    near = (u @ u.T >= 0.98) & (label[:, None] == label[None, :]) & ~np.eye(400, dtype=bool)
    assert [out[i][0] for i in range(400)] == near.sum(1).tolist()
    root = list(range(400))
    for _ in range(400):
        new = [min([root[i], *(root[j] for j in np.flatnonzero(near[i]))]) for i in range(400)]
        if new == root:
            break
        root = new
    assert [out[i][1:] for i in range(400)] == [(root[i], root[i] == i) for i in range(400)]
    assert all(out[i] == (0, i, True) for i in range(900, 907))
    assert embedding_dedup.link(df.limit(0)).count() == 0


def test_embeddings_repeated_rows_and_labels_of_text(spark):
    rows = [(1, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (2, [2.0, 0.0], "a"), (3, [1.0, 0.0], "b"), (4, [0.0, 1.0], "a"), (1, [0.0, 1.0], "a"), (None, [1.0, 0.0], "a"), (5, [1.0, 0.0], None)]
    out = embedding_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    assert Counter(tuple(r) for r in out) == Counter({(1, 2, 1, True): 3, (2, 1, 1, False): 1, (3, 0, 3, True): 1, (4, 1, 1, False): 1, (None, 0, None, False): 1, (5, 0, 5, True): 1})


def linked_rows(rows, least=0.98):
    """Links of every row by comparing all distinct rows: per id their sum, and the smallest id reachable."""
    distinct = sorted(set(rows))
    unit = [np.array(v) / np.linalg.norm(v) for _, v, _ in distinct]
    near = [[i != j and distinct[i][2] == distinct[j][2] and unit[i] @ unit[j] >= least for j in range(len(distinct))] for i in range(len(distinct))]
    total, root = Counter(), {r[0]: r[0] for r in rows}
    for i, r in enumerate(distinct):
        total[r[0]] += sum(near[i])
    for _ in distinct:
        for i, r in enumerate(distinct):
            for j, other in enumerate(distinct):
                if near[i][j]:
                    root[r[0]] = root[other[0]] = min(root[r[0]], root[other[0]])
    return {i: (total[i], root[i], root[i] == i) for i in root}


@pytest.mark.parametrize("case", ["different vectors", "two labels", "random"])
def test_embeddings_of_repeated_ids_equal_brute_force(spark, case):
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((12, 6))
    rows = {
        "different vectors": [(1, (1.0, 0.0), 1), (1, (0.0, 1.0), 1), (2, (1.0, 0.02), 1)],
        "two labels": [(1, (1.0, 0.5), 1), (1, (1.0, 0.5), 2), (2, (1.0, 0.51), 1), (3, (1.0, 0.51), 2)],
        "random": [(int(rng.integers(60)), tuple((centres[rng.integers(12)] + rng.choice([0, 0.1]) * rng.standard_normal(6)).tolist()), int(rng.integers(2))) for _ in range(160)],
    }[case]
    df = spark.createDataFrame([(i, list(v), label) for i, v, label in rows], "vec_id long, embedding array<double>, label int")
    out = embedding_dedup.link(df).collect()
    assert len(out) == len(rows) and {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out} == linked_rows(rows)


def planted(rng, v, at, apart):
    """Copies of the rows ``at`` of ``v``, each turned by the same small angle."""
    u = v[at] / np.linalg.norm(v[at], axis=1, keepdims=True)
    side = rng.standard_normal(u.shape)
    side -= (side * u).sum(1, keepdims=True) * u
    return u + apart * side / np.linalg.norm(side, axis=1, keepdims=True)


def links_found(spark, vectors, pairs):
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    out = {r.vec_id: r for r in embedding_dedup.link(df).collect()}
    assert len(out) == len(vectors)
    return sum(out[a].component_id == out[b].component_id and out[b].n_links > 0 for a, b in pairs)


def test_embeddings_of_mixed_dimensions(spark):
    rng = np.random.default_rng(5)
    v, w = rng.standard_normal((8000, 24)), rng.standard_normal((2000, 32))
    rows = [*v, *planted(rng, v, np.arange(30), 0.15), *w, *planted(rng, w, np.arange(10), 0.15), rng.standard_normal(40)]
    pairs = [(k, 8000 + k) for k in range(30)] + [(8030 + k, 10030 + k) for k in range(10)]
    assert links_found(spark, rows, pairs) >= 39


def test_embeddings_find_rare_links_in_a_cone(spark):
    rng = np.random.default_rng(7)
    v = rng.standard_normal((15_000, 24))
    v[:6000] = 0.42 * rng.standard_normal((6000, 24)) + rng.standard_normal(24)
    pairs = [(k, 15_000 + k) for k in range(30)]
    rows = [*v, *planted(rng, v, np.arange(30), 0.1)]
    assert links_found(spark, rows, pairs) >= 29


def test_embeddings_missing_links_are_an_error(spark, monkeypatch):
    rng = np.random.default_rng(9)
    v = rng.standard_normal((300, 16))
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate([*v, *planted(rng, v, np.arange(300), 0.1)])], "vec_id long, embedding array<double>, label int")
    import pyarrow as pa

    monkeypatch.setattr(embedding_dedup, "MOST", 1)
    monkeypatch.setattr(embedding_dedup, "_groups", lambda k: lambda table: pa.Table.from_pylist([], embedding_dedup._EDGE))
    with pytest.raises(RuntimeError, match="links are missing after 1 attempts: 0 of"):
        embedding_dedup.link(df)


RULES = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(text):
    """The base rules as they are stated."""
    found = []
    for k, rule in enumerate(RULES):
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = sum(int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(reversed(digits)))
            if (True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 12 <= len(digits) <= 19 and doubled % 10 == 0, 9 <= len(digits) <= 15)[k]:
                found.append((m.start(), m.end(), k))
    return sorted(found, key=lambda s: (s[0], s[2]))


def test_pii_rules_equal_the_stated_ones(documents):
    rng = np.random.default_rng(1)
    for signs in ("a.@_-1", "12.", "0 1-2+(). @a.b", "a@.-_ b+%"):
        for _ in range(5_000):
            text = "".join(rng.choice(list(signs), rng.integers(0, 40)))
            assert pii.rule_spans(text) == plain_spans(text)
    for r in documents.collect():
        assert pii.rule_spans(r.text) == plain_spans(r.text)


def test_pii_rules_read_long_runs_once():
    start = time.time()
    for text in ("0" * 5000 + ".1.1.1", "1" * 1_000_000, "a" * 1_000_000 + " @ 1", "+1(" * 300_000, "a@" * 300_000, "1.1.1 " * 200_000, "+1" + "(" * 500_000):
        pii.rule_spans(text)
    assert pii.rule_spans("0" * 5000 + ".1.1.1") == [(0, 5006, 1)] and time.time() - start < 20


def test_pii_model_adds_spans_that_no_rule_has(spark):
    docs = spark.read.parquet(DATA.replace("0.001", "0.01") + "/documents.parquet").select("doc_id", "text").collect()
    seen, unseen = [r.text for r in docs if r.doc_id % 2], [r.text for r in docs if r.doc_id % 2 == 0]
    model = pii.train(spark.createDataFrame([(i, t) for i, t in enumerate(seen)], "doc_id long, text string"))
    made, want = [], []
    prose = [t for t in unseen if not pii.rule_spans(t)]
    values = [(t[a:b], k) for t in unseen for a, b, k in pii.rule_spans(t)]
    for i, (value, kind) in enumerate(values):
        for form in range(len(pii.FORMS[kind])):
            new, around = pii.rewritten(value, kind, form), prose[i % len(prose)][:300]
            made.append(f"{around[:40]} {new} {around[40:]}")
            want.append((len(around[:40]) + 1, len(around[:40]) + 1 + len(new), kind))
    found = pii.find_spans(made, model)
    assert sum(w in spans and w not in base for w, (base, spans) in zip(want, found, strict=True)) >= 0.5 * len(want)
    extra = sum(len(spans) - len(base) for base, spans in pii.find_spans(prose, model))
    assert extra <= 0.02 * len(prose)


def test_pii_reads_stretches_across_windows_and_sections(monkeypatch):
    """Sections and windows give the spans of one path over the whole stretch."""
    p = {k: v for k, v in pii.initial().items()}
    p["c"] = np.array([1.0] + [0.2] * (pii.TAGS - 1), np.float32)
    rng = np.random.default_rng(4)
    e = rng.normal(0, 1.5, (3000, pii.TAGS)).astype(np.float32)
    e[:, 0] += 3
    trans = np.where(pii._FORBIDDEN, pii._NO, p["t"])
    path = pii.viterbi(e[:, None, :], trans)[:, 0]
    whole = [i for i in np.flatnonzero(path % 2 == 1).tolist()]
    assert [a for a, _, _ in sorted(pii.paths(p, [e])[0])] == whole and whole


def test_pii(spark, odd, documents):
    text = ODD[-1]
    assert [(text[a:b], pii.KINDS[k]) for a, b, k in pii.rule_spans(text)][0] == ("+1 (743) 555-3824", "phone")
    assert pii.luhn("4539148803436467") and not pii.luhn("4539148803436468")
    model = pii.train(documents)
    for model_ in (model, None):
        for r, x in zip(odd.collect(), pii.find(odd, model_).collect(), strict=True):
            base = pii.spell(plain_spans(r.text or ""))
            assert x.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and set(filter(None, base.split(","))) <= set(x.spans.split(","))
    p = {k: v.astype(float) for k, v in pii.initial().items()}
    x, y = np.random.default_rng(0).integers(1, 22, (6, 2)), np.zeros((6, 2), int)
    y[1:4, 0] = [3, 4, 4]
    _, g = pii.gradients(p, x, y)
    for k, w in p.items():
        at = np.unravel_index(np.abs(g[k]).argmax(), w.shape)
        keep, step = w[at], 1e-3
        w[at] = keep + step
        high, _ = pii.gradients(p, x, y)
        w[at] = keep - step
        low, _ = pii.gradients(p, x, y)
        w[at] = keep
        assert g[k][at] == pytest.approx((high - low) / (2 * step), rel=1e-2)
    assert pii.redact("a b@c.de d", [(2, 8, 0)]) == "a [EMAIL] d" and pii.train(odd.limit(0)) is None


def test_quality(spark, odd, documents):
    out = {r.doc_id: r for r in queries.op10_quality(spark, DATA).collect()}
    for r in documents.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = Counter(x for x in r.text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x))
        x = out[r.doc_id]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text)), sum(lines.values()) - len(lines), len(cover))
        assert x.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w)) and not (x.base_failed and x.kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    clean = [out[i] for i, q in labels.items() if q == 1 and not out[i].base_failed]
    assert sum(r.kept for r in clean) >= 0.97 * len(clean)
    ratios = quality.fit(odd, odd.limit(0).select("doc_id"))
    assert quality.judge(odd, ratios).count() == odd.count() and quality.judge(odd.limit(0), ratios).count() == 0


def test_quality_counts_every_trusted_text(spark):
    docs = spark.createDataFrame([(i, f"text number {i} of a few words") for i in range(40)], "doc_id long, text string")
    many = quality.fit(docs, spark.range(0, 60_000, 2).withColumnRenamed("id", "doc_id"))
    few = quality.fit(docs, spark.range(0, 40, 2).withColumnRenamed("id", "doc_id"))
    assert (many == few).all() and many.any()


def test_pipeline(spark, documents):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, DATA).collect()
    assert 0 < len({r.doc_id for r in out}) < documents.count() and {r.doc_id for r in out} <= {r.doc_id for r in documents.collect()}


def test_word_hashes_do_not_depend_on_the_batch():
    import pyarrow as pa

    one = next(textkernel.words(pa.array(["b a"]))).hashes
    two = next(textkernel.words(pa.array(["x", None, "", "c b a"])))
    assert list(two.hashes[two.of(3)][1:]) == list(one)


def test_quality_shuffles_only_texts_that_may_be_trusted(spark, monkeypatch):
    docs = spark.range(4000).selectExpr("id doc_id", "concat('some text of number ', id) text")
    seen = []
    plain = quality._summed
    monkeypatch.setattr(quality, "_summed", lambda texts: (seen.append((texts.count(), texts._jdf.queryExecution().executedPlan().toString())), plain(texts))[1])
    trusted = spark.range(0, 4000, 8).withColumnRenamed("id", "doc_id")
    ratios = quality.fit(docs, trusted.unionByName(trusted))
    (every, whole), (good, joined) = seen
    assert (every, good) == (4000, 500) and "Join" not in whole and "SortMergeJoin" in joined and joined.count("MapInArrow") == 1
    one = spark.range(1).selectExpr("id doc_id", "'abcd' text")
    assert ratios.any() and not quality.fit(docs, one.where("text is null").select("doc_id")).any() and np.isfinite(quality.fit(docs, one.select("doc_id"))).all()
