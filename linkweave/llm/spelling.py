"""Groups of spelling variants: words one edit apart, found by exact signatures of their letters (PartEnum).

A word's letters, with their counts, are a binary vector (letter, k-th
occurrence). One edit changes at most two of its bits. The letters are dealt
into ``first * second`` parts; of each of ``first`` groups of parts, every choice
of all but ``spare`` of its parts is a signature: the letters of the word in those
parts. By the pigeonhole principle words at distance two or less share one.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sparkutil import Stage, partitions, session
from .textkernel import mix

_rng = np.random.default_rng(20240811)
_LETTER = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAG = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_SALT = _rng.integers(1, 1 << 63, 3, dtype=np.uint64)
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = np.uint64(pow(_P, -1, 1 << 64))
#: Distinct words that a task counts before it passes them on.
HELD = 400_000
#: Letters of whole buckets that are compared at once.
CHUNK = 1 << 20
#: Words of more letters are dealt by the rest of ``BLOCKS`` blocks of letters, not of each letter.
LONG, BLOCKS = 64, 32
#: What words of a dealt group have in common: all but one place, all letters without one, all but a block.
HOLE, LESS, BLOCK = range(3)


@dataclass(frozen=True)
class Config:
    """Words count from ``shortest`` code points and ``least`` occurrences on.

    A form has to occur ``ratio`` times as often. Buckets of more than ``bucket``
    words are split by keys of which no group outgrows the alphabet.
    """

    shortest: int = 7
    least: int = 2
    ratio: int = 10
    first: int = 1
    second: int = 4
    bucket: int = 16_384


def count_words(docs: DataFrame, cfg: Config, id_col: str = "doc_id", text_col: str = "text", misspelt: int | None = None) -> DataFrame:
    """``word, n`` of runs of Latin letters, A-Z lower-cased, summed over all texts.

    With ``misspelt`` each run whose crc32 with its document's id is a multiple of
    it loses one code point first. A task's sums are passed on whenever it holds
    ``HELD`` words.
    """
    run = re.compile("[a-zÀ-ÿ]{%d,}" % cfg.shortest)
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                start = zlib.crc32(f"{doc.as_py()}:".encode())
                for word, n in Counter(run.findall(text.as_buffer().to_pybytes().lower().decode())).items():
                    if misspelt:
                        h = zlib.crc32(word.encode(), start)
                        if h % misspelt == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                    if len(word) >= cfg.shortest:
                        total[word] += n
                if len(total) >= HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], schema=schema)
                    total.clear()
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], schema=schema)

    found = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= cfg.least)


class Signatures:
    """The parts that letters are dealt to, and which signatures a part belongs to."""

    def __init__(self, letters: dict[str, int], cfg: Config):
        parts = cfg.first * cfg.second
        load, self.part = [0] * parts, np.zeros(256, np.int64)
        for letter in sorted(letters, key=lambda c: (-letters[c], c)):
            k = load.index(min(load))
            load[k] += letters[letter]
            self.part[ord(letter)] = k
        spare = -(-3 // cfg.first) - 1
        self.chosen = [[g * cfg.second + k for k in picked] for g in range(cfg.first) for picked in itertools.combinations(range(cfg.second), cfg.second - spare)]
        # the first signature that two words share whose letters differ in the parts p and q only
        self.earliest = np.array([[next(s for s, parts in enumerate(self.chosen) if p not in parts and q not in parts) for q in range(parts)] for p in range(parts)])

    def of(self, words: list[str]) -> list[np.ndarray]:
        """Each signature of each word."""
        codes, starts, _ = _letters(words)
        sums = []
        for k in range(self.part.max() + 1 if len(words) else 0):
            sums.append(np.add.reduceat(np.where(self.part[codes] == k, _BAG[codes], np.uint64(0)), starts))
        none = np.zeros(len(words), np.uint64)
        return [mix(sum((sums[p] for p in parts if p < len(sums)), none) + _BAG[s]) for s, parts in enumerate(self.chosen)]


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return codes, np.cumsum(sizes) - sizes, sizes


def _keys(words: list[str], bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per letter of all words: its word, its place, and the keys of the word with a hole there and without it; per word its own key and first letter.

    Words of other buckets never share a key.
    """
    codes, starts, sizes = _letters(words)
    row = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(codes)) - starts[row]
    power = np.full(int(sizes.max()), _P, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    term = _LETTER[codes] * power[at]
    whole = np.add.reduceat(term, starts)
    before = np.cumsum(term) - term
    before -= before[starts][row]
    apart = mix(bucket.astype(np.uint64) + _SALT[0])
    hole = mix(whole[row] - term + at.astype(np.uint64) * _SALT[1] + apart[row])
    less = mix(before + (whole[row] - before - term) * _P_INV + apart[row] + _SALT[2])
    return row, at, hole, less, mix(whole + apart + _SALT[2]), starts


def _same(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places with equal keys; groups are as large as the alphabet at most."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    for step in itertools.count(1):
        hit = np.flatnonzero(ordered[:-step] == ordered[step:]) if step < len(ordered) else np.zeros(0, np.int64)
        if not len(hit):
            return
        yield order[hit], order[hit + step]


NEAR = pa.schema([("word", pa.string()), ("n", pa.int64()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
NEAR_DDL = "word string, n long, n_near long, best_n long, best string"


class _Found:
    """Near words seen so far, and the most frequent of them, per word."""

    def __init__(self):
        self.near: dict[str, list] = {}

    def add(self, a: str, na: int, b: str, nb: int) -> None:
        for x, nx, y, ny in ((a, na, b, nb), (b, nb, a, na)):
            held = self.near.get(x)
            if held is None:
                self.near[x] = [nx, 1, (-ny, y)]
            else:
                held[1] += 1
                held[2] = min(held[2], (-ny, y))

    def batch(self) -> pa.RecordBatch:
        rows = [(w, n, k, -best[0], best[1]) for w, (n, k, best) in self.near.items()]
        self.near = {}
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(NEAR)], schema=NEAR)


def _compare(rows: list[tuple], signatures: Signatures, found: _Found) -> None:
    """Near pairs within the buckets of ``rows`` (bucket, signature, word, n), each in the first bucket it shares."""
    words = [r[2] for r in rows]
    row, at, hole, less, whole, starts = _keys(words, np.fromiter((r[0] for r in rows), np.int64, len(rows)))
    codes, _, _ = _letters(words)
    part, place = signatures.part, np.fromiter((r[1] for r in rows), np.int64, len(rows))

    def emit(x: np.ndarray, y: np.ndarray, i: np.ndarray, replaced: bool) -> None:
        for a, b, k in zip(x.tolist(), y.tolist(), i.tolist(), strict=True):
            s, t = words[a], words[b]
            if (s[:k] == t[:k] and s[k + 1 :] == t[k + 1 :] and s != t) if replaced else (s[:k] + s[k + 1 :] == t):
                found.add(s, rows[a][3], t, rows[b][3])

    for left, right in _same(hole):
        x, y, i = row[left], row[right], at[left]
        p, q = part[codes[left]], part[codes[right]]
        mine = (signatures.earliest[p, q] == place[x]) & (x != y)
        emit(x[mine], y[mine], i[mine], True)
    order = np.argsort(whole, kind="stable")
    spot = np.minimum(np.searchsorted(whole[order], less), len(order) - 1)
    hit = np.flatnonzero(whole[order[spot]] == less)
    x, y, p = row[hit], order[spot[hit]], part[codes[hit]]
    mine = signatures.earliest[p, p] == place[x]
    x, y, i = x[mine], y[mine], at[hit][mine]
    _, once = np.unique(x * len(rows) + y, return_index=True)  # equal letters in a row leave the same word
    emit(x[once], y[once], i[once], False)


def near_words(vocabulary: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Per word of ``vocabulary`` (``word, n``, distinct) with near words: their number and the most frequent, in parts to be summed.

    A word meets others in its buckets only. A bucket is read by one task, up to
    ``cfg.bucket`` words; the words of larger ones are dealt out by their holes
    and by what is left without a letter.
    """
    letters = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c"), "n").where("c <> ''").groupBy("c").count().collect()  # at most the alphabet
    signatures = Signatures({r.c: r["count"] for r in letters}, cfg)
    n = partitions(vocabulary.sparkSession)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            if words:
                for s, values in enumerate(signatures.of(words)):
                    yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(np.full(len(words), s, np.int32)), batch.column(0), batch.column(1)], names=["bucket", "sign", "word", "n"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, found, bucket, first = 0, _Found(), None, 0

        def close() -> None:
            nonlocal size
            if len(held) - first == 1:  # a word alone in its bucket
                size -= len(held.pop()[2])

        for batch in batches:
            for r in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if r[0] != bucket:
                    close()
                    if size >= CHUNK:
                        _compare(held, signatures, found)
                        yield found.batch()
                        held.clear()
                        size = 0
                    bucket, first = r[0], len(held)
                held.append(r)
                size += len(r[2])
        close()
        if held:
            _compare(held, signatures, found)
        yield found.batch()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "kind", "sign", "word", "n", "bucket"]
        for batch in batches:
            words = batch.column(2).to_pylist()
            for first, last in _runs([w if len(w) <= LONG + 1 else "" for w in words]):
                some = [k for k in range(first, last) if len(words[k]) <= LONG + 1]
                if some:
                    part = batch.take(pa.array(some))
                    row, _, hole, less, whole, _ = _keys([words[k] for k in some], part.column(0).to_numpy())
                    key, kind, row = np.concatenate([hole, less, whole]), np.repeat([HOLE, LESS, LESS], [len(row), len(row), len(some)]), np.concatenate([row, row, np.arange(len(some))])
                    _, once = np.unique(np.stack([key.view(np.int64), row]), axis=1, return_index=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key[once].view(np.int64)), pa.array(kind[once].astype(np.int32)), *(part.column(k).take(pa.array(row[once])) for k in (1, 2, 3, 0))], names=names)
            for bucket, sign, word, n in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if len(word) > LONG:
                    keys = [_block_key(word, size, j, bucket) for size in (len(word), len(word) - 1) for j in range(BLOCKS)]
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([BLOCK] * len(keys), pa.int32()), pa.array([sign] * len(keys), pa.int32()), pa.array([word] * len(keys)), pa.array([n] * len(keys), pa.int64()), pa.array([bucket] * len(keys), pa.int64())], names=names)

    def compare_dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, key, group = _Found(), None, []
        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if r[:2] != key:
                    _within(group, signatures, found)
                    if len(found.near) >= HELD:
                        yield found.batch()
                    key, group = r[:2], []
                group.append(r)
        _within(group, signatures, found)
        yield found.batch()

    rows = vocabulary.select("word", "n").mapInArrow(sign, "bucket long, sign int, word string, n long")
    hot = Stage(rows.groupBy("bucket").count().where(F.col("count") > cfg.bucket).select("bucket"), "buckets")
    large = not hot.df.isEmpty()
    cool = rows.join(hot.df, "bucket", "left_anti") if large else rows
    near = cool.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(compare, NEAR_DDL)
    if large:
        dealt = rows.join(hot.df, "bucket", "left_semi").select("bucket", "sign", "word", "n").mapInArrow(deal, "key long, kind int, sign int, word string, n long, bucket long")
        near = near.unionByName(dealt.repartition(n, "key").sortWithinPartitions("key", "kind", "word").mapInArrow(compare_dealt, NEAR_DDL))
    return near


def _runs(words: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of words of about ``CHUNK`` letters together."""
    first = size = 0
    for k, word in enumerate(words):
        size += len(word)
        if size >= CHUNK:
            yield first, k + 1
            first, size = k + 1, 0
    if first < len(words):
        yield first, len(words)


def _block_key(word: str, size: int, j: int, bucket: int) -> int:
    """Key of a long word without the ``j``-th block of ``size`` letters; the rest stands at either end."""
    low, high = size * j // BLOCKS, size * (j + 1) // BLOCKS
    tail = word[len(word) - (size - high) :]
    return int.from_bytes(hashlib.blake2b(f"{bucket} {size} {j} {word[:low]} {tail}".encode(), digest_size=8).digest(), "little", signed=True)


def _within(group: list[tuple], signatures: Signatures, found: _Found) -> None:
    """Near pairs of a dealt group (key, kind, signature, word, n).

    A pair of short words counts where they have one hole in common or the longer
    leaves the shorter; of long ones in the block where they first differ.
    """
    for (key, kind, s, a, na, bucket), (_, _, _, b, nb, _) in itertools.combinations(group, 2):
        if len(a) > len(b):
            a, na, b, nb = b, nb, a, na
        more = len(b) - len(a)
        if more > 1 or (kind == BLOCK) != (len(a) > LONG) or kind == (HOLE if more else LESS):
            continue
        k = len(os.path.commonprefix((a, b)))
        if a[k + 1 - more :] != b[k + 1 :] or k == len(b):
            continue
        p, q = signatures.part[ord(b[k])], signatures.part[ord(b[k] if more else a[k])]
        if signatures.earliest[p, q] == s and (kind != BLOCK or _block_key(a, len(a), next(j for j in range(BLOCKS) if j == BLOCKS - 1 or k < len(a) * (j + 1) // BLOCKS), bucket) == key):
            found.add(a, na, b, nb)


def variants(vocabulary: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Every word of ``vocabulary`` with its form, root, and near words.

    ``vocabulary`` has distinct ``word string`` of the letters a-z and U+00C0 to
    U+00FF, and ``n long``; an empty one gives no rows. Near words differ by one
    inserted, deleted or replaced letter. A word's form is its most frequent near
    word (ties: the least in code-point order) if that occurs ``cfg.ratio`` times
    as often; the root is the end of the chain of forms, the word itself if it
    has none. Counts grow by ``cfg.ratio`` along a chain, so chains are short and
    are followed by doubling, as often as the largest count allows.
    """
    session(vocabulary)
    words = Stage(vocabulary.select("word", "n"), "words")
    alone = words.df.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))))
    met = alone.unionByName(near_words(words.df, cfg)).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b"))
    is_form = -F.col("b.m") >= cfg.ratio * F.col("n")
    found = Stage(met.select("word", "n", "n_near", F.when(is_form, F.col("b.w")).alias("form"), F.when(is_form, -F.col("b.m")).alias("form_n")), "forms")
    top = found.df.agg(F.max("n")).first()[0] or 1
    hops = int(math.log(top, cfg.ratio)) + 1 if cfg.ratio > 1 else top
    ends = found.df.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(hops)))):
        on = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ends = ends.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return found.df.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
