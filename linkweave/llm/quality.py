"""Quality rules: line and word statistics, and a log-likelihood ratio of hashed n-grams.

The model compares two multinomials over hashed character n-grams: one of
trusted texts, one of the raw corpus. A text's score is the mean, over its
n-grams, of log(p_trusted / p_raw); texts below a fixed threshold are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngram_join import may_contain
from .sparkutil import columns, named, output, session, sum_blocks, whole_rows
from .textkernel import EXACT, NON_SPACE, mix, shingles, utf8, words

#: Bytes to an n-gram and hashed n-grams (2**BITS counters for each multinomial).
GRAM, BITS = 4, 16
#: Pseudo-counts of each hashed n-gram, relative to uniform, in n-grams in all.
SMOOTH = float(1 << BITS)
#: Least mean log-likelihood ratio of a kept text.
THRESHOLD = -0.5
MIN_WORDS, MAX_REPEAT, WINDOW = 20, 30, 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def grams(raw: np.ndarray) -> np.ndarray:
    """Hashed n-grams of a text's bytes; a shorter text is one n-gram."""
    if not len(raw):
        return np.zeros(0, np.int64)
    width, total = min(GRAM, len(raw)), None
    wide = raw.astype(np.uint64)
    for k in range(width):
        part = (wide[k : len(raw) - width + 1 + k] + np.uint64(1)) * _FACTORS[k]
        total = part if total is None else total + part
    return (mix(total) >> np.uint64(64 - BITS)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << BITS, np.int64)
    for batch in batches:
        raw, at = utf8(batch.column(0))
        for i in range(len(at) - 1):
            n = np.bincount(grams(raw[at[i] : at[i + 1]]), minlength=0)
            total[: len(n)] += n
    yield pa.RecordBatch.from_pydict({"key": pa.array(["all"]), "block": pa.array([total.tobytes()], pa.binary())})


def _summed(texts: DataFrame) -> np.ndarray:
    """How often each hashed n-gram occurs in the column ``text``."""
    found = sum_blocks(texts.where("text is not null").select("text").mapInArrow(_counts, "key string, block binary")).collect()  # one row
    return sum((np.frombuffer(r.block, np.int64).astype(float) for r in found), np.zeros(1 << BITS))


def fit(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Log ratio of each hashed n-gram.

    Raw counts cover every text of ``docs``. Trusted texts are those whose id is
    in ``trusted_ids`` (column ``doc_id``); all of them count. Only texts that a
    Bloom filter of the ids lets through are shuffled to meet the ids.
    Without any trusted text, or any text, all ratios are 0.
    """
    session(docs)
    ids = trusted_ids.where("doc_id is not null").select(F.col("doc_id").alias("__id")).distinct()
    wanted = may_contain(ids.select(F.xxhash64("__id").alias("id")))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = wanted.value.perhaps(batch.column(0).to_numpy(zero_copy_only=False))
            yield batch.select([1, 2]).filter(pa.array(hit))

    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    known = texts.where("__id is not null and text is not null").withColumn("__id", F.col("__id").cast(ids.schema["__id"].dataType))
    perhaps = known.select(F.xxhash64("__id").alias("hash"), "__id", "text").mapInArrow(pick, known.schema)
    raw, good = _summed(texts), _summed(perhaps.join(ids.hint("merge"), "__id"))
    wanted.destroy()
    if not good.any():
        return np.zeros(1 << BITS, np.float32)
    share = SMOOTH / (1 << BITS)
    return (np.log((good + share) / (good.sum() + SMOOTH)) - np.log((raw + share) / (raw.sum() + SMOOTH))).astype(np.float32)


def _line_copies(raw: bytes) -> int:
    seen: set[bytes] = set()
    n = 0
    for line in raw.split(b"\n"):
        if line.strip(b" \t\r\x0b\x0c"):
            n += line in seen
            seen.add(line)
    return n


def _repeated(hashes: np.ndarray) -> int:
    """Words that lie in a window of WINDOW words that the text has twice or more."""
    if len(hashes) < WINDOW:
        return 0
    _, inverse, n = np.unique(shingles(hashes, WINDOW), return_inverse=True, return_counts=True)
    if n.max() < 2:
        return 0
    at = np.flatnonzero(n[inverse] > 1)
    change = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(change) > 0))


def judge(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", rows: bool = False) -> DataFrame:
    """Statistics and verdict of every whole text.

    Returns the id, ``n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words`` (long), ``base_failed``, ``kept`` and ``score``. A null or
    empty text has zeros, fails and is not kept. Repeated rows each get a row,
    null ids are kept, other columns are ignored; with ``rows`` the whole input
    row comes along as the struct ``row``.
    """
    spark = session(docs)
    table = spark.sparkContext.broadcast(ratios)
    source, extra = whole_rows(docs, id_col, text_col, rows)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = table.value
        for batch in batches:
            schema = pa.schema([batch.schema.field(0), *((n, pa.int64()) for n in names), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("score", pa.float64()), *list(batch.schema)[2:]])
            raw, at = utf8(batch.column(1))
            for w in words(batch.column(1), NON_SPACE, EXACT):
                found = []
                for i in range(w.last - w.first):
                    text = raw[at[w.first + i] : at[w.first + i + 1]]
                    h = w.hashes[w.of(i)]
                    chars = int(np.count_nonzero(NON_SPACE[text] & ((text & 0xC0) != 0x80)))
                    repeat = _repeated(h)
                    failed = len(h) < MIN_WORDS or 100 * repeat > MAX_REPEAT * len(h)
                    score = float(ratio[grams(text)].mean(dtype=np.float64)) if len(text) else 0.0
                    found.append((len(h), chars, int(np.count_nonzero(_SYMBOL[text])), _line_copies(text.tobytes()), repeat, failed, not failed and score >= threshold, score))
                made = dict(zip((*names, "base_failed", "kept", "score"), zip(*found, strict=True), strict=True))
                yield output(schema, **columns(batch, w.first, len(found)), **made)

    fields = ", ".join(f"{n} long" for n in names)
    return source.mapInArrow(measure, named(source, f"{fields}, base_failed boolean, kept boolean, score double", extra)).withColumnRenamed("__id", id_col)
