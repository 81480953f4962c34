"""Toxicity scores by FTRL-proximal logistic regression over hashed n-grams.

Features are the distinct hashed words, word pairs and pairs with one word
between. Each coordinate has its own learning rate; the L1 term leaves few
weights different from zero, and only those are sent to the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sparkutil import columns, named, output, session, whole_rows
from .textkernel import ALNUM, FOLDED, Words, mix, words

#: Hashed features, so also the most weights that can be broadcast (2**BITS).
BITS = 20
#: Rows of each label that training reads at most: the smallest hashes of their ids.
POSITIVES, NEGATIVES = 3_000, 6_000
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 6.0, 0.0, 8
THRESHOLD = 0.3


def features(w: Words, i: int) -> np.ndarray:
    """Distinct hashed features of a row of ``w``."""
    h = w.hashes[w.of(i)]
    pairs = [mix(h[:-k] * np.uint64(0x9E3779B97F4A7C15) + h[k:] + np.uint64(k)) for k in (1, 2) if len(h) > k]
    return np.unique((np.concatenate([h, *pairs]) >> np.uint64(64 - BITS)).astype(np.int32))


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [(x, y) for batch in batches for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
    rows = [(np.frombuffer(x, np.int32), y) for x, y in rows]
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias, bias_n = 0.0, 0.0
    for _ in range(EPOCHS):
        for x, y in rows:
            zx, nx = z[x], n[x]
            root = np.sqrt(nx)
            w = np.where(np.abs(zx) > L1, (np.sign(zx) * L1 - zx) / ((BETA + root) / ALPHA + L2), 0.0)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -30, 30)))
            g = p - y
            z[x] = zx + g - (np.sqrt(nx + g * g) - root) / ALPHA * w
            n[x] = nx + g * g
            bias_n += g * g
            bias -= ALPHA * g / (BETA + np.sqrt(bias_n))
    at = np.flatnonzero(np.abs(z) > L1)
    w = (np.sign(z[at]) * L1 - z[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
    yield pa.RecordBatch.from_pydict({"feature": pa.array([-1, *at.tolist()], pa.int32()), "weight": pa.array([bias, *w.tolist()], pa.float64())})


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, features and weights learnt from ``labels`` (``doc_id``, ``label`` 0 or 1).

    At most POSITIVES and NEGATIVES labelled ids are read, the ones with the
    smallest hashes; an id with both labels counts as 1. Texts of these ids are
    hashed where they lie; the bounded sample is fitted in one task in the order
    of the hashes, so the result does not depend on partitions. Null ids, labels
    and texts teach nothing; with one class or none everything scores 0.
    """
    session(docs)
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    order = F.xxhash64("doc_id")
    sample = known.where("label = 1").orderBy(order, "doc_id").limit(POSITIVES).unionByName(known.where("label = 0").orderBy(order, "doc_id").limit(NEGATIVES)).select(F.col("doc_id").alias("__id"), F.col("label").cast("int").alias("__label"))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).where("__text is not null").join(F.broadcast(sample), "__id").select("__text", "__label", F.xxhash64("__id").alias("__order"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("x", pa.binary()), ("y", pa.int32()), ("o", pa.int64())])
        for batch in batches:
            for w in words(batch.column(0), ALNUM, FOLDED):
                n = w.last - w.first
                yield output(schema, x=[features(w, i).tobytes() for i in range(n)], y=batch.column(1).slice(w.first, n), o=batch.column(2).slice(w.first, n))

    found = rows.mapInArrow(extract, "x binary, y int, o long").repartition(1).sortWithinPartitions("o", "x").select("x", "y").mapInArrow(_train, "feature int, weight double").collect()
    table = {r.feature: r.weight for r in found}
    bias = table.pop(-1, 0.0)
    if not table:
        return -30.0, np.zeros(0, np.int32), np.zeros(0)
    at = np.array(sorted(table), np.int32)
    return bias, at, np.array([table[k] for k in at.tolist()])


def score(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray], threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", rows: bool = False) -> DataFrame:
    """Score of every whole text: the id, ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    A null or empty text has no features and scores the bias. Repeated rows each
    get a row, null ids are kept, other columns are ignored; with ``rows`` the
    whole input row comes along as the struct ``row``.
    """
    spark = session(docs)
    shared = spark.sparkContext.broadcast(model)
    source, extra = whole_rows(docs, id_col, text_col, rows)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, at, w = shared.value
        weight = np.zeros(1 << BITS)
        weight[at] = w
        for batch in batches:
            schema = pa.schema([batch.schema.field(0), ("score", pa.float64()), ("predicted", pa.int32()), *list(batch.schema)[2:]])
            for part in words(batch.column(1), ALNUM, FOLDED):
                sums = np.array([weight[features(part, i)].sum() + bias for i in range(part.last - part.first)])
                p = 1 / (1 + np.exp(-np.clip(sums, -30, 30)))
                yield output(schema, **columns(batch, part.first, len(p)), score=p, predicted=(p >= threshold).astype(np.int32))

    return source.mapInArrow(predict, named(source, "score double, predicted int", extra)).withColumnRenamed("__id", id_col)
