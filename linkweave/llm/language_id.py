"""Language identification by hyperdimensional letter-trigram profiles.

Each letter has a random vector of +1 and -1. A trigram's vector binds its
letters: the elementwise product of the first letter's vector rotated twice,
the second's rotated once, and the third's. A text's vector bundles (adds) the
vectors of its trigrams, a language's prototype bundles its training texts, and
a text gets the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sparkutil import output, session, sum_blocks

DIM = 512
LETTERS = 64
#: Prototypes are broadcast: LANGUAGES * DIM * 8 bytes at most (4 MB).
LANGUAGES = 1024
UNKNOWN = "und"

_bank: list[np.ndarray] = []
_code: list[np.ndarray] = []


def _letter_codes() -> np.ndarray:
    """Code of every code point: 0 for no letter, 1-26 for a-z, 27-63 for the others by hash."""
    if not _code:
        code = np.zeros(0x110000, np.uint8)
        for cp in range(0x110000):
            if chr(cp).isalpha():
                code[cp] = cp - 96 if 97 <= cp <= 122 else 27 + (cp * 2654435761 >> 7) % (LETTERS - 27)
        _code.append(code)
    return _code[0]


def _rotated() -> list[np.ndarray]:
    """Letter vectors rotated twice, once and not at all."""
    if not _bank:
        letters = np.random.default_rng(7919).choice(np.array([-1, 1], np.int8), (LETTERS, DIM))
        _bank.extend([np.roll(letters, 2, 1), np.roll(letters, 1, 1), letters])
    return _bank


def trigrams(text: str) -> np.ndarray:
    """Trigram codes of the lower-cased letters; other characters make one gap."""
    code = _letter_codes()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    code = np.concatenate(([0], code, [0])).astype(np.int32)
    code = code[np.concatenate(([True], (code[1:] != 0) | (code[:-1] != 0)))]
    if len(code) < 3:
        return code[:0]
    return (code[:-2] * LETTERS + code[1:-1]) * LETTERS + code[2:]


def bundle(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of the trigrams' vectors, each as often as it occurs."""
    two, one, none = _rotated()
    total = np.zeros(DIM)
    for i in range(0, len(grams), 4096):
        g = grams[i : i + 4096]
        bound = two[g // LETTERS**2] * one[g // LETTERS % LETTERS] * none[g % LETTERS]
        total += counts[i : i + 4096].astype(np.float32) @ bound.astype(np.float32)
    return total


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            grams = np.flatnonzero(counts)
            exact = np.zeros(DIM, np.int64)
            two, one, none = _rotated()
            for i in range(0, len(grams), 4096):
                g = grams[i : i + 4096]
                bound = two[g // LETTERS**2] * one[g // LETTERS % LETTERS] * none[g % LETTERS]
                exact += (counts[g] @ bound.astype(np.float64)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"key": pa.array([lang]), "block": pa.array([exact.tobytes()], pa.binary())})
        held.clear()

    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            grams, n = np.unique(trigrams(text), return_counts=True)
            if lang not in held:
                if len(held) == 16:
                    yield from rows()
                held[lang] = np.zeros(LETTERS**3, np.int64)
            held[lang][grams] += n
    yield from rows()


def train(texts: DataFrame) -> dict[str, np.ndarray]:
    """Prototypes of the languages in ``text string, lang string``; every row counts.

    Rows without text or lang teach nothing. Each task sums trigram counts by
    language and sends one integer vector per language, so only languages times
    tasks vectors move. More than ``LANGUAGES`` languages are an error.
    """
    session(texts)
    rows = sum_blocks(texts.where("text is not null and lang is not null").select("text", "lang").mapInArrow(_profile, "key string, block binary")).limit(LANGUAGES + 1).collect()
    if len(rows) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    return {r.key: np.frombuffer(r.block, np.int64).astype(float) for r in sorted(rows, key=lambda r: r.key)}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of every whole text: the id, ``lang_pred`` and ``score`` (cosine, 0 to 1).

    A null text, or one without a letter, is ``und`` with score 0; so is every
    text when no prototype was learnt. Ties go to the first language by name.
    Repeated rows each get a row, null ids are kept, other columns are ignored.
    """
    session(docs)
    names = [k for k, v in prototypes.items() if np.any(v)]
    matrix = np.array([prototypes[k] / np.linalg.norm(prototypes[k]) for k in names]).reshape(len(names), DIM)
    field = docs.schema[id_col]
    picked = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    kind = f"`{id_col}` {field.dataType.simpleString()}, lang_pred string, score double"

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(1).to_pylist():
                lang, score = UNKNOWN, 0.0
                if text and names:
                    grams, n = np.unique(trigrams(text), return_counts=True)
                    vector = bundle(grams, n)
                    if size := float(np.sqrt(vector @ vector)):
                        cosines = matrix @ vector / size
                        best = int(np.argmax(cosines))
                        lang, score = names[best], min(1.0, max(0.0, float(cosines[best])))
                langs.append(lang)
                scores.append(score)
            schema = pa.schema([pa.field(id_col, batch.schema.field(0).type), ("lang_pred", pa.string()), ("score", pa.float64())])
            yield output(schema, **{id_col: batch.column(0), "lang_pred": langs, "score": scores})

    return picked.mapInArrow(predict, kind)
