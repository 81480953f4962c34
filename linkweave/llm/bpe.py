"""BPE encoding and decoding through a table of distinct words.

1. Split each block of documents into words and keep each block's distinct ones.
2. Sort the (word, block) rows by word over the cluster and encode each distinct
   word once.
3. Send words and ids back to the blocks that hold the words, and put the ids
   in the places where the words stand.
4. Join the ids that a task has met with the vocabulary, id to piece, and spell
   the documents' pieces.

The splits are those of a lower-casing tokenizer whose words are letter runs,
single digits and runs of other signs, and that drops white space.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sparkutil import output, session

#: UTF-8 bytes of text in one block, and documents in one packed row.
BLOCK, ROW = 16 << 20, 64
#: Words of all blocks that an encoding task holds before it sends them off, and words that it encodes in one string.
HELD, JOINED = 200_000, 200
#: Tasks (2**SPREAD) whose blocks ask for a word in one place: a common word of more blocks is encoded in several.
SPREAD = 12
_ODD = regex.compile("[\x1c-\x1f]")
_WHITE = regex.compile("[\t-\r \x85\xa0  -     　]+")


#: Texts whose words a pattern can tell: ASCII and Latin letters, of which none is changed by normal form C.
_PLAIN = regex.compile("[\x00-\x1b\x20-\x7eÀ-ÖØ-öø-įı-ſ]*")
#: Words of such texts in lower case; fixed value of the tokenizer's pattern.
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def split_words(text: str, special: tuple[str, ...] = ()) -> list[str]:
    """Parts of a text that are encoded independently.

    Plain Latin text splits into lower-cased letter runs, digits and runs of
    other signs. Any other text, or one with a special token, splits at Unicode
    white space, which, other than for ``str.split``, has no U+001C to U+001F.
    """
    if _PLAIN.fullmatch(text) and not any(x in text for x in special):
        return _WORD.findall(text.lower())
    if _ODD.search(text):
        return [w for w in _WHITE.split(text) if w]
    return text.split()


def load_tokenizer(path: str):
    """The tokenizer of a file that each executor has, without truncation, padding or threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows with the number of their block: the task's number, then a running one."""
    task, k, held = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        for first in range(0, len(batch), ROW):
            part = batch.slice(first, ROW)
            yield (task << 32) | k, part
            held += sum(len(x.as_buffer()) for x in part.column("__text") if x.is_valid)
            if held >= BLOCK:
                k, held = k + 1, 0


def _words(batches: Iterator[pa.RecordBatch], special: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    def row(block: int, seen: set[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.string()), "block": pa.array([block] * len(seen), pa.int64())})

    now, seen = None, set()
    for block, part in _blocks(batches):
        if block != now and seen:
            yield row(now, seen)
            seen = set()
        now = block
        for text in part.column("__text").to_pylist():
            if text:
                seen.update(split_words(text, special))
    if seen:
        yield row(now, seen)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a block in compressed rows, marked 1."""
    for block, part in _blocks(batches):
        yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "kind": pa.array([1], pa.int32()), "payload": pa.array([_zipped(part)], pa.binary())})


def _zipped(table: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(table)
    return sink.getvalue().to_pybytes()


class Codec:
    """Encodes words: the ids of each as bytes, of the narrowest type that holds the vocabulary."""

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        pieces = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(pieces.values()) + 1
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.last = np.zeros(self.size, bool)
        self.last[[i for p, i in pieces.items() if p.endswith("</w>")]] = True

    def _one(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, self.kind).tobytes()

    def rows(self, found: list[str]) -> list[bytes]:
        """Ids of each word.

        Words that are one match of the pattern are encoded many at a time, with
        a space between, as each then ends at the one piece that ends a word;
        any other is encoded by itself, as are all if that count is not right.
        """
        out: list[bytes] = [b""] * len(found)
        whole = [i for i, w in enumerate(found) if _PLAIN.fullmatch(w) and _WORD.fullmatch(w)]
        for i in set(range(len(found))) - set(whole):
            out[i] = self._one(found[i])
        runs = [whole[k : k + JOINED] for k in range(0, len(whole), JOINED)]
        for run, e in zip(runs, self.tokenizer.encode_batch_fast([" ".join([found[i] for i in run]) for run in runs], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.kind)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(run) or len(ids) and ends[-1] != len(ids):
                for i in run:
                    out[i] = self._one(found[i])
                continue
            raw, at = ids.tobytes(), 0
            for i, end in zip(run, (ends * self.kind.itemsize).tolist(), strict=True):
                out[i] = raw[at:end]
                at = end
        return out


def vocabulary(spark: SparkSession, tokenizer_path: str) -> DataFrame:
    """``id int, piece string`` of a tokenizer; one row per id, so of fixed size."""
    pieces = load_tokenizer(tokenizer_path).get_vocab(with_added_tokens=True)
    table = pa.table({"id": pa.array(pieces.values(), pa.int32()), "piece": pa.array(pieces.keys(), pa.string())})
    return spark.createDataFrame(table)


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text with a tokenizer whose words are white-space free.

    Returns the id, ``n_tokens long``, ``ids string`` (decimal, joined by one
    space) and ``decoded string``. A null or blank text has no ids and decodes
    to the empty text. Repeated rows each get a row, null ids are kept, other
    columns are ignored. The tokenizer file has to exist on every executor and
    must have no decoder, so that pieces are joined by one space.

    A word that a block's table lacks, which happens if the input's partitions
    change between the two readings, is encoded where it stands.
    """
    spark = session(docs)
    tokenizer = load_tokenizer(tokenizer_path)
    special = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())
    if tokenizer.decoder is not None:
        raise ValueError("the tokenizer has a decoder; its words can't be decoded one by one")
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(tokenizer_path)
        out: dict[int, tuple[list[str], list[bytes]]] = {}
        held, last, ids = 0, None, b""

        def sent() -> Iterator[pa.RecordBatch]:
            for block, (found, coded) in out.items():
                payload = _zipped(pa.RecordBatch.from_pydict({"word": pa.array(found, pa.string()), "ids": pa.array(coded, pa.binary())}))
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "kind": pa.array([0], pa.int32()), "payload": pa.array([payload], pa.binary())})
            out.clear()

        for batch in batches:
            found, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            coded = iter(codec.rows([w for i, w in enumerate(found) if w != (found[i - 1] if i else last)]))
            for w, block in zip(found, blocks, strict=True):
                if w != last:
                    last, ids = w, next(coded)
                if (to := out.get(block)) is None:
                    to = out[block] = ([], [])
                to[0].append(w)
                to[1].append(ids)
            held += len(found)
            if held >= HELD:
                yield from sent()
                held = 0
        yield from sent()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ids of each document, packed as the documents came; before them those ids that are new to the task."""
        codec, now, table = Codec(tokenizer_path), None, {}
        told = np.zeros(codec.size, bool)
        for batch in batches:
            for block, what, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if block != now:
                    now, table = block, {}
                for part in pa.ipc.open_stream(payload.as_buffer()):
                    if what == 0:
                        table.update(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True))
                        continue
                    coded = []
                    for text in part.column(1).to_pylist():
                        found = split_words(text or "", special)
                        ids = list(map(table.get, found))
                        if None in ids:
                            new = [w for w in set(found) if w not in table]
                            table.update(zip(new, codec.rows(new), strict=True))
                            ids = [table[w] for w in found]
                        coded.append(b"".join(ids))
                    met = np.bincount(np.frombuffer(b"".join(coded), codec.kind), minlength=codec.size) > 0
                    new = np.flatnonzero(met & ~told)
                    told |= met
                    if len(new):
                        yield pa.RecordBatch.from_pydict({"id": pa.array(new, pa.int32()), "payload": pa.nulls(len(new), pa.binary())})
                    row = _zipped(pa.RecordBatch.from_arrays([part.column(0), pa.array(coded, pa.binary())], ["__id", "ids"]))
                    yield pa.RecordBatch.from_pydict({"id": pa.nulls(1, pa.int32()), "payload": pa.array([row], pa.binary())})

    size = tokenizer.get_vocab_size(with_added_tokens=True)
    width = np.dtype("<u2" if size <= 1 << 16 else "<u4")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents with their ids and pieces as texts; a piece came before the first document that has it."""
        number, piece = pa.array([str(i) for i in range(size)], pa.string()), np.full(size, None, object)
        known = None
        for batch in batches:
            for i, payload, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                if i is not None:
                    piece[i], known = text, None
                    continue
                if known is None:
                    known = pa.array(piece, pa.string())
                for part in pa.ipc.open_stream(payload.as_buffer()):
                    coded = part.column(1).to_pylist()
                    ids = pa.array(np.frombuffer(b"".join(coded), width))
                    n = np.array([len(x) // width.itemsize for x in coded], np.int64)
                    at = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
                    pieces = known.take(ids)
                    if pieces.null_count:
                        raise RuntimeError("an id came before its piece")
                    joined = [pc.binary_join(pa.ListArray.from_arrays(at, x), " ") for x in (number.take(ids), pieces)]
                    schema = pa.schema([part.schema.field(0), ("n_tokens", pa.int64()), ("ids", pa.string()), ("decoded", pa.string())])
                    yield output(schema, __id=part.column(0), n_tokens=n, ids=joined[0], decoded=joined[1])

    packed = "block long, kind int, payload binary"
    asked = source.mapInArrow(lambda batches: _words(batches, special), "word string, block long")
    coded = asked.repartition("word", F.shiftright("block", 32 + SPREAD)).sortWithinPartitions("word").mapInArrow(encode, packed)
    # the documents come first in the union: there, too, a task then has the number of its part of the input
    met = source.mapInArrow(_packed, packed).unionByName(coded).repartition("block").sortWithinPartitions("block", "kind")
    placed = met.mapInArrow(place, "id int, payload binary").join(F.broadcast(vocabulary(spark, tokenizer_path)), "id", "left")
    return placed.select("id", "payload", "piece").mapInArrow(spell, f"__id {kind}, n_tokens long, ids string, decoded string").withColumnRenamed("__id", id_col)
