"""Packing of tokenized documents into sequences of fixed size.

Lengths are few, documents many: a histogram of the pieces' lengths goes to the
driver (at most one count per length), where a configuration linear program is
solved by multiplicative weights, its columns priced by a knapsack dynamic
program, and rounded to whole sequences. The plan, again bounded by lengths and
patterns, is broadcast, and each piece finds its place by its rank among the
pieces of its length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import load_tokenizer
from .sparkutil import Stage, output, session

CAPACITY, END = 1024, 2
#: Parts and words whose ids a task remembers.
CACHE = 500_000
#: Pieces of one length that are ranked in one group.
RANKED = 100_000
#: Rounds of pricing at most, share of a length that one round covers, and the weights' rate. Later rounds only
#: find patterns with gaps, to which best-fit placement of the open lengths is superior.
ROUNDS, STEP, RATE = 600, 0.5, 1.0
#: Latin letters and ASCII without the separators on which libraries differ.
_PLAIN = regex.compile("[\x00-\x1b\x20-\x7eÀ-ÖØ-öø-ſ]*")
#: The words of such texts; fixed value of byte-level BPE.
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")

Pattern = tuple[tuple[int, int], ...]


class ByteEncoder:
    """Ids of texts by a byte-level BPE tokenizer whose words begin with at most one space.

    A space between two characters that aren't white space begins a word of its
    own, so a text splits there into parts that are encoded independently, and a
    part splits into words; each distinct part and word is encoded once while it
    is remembered. Texts where that is not sure (two white spaces running,
    unusual characters, special tokens) go to the tokenizer whole.
    """

    def __init__(self, path: str):
        import tiktoken

        self.tokenizer = load_tokenizer(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # the vocabulary's characters stand for bytes: printable ones for themselves, the others for 256 and up
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(byte[c] for c in w): i for w, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if w not in self.special}
        self.merge = tiktoken.Encoding("words", pat_str=r"[^\r\n]+|[\r\n]", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.parts: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        found = []
        for word in _WORD.findall(part):
            ids = self.words.get(word)
            if ids is None:
                if len(self.words) > CACHE:
                    self.words.clear()
                ids = self.words[word] = np.array(self.merge(word.encode()), "<u4").tobytes()
            found.append(ids)
        return b"".join(found)

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        if text[0] == " " or text[-1] == " " or any(x in text for x in ("  ", "\n ", "\t ", "\r ", "\x0b ", "\x0c ")) or any(x in text for x in self.special) or not _PLAIN.fullmatch(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = text.split(" ")
        if len(self.parts) > CACHE:
            self.parts.clear()
        found = list(map(self.parts.get, rest))
        if None in found:
            known, part = self.parts, self._part
            for k, ids in enumerate(found):
                if ids is None:
                    x = rest[k]
                    if (ids := known.get(x)) is None:
                        ids = known[x] = part(" " + x)
                    found[k] = ids
        return self._part(first) + b"".join(found)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of every whole text: the id, ``piece int, start long, length long, ids_crc32 long``.

    A document is its ids and then ``end``; a null text is empty. Documents
    longer than ``capacity`` are cut into pieces of that length, of which the
    first may be shorter.
    """
    session(docs)
    kind = docs.schema[id_col].dataType.simpleString()
    tail = np.asarray([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteEncoder(tokenizer_path)
        for batch in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = encoder.ids(text or "") + tail
                n = len(ids) // 4
                bounds = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    at.append(row)
                    piece.append(k)
                    start.append(low)
                    length.append(high - low)
                    crc.append(zlib.crc32(ids[4 * low : 4 * high]))
            schema = pa.schema([batch.schema.field(0), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
            yield output(schema, __id=batch.column(0).take(pa.array(at, pa.int64())), piece=piece, start=start, length=length, ids_crc32=crc)

    source = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    return source.mapInArrow(cut, f"__id {kind}, piece int, start long, length long, ids_crc32 long")


def best_pattern(value: np.ndarray, capacity: int) -> Pattern:
    """The most valuable multiset of lengths within ``capacity``: an unbounded knapsack."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        options = value[1 : room + 1] + best[room - 1 :: -1]
        k = int(options.argmax())
        best[room], last[room] = options[k], k + 1
    used: Counter[int] = Counter()
    room = capacity
    while room > 0 and best[room] > 0:
        if value[last[room]] > 0:
            used[int(last[room])] += 1
        room -= int(last[room])
    return tuple(sorted(used.items(), reverse=True))


def fractional(count: np.ndarray, capacity: int) -> dict[Pattern, float]:
    """Use of each pattern in the configuration program, by multiplicative weights.

    Each round prices the best pattern, uses it so often that the scarcest of
    its lengths gains STEP of its demand, and lowers the weights of the lengths
    it covers. A length's value is its share of a sequence times its weight.
    """
    demand = count.astype(float)
    active = demand > 0
    weight, covered = active.astype(float), np.zeros(len(demand))
    size = np.arange(len(demand)) / capacity
    x: dict[Pattern, float] = defaultdict(float)
    for _ in range(ROUNDS):
        open_ = active & (covered < demand)
        if not open_.any():
            break
        pattern = best_pattern(np.where(open_, size * weight, 0.0), capacity)
        step = STEP * min(max(1.0, demand[n]) / k for n, k in pattern)
        x[pattern] += step
        for n, k in pattern:
            covered[n] += step * k
            weight[n] *= np.exp(-RATE * step * k / demand[n])
    return x


def plan(count: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns and how often each is used, so that every length is placed exactly ``count`` times.

    The fractional solution is rounded down; what is left goes best-fit into the
    fullest sequence that still has room, longest first.
    """
    left = count.astype(np.int64).copy()
    whole: Counter[Pattern] = Counter()
    if left[capacity]:
        whole[((capacity, 1),)] += int(left[capacity])
        left[capacity] = 0
    for pattern, times in sorted(fractional(left, capacity).items(), key=lambda p: (-sum(n * k for n, k in p[0]), p[0])):
        copies = min(int(times + 1e-9), min(int(left[n] // k) for n, k in pattern))
        if copies > 0:
            whole[pattern] += copies
            for n, k in pattern:
                left[n] -= copies * k
    rooms: dict[int, Counter[Pattern]] = defaultdict(Counter)
    for n in range(capacity, 0, -1):
        while left[n]:
            room = next((r for r in range(n, capacity) if rooms.get(r)), capacity)
            if room == capacity:
                per = capacity // n
                full, rest = divmod(int(left[n]), per)
                for k, copies in ((per, full), (rest, 1)):
                    if k and copies:
                        rooms[capacity - k * n][((n, k),)] += copies
                left[n] = 0
                continue
            pattern, copies = next(iter(rooms[room].items()))
            used = min(copies, int(left[n]))
            rooms[room][pattern] -= used
            if not rooms[room][pattern]:
                del rooms[room][pattern]
            grown = Counter(dict(pattern))
            grown[n] += 1
            rooms[room - n][tuple(sorted(grown.items(), reverse=True))] += used
            left[n] -= used
    for found in rooms.values():
        whole.update(found)
    return sorted(whole.items(), reverse=True)


def _slots(patterns: list[tuple[Pattern, int]]) -> dict[int, np.ndarray]:
    """By length: first rank, pieces to a sequence, first sequence, and offset of the first piece."""
    slots: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    rank: Counter[int] = Counter()
    sequence = 0
    for pattern, copies in patterns:
        offset = 0
        for n, k in pattern:
            slots[n].append((rank[n], k, sequence, offset))
            rank[n] += k * copies
            offset += n * k
        sequence += copies
    return {n: np.array(rows, np.int64) for n, rows in slots.items()}


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack the token pieces of all documents into sequences of at most ``capacity`` tokens.

    Returns per piece: the id, ``piece, start, length, ids_crc32, sequence_id``
    and ``offset``. Sequences are filled without gaps from 0. A null or empty
    text is one piece of one token, repeated rows are packed each, null ids are
    kept, an empty table gives no rows, other columns are ignored.
    """
    spark = session(docs)
    stage = Stage(pieces(docs, tokenizer_path, capacity, end, id_col, text_col), "pieces")
    count = np.zeros(capacity + 1, np.int64)
    for row in stage.df.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most one row per length
        count[row.length] = row.n
    # a length with many pieces is ranked in as many groups as it needs
    dealt = spark.createDataFrame([(int(n), int(-(-count[n] // RANKED))) for n in np.flatnonzero(count)], "length long, groups int")
    found = stage.df.join(F.broadcast(dealt), "length").withColumn("g", F.pmod(F.xxhash64("__id", "piece", "ids_crc32"), F.col("groups")).cast("int"))
    before: dict[tuple[int, int], int] = {}
    rank: Counter[int] = Counter()
    for row in found.groupBy("length", "g").agg(F.count("*").alias("n")).orderBy("length", "g").collect():  # a row per length, and per RANKED pieces
        before[row.length, row.g] = rank[row.length]
        rank[row.length] += row.n
    shared = spark.sparkContext.broadcast((before, _slots(plan(count, capacity))))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("length", "g").orderBy("__id", "piece", "start")) - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, slots = shared.value
        for batch in batches:
            length, group, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "g", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                r = rank[at] + np.array([first[int(n), int(g)] for g in group[at]], np.int64)
                rows = slots[int(n)][np.searchsorted(slots[int(n)][:, 0], r, side="right") - 1]
                inside = r - rows[:, 0]
                sequence[at] = rows[:, 2] + inside // rows[:, 1]
                offset[at] = rows[:, 3] + inside % rows[:, 1] * n
            schema = pa.schema([*(batch.schema.field(c) for c in ("__id", "piece", "start", "length", "ids_crc32")), ("sequence_id", pa.int64()), ("offset", pa.int64())])
            yield output(schema, **{c: batch.column(c) for c in ("__id", "piece", "start", "length", "ids_crc32")}, sequence_id=sequence, offset=offset)

    kind = docs.schema[id_col].dataType.simpleString()
    return ranked.mapInArrow(place, f"__id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("__id", id_col)
