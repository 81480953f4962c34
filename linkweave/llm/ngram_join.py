"""Near-duplicate join on word n-gram Jaccard similarity by prefix filtering.

1. Count shingles in a frequency sketch of fixed size, which orders shingles
   rare first; any fixed order gives complete results, a good one fewer candidates.
2. Collapse texts with equal shingle sets into one class.
3. Give each class its prefix, the rarest shingles of which two sets above the
   threshold share at least one; keep postings of shingles that two classes hold, found
   from compressed blocks of all prefixes and passed on by a Bloom filter.
4. In each posting list, verify neighbours, and each class with the list's
   centre, of which many are edited; join linked classes into components.
   Members of a component need no further comparison.
5. In a few rounds, let the most common members of the components that a list
   still mixes meet likewise, verify them, and join their components.
6. Join the postings of different components, under length, positional and
   suffix filters, and verify each remaining pair once. Long lists are dealt
   out: one side by parts, the other to all parts.

Groups of copies thus cost as many pairs as members, and no link between
components is lost, however few rounds step 5 has. Texts are hashed to 64 bits a shingle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import components
from .sparkutil import Stage, output, partitions, session, sum_blocks
from .textkernel import mix, shingles, words

#: Parts of the shingle space whose parities the suffix filter compares, 64 to a number.
PARTS = 2048
#: Longer posting lists are split, so that no task gets one whole.
LIST = 256
#: Leading bits of a shingle by which classes are asked whether another has it, and shingles a task asks about at once.
LEAD, ASKED = 48, 1 << 21
#: Rounds in which representatives of components meet before the exact join, in lists of so many members at least;
#: pairs within shorter lists are few.
ROUNDS, LONG = 1, 16
#: Blocks of a Bloom filter, and the most bits that it has in all (2**BLOOM, so 8 MB are broadcast at most;
#: a fuller one lets more through, which later steps drop).
BLOCKS, BLOOM = 64, 26
#: Longs that the parities are folded to where they travel with postings.
FOLDED = 8
#: Neighbours in posting lists that a class is compared with first.
NEAREST = 3


@dataclass(frozen=True)
class Config:
    """Words to a shingle, least similarity in percent, and the sketch's size (2**bits counters)."""

    width: int = 5
    percent: int = 80
    bits: int = 24


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _sketch(texts: DataFrame, cfg: Config) -> np.ndarray:
    """Frequency rank (0 to 255, logarithmic) of each bucket of the shingle space."""
    size, parts = 1 << cfg.bits, 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint32)
        for batch in batches:
            for w in words(batch.column(0)):
                for i in range(w.last - w.first):
                    np.add.at(total, _bucket(shingles(w.hashes[w.of(i)], cfg.width), cfg.bits), np.uint32(1))
        # a task sends at most 65535 for a bucket: order only matters among rare and frequent
        for k, part in enumerate(np.split(total, parts)):
            if part.any():
                part = np.minimum(part, 65535).astype(np.uint16)
                yield pa.RecordBatch.from_pydict({"key": pa.array([str(k)]), "block": pa.array([pa.compress(part, "zstd", asbytes=True)], pa.binary())})

    def ranked(n: np.ndarray) -> bytes:
        return pa.compress(np.minimum(255, np.round(np.log2(n + 1.0) * 8)).astype(np.uint8), "zstd", asbytes=True)

    rank = np.zeros(size, np.uint8)
    each = size // parts
    # one job for all blocks, 2**bits bytes at most before compression; an iterator would start a job for each partition
    for row in sum_blocks(texts.mapInArrow(count, "key string, block binary"), dtype=np.uint16, packed=size // parts, finish=ranked).collect():
        k = int(row.key)
        rank[k * each : (k + 1) * each] = np.frombuffer(pa.decompress(row.block, each, "zstd"), np.uint8)
    return rank


def _profiles(texts: DataFrame, cfg: Config, rank) -> DataFrame:
    """Per text: set size, two hashes of the set, mean rank and shingles of the prefix in rare-first order, parities by part."""
    fields = "doc_id long, n int, key1 long, key2 long, common double, prefix array<long>, ranks binary, parts array<long>"
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("key1", pa.int64()), ("key2", pa.int64()), ("common", pa.float64()), ("prefix", pa.list_(pa.int64())), ("ranks", pa.binary()), ("parts", pa.list_(pa.int64()))])

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = rank.value
        for batch in batches:
            ids = batch.column(0)
            for w in words(batch.column(1)):
                n, key1, key2, common, prefix, ranks, parts = [], [], [], [], [], [], []
                for i in range(w.last - w.first):
                    s = np.unique(shingles(w.hashes[w.of(i)], cfg.width))
                    level = order[_bucket(s, cfg.bits)]
                    first = np.argsort(level, kind="stable")[: len(s) - -(-cfg.percent * len(s) // 100) + 1] if len(s) else s[:0].astype(int)
                    n.append(len(s))
                    key1.append(np.add.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D))).astype(np.int64))
                    key2.append(np.bitwise_xor.reduce(mix(s + np.uint64(0x14057B7EF767814F)), initial=np.uint64(len(s))).astype(np.int64))
                    common.append(float(level[first].mean()) if len(first) else 0.0)
                    prefix.append(s[first].astype(np.int64))
                    ranks.append(level[first].tobytes())
                    parts.append(np.packbits(np.bincount((s % np.uint64(PARTS)).astype(np.int64), minlength=PARTS) & 1).view(np.int64))
                yield output(schema, doc_id=ids.slice(w.first, w.last - w.first), n=n, key1=key1, key2=key2, common=common, prefix=prefix, ranks=ranks, parts=parts)

    return texts.mapInArrow(profile, fields)


class Bloom:
    """A Bloom filter in blocks: an id's block and its three bits there follow from its hash."""

    def __init__(self, bits: int, held: np.ndarray):
        self.bits, self.held = bits, held

    @staticmethod
    def places(ids: np.ndarray, bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Block of each id, and its three bits within a block of 2**bits."""
        h = mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x632BE59BD9B4E019))
        again = mix(h)
        mask = np.uint64((1 << bits) - 1)
        return (h >> np.uint64(58)).astype(np.int64), [(x & mask).astype(np.int64) for x in (h, again, again >> np.uint64(32))]

    def perhaps(self, ids: np.ndarray) -> np.ndarray:
        """False for ids that are surely not among those put in."""
        block, found = self.places(ids, self.bits)
        hit = np.ones(len(ids), bool)
        for x in found:
            hit &= (self.held[block, x >> 3] >> (x & 7).astype(np.uint8)) & 1 == 1
        return hit


def may_contain(ids: DataFrame):
    """A broadcast Bloom filter of the column ``id``, of fixed size at most; each task makes whole blocks of it."""
    bits = min(BLOOM, max(12, int(ids.count() * 16).bit_length())) - 6

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_pydict({"block": pa.array(Bloom.places(x, bits)[0]), "id": pa.array(x, pa.int64())})

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            block, found = Bloom.places(batch.column(1).to_numpy(zero_copy_only=False), bits)
            for k in np.unique(block):
                held = made.setdefault(int(k), np.zeros((1 << bits) // 8, np.uint8))
                for x in found:
                    np.bitwise_or.at(held, x[block == k] >> 3, np.uint8(1) << (x[block == k] & 7).astype(np.uint8))
        for k, held in made.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int64()), "held": pa.array([pa.compress(held, "zstd", asbytes=True)], pa.binary())})

    each = (1 << bits) // 8
    held = np.zeros((BLOCKS, each), np.uint8)
    n = min(BLOCKS, partitions(ids.sparkSession))
    for row in ids.mapInArrow(dealt, "block long, id long").repartition(n, "block").mapInArrow(fill, "block long, held binary").collect():  # BLOCKS rows, in one job
        held[row.block] = np.frombuffer(pa.decompress(row.held, each, "zstd"), np.uint8)
    return ids.sparkSession.sparkContext.broadcast(Bloom(bits, held))


def _sets(texts: DataFrame, cfg: Config, wanted) -> DataFrame:
    """Sorted shingle sets (``doc_id, shingle_set``) of the texts that ``wanted`` may contain."""
    schema = pa.schema([("doc_id", pa.int64()), ("shingle_set", pa.binary())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = wanted.value.perhaps(batch.column(0).to_numpy(zero_copy_only=False))
            if not hit.any():
                continue
            batch = batch.filter(pa.array(hit))
            ids = batch.column(0)
            for w in words(batch.column(1)):
                found = [np.unique(shingles(w.hashes[w.of(i)], cfg.width)).tobytes() for i in range(w.last - w.first)]
                yield output(schema, doc_id=ids.slice(w.first, w.last - w.first), shingle_set=found)

    return texts.where("doc_id is not null").mapInArrow(gather, "doc_id long, shingle_set binary")


def _verified(pairs: DataFrame, texts: DataFrame, cfg: Config) -> Stage:
    """Those of the distinct pairs ``a, b`` whose sets reach the threshold, written."""
    pairs = Stage(pairs, "pairs")  # read several times below
    ids = pairs.df.select(F.col("a").alias("id")).unionByName(pairs.df.select(F.col("b").alias("id"))).distinct()
    wanted = may_contain(ids)
    sets = Stage(_sets(texts, cfg, wanted), "sets")
    wanted.destroy()
    left = pairs.df.join(sets.df.select(F.col("doc_id").alias("a"), F.col("shingle_set").alias("x")), "a")
    both = left.join(sets.df.select(F.col("doc_id").alias("b"), F.col("shingle_set").alias("y")), "b").select("a", "b", "x", "y")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                shared = int(np.count_nonzero(y[at] == x)) if len(y) else 0
                keep.append(shared > 0 and 100 * shared >= cfg.percent * (len(x) + len(y) - shared))
            keep = pa.array(keep, pa.bool_())
            yield output(schema, a=batch.column(0).filter(keep), b=batch.column(1).filter(keep))

    links = Stage(both.mapInArrow(verify, "a long, b long"), "links")
    sets.drop()
    pairs.drop()
    return links


def _suffix_fits(cfg: Config) -> str:
    """Whether sides ``x`` and ``y`` can share enough: a part with different parities holds a shingle that only one has."""
    return f"aggregate(zip_with(x.parts, y.parts, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v) <= x.n + y.n - 2 * ceil({cfg.percent} * (x.n + y.n) / {100 + cfg.percent})"


def _suffix_filter(pairs: DataFrame, classes: DataFrame, cfg: Config) -> DataFrame:
    """Drop pairs whose sizes, or parities by part, rule the needed overlap out."""
    x, y = (classes.select(F.col("doc_id").alias(side), F.struct("n", "parts").alias(name)) for side, name in (("a", "x"), ("b", "y")))
    sized = F.expr(f"100 * least(x.n, y.n) >= {cfg.percent} * greatest(x.n, y.n)")
    return pairs.join(x, "a").join(y, "b").where(sized & F.expr(_suffix_fits(cfg))).select("a", "b")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def _merged(group: DataFrame, links: DataFrame) -> DataFrame:
    """``node, component`` after the components of ``group`` that ``links`` connect are joined."""
    side = lambda c: F.coalesce(F.col(c), F.col(c[0]))
    met = links.join(group.select(F.col("node").alias("a"), F.col("component").alias("a_")), "a", "left").join(group.select(F.col("node").alias("b"), F.col("component").alias("b_")), "b", "left")
    joined = components(met.select(side("a_").alias("a"), side("b_").alias("b")))
    old = group.join(joined.select(F.col("node").alias("component"), F.col("component").alias("now")), "component", "left").select("node", F.coalesce("now", "component").alias("component"))
    return Stage(old.unionByName(joined.join(group, "node", "left_anti")), "groups").df


def _centre(doc: str) -> Column:
    """The member of a list's part whose rare shingles are the most common: one that others are edited from."""
    return F.max_by(doc, F.struct("common", doc)).over(Window.partitionBy("token", "part"))


def _neighbours(lists: DataFrame) -> DataFrame:
    """Each member of a list's part with the next one and with the part's centre: as many pairs as members."""
    chain = lists.where("after is not null").select(F.col("doc_id").alias("a"), F.col("after").alias("b"))
    return chain.unionByName(lists.where("centre <> doc_id").select(F.col("centre").alias("a"), F.col("doc_id").alias("b")))


def _shared(classes: DataFrame) -> DataFrame:
    """Leading bits (``id long``) of prefix shingles that two classes hold.

    Tasks send their shingles sorted, as differences in compressed blocks, one
    for each range of the shingle space; one that a task holds often is sent twice.
    """
    ranges = partitions(classes.sparkSession)
    width = -(-(1 << LEAD) // ranges)

    def packed(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        lead, n = np.unique(np.concatenate(found) >> np.uint64(64 - LEAD), return_counts=True)
        lead = np.repeat(lead, np.minimum(n, 2))
        cuts = np.searchsorted(lead, np.arange(1, ranges, dtype=np.uint64) * np.uint64(width))
        for k, part in enumerate(np.split(lead, cuts)):
            if len(part):
                apart = np.diff(part, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
                yield pa.RecordBatch.from_pydict({"range": pa.array([k], pa.int32()), "n": pa.array([len(part)], pa.int64()), "block": pa.array([pa.compress(np.ascontiguousarray(apart), "zstd", asbytes=True)], pa.binary())})

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0
        for batch in batches:
            found.append(batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            n += len(found[-1])
            if n >= ASKED:
                yield from packed(found)
                found, n = [], 0
        if n:
            yield from packed(found)

    def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for k, n, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                apart = np.frombuffer(pa.decompress(block.as_buffer(), 8 * n, "zstd"), np.uint8).reshape(8, n)
                held.setdefault(k, []).append(np.cumsum(np.ascontiguousarray(apart.T).view(np.uint64).ravel(), dtype=np.uint64))
        for found in held.values():
            lead, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_pydict({"id": pa.array(lead[n > 1].astype(np.int64), pa.int64())})

    return classes.select("prefix").mapInArrow(send, "range int, n long, block binary").repartition(ranges, "range").mapInArrow(twice, "id long")


def _postings(classes: DataFrame, shared) -> DataFrame:
    """``doc_id, n, common, pos, token, part, lists`` of those prefix shingles that the filter ``shared`` may contain."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("common", pa.float64()), ("pos", pa.int32()), ("token", pa.int64()), ("rank", pa.int32())])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, common, prefix, ranks = batch.columns
            token = prefix.flatten().to_numpy(zero_copy_only=False)
            size = prefix.value_lengths().to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(len(size)), size)
            pos = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
            rank = np.frombuffer(b"".join(ranks.to_pylist()), np.uint8)
            lead = token.view(np.uint64) >> np.uint64(64 - LEAD)
            hit = np.flatnonzero(shared.value.perhaps(lead.astype(np.int64)))
            of = pa.array(of[hit])
            yield output(schema, doc_id=ids.take(of), n=n.take(of), common=common.take(of), pos=pos[hit], token=token[hit], rank=rank[hit].astype(np.int32))

    spread = F.greatest(F.lit(1), F.ceil(F.pow(F.lit(2.0), F.col("rank") / 8) / LIST)).cast("long")
    found = classes.select("doc_id", "n", "common", "prefix", "ranks").mapInArrow(pick, "doc_id long, n int, common double, pos int, token long, rank int")
    return found.select("doc_id", "n", "common", "pos", "token", F.pmod(F.xxhash64("doc_id"), spread).alias("part"), spread.cast("int").alias("lists"))


def link(docs: DataFrame, cfg: Config = Config(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Class membership by n-gram Jaccard similarity, one row per row of ``docs``.

    Words are runs of non-white-space, A-Z lower-cased. A text's set holds its
    distinct runs of ``width`` words (a shorter text is one run; a null or
    blank text has none and links with nothing). Two texts link when their sets'
    Jaccard similarity is at least ``percent`` / 100. Returns ``doc_id``,
    ``n_shingles long`` and ``component_id long``, the smallest id reachable by
    links. Rows that repeat an id are one document with several texts, each of
    which may link it; a row with a null id links with nothing and has a null
    component. Other columns are ignored.
    """
    spark = session(docs)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rank = spark.sparkContext.broadcast(_sketch(texts.select("text"), cfg))
    profiles = Stage(_profiles(texts, cfg, rank), "profiles")
    rank.destroy()
    members = Stage(profiles.df.select("doc_id", "n", "key1", "key2"), "members")
    classes = Stage(profiles.df.where("n > 0 and doc_id is not null").groupBy("key1", "key2").agg(F.min_by(F.struct("doc_id", "n", "common", "prefix", "ranks", "parts"), "doc_id").alias("c")).select("c.*"), "classes")
    profiles.drop()

    # postings of shingles that two classes hold; a list that the sketch finds long is dealt out in parts
    near = Window.partitionBy("token", "part").orderBy("n", "doc_id")
    beside = {"after": F.lead("doc_id").over(near), "before": F.lag("doc_id").over(near), "centre": _centre("doc_id")}
    shared = Stage(_shared(classes.df), "shared")
    seen = may_contain(shared.df)
    postings = Stage(_postings(classes.df, seen).withColumns(beside).where("lists > 1 or after is not null or before is not null"), "postings")
    seen.destroy()
    shared.drop()
    met = _neighbours(postings.df)
    # of a class's neighbours the ones it meets in most lists come first; later steps look at all others
    often = met.groupBy("b", "a").count().withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("count"), "a"))).where(F.col("r") <= NEAREST)
    links = _verified(_suffix_filter(_ordered(often.select("a", "b")), classes.df, cfg), texts, cfg)
    group = components(links.df)

    def with_groups(lists: DataFrame) -> DataFrame:
        return lists.join(group.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("g", F.coalesce("component", "doc_id")).drop("component")

    base = postings.df.select("token", "doc_id", "n", "common", "pos", "lists")
    hot = Stage(base.join(base.groupBy("token").count().where(F.col("count") >= LONG).select("token"), "token", "left_semi"), "hot")
    for turn in range(ROUNDS):
        # of each component in a list its most common member meets others', in parts of this turn's own
        chosen = with_groups(hot.df).groupBy("token", "g", "lists").agg(F.max_by(F.struct("doc_id", "common"), F.struct("common", "doc_id")).alias("m")).select("token", "m.*", F.pmod(F.xxhash64("g", F.lit(turn)), F.col("lists")).alias("part"))
        after = F.lead("doc_id").over(Window.partitionBy("token", "part").orderBy(F.xxhash64("doc_id", "token", F.lit(turn)), "doc_id"))
        met = _ordered(_neighbours(chosen.withColumns({"after": after, "centre": _centre("doc_id")})))
        links = _verified(_suffix_filter(met, classes.df, cfg), texts, cfg)
        if links.df.isEmpty():
            break
        group = _merged(group, links.df)
    hot.drop()
    grouped = with_groups(base.drop("common"))
    mixed = grouped.groupBy("token").agg((F.min("g") < F.max("g")).alias("mixed")).where("mixed").select("token")
    held = grouped.join(mixed, "token", "left_semi")

    # a linked pair meets at its first common shingle, from which on each has at least the needed number left
    # folded parities travel with the postings, pairs that they let through meet the whole ones
    folded = F.expr(f"transform(sequence(0, {FOLDED - 1}), i -> " + " ^ ".join(f"parts[i + {k}]" for k in range(0, PARTS // 64, FOLDED)) + ")")
    side = held.join(classes.df.select("doc_id", folded.alias("parts")), "doc_id")
    x = side.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("lists")).cast("int")).alias("x")
    y = side.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("lists") - 1))).alias("y")
    need = f"ceil({cfg.percent} * (x.n + y.n) / {100 + cfg.percent})"
    meet = F.expr("x.token = y.token and x.part = y.part and x.g <> y.g and (x.n < y.n or x.n = y.n and x.doc_id < y.doc_id)") & F.expr(f"100 * x.n >= {cfg.percent} * y.n and x.n - x.pos >= {need} and y.n - y.pos >= {need} and {_suffix_fits(cfg)}")
    fits = x.join(y, meet).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))
    rest = _verified(_suffix_filter(_ordered(fits), classes.df, cfg), texts, cfg)

    # every row links with its class; so do rows that repeat an id
    keyed = members.df.where("n > 0 and doc_id is not null")
    rep = keyed.groupBy("key1", "key2").agg(F.min("doc_id").alias("rep"))
    node = Stage(keyed.join(rep, ["key1", "key2"]).select("doc_id", "rep").distinct(), "nodes")
    repeated = node.df.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b")
    many = node.df.join(repeated.select("doc_id", F.col("a").alias("least")), "doc_id").select(F.col("least").alias("a"), F.col("rep").alias("b"))
    final = _merged(group, rest.df.unionByName(many))
    of = node.df.groupBy("doc_id").agg(F.min("rep").alias("rep")).join(final.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("found"))
    for stage in (classes, postings):
        stage.drop()
    return members.df.select("doc_id", "n").join(of, "doc_id", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("found", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, cfg: Config = Config(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of each component; rows with a null id stay.

    Of rows that repeat a kept id one stays. Only rows that may go, as a Bloom
    filter of fixed size tells, are joined; all others pass where they lie.
    """
    spark = session(docs)
    found = Stage(link(docs, cfg, id_col, text_col), "members").df.where("doc_id is not null")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct()
    again = found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("id"))
    wanted = may_contain(gone.unionByName(again).distinct())

    @F.pandas_udf("boolean")
    def perhaps(ids: pd.Series) -> pd.Series:
        return pd.Series(wanted.value.perhaps(ids.fillna(0).to_numpy().astype(np.int64)) & ids.notna().to_numpy())

    marked = docs.withColumn("__perhaps", perhaps(F.col(id_col).cast("long")))
    sure = marked.where("not __perhaps").drop("__perhaps")
    rest = marked.where("__perhaps").drop("__perhaps").join(gone.withColumnRenamed("id", id_col), id_col, "left_anti").dropDuplicates([id_col])
    return sure.unionByName(rest.select(*docs.columns))
