"""Merkle manifest of a dataset: a tree of SHA-256 hashes per group of rows, proofs, and folding of changed rows.

Nodes are bytes here; a parent hashes its children's lowercase hex text. While
a run of children is hashed, the hash object is copied before each of them. A
changed child is folded into its parent by resuming the copy before its slot
with the new child and the siblings to its right; what lies left of it is not
hashed again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sparkutil import Stage, partitions, session

ARITY = 8
#: Levels that one task builds from a block of ``ARITY ** HEIGHT`` consecutive nodes.
HEIGHT = 3
#: One level of a path: the node's place in its run, and the run's digests one after another.
PATH = "array<struct<slot: int, run: binary>>"


class Run:
    """A run of siblings, with the copied state of their parent's hash before each slot."""

    __slots__ = ("digest", "others", "run", "states", "tails")

    def __init__(self, children: Sequence[bytes]):
        texts = [c.hex().encode() for c in children]
        state = hashlib.sha256()
        self.states = []
        for text in texts:
            self.states.append(state.copy())
            state.update(text)
        self.digest = state.digest()
        self.run = b"".join(children)
        self.tails = [b"".join(texts[k + 1 :]) for k in range(len(texts))]
        self.others = [b"".join(texts[:k]) + self.tails[k] for k in range(len(texts))]

    def fold(self, slot: int, child: bytes) -> bytes:
        """The parent's digest with ``child`` in ``slot``."""
        state = self.states[slot].copy()
        state.update(child.hex().encode() + self.tails[slot])
        return state.digest()


def grow(nodes: Sequence[bytes], levels: int) -> list[list[Run]]:
    """The runs of each of ``levels`` levels above ``nodes``."""
    grown = []
    for _ in range(levels):
        grown.append([Run(nodes[k : k + ARITY]) for k in range(0, len(nodes), ARITY)])
        nodes = [run.digest for run in grown[-1]]
    return grown


def split(run: bytes) -> list[bytes]:
    return [run[k : k + 32] for k in range(0, len(run), 32)]


def canonical(columns: Sequence[str]) -> Column:
    """Text of a row: of each column ``-`` if null, else its UTF-8 byte count, a colon and its value."""

    def part(name: str) -> Column:
        value = F.col(f"`{name}`").cast("string")
        return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.concat(*map(part, columns))


def leaves(docs: DataFrame, columns: Sequence[str], tree: str, order: str, changed: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """``tree, ordinal, leaf`` and ``changed_leaf`` of each row; the latter is null where nothing changes.

    ``tree`` is ``-`` for a null group and else ``=`` with its value, so that
    null comes first in byte order. ``changed`` has new values for columns of the
    rows that ``when`` selects.
    """
    hashed = lambda c: F.unhex(F.sha2(c, 256))
    picked = docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*columns, tree, order])))
    made = {"__tree": F.coalesce(F.concat(F.lit("="), F.col(f"`{tree}`").cast("string")), F.lit("-")), "__ordinal": F.col(f"`{order}`").cast("long"), "__leaf": hashed(canonical(columns)), "__do": F.coalesce(when, F.lit(False)) if when is not None else F.lit(False)}
    kept = picked.withColumns(made)
    after = kept.withColumns({c: F.when(F.col("__do"), value).otherwise(F.col(f"`{c}`")) for c, value in (changed or {}).items()})
    return after.select(F.col("__tree").alias("tree"), F.col("__ordinal").alias("ordinal"), F.col("__leaf").alias("leaf"), F.when(F.col("__do"), hashed(canonical(columns))).alias("changed_leaf"))


def _placed(rows: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """``rows`` with ``pos``, their place from 0 in their tree in the order of ``by``, and ``size``, their tree's rows, as a written table.

    Rows are written with a number each, dealt by ranges, and counted per range
    and tree; equal rows are told apart by that number, so no key is hot. A
    range holds parts of few trees: the counts are ranges and trees together.
    """
    numbered = Stage(rows.withColumn("__k", F.monotonically_increasing_id()), f"{name}-rows")
    ranged = numbered.df.repartitionByRange(partitions(rows.sparkSession), "tree", *by, "__k").sortWithinPartitions("tree", *by, "__k")
    at = F.monotonically_increasing_id()
    held = Stage(ranged.select(*rows.columns, F.shiftright(at, 33).alias("__range"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("__at")), f"{name}-ranges")
    numbered.drop()
    counts = held.df.groupBy("tree", "__range").agg(F.count("*").alias("n"), F.min("__at").alias("low"))
    own = Window.partitionBy("tree")
    earlier = F.coalesce(F.sum("n").over(own.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = counts.select("tree", "__range", "low", earlier.alias("first"), F.sum("n").over(own).alias("size"))
    return held.df.join(before, ["tree", "__range"]).select(*rows.columns, (F.col("__at") - F.col("low") + F.col("first")).alias("pos"), "size")


def _depth(size: Column) -> Column:
    """Levels between ``size`` leaves and their top."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.lit(0), lambda d, k: F.when(F.pow(F.lit(float(ARITY)), (k - 1).cast("double")) < size, k).otherwise(d))


def _levels(turn: int, height: int) -> Column:
    """Levels that the blocks of a turn build: none once a tree has one node."""
    return F.greatest(F.lit(0), F.least(F.lit(height), F.col("depth") - turn * height))


def _raised(nodes: DataFrame, turn: int, height: int) -> DataFrame:
    """The nodes above blocks of consecutive ``tree, depth, pos, leaf``."""

    def top(table: pa.Table) -> pa.Table:
        place = sorted(range(table.num_rows), key=table.column("pos").to_pylist().__getitem__)
        found = table.column("leaf").to_pylist()
        digests = [found[k] for k in place]
        grown = grow(digests, table.column("levels")[0].as_py())
        made = grown[-1][0].digest if grown else digests[0]
        return table.slice(0, 1).select(["tree", "depth", "block"]).append_column("leaf", pa.array([made], pa.binary()))

    blocks = nodes.select("tree", "depth", F.floor(F.col("pos") / ARITY**height).alias("block"), "pos", "leaf", _levels(turn, height).alias("levels"))
    return blocks.groupBy("tree", "block").applyInArrow(top, "tree string, depth int, block long, leaf binary").withColumnRenamed("block", "pos")


def _lowered(nodes: DataFrame, paths: DataFrame, turn: int, height: int) -> DataFrame:
    """The path of each node from the path of its block's top."""

    def spread(left: pa.Table, right: pa.Table) -> pa.Table:
        place = sorted(range(left.num_rows), key=left.column("pos").to_pylist().__getitem__)
        left = left.take(place)
        above = right.column("path")[0].as_py()
        grown = grow(left.column("leaf").to_pylist(), left.column("levels")[0].as_py())
        made = [[{"slot": (k // ARITY**level) % ARITY, "run": runs[k // ARITY ** (level + 1)].run} for level, runs in enumerate(grown)] + above for k in range(left.num_rows)]
        kind = pa.list_(pa.struct([("slot", pa.int32()), ("run", pa.binary())]))
        return left.select(["tree", "pos"]).append_column("path", pa.array(made, kind))

    blocks = nodes.select("tree", F.floor(F.col("pos") / ARITY**height).alias("block"), "pos", "leaf", _levels(turn, height).alias("levels"))
    tops = paths.withColumnRenamed("pos", "block")
    return blocks.groupBy("tree", "block").cogroup(tops.groupBy("tree", "block")).applyInArrow(spread, f"tree string, pos long, path {PATH}")


def _tower(nodes: DataFrame, height: int, name: str) -> list[Stage]:
    """Written tables of nodes, each the tops of the blocks of the one before; the last has one node per tree."""
    tower = [Stage(nodes, f"{name}-0")]
    deepest = tower[0].df.agg(F.max("depth")).first()[0] or 0
    for turn in range(-(-deepest // height)):
        tower.append(Stage(_raised(tower[-1].df, turn, height), f"{name}-{turn + 1}"))
    return tower


def _paths(tower: list[Stage], tops: DataFrame, height: int, last: int) -> DataFrame:
    """Paths of the nodes of level ``last`` of ``tower`` from those of its tops."""
    paths = tops
    for turn in range(len(tower) - 2, last - 1, -1):
        paths = _lowered(tower[turn].df, paths, turn, height)
    return paths


def _folded(blocks: DataFrame, tops: DataFrame, extra: Sequence[str]) -> DataFrame:
    """Every leaf with its subroot, root, proof and folded root."""

    def fold(left: pa.Table, right: pa.Table) -> pa.Table:
        place = sorted(range(left.num_rows), key=left.column("pos").to_pylist().__getitem__)
        left = left.take(place)
        digests = left.column("leaf").to_pylist()
        grown = grow(digests, left.column("levels")[0].as_py())
        path, own = right.column("path")[0].as_py(), right.column("own")[0].as_py()
        above = [(Run(split(p["run"])), p["slot"]) for p in path]
        top = grown[-1][0].digest if grown else digests[0]
        tops = [top] + [run.digest for run, _ in above]
        shared = b"".join(run.others[slot] for run, slot in above)
        lower: dict[int, bytes] = {}  # siblings above the first level, once per run
        proofs, folded = [], []
        for k, (leaf, changed) in enumerate(zip(digests, left.column("changed_leaf").to_pylist(), strict=True)):
            first, node = k // ARITY, leaf if changed is None else changed
            if first not in lower:
                lower[first] = b"".join(runs[k // ARITY ** (level + 2)].others[(k // ARITY ** (level + 1)) % ARITY] for level, runs in enumerate(grown[1:])) + shared
            proof = hashlib.sha256(grown[0][first].others[k % ARITY] if grown else b"")
            proof.update(lower[first])
            proofs.append(proof.hexdigest())
            for level, runs in enumerate(grown):
                node = runs[k // ARITY ** (level + 1)].fold((k // ARITY**level) % ARITY, node)
            for run, slot in above:
                node = run.fold(slot, node)
            folded.append(node.hex())
        root, n = tops[-1].hex(), left.num_rows
        made = {"leaf": [d.hex() for d in digests], "subroot": [tops[own].hex()] * n, "root": [root] * n, "proof_sha256": proofs, "folded_root": folded, "verified": [f == root for f in folded]}
        out = left.select(list(extra))
        for name, values in made.items():
            out = out.append_column(name, pa.array(values))
        return out

    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema}
    schema = "".join(f"{c} {kinds[c]}, " for c in extra) + "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return blocks.groupBy("tree", "block").cogroup(tops.groupBy("tree", "block")).applyInArrow(fold, schema)


def manifest(docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), tree: str = "lang", order: str = "doc_id", changed: dict[str, Column] | None = None, when: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """Leaf, subroot, root, proof and folded root of every row of ``docs``.

    A row is a leaf; the leaves of each value of ``tree`` are a tree in the order
    of ``order`` (null first, ties by the leaf's hash), in which every ``ARITY``
    consecutive nodes have a parent until one node is left, the subroot.
    Subroots, by value (null first, in byte order), make the root likewise.
    Returns ``ordinal`` (the value of ``order``), ``leaf``, ``subroot``, ``root``,
    ``proof_sha256`` (hash of the siblings from leaf to root), ``folded_root``
    (from the changed row, else the row itself, and the siblings) and
    ``verified`` (whether that is the root). All values may be null or empty, rows
    that repeat are leaves of their own; an empty table gives no rows. Other
    columns are ignored, ``columns`` may have any names.

    Only hashes are shuffled. A task builds ``height`` levels over
    ``ARITY ** height`` leaves at most, however large a tree is.
    """
    session(docs)
    placed = _placed(leaves(docs, columns, tree, order, changed, when), ("ordinal", "leaf"), "leaves")
    tower = _tower(placed.select("tree", _depth(F.col("size")).alias("depth"), "pos", "ordinal", "leaf", "changed_leaf"), height, "trees")
    subroots = tower[-1].df.select("tree", "leaf")
    every = _placed(subroots.select(F.lit("").alias("tree"), "leaf", F.col("tree").alias("of")), ("of",), "subroots")
    crown = _tower(every.select("tree", _depth(F.col("size")).alias("depth"), "pos", "leaf", "of"), height, "crown")

    high = _paths(crown, crown[-1].df.select("tree", "pos", F.array().cast(PATH).alias("path")), height, 0)
    tops = crown[0].df.join(high.drop("tree"), "pos").select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("pos"), "path")
    paths = _paths(tower, tops, height, 1)
    rooted = tops.select("tree", F.size("path").alias("crown"))
    heads = paths.join(rooted, "tree").select("tree", F.col("pos").alias("block"), "path", (F.size("path") - F.col("crown")).alias("own"))
    blocks = tower[0].df.select("tree", F.floor(F.col("pos") / ARITY**height).alias("block"), "pos", "ordinal", "leaf", "changed_leaf", _levels(0, height).alias("levels"))
    return _folded(blocks, heads, ("ordinal",))
