"""Near-duplicate vectors by NN-descent.

1. Scale vectors to length one and collapse equal ones of a label.
2. Give each vector its best neighbours in a few buckets of random hyperplanes,
   drawn for each dimension; a bucket is split around its own mean until it fits a block.
3. Refine: each vector introduces its neighbours, and those that have it as a
   neighbour, to one another; every vector keeps its best.
4. Enlarge the lists of linked vectors to their whole component, compared in
   blocks of fixed size, so a saturated list loses no link.
5. Repeat 2 and 3 with new buckets until that links almost no more vectors, and an
   audit against brute force on a sample finds its links; an error says what is missing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import components
from .sparkutil import Stage, output, session
from .textkernel import mix

#: Neighbours kept, vectors compared in one block, hash tables and rounds of an attempt, and attempts at most.
NEIGHBOURS, BLOCK, TABLES, ROUNDS, MOST = 8, 256, 4, 1, 6
#: Sampled vectors of the audit at first and at most, the links it should hold, and the
#: least share of them that has to be found.
AUDIT, ENOUGH, RECALL = (200, 3200), 30, 0.97
#: Projections a bucket is split by at a time, and splits at most.
PLANES, LEVELS = 8, 12

_EDGE = pa.schema([("s", pa.int64()), ("t", pa.int64()), ("sim", pa.float64())])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose vector can be compared, scaled to length one."""
    schema = pa.schema([("id", pa.int64()), ("label", pa.int64()), ("unit", pa.binary()), ("hash", pa.int64())])
    for batch in batches:
        ids, labels, units, hashes = [], [], [], []
        for i, label, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if i is None or label is None or not v or None in v:
                continue
            x = np.asarray(v, float)
            top = np.abs(x).max()
            if not np.isfinite(top) or top == 0 or not np.isfinite(x).all():
                continue
            x = x / top
            x /= np.sqrt(x @ x)
            ids.append(i)
            labels.append(label)
            units.append(x.tobytes())
            hashes.append(int(np.add.reduce(mix(x.view(np.uint64) * np.arange(1, 2 * len(x), 2, dtype=np.uint64))).astype(np.int64)))
        yield output(schema, id=ids, label=labels, unit=units, hash=hashes)


def _matrix(units: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(units)).reshape(len(units), -1)


def _same_size(ids: np.ndarray, units: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Vectors of equal dimension together; others can't be compared."""
    sizes = np.array([len(u) for u in units])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield ids[at], _matrix([units[k] for k in at])


def _best(ids: np.ndarray, m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best partners of each row among the others."""
    sim = m @ m.T
    np.fill_diagonal(sim, -2)
    k = min(k, len(ids) - 1)
    if k < 1:
        return ids[:0], ids[:0], np.zeros(0)
    top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    rows = np.repeat(np.arange(len(ids)), k)
    return ids[rows], ids[top.ravel()], np.clip(sim[rows, top.ravel()], -1, 1)


def _groups(k: int):
    """Best partners within each group of rows, which has at most about BLOCK rows."""

    def run(table: pa.Table) -> pa.Table:
        ids, at = np.unique(table.column("id").to_numpy(), return_index=True)
        units = table.column("unit").take(pa.array(at)).to_pylist()
        parts = [_best(i, m, k) for i, m in _same_size(ids, units)]
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], schema=_EDGE)

    return run


def _trim(edges: DataFrame, k: int) -> DataFrame:
    near = Window.partitionBy("s").orderBy(F.desc("sim"), "t")
    return edges.groupBy("s", "t").agg(F.max("sim").alias("sim")).withColumn("r", F.row_number().over(near)).where(F.col("r") <= k).drop("r")


def _project(nodes: DataFrame, tables: range, level: int) -> DataFrame:
    """``id, t, p``: projections of each row on PLANES random directions, drawn for its table, dimension and level."""
    schema = pa.schema([("id", pa.int64()), ("t", pa.int32()), ("p", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, m in _same_size(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()):
                for t in tables:
                    planes = np.random.default_rng([1000 + t, m.shape[1], level]).standard_normal((PLANES, m.shape[1]))
                    yield output(schema, id=ids, t=np.full(len(ids), t, np.int32), p=list(m @ planes.T))

    return nodes.select("id", "unit").mapInArrow(run, "id long, t int, p array<double>")


def _seed(nodes: DataFrame, tables: range) -> DataFrame:
    """Rows with a bucket for each table: ``t, label, dim, code, part, id``.

    All rows of a label and dimension are one bucket at first. What is larger
    than a block is split by the signs of projections around the bucket's own
    mean, with as many bits as its own row count asks for, until it fits. Only
    a bucket that LEVELS splits leave too large is dealt into parts.
    """
    key = ["t", "label", "dim", "code"]
    split = nodes.select(F.explode(F.array(*(F.lit(t) for t in tables))).alias("t"), "label", F.length("unit").alias("dim"), F.lit(0).cast("long").alias("code"), "id")
    made = []
    for level in range(LEVELS + 1):
        size = split.groupBy(*key).agg(F.count("*").alias("size"))
        sized = Stage(split.join(size, key), "buckets").df
        large = sized.where(F.col("size") > BLOCK)
        if level == LEVELS or large.isEmpty():
            made.append(sized)
            break
        made.append(sized.where(F.col("size") <= BLOCK))
        near = large.join(_project(nodes, tables, level), ["id", "t"])
        means = near.groupBy(*key).agg(*(F.avg(F.col("p")[j]).alias(f"m{j}") for j in range(PLANES)))
        bits = F.ceil(F.log2(F.col("size") / 96))
        code = sum((F.when((F.col("p")[j] > F.col(f"m{j}")) & (bits > j), 1 << j).otherwise(0) for j in range(PLANES)), F.lit(0))
        split = near.join(means, key).select("t", "label", "dim", F.xxhash64("code", code).alias("code"), "id")
    rows = made[0]
    for more in made[1:]:
        rows = rows.unionByName(more)
    return rows.select(*key, F.pmod(F.xxhash64("id", "t"), F.ceil(F.col("size") / BLOCK).cast("long")).alias("part"), "id")


def _introduce(graph: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Edges between neighbours of a vector; those of a hub meet in groups of BLOCK / 2."""
    both = graph.select("s", "t").unionByName(graph.select(F.col("t").alias("s"), F.col("s").alias("t"))).unionByName(graph.select("s", F.col("s").alias("t"))).distinct()
    size = both.groupBy("s").agg(F.count("*").alias("size"))
    dealt = both.join(size, "s").withColumn("part", F.pmod(F.xxhash64("t", "s"), F.ceil(F.col("size") / (BLOCK // 2)).cast("long")))
    return dealt.join(nodes.select(F.col("id").alias("t"), "unit"), "t").select("s", "part", F.col("t").alias("id"), "unit").groupBy("s", "part").applyInArrow(_groups(k), "s long, t long, sim double")


def _pairs_in_blocks(members: DataFrame, least: float) -> DataFrame:
    """Links of each member of a component, compared block by block: ``id, links`` weighted by copies.

    ``members`` has ``g, id, size, unit``. A component of m members is cut into
    ceil(m / BLOCK) blocks, each pair of which is one group of two blocks.
    """
    count = members.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    cut = members.join(count, "g").withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = cut.withColumn("o", other).select("g", F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"), "b", "id", "size", "unit")
    schema = pa.schema([("id", pa.int64()), ("links", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        ids, size = table.column("id").to_numpy(), table.column("size").to_numpy()
        block = table.column("b").to_numpy()
        links = np.zeros(len(ids), np.int64)
        units = table.column("unit").to_pylist()
        dims = np.array([len(u) for u in units])
        for dim in np.unique(dims):
            left, right = np.flatnonzero((dims == dim) & (block == x)), np.flatnonzero((dims == dim) & (block == y))
            if not len(left) or not len(right):
                continue
            near = _matrix([units[k] for k in left]) @ _matrix([units[k] for k in right]).T >= least
            if x == y:
                np.fill_diagonal(near, False)
            links[left] += near @ size[right]
            if x != y:
                links[right] += near.T @ size[left]
        return pa.Table.from_arrays([pa.array(ids), pa.array(links)], schema=schema)

    return dealt.groupBy("g", "x", "y").applyInArrow(run, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def _audit(nodes: DataFrame, least: float) -> DataFrame:
    """Every link ``s, t`` of a fixed sample of vectors, by comparing the sample with all vectors.

    The sample grows from AUDIT[0] to AUDIT[1] vectors until it holds ENOUGH links.
    """
    sample = nodes.orderBy(F.xxhash64("id"), "id").select("id", "label", "unit").limit(AUDIT[1]).collect()
    found, links, first, last = [], 0, 0, AUDIT[0]
    while not found or links < ENOUGH and first < len(sample):
        found.append(Stage(_compare(nodes, sample[first:last], least), "audit").df)
        links += found[-1].count()
        first, last = last, min(4 * last, AUDIT[1])
    truth = found[0]
    for more in found[1:]:
        truth = truth.unionByName(more)
    return truth


def _compare(nodes: DataFrame, sample: list, least: float) -> DataFrame:
    """Links between the rows of ``sample`` and all of ``nodes``."""
    held = nodes.sparkSession.sparkContext.broadcast([tuple(r) for r in sample])
    schema = pa.schema([("s", pa.int64()), ("t", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels = np.array([r[0] for r in held.value], np.int64), np.array([r[1] for r in held.value], np.int64)
        sizes = np.array([len(r[2]) for r in held.value])
        for batch in batches:
            i, label = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            raw = batch.column(2).to_pylist()
            dims = np.array([len(u) for u in raw])
            for dim in np.unique(dims):
                at, mine = np.flatnonzero(dims == dim), np.flatnonzero(sizes == dim)
                m = _matrix([raw[k] for k in at])
                for q in np.split(mine, range(BLOCK, len(mine), BLOCK)) if len(mine) else ():
                    near = (_matrix([held.value[k][2] for k in q]) @ m.T >= least) & (labels[q][:, None] == label[at][None, :]) & (ids[q][:, None] != i[at][None, :])
                    a, b = np.nonzero(near)
                    yield output(schema, s=ids[q[a]], t=i[at[b]])

    return nodes.select("id", "label", "unit").mapInArrow(compare, "s long, t long")


def link(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links between vectors of one label whose cosine, in double precision, is at least ``threshold``.

    Returns one row per row of ``vectors``: the id, ``n_links long`` (other
    vectors linked directly), ``component_id long`` (smallest id reachable) and
    ``kept boolean`` (the id is its component's). Vectors that are null, empty,
    zero or have a null or non-finite component, and rows without a label, link
    with nothing; vectors of different dimension don't link. Labels of any type
    are compared as they are. Rows that repeat an id are one vector where they
    are equal, which doesn't link with itself; different vectors of one id are
    one node whose links are the sum of theirs. Each row gets a row. A
    null id has a null component and is not kept. Other columns are ignored.
    A search that still misses links after MOST attempts raises RuntimeError.
    """
    session(vectors)
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    usable = source.select("id", F.xxhash64("label").alias("label"), "v", F.col("label").isNotNull().alias("known")).where("known").mapInArrow(_units, "id long, label long, unit binary, hash long")
    # equal vectors of a label are one class, compared once and known by a number of its own; a repeated row counts once
    members = Stage(usable.distinct(), "units").df
    classes = members.groupBy("label", "hash", "unit").agg(F.min("id").alias("least"), F.count("*").alias("size"))
    nodes = Stage(classes.select(F.monotonically_increasing_id().alias("id"), "label", "unit", "hash", "size", "least"), "nodes").df
    bare = nodes.select("id", "label", "unit")

    truth = _audit(nodes, threshold)
    k, rounds = NEIGHBOURS, ROUNDS
    graph, merged = None, 0
    for attempt in range(MOST):
        dealt = _seed(bare, range(TABLES * attempt, TABLES * (attempt + 1))).withColumnRenamed("t", "table").join(bare.select("id", "unit"), "id")
        edges = dealt.select("table", "label", "dim", "code", "part", "id", "unit").groupBy("table", "label", "dim", "code", "part").applyInArrow(_groups(k), "s long, t long, sim double")
        edges = edges if graph is None else edges.unionByName(graph.df)
        graph = Stage(_trim(edges, k), "graph")
        for _ in range(rounds):
            labels = nodes.select("id", "label")
            met = _introduce(graph.df, nodes, k)
            same = met.join(labels.withColumnRenamed("id", "s"), "s").join(labels.select(F.col("id").alias("t"), F.col("label").alias("other")), "t").where("label = other").select("s", "t", "sim")
            graph = Stage(_trim(graph.df.unionByName(same), k), "graph")
        groups = components(graph.df.where(F.col("sim") >= threshold).select(F.col("s").alias("a"), F.col("t").alias("b")))
        seen = truth.join(groups.select(F.col("node").alias("s"), F.col("component").alias("x")), "s", "left").join(groups.select(F.col("node").alias("t"), F.col("component").alias("y")), "t", "left")
        row = seen.agg(F.count("*").alias("n"), F.count(F.when(F.col("x") == F.col("y"), 1)).alias("hit")).first()
        # vectors that joined a smaller one: it grows with links found, not with longer lists
        before, merged = merged, groups.where("node <> component").count()
        whole = row.hit >= RECALL * row.n
        if whole and attempt and merged - before <= (1 - RECALL) * merged:
            break
        if not whole:
            k, rounds = 2 * k, rounds + 1
    else:
        raise RuntimeError(f"links are missing after {MOST} attempts: {row.hit} of {row.n} links of the audit found, {merged - before} of {merged} linked vectors new in the last attempt")

    grouped = groups.withColumnRenamed("node", "id").join(nodes.select("id", "size", "unit"), "id").withColumnRenamed("component", "g")
    linked = _pairs_in_blocks(grouped, threshold)
    group = groups.select(F.col("node").alias("id"), "component").join(nodes.select("id", F.col("least").alias("own")), "id")
    named = group.join(group.groupBy("component").agg(F.min("own").alias("found")), "component").select("id", "found")
    per = nodes.join(linked, "id", "left").join(named, "id", "left")
    per = per.select("label", "hash", "unit", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("found", "least").alias("component_id"))
    of = members.join(per, ["label", "hash", "unit"]).select("id", "n_links", "component_id")
    # different vectors of one id, which are rare, join what they link
    many = of.groupBy("id").agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id"), F.max("component_id").alias("other"))
    bridged = components(of.join(many.where("component_id < other").select("id", F.col("component_id").alias("least")), "id").select(F.col("component_id").alias("a"), F.col("least").alias("b")))
    of = many.drop("other").join(bridged.select(F.col("node").alias("component_id"), F.col("component").alias("found")), "component_id", "left").select("id", "n_links", F.coalesce("found", "component_id").alias("component_id"))
    done = source.select("id").join(of, "id", "left")
    return done.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce(F.coalesce("component_id", "id") == F.col("id"), F.lit(False)).alias("kept"))
