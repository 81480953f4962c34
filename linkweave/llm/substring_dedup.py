"""Repeated passages by seed and extend: winnowed anchors, their surroundings, and the passages that earlier documents hold.

Every run of ``length`` words (a window) has one anchor: the least hash of its
runs of ``seed`` words. It depends on the window's words only, so equal windows
meet at equal anchors. Windows in a row with one anchor form a span; documents
join on anchors, and a span is extended to both sides as far as its words go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel
from .sparkutil import Stage, output, session, whole_rows
from .textkernel import EXACT, NON_SPACE, mix


@dataclass(frozen=True)
class Config:
    """Passages of ``length`` words and more count; anchors have ``seed`` words."""

    length: int = 50
    seed: int = 16


def _prefix(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums from which the hash of any run of words follows, and inverse powers."""
    up, down = textkernel._power_tables(len(hashes))
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return total, down


def _run_hashes(sums: tuple[np.ndarray, np.ndarray], start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    total, down = sums
    return mix((total[start + size] - total[start]) * down[start] + np.asarray(size).astype(np.uint64))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first least value of each ``width`` in a row."""
    low, at, done = values, np.arange(len(values)), 1
    while done < width:
        step = min(done, width - done)
        right = low[step:] < low[: len(low) - step]
        at = np.where(right, at[step:], at[: len(at) - step])
        low = np.where(right, low[step:], low[: len(low) - step])
        done += step
    return at


def spans(hashes: np.ndarray, row: np.ndarray, cfg: Config) -> tuple[np.ndarray, ...]:
    """Spans of rows of words: row, first window, number of windows, anchor and the hash of all the span's words.

    ``row`` has each row's first word and the end of the last.
    """
    n = len(hashes)
    none = np.zeros(0, np.int64)
    if n < cfg.length:
        return none, none, none, none, none
    sums = _prefix(hashes)
    seeds = _run_hashes(sums, np.arange(n - cfg.seed + 1), cfg.seed)
    anchor = _least(seeds, cfg.length - cfg.seed + 1)
    of = np.repeat(np.arange(len(row) - 1), np.diff(row))
    starts = np.arange(len(anchor))
    whole = of[starts] == of[starts + cfg.length - 1]
    starts, anchor = starts[whole], anchor[whole]
    if not len(starts):
        return none, none, none, none, none
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    start = starts[first]
    owner = of[start]
    return owner, start - row[owner], count, seeds[anchor[first]].view(np.int64), _run_hashes(sums, start, count + (cfg.length - 1)).view(np.int64)


_SPANS = pa.schema([("doc", pa.int64()), ("copy", pa.int64()), ("start", pa.int32()), ("m", pa.int32()), ("anchor", pa.int64()), ("span", pa.int64())])


def _spans_of(texts: DataFrame, cfg: Config) -> DataFrame:
    """All spans of ``doc, copy, text``."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in textkernel.words(batch.column(2), NON_SPACE, EXACT):
                owner, start, m, anchor, span = spans(w.hashes, w.row, cfg)
                if len(owner):
                    at = pa.array(owner + w.first)
                    yield output(_SPANS, doc=batch.column(0).take(at), copy=batch.column(1).take(at), start=start, m=m, anchor=anchor, span=span)

    return texts.mapInArrow(find, "doc long, copy long, start int, m int, anchor long, span long")


def _windows_of(texts: DataFrame, wanted: DataFrame, cfg: Config) -> DataFrame:
    """The windows of wanted spans: ``anchor, span, first, k`` and the hash of the ``k``-th window's words."""
    asked = wanted.groupBy("doc", "copy").agg(F.collect_list(F.struct("anchor", "span", "first", "start", "m")).alias("asked"))  # at most the spans of one text
    one = texts.join(asked, ["doc", "copy"]).select("text", "asked")
    schema = pa.schema([("anchor", pa.int64()), ("span", pa.int64()), ("first", pa.int64()), ("k", pa.int32()), ("window", pa.int64())])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in textkernel.words(batch.column(0), NON_SPACE, EXACT):
                sums = _prefix(w.hashes)
                rows = batch.column(1).slice(w.first, w.last - w.first)
                flat = rows.flatten()
                of = np.repeat(np.arange(len(rows)), pc.list_value_length(rows).to_numpy(zero_copy_only=False))
                fields = {name: flat.field(name).to_numpy(zero_copy_only=False) for name in ("anchor", "span", "first", "start", "m")}
                m = fields["m"].astype(np.int64)
                at = np.repeat(np.arange(len(m)), m)
                k = np.arange(len(at)) - np.repeat(np.cumsum(m) - m, m)
                window = _run_hashes(sums, w.row[of][at] + fields["start"][at] + k, cfg.length).view(np.int64)
                yield output(schema, anchor=fields["anchor"][at], span=fields["span"][at], first=fields["first"][at], k=k, window=window)

    return one.mapInArrow(extend, "anchor long, span long, first long, k int, window long")


def repeats(docs: DataFrame, cfg: Config = Config(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Windows of each text that also start in a document with a smaller id: ``doc, copy`` and ``runs`` of first window and number.

    ``copy`` is a hash of the text, for ids that repeat. A written table.
    """
    texts = _keyed(docs, id_col, text_col).where("doc is not null and text is not null")
    held = Stage(_spans_of(texts, cfg), "spans")
    # equal spans are one class; its first document is the least, wherever an anchor has two documents
    classes = held.df.groupBy("anchor", "span").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.min(F.struct("doc", "copy", "start", "m")).alias("at"))
    classes = Stage(classes, "span-classes")
    shared = classes.df.groupBy("anchor").agg(F.min("first").alias("least"), F.max("last").alias("most"), F.count("*").alias("kinds")).where("least < most").select("anchor", "kinds")
    met = Stage(classes.df.join(shared, "anchor"), "seeds")
    classes.drop()

    # an anchor with one span needs no extension; others are extended window by window
    alike = met.df.where("kinds = 1").select("anchor", "span", F.col("at.m").alias("m"), F.array(F.struct(F.lit(0).alias("k"), "first")).alias("firsts"))
    mixed = met.df.where("kinds > 1").select("anchor", "span", "first", "at.doc", "at.copy", "at.start", "at.m")
    windows = Stage(_windows_of(texts, mixed, cfg), "windows")
    least = windows.df.groupBy("anchor", "window").agg(F.min("first").alias("least"))
    # windows in a row with one least document are noted once
    noted = windows.df.join(least, ["anchor", "window"]).groupBy("anchor", "span").agg(F.array_sort(F.collect_list(F.struct("k", F.col("least").alias("first")))).alias("f"))
    changes = F.expr("filter(f, (x, i) -> i = 0 or x.first <> get(f, i - 1).first)")
    extended = noted.select("anchor", "span", F.size("f").alias("m"), changes.alias("firsts"))
    seen = Stage(alike.unionByName(extended), "extended")
    met.drop()
    windows.drop()
    ends = F.expr("transform(firsts, (x, i) -> struct(start + x.k as a, coalesce(get(firsts, i + 1).k, m) - x.k as n, x.first as first))")
    runs = held.df.drop("m").join(seen.df, ["anchor", "span"]).select("doc", "copy", F.filter(ends, lambda x: x["first"] < F.col("doc")).alias("runs")).where("size(runs) > 0")
    found = Stage(runs.groupBy("doc", "copy").agg(F.flatten(F.collect_set("runs")).alias("runs")).select("doc", "copy", F.expr("transform(runs, x -> struct(x.a as a, x.n as n))").alias("runs")), "repeats")
    held.drop()
    seen.drop()
    return found.df


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.xxhash64(F.col(f"`{text_col}`")).alias("copy"), F.col(f"`{text_col}`").alias("text"))


def remove(docs: DataFrame, cfg: Config = Config(), id_col: str = "doc_id", text_col: str = "text", rows: bool = False) -> DataFrame:
    """Every row's text without the words of passages that documents with a smaller id hold.

    Words are runs of non-white-space. A word goes if a window of ``cfg.length``
    words that covers it also starts in a document with a smaller id; windows
    are judged on the input. Returns the id, ``n_words``, ``n_removed``,
    ``kept_sha256`` (kept words joined by one space) and ``kept``, that text, with
    the whole row as the struct ``row`` if asked for. Null and empty texts have no
    words; a row with a null id neither loses words nor takes them from others;
    rows that repeat an id take none from each other. A repeated passage within
    one document stays.
    """
    session(docs)
    found = repeats(docs, cfg, id_col, text_col)
    every, _ = whole_rows(docs, id_col, text_col, rows)
    keyed = every.withColumns({"__doc": F.col("__id").cast("long"), "__copy": F.xxhash64("__text")})
    met = keyed.join(found.select(F.col("doc").alias("__doc"), F.col("copy").alias("__copy"), "runs"), ["__doc", "__copy"], "left").drop("__doc", "__copy")
    kind = {f.name: f.dataType.simpleString() for f in met.schema}
    ddl = f"__id {kind['__id']}, n_words long, n_removed long, kept_sha256 string, kept string" + (f", row {kind['row']}" if rows else "")
    others = ["__id", *(["row"] if rows else [])]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("runs")
            for w in textkernel.words(batch.column(batch.schema.get_field_index("__text")), NON_SPACE, EXACT):
                runs = batch.column(at).slice(w.first, w.last - w.first).to_pylist()
                data = w.raw.tobytes()
                counts, removed, kept = [], [], []
                for i, row_runs in enumerate(runs):
                    own = w.of(i)
                    starts, ends = w.starts[own], w.ends[own]
                    keep = np.ones(len(starts), bool)
                    if row_runs:
                        edge = np.zeros(len(starts) + 1, np.int64)
                        a = np.fromiter((r["a"] for r in row_runs), np.int64, len(row_runs))
                        n = np.fromiter((r["n"] for r in row_runs), np.int64, len(row_runs))
                        np.add.at(edge, a, 1)
                        np.add.at(edge, a + n + cfg.length - 1, -1)
                        keep = np.cumsum(edge[:-1]) == 0
                    counts.append(len(keep))
                    removed.append(int(len(keep) - keep.sum()))
                    kept.append(b" ".join(data[s:e] for s, e in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)))
                made = {"n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept]), "kept": pa.array(kept, pa.binary()).cast(pa.string())}
                columns = {c: batch.column(batch.schema.get_field_index(c)).slice(w.first, w.last - w.first) for c in others}
                made = {"__id": columns["__id"], **made, **({"row": columns["row"]} if rows else {})}
                yield pa.RecordBatch.from_arrays(list(made.values()), names=list(made))

    return met.mapInArrow(cut, ddl).withColumnRenamed("__id", id_col)
