"""Small helpers shared by the operators: shared tables, streaming sums, Arrow output."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch handed to Python; long texts make short batches.
BATCH_BYTES = 16 << 20


def session(df: DataFrame) -> SparkSession:
    """The session of ``df`` with Arrow batches bounded in bytes, not only in rows."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, named by ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests) gets a folder of its own; on a
    cluster that would be lost on other machines, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-linkweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Stage:
    """A table written to the shared folder: it cuts lineage and survives lost executors."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/linkweave-{name}-{uuid.uuid4().hex}"
        schema = df.schema
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files once no later read needs them."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sum_blocks(df: DataFrame, most: int = 64, dtype: type = np.int64, packed: int = 0, finish: Callable[[np.ndarray], bytes] = np.ndarray.tobytes) -> DataFrame:
    """Sum equally long vectors of ``dtype`` by key; sums are int64, or what ``finish`` makes of them.

    ``df`` has ``key string, block binary``; each task has pre-summed its rows,
    so a key comes once per task. Rows are summed as they stream by: a task
    holds one vector for each of its keys, however many rows there are. Blocks
    compressed with zstd have ``packed`` values.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for key, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values = np.frombuffer(pa.decompress(block, packed * np.dtype(dtype).itemsize, "zstd") if packed else block, dtype)
                if key in total:
                    total[key] += values
                else:
                    total[key] = values.astype(np.int64)
        for key, values in total.items():
            yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.string()), "block": pa.array([finish(values)], pa.binary())})

    n = min(most, partitions(df.sparkSession))
    return df.repartition(n, "key").mapInArrow(add, "key string, block binary")


def output(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch of ``columns``, each cast to its type in ``schema``."""
    arrays = []
    for field in schema:
        values = columns[field.name]
        if isinstance(values, (pa.Array, pa.ChunkedArray)):
            values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
            arrays.append(values.cast(field.type))
        else:
            arrays.append(pa.array(values, field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def whole_rows(docs: DataFrame, id_col: str, text_col: str, rows: bool) -> tuple[DataFrame, bool]:
    """``__id, __text`` of ``docs`` and, if asked for, each input row as the struct ``row``."""
    picked = [F.col(id_col).alias("__id"), F.col(text_col).alias("__text")]
    return docs.select(*picked, *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if rows else [])), rows


def named(source: DataFrame, made: str, rows: bool) -> str:
    """DDL of what an Arrow function over ``whole_rows`` returns: id, ``made``, and the rows."""
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    return f"__id {kinds['__id']}, {made}" + (f", row {kinds['row']}" if rows else "")


def columns(batch: pa.RecordBatch, first: int, n: int) -> dict[str, pa.Array]:
    """The id and, if there, the rows of a run of a batch's rows."""
    return {name: batch.column(name).slice(first, n) for name in batch.schema.names if name != "__text"}
