"""Sources and sinks: collection files, fingerprints, snapshots and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from linkweave.operators.staging import staged


def read_collection(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A collection export: header, quoted, UTF-8; short rows end in nulls; no rows are an error."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', mode="PERMISSIVE", schema=schema, enforceSchema=True)
    if rows.isEmpty():
        raise ValueError("the collection file has no rows")
    return rows


def row_keys(rows: DataFrame, id_col: str) -> DataFrame:
    """Rows with their number in file order, from 1, and a stable key ``id:number`` or ``row-number:number``.

    Rows are numbered within their part of the file, and parts start at the sum of
    those before them; the numbers are written once, so a later read agrees.
    """
    at = F.monotonically_increasing_id()
    held = staged(rows.select("*", F.shiftright(at, 33).alias("__part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("__at")))
    counts = held.groupBy("__part").agg(F.count("*").alias("n"))
    before = counts.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("before"))  # a row per part
    numbered = held.join(F.broadcast(before), "__part").select(*(F.col(f"`{c}`") for c in rows.columns), (F.col("__at") + F.col("before") + 1).alias("row_index"))
    own = F.nullif(F.trim(F.col(id_col)), F.lit(""))
    return numbered.withColumn("row_key", F.concat_ws(":", F.coalesce(own, F.concat(F.lit("row-"), F.col("row_index"))), F.col("row_index")))


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 and size of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def merge_snapshot(existing: DataFrame, changed: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """A new snapshot with changed rows in place of existing ones, and rejected rows whose key comes twice in the change."""
    twice = changed.groupBy(*key).count().where("count > 1").drop("count")
    good = changed.join(twice, key, "left_anti")
    return existing.join(good, key, "left_anti").unionByName(good), changed.join(twice, key, "left_semi")


def export(df: DataFrame, path: str, kind: str) -> None:
    """Write as json or csv; other kinds are an error."""
    if kind not in ("json", "csv"):
        raise ValueError(f"unknown export format {kind}")
    df.write.format(kind).options(**({"header": True} if kind == "csv" else {})).save(path)


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows without a result yet."""
    return rows.join(done.select(key), key, "left_anti")
