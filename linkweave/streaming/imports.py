"""Incremental work: resumable imports, progress by platform, completions per hour."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def resumable_import(rows: DataFrame, results_path: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], key: str = "row_id") -> StreamingQuery:
    """Apply ``work`` to streamed rows that have no result yet and append; the checkpoint gives resumption.

    A batch that is run again after a failure finds its rows done, so a key gets one result.
    """

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(results_path)
        new = df.dropDuplicates([key])
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            new = new.join(spark.read.parquet(results_path).select(key), key, "left_anti")
        work(new).write.mode("append").parquet(results_path)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(events: DataFrame) -> DataFrame:
    """Current state of each platform: events, last moment and the value it had."""
    return events.groupBy("source").agg(F.count("*").alias("n"), F.max("created_at").alias("last_at"), F.max_by("k", "created_at").alias("last_k"))


def per_hour(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Completions per hour; rows later than the watermark drop."""
    return events.withWatermark("created_at", late).groupBy(F.window("created_at", "1 hour")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "n")
