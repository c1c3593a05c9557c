"""Bottom-k sketches that follow a stream: an extension, as sketches of parts merge into sketches of the whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.query import StreamingQuery

from joinwright.functions.keys import hash_prefix, normalize_key
from joinwright.operators.sketch import K_MAX, long_values


def merge_sketches(old: DataFrame | None, new: DataFrame, k: int = K_MAX) -> DataFrame:
    """The ``k`` smallest distinct hashes of each column of both; the same whatever was merged before."""
    both = new if old is None else old.unionByName(new)
    rank = F.row_number().over(W.partitionBy("table_id", "column").orderBy("hash"))
    return both.distinct().withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def sketch_stream(stream: DataFrame, table_id: str, columns: list[str], path: str, checkpoint: str, k: int = 1024) -> StreamingQuery:
    """Keeps the sketches of a stream's columns in ``<path>/batch=<n>``: each batch writes the merge of its hashes and
    the version before, under its own number, so a repeated batch overwrites its own result only."""
    names = ["table_id", "column", "hash"]

    def update(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = long_values(batch, table_id, columns).select("table_id", "column", hash_prefix(normalize_key(F.col("value"))).alias("hash"))
        old = spark.read.parquet(f"{path}/batch={number - 1}").select(*names) if number else None
        merge_sketches(old, fresh, k).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, at: str, key: str, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts by key and window; rows later than ``late`` are left out and windows close then."""
    stream = stream.withColumn(at, F.col(at).cast("timestamp"))
    return stream.withWatermark(at, late).groupBy(F.window(at, size), key).agg(F.count("*").alias("n"))
