"""A kept index of the sketches of a lake's columns.

Two Parquet tables in one folder. ``entries`` has the hashes of each sketch, in folders by batch and by hash prefix;
``columns`` has a row for each sketched column, and is written after a batch's entries. A table's latest batch is the one
that counts, so a batch whose writer was lost before it wrote ``columns`` is never seen, and no file is ever changed.
Adding a table reads that table alone; a query reads the prefixes of its own hashes alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from joinwright.operators import sketch

_ENTRIES = "table_id string, column string, hash string, batch string, prefix string"
_COLUMNS = "table_id string, column string, size long, token string, batch string"
#: Digits of a batch's number; batches are ordered as texts.
_DIGITS = 12


def _zeros(hash_: Column) -> Column:
    return F.length(F.regexp_extract(hash_, "^(0*)", 1))


def hash_prefix_class(hash_: Column) -> Column:
    """The number of a hash's leading zeros and its first other digit. Sketches hold the smallest hashes, so that a column
    of many values has all of its in a few classes of many zeros; plain prefixes would put those into one."""
    return F.concat_ws("-", _zeros(hash_).cast("string"), F.substring(hash_, _zeros(hash_) + 1, F.lit(1)))


def _cell(hash_: Column) -> Column:
    """The two digits after the prefix's. A tenth of a column's values lie in few prefixes, so one prefix may have a third
    of a batch: its cells are dealt to tasks, and adaptive execution joins them again where they are small."""
    return F.substring(hash_, _zeros(hash_) + 2, F.lit(2))


class SketchIndex:
    """``add``, ``remove`` and ``compact`` write; ``scores`` and ``propose`` give what ``operators.sketch`` gives for sketches
    of all tables made anew. Columns are sketched with ``k`` hashes at least, which an index must not change.

    Of two writers of one table the later batch number counts, and of equal numbers the greater random part. A table
    without columns, or an empty one, has no sketch. An index that isn't there is an empty one.
    """

    def __init__(self, spark: SparkSession, path: str, k: int = 1024):
        self.spark, self.path, self.k = spark, path.rstrip("/"), k

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _latest(self) -> DataFrame:
        """The rows of ``columns`` that count: those of each table's latest batch."""
        rows = self._read("columns", _COLUMNS)
        latest = rows.groupBy("table_id").agg(F.max("batch").alias("batch"))
        return rows.join(latest, ["table_id", "batch"], "left_semi")

    def columns(self) -> DataFrame:
        """``table_id, column, size, token, batch`` of every sketched column."""
        return self._latest().where("column is not null")

    def stale(self, tokens: Mapping[str, str]) -> list[str]:
        """Those of the named tables that are not in the index with this token (a version, or a time of change)."""
        asked = self.spark.createDataFrame(list(tokens.items()), "table_id string, token string")
        known = self._latest().where("token is not null").select("table_id", "token")
        return sorted(r.table_id for r in asked.join(known, ["table_id", "token"], "left_anti").collect())

    def _next(self) -> str:
        last = self._read("columns", _COLUMNS).agg(F.max("batch").alias("batch")).first().batch
        return f"{int(last[:_DIGITS]) + 1 if last else 0:0{_DIGITS}d}-{uuid.uuid4().hex}"

    def _write(self, entries: DataFrame | None, rows: DataFrame, batch: str) -> None:
        """Entries first: the rows of ``columns`` make them count. Their sizes are read from the batch as written."""
        if entries is not None:
            placed = entries.withColumn("prefix", hash_prefix_class(F.col("hash"))).withColumn("batch", F.lit(batch))
            placed.repartition(F.col("prefix"), _cell(F.col("hash"))).sortWithinPartitions("prefix", "hash").write.partitionBy("batch", "prefix").mode("append").parquet(f"{self.path}/entries")
            written = self._read("entries", _ENTRIES).where(F.col("batch") == batch)
            sizes = written.groupBy("table_id", "column").agg(F.count("*").alias("size"))
            rows = sizes.join(F.broadcast(rows), "table_id", "right")  # a row for each table of the batch
        else:
            rows = rows.withColumns({"column": F.lit(None).cast("string"), "size": F.lit(0).cast("long")})
        rows.select("table_id", "column", "size", "token", F.lit(batch).alias("batch")).coalesce(1).write.partitionBy("batch").mode("append").parquet(f"{self.path}/columns")

    def add(self, lake: Mapping[str, DataFrame], tokens: Mapping[str, str] | None = None) -> None:
        """Sketches these tables, in place of what the index has of them. ``tokens`` are kept for ``stale``."""
        values = None
        for table_id, df in lake.items():
            if df.columns:
                own = sketch.long_values(df, table_id)
                values = own if values is None else values.union(own)
        named = self.spark.createDataFrame([(t, (tokens or {}).get(t)) for t in lake], "table_id string, token string")
        if lake:
            self._write(None if values is None else sketch.bottom_k(values, k=self.k), named, self._next())

    def remove(self, table_ids: list[str]) -> None:
        if table_ids:
            self._write(None, self.spark.createDataFrame([(t, None) for t in table_ids], "table_id string, token string"), self._next())

    def entries(self) -> DataFrame:
        """``table_id, column, hash`` of the sketches that count."""
        live = self.columns().select("table_id", "batch").distinct()
        return self._read("entries", _ENTRIES).join(live, ["table_id", "batch"], "left_semi").select("table_id", "column", "hash")

    def scores(self, query: DataFrame) -> DataFrame:
        """``operators.sketch.scores`` of a query's sketch against the index. The query's prefixes, at most 256, are looked
        up first, so that the scan has them as a partition filter."""
        prefixes = [r.p for r in query.select(hash_prefix_class(F.col("hash")).alias("p")).distinct().collect()]
        live = self.columns()
        found = self._read("entries", _ENTRIES).where(F.col("prefix").isin(prefixes))
        found = found.join(live.select("table_id", "batch").distinct(), ["table_id", "batch"], "left_semi")
        return sketch.scores(query, found, live.select("table_id", "column", "size"))

    def propose(self, query: DataFrame, keys: list[str], k: int = 5, least: float = 0.1) -> DataFrame:
        """``operators.sketch.propose_join_columns`` against the index."""
        return sketch.top_columns(self.scores(sketch.bottom_k(sketch.long_values(query, "query", keys))), k, least)

    def compact(self) -> None:
        """Writes all that counts as one batch, without reading any table of the lake, and deletes the other batches. No
        other writer or reader may be at work."""
        batch = self._next()
        live = self._latest()
        tokens = live.where("column is not null or token is not null").select("table_id", "token").distinct()
        self._write(self.entries(), tokens, batch)
        manager = self.spark._jvm.org.apache.hadoop.fs
        for name in ("columns", "entries"):  # without their rows of ``columns``, entries do not count
            root = manager.Path(f"{self.path}/{name}")
            files = root.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
            for status in files.listStatus(root):
                if status.getPath().getName().startswith("batch=") and status.getPath().getName() != f"batch={batch}":
                    files.delete(status.getPath(), True)


def ranked(index: SketchIndex, query: DataFrame, keys: list[str]) -> DataFrame:
    """The tables of the index by their best column for any of the keys: ``table_id, best, rank``."""
    best = sketch.best_score(index.propose(query, keys))
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("best"), "table_id")))  # a row for each proposed table
