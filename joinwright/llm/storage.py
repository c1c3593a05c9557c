"""Intermediate tables in the folder that driver and executors share.

The folder is the one named in ``spark.checkpoint.dir``. Only where that is unset and no checkpoint
directory was set on the context (local sessions, tests) a folder on this machine is chosen, which in a
local session every task can see.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; also makes sure that ``DataFrame.checkpoint`` has one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if named:
        if current is None:
            context.setCheckpointDir(named)
        return named.rstrip("/")
    if current is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="joinwright-"))
        current = context.getCheckpointDir()
    return current.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which :func:`release` deletes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: later uses neither recompute it nor
    depend on the executors that made it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 2_000_000, size: int = 48 << 20) -> DataFrame:
    """``df`` marked to be broadcast if, counted now, it has at most so many rows and bytes of texts and lists; else
    as it is, to be joined by a shuffle."""
    wide = [F.octet_length(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    wide += [F.size(f"`{f.name}`") * 32 for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    found = df.agg(F.count("*").alias("n"), *[F.sum(w).alias(f"w{i}") for i, w in enumerate(wide)]).first()
    return F.broadcast(df) if found.n <= rows and sum(x or 0 for x in found[1:]) <= size else df


def rows_by_id(docs: DataFrame, ids: DataFrame, id_col: str = "id", having: bool = True) -> DataFrame:
    """The rows of ``docs`` that have one of the ids, or that have none. Few ids are broadcast, so that no text is
    shuffled; more are joined by a shuffle."""
    return docs.join(small(ids.select(id_col).distinct()), id_col, "left_semi" if having else "left_anti")


def release(spark: SparkSession) -> int:
    """Delete the tables that :func:`materialise` wrote in this application; their results must have been
    consumed. Returns how many were deleted."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    return len(paths)


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lowers how many rows a session sends to Python at once, from the default of 10,000: rows with texts of some KB make
    large batches, of which JVM and Python hold several."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
