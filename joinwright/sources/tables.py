"""Tables from files, logs and clients."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from joinwright.operators.profile import convert_numeric_columns


def read_csv(spark: SparkSession, path: str, coerce: bool = False, exclude: list[str] = (), multi_line: bool = True) -> DataFrame:
    """All columns as texts; with ``coerce`` numbers are found from the data. Quoted fields may go on over several lines, for
    which a file is read by one task; without ``multi_line``, for files known to have no such field, several tasks read it."""
    df = spark.read.csv(path, header=True, multiLine=multi_line, escape='"')
    return convert_numeric_columns(df, exclude) if coerce else df


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share, which ``spark.checkpoint.dir`` names; local
    sessions without one get a folder of this machine. What is written there stays until the folder is cleared."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="joinwright-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


#: (bytes up to which, rows read); the last entry holds for anything larger.
TIERS = ((50 << 20, None), (100 << 20, 10_000), (None, 5_000))


def head_rows(size: int) -> int | None:
    return next(rows for limit, rows in TIERS if limit is None or size < limit)


def read_head(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file whole, or its first rows if it is large; those of the file's beginning, which a limit takes first."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(fs_path).getLength()
    rows, df = head_rows(size), read_csv(spark, path)
    return df if rows is None else df.limit(rows)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; malformed ones are left out."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def append_log(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def replace_entries(log: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Entries that the new ones share a key with are replaced, by the last of several; nothing is inserted. Which one is
    the last follows the order of the rows of ``new``, so its files must be read in order."""
    rest = [c for c in log.columns if c not in keys]
    fresh = new.select(*keys, F.struct(*rest).alias("__new"), F.monotonically_increasing_id().alias("__at"))
    fresh = fresh.groupBy(*keys).agg(F.max_by("__new", "__at").alias("__new"))
    joined = log.join(fresh, keys, "left")
    return joined.select(*[F.col(c) if c in keys else F.when(F.col("__new").isNotNull(), F.col("__new")[c]).otherwise(F.col(c)).alias(c) for c in log.columns])


def failed_entries(log: DataFrame) -> DataFrame:
    return log.where("returncode <> 0 or error is not null")


def without_candidates(log: DataFrame) -> DataFrame:
    return log.where(F.size("selected_candidate_tables") == 0)


def successes(log: DataFrame) -> DataFrame:
    return log.where("status = 'success' and result.status = 'success'")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


class RowClient(Protocol):
    """What a service of rows must offer: a page of a table's rows as dictionaries."""

    def __call__(self, table_id: str, offset: int, limit: int) -> list[Mapping]: ...


class RowSource(DataSource):
    """``spark.read.format("joinwright_rows")`` with options ``table_id, page, max_rows, tasks`` and a client set by
    ``register_rows``. Without ``max_rows`` the whole table is read: of ``tasks`` tasks each reads every so manieth page
    until nothing is left; a service that gives fewer rows than asked for is asked again from the rows received. A page that fails fails its task, which Spark tries again, so that no table comes back
    incomplete without a sign; a table that the client doesn't know (``KeyError``) has no rows."""

    client: Callable = staticmethod(lambda table_id, offset, limit: [])

    @classmethod
    def name(cls) -> str:
        return "joinwright_rows"

    def reader(self, schema) -> DataSourceReader:
        return _RowReader(self.client, self.options, schema.fieldNames())


class _RowReader(DataSourceReader):
    def __init__(self, client: Callable, options: Mapping, names: list[str]):
        self.client, self.names, self.table_id = client, names, options["table_id"]
        self.page, self.tasks = int(options.get("page", 1000)), int(options.get("tasks", 8))
        self.most = int(options["max_rows"]) if "max_rows" in options else None

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.tasks)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        offset = partition.value * self.page
        while self.most is None or offset < self.most:
            end = offset + self.page if self.most is None else min(offset + self.page, self.most)
            at = offset
            while at < end:
                try:
                    rows = self.client(self.table_id, at, end - at)[: end - at]
                except KeyError:  # the service has no such table
                    return
                if not rows:
                    return
                for row in rows:
                    yield tuple(None if row.get(n) is None else str(row[n]) for n in self.names)
                at += len(rows)
            offset += self.tasks * self.page


def register_rows(spark: SparkSession, client: RowClient) -> None:
    spark.dataSource.register(type("Rows", (RowSource,), {"client": staticmethod(client)}))


class TableProvider(Protocol):
    def load(self, table_id: str) -> DataFrame: ...

    def names(self) -> list[str]: ...


class DirectoryProvider:
    """``<base>/<name>/rows.csv`` or ``<base>/<name>.parquet``, found by cleaned names; the last of equal ones wins."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.base)
        entries = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
        self._entries = sorted(e.getPath().getName() for e in entries)

    def names(self) -> list[str]:
        return [e.removesuffix(".parquet") for e in self._entries]

    def resolve(self, name: str) -> str:
        cleaned = {clean_table_name(e.removesuffix(".parquet")): e for e in self._entries}
        exact = {e.removesuffix(".parquet"): e for e in self._entries}
        found = cleaned.get(clean_table_name(name)) or exact.get(name)
        if found is None:
            raise KeyError(f"no table {name!r}; there are {self.names()}")
        return found

    def load(self, table_id: str) -> DataFrame:
        entry = self.resolve(table_id)
        return self.spark.read.parquet(f"{self.base}/{entry}") if entry.endswith(".parquet") else read_csv(self.spark, f"{self.base}/{entry}/rows.csv", coerce=True, multi_line=True)


def clean_table_name(name: str) -> str:
    return re.sub(r"\s+\d+$", "", name.strip().lower())

