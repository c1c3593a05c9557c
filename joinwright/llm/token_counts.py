"""Token totals by source, language and tokenizer version, maintained from signed deltas.

A batch of changes becomes signed contributions (documents and tokens: +1 and +n for an insert, -1 and -n for a delete, both
for a revised count), summed by key and stored under the batch's id. Totals are additive and their order doesn't matter:
the latest snapshot, which holds the totals of the batches that were compacted, plus the batches since.

A batch is written to a folder of its own and committed by renaming that to the batch's name, which fails if the name is
taken. So a repeated or retried batch, or one that two writers commit at once, counts once, and what a lost attempt left is
never read. Snapshots are numbered and committed in the same way.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from urllib.parse import quote, unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import BpeCodec

KEYS = ["source", "lang", "version"]
SUMS = "source string, lang string, version string, docs long, tokens long"


def count_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null text: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def count_words_and_marks(text: Column) -> Column:
    """Runs of ASCII letters and digits and of other characters that are not white space count one each."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[A-Za-z0-9]+|[^\x20\x09-\x0DA-Za-z0-9]+")), F.lit(0)).cast("long")


#: Version -> its count of a text: plain measures, which need no tokenizer.
VERSIONS: Mapping[str, object] = {"words-1": count_words, "marks-1": count_words_and_marks}


def counted(docs: DataFrame, versions: Mapping = VERSIONS, text_col: str = "text", id_col: str | None = None, codecs: Mapping[str, BpeCodec] | None = None) -> DataFrame:
    """One row for each row and version: ``source, lang, version, tokens``, after ``id_col`` if one is named. ``versions`` are
    native expressions, ``codecs`` tokenizers. Null and empty texts have 0 tokens, very long ones are counted whole,
    repeated rows count as often as they come, and other columns are ignored, whatever their names."""
    ids = [] if id_col is None else [F.col(id_col).alias("id")]
    texts = docs.select(*ids, F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), *[f(F.col(text_col)).alias(f"n{i}") for i, f in enumerate(versions.values())])
    names = list(versions)
    for version, codec in (codecs or {}).items():
        last = version == list(codecs)[-1]  # the text goes no further
        texts = codec.count(texts, [c for c in texts.columns if c != "text" or not last], "text", f"n{len(names)}")
        names.append(version)
    counts = F.array(*[F.struct(F.lit(v).alias("version"), F.col(f"n{i}").alias("tokens")) for i, v in enumerate(names)])
    return texts.select(*[F.col("id").alias(id_col) for _ in ids], "source", "lang", F.inline(counts))


def signed(rows: DataFrame, sign: int) -> DataFrame:
    """Contributions of ``counted`` rows that are inserted (1) or deleted (-1)."""
    return rows.select(*KEYS, F.lit(sign).cast("long").alias("docs"), (F.col("tokens") * sign).cast("long").alias("tokens"))


def revised(before: DataFrame, after: DataFrame) -> DataFrame:
    """Contributions of documents whose counts, or keys, change: the old are taken back and the new ones added."""
    return signed(before, -1).union(signed(after, 1))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


class TokenLedger:
    """Batches of contributions and snapshots of totals in a folder that all executors share. Its driver-side state is
    the list of the batches' ids."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self, path: str):
        return self._path(path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        files, path = self._files(self.path), self._path(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []

    def _publish(self, rows: DataFrame, name: str) -> bool:
        """Write the rows and give them the name; False if it is taken."""
        attempt = f"{self.path}/attempts/{uuid.uuid4().hex}"
        rows.write.parquet(attempt)
        context = self.spark.sparkContext
        jvm, target = context._jvm, self._path(f"{self.path}/{name}")
        files = self._files(self.path)
        files.mkdirs(target.getParent())
        options = context._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        source = files.makeQualified(self._path(attempt))
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), context._jsc.hadoopConfiguration()).rename(source, files.makeQualified(target), options)
        except Py4JJavaError:
            files.delete(source, True)
            if not files.exists(target):
                raise
            return False
        return True

    def batches(self) -> list[str]:
        """Ids of the committed batches."""
        return [unquote(n) for n in self._names("batches")]

    def committed(self, batch: str) -> bool:
        return self._files(self.path).exists(self._path(f"{self.path}/batches/{quote(batch, safe='')}"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add the contributions of a batch; False if it is committed already. Sums are made before the shuffle, so a source
        of most rows is no hot key. An empty batch is a batch."""
        return not self.committed(batch) and self._publish(_summed(changes), f"batches/{quote(batch, safe='')}")

    def _current(self) -> tuple[int, DataFrame, list[str]]:
        """Number of the latest snapshot, its totals and the batches that it doesn't hold."""
        number = max(map(int, self._names("snapshots")), default=0)
        totals, held = self.spark.createDataFrame([], SUMS), set()
        if number:
            snapshot = self.spark.read.schema(SUMS + ", batches array<string>").parquet(f"{self.path}/snapshots/{number}")
            held = set(snapshot.where("batches is not null").first().batches)
            totals = snapshot.where("batches is null").drop("batches")
        return number, totals, [b for b in self.batches() if b not in held]

    def _with(self, totals: DataFrame, batches: list[str]) -> DataFrame:
        if batches:
            totals = totals.union(self.spark.read.schema(SUMS).parquet(*[f"{self.path}/batches/{quote(b, safe='')}" for b in batches]))
        return _summed(totals).where("docs <> 0 or tokens <> 0")

    def compact(self) -> bool:
        """A new snapshot with the batches since the latest, if there are any; totals read it and what comes after.
        False if there was nothing to do, or another compaction was first."""
        number, totals, new = self._current()
        if not new:
            return False
        now = self._with(totals, new).withColumn("batches", F.lit(None).cast("array<string>"))
        mark = self.spark.createDataFrame([(None, None, None, 0, 0, self._held(number) + new)], SUMS + ", batches array<string>")
        return self._publish(now.unionByName(mark), f"snapshots/{number + 1}")

    def _held(self, number: int) -> list[str]:
        return list(self.spark.read.parquet(f"{self.path}/snapshots/{number}").where("batches is not null").first().batches) if number else []

    def totals(self) -> DataFrame:
        """``source, lang, version, docs, tokens`` over all committed batches. Null sources and languages are keys of their
        own; keys whose documents are all deleted have no row."""
        _, totals, new = self._current()
        return self._with(totals, new)
