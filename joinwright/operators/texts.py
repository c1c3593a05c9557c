"""Embeddings of texts, the texts that cover a group best, and summaries; models are pluggable.

The default embedder is a stand-in without a model: hashed character n-grams, the same on every machine. Its values are
not those of any language model.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Embedder = Callable[[list[str]], np.ndarray]
SIZE = 64


def hashed_ngrams(texts: list[str], size: int = SIZE, most_bytes: int = 1 << 20) -> np.ndarray:
    """Signed counts of character trigrams in ``size`` cells, scaled to length 1; blank texts are zeros. About ``most_bytes``
    are counted at once, or one longer text."""
    out, held, total, first = np.zeros((len(texts), size)), [], 0, 0
    for i, text in enumerate(texts):
        held.append(f"  {' '.join(text.lower().split())}  ".encode())
        total += len(held[-1])
        if total >= most_bytes or i + 1 == len(texts):
            out[first : i + 1] = _trigram_counts(held, size)
            held, total, first = [], 0, i + 1
    norms = np.linalg.norm(out, axis=1)
    norms[norms == 0] = 1
    return out / norms[:, None]


def _trigram_counts(texts: list[bytes], size: int) -> np.ndarray:
    data, lengths = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64), np.array([len(t) for t in texts])
    h = (data[:-2] * np.uint64(0x10001) + data[1:-1] * np.uint64(0x101) + data[2:]) * np.uint64(0x9E3779B97F4A7C15)
    within = np.ones(len(data), bool)  # trigrams that begin in the last two bytes of a text would reach into the next
    ends = np.cumsum(lengths)
    within[ends - 1] = within[ends - 2] = False
    row = np.repeat(np.arange(len(texts)), lengths)
    within &= np.repeat(lengths > 4, lengths)
    within, row = within[:-2], row[:-2]
    cell = row * size + ((h >> np.uint64(40)) % np.uint64(size)).astype(np.int64)
    sign = np.where((h >> np.uint64(39)) & np.uint64(1), 1.0, -1.0)
    return np.bincount(cell[within], sign[within], len(texts) * size).reshape(len(texts), size)


def embed(text: Column, embedder: Embedder = hashed_ngrams) -> Column:
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(embedder([(t or "").replace("\n", " ") for t in texts])))

    return run(text)


def _unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1)
    norms[norms == 0] = 1
    return vectors / norms[:, None]


def similarities(vectors: np.ndarray) -> np.ndarray:
    """Cosines, with 1 for zero norms and on the diagonal."""
    unit = _unit(vectors)
    found = unit @ unit.T
    np.fill_diagonal(found, 1.0)
    return found


def greedy_cover(vectors: np.ndarray, k: int, least: float = 1e-6, weights: np.ndarray | None = None, batch: int = 8) -> list[int]:
    """Up to ``k`` rows that together are most similar to all: first the one with the largest sum, then each time the
    one that raises the sum of best similarities most, until that is below ``least``. Ties go to the first. A row with a
    weight counts as so many rows.

    A row's gain never grows as rows are chosen, so an earlier gain bounds it, and only the rows with the highest bounds are
    looked at again, ``batch`` at a time, until the highest one is of now."""
    if k >= len(vectors):
        return list(range(len(vectors)))
    weights = np.ones(len(vectors)) if weights is None else weights
    near = similarities(vectors)
    chosen = [int((weights @ near).argmax())]
    best = near[chosen[0]]
    gains = np.maximum(near - best, 0) @ weights
    fresh = np.ones(len(vectors), bool)
    gains[chosen[0]] = -1
    while len(chosen) < k:
        i = int(gains.argmax())
        while not fresh[i]:
            some = np.argpartition(gains, -batch)[-batch:] if batch < len(gains) else np.arange(len(gains))
            some = np.append(some[~fresh[some] & (gains[some] >= 0) & (some != i)], i)
            gains[some] = np.maximum(near[some] - best, 0) @ weights
            fresh[some] = True
            i = int(gains.argmax())
        if gains[i] < least:
            break
        chosen.append(i)
        best = np.maximum(best, near[i])
        fresh[:] = False
        gains[chosen] = -1
    return chosen


def nominate(texts: list[str], weights: list[float], k: int, embedder: Embedder = hashed_ngrams) -> tuple[list[str], list[float]]:
    """The cover of distinct texts, in the order of the texts, and for each chosen one the weight of the texts that
    resemble it most."""
    order = sorted(range(len(texts)), key=texts.__getitem__)
    texts, held = [texts[i] for i in order], np.array([weights[i] for i in order], float)
    vectors = embedder(texts)
    chosen = greedy_cover(vectors, k, weights=held)
    unit = _unit(vectors)
    nearest = (unit @ unit[chosen].T).argmax(1)
    nearest[chosen] = range(len(chosen))
    return [texts[i] for i in chosen], np.bincount(nearest, held, len(chosen)).tolist()


def text_subsets(df: DataFrame, keys: list[str], column: str, k: int | None = 5, embedder: Embedder = hashed_ngrams, block: int = 1024) -> DataFrame:
    """``keys..., texts``: the greedy cover of each key's distinct texts, or all of them without ``k``; null keys are a key.

    Keys of up to ``block`` texts (or 4 ``k``) are covered as a whole. The texts of larger ones are dealt into parts of
    that size by a hash; each part nominates a sixteenth, or ``k``, and a nominee takes over the weight of the texts that
    resemble it most, so that a dense cluster counts in full. This repeats until a key's nominees fit.
    """
    texts = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keys)], F.col(f"`{column}`").cast("string").alias("text"))
    texts, names = texts.where("text is not null and trim(text) <> ''").distinct(), [f"k{i}" for i in range(len(keys))]
    listed = lambda rows: rows.groupBy(*names).agg(F.sort_array(F.collect_list("text")).alias("texts")).withColumnsRenamed(dict(zip(names, keys)))
    if k is None:
        return listed(texts)
    block, rows = max(block, 4 * k), texts.withColumn("weight", F.lit(1.0))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])

    def cover(most: int) -> Callable[[pa.Table], pa.Table]:
        def run(table: pa.Table) -> pa.Table:
            chosen, weights = nominate(table.column("text").to_pylist(), table.column("weight").to_pylist(), most, embedder)
            first = table.slice(0, 1)
            same = {c: pa.array(first.column(c).to_pylist() * len(chosen), first.schema.field(c).type) for c in names}
            return pa.table({**same, "text": pa.array(chosen, pa.string()), "weight": pa.array(weights, pa.float64())})

        return run

    tasks, before = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), None
    while True:
        large = rows.groupBy(*names).count().where(F.col("count") > block)
        large = large.select(*[F.col(c).alias(f"of_{c}") for c in names], F.ceil(F.col("count") / block).alias("parts"))
        last = large.isEmpty()  # also makes all nominees of the round before, which are kept, as each further use would make them again
        if before is not None:
            before.unpersist()
        if last:
            break
        found = rows.join(large, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in names], "left")
        small = found.where("parts is null").select(*names, "text", "weight")
        dealt = found.where("parts is not null").select(*names, "text", "weight", F.pmod(F.xxhash64("text"), F.col("parts")).alias("part"))
        dealt = dealt.repartition(tasks, *names, "part")  # a stated number: the work is not in proportion to the bytes
        before = rows if rows.is_cached else None
        rows = small.union(dealt.groupBy(*names, "part").applyInArrow(cover(max(k, block // 16)), schema)).persist(StorageLevel.DISK_ONLY)
    # Most keys may have no more texts than wanted, and there may be very many keys: these need no call for each key.
    lists = rows.groupBy(*names).agg(F.collect_list(F.struct("text", "weight")).alias("l"))
    small = lists.where(F.size("l") <= k).select(*[F.col(c).alias(n) for c, n in zip(names, keys)], F.sort_array(F.col("l.text")).alias("texts"))
    large = lists.where(F.size("l") > k).select(*names, F.inline("l"))
    return small.union(listed(large.groupBy(*names).applyInArrow(cover(k), schema)))


Summarizer = Callable[[list[str]], list[str]]


def first_sentences(texts: list[str]) -> list[str]:
    """The stand-in for a summary: each text's first sentence."""
    return [re.split(r"(?<=[.!?])\s", t.strip(), maxsplit=1)[0] if t else "" for t in texts]


def summarize(df: DataFrame, column: str, summarizer: Summarizer = first_sentences, most_chars: int = 100_000) -> DataFrame:
    """Adds ``<column>_summary``; a call of the model gets at most ``most_chars`` characters, or one longer text."""
    schema = T.StructType([*df.schema.fields, T.StructField(f"{column}_summary", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held, size = [], [], 0
            for text in batch.column(batch.schema.get_field_index(column)).to_pylist():
                if held and size + len(text or "") > most_chars:
                    out += summarizer(held)
                    held, size = [], 0
                held.append(text or "")
                size += len(text or "")
            out += summarizer(held) if held else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], schema.names)

    return df.mapInArrow(run, schema)


def choose_text_columns(correlations: DataFrame, n: int = 2) -> list[str]:
    """The stand-in for a model's choice: the first of the lowest correlations."""
    return [r.feature for r in lowest(correlations).limit(n).collect()]


def lowest(correlations: DataFrame, n: int = 5) -> DataFrame:
    """The lowest signed values, NaN and null last."""
    value = F.when(~F.isnan("value"), F.col("value"))
    return correlations.orderBy(value.asc_nulls_last(), "feature").limit(n)
