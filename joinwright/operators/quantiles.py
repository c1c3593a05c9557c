"""Exact quantiles by selection, for all columns and ranks at once.

A double's bits, rearranged, are an integer in the same order. Each round counts the values by the next bits of that
integer, within the cells that hold a wanted rank, and goes on in the cell that each rank falls into, until all cells hold
one value. Tasks count in arrays of a fixed size, so that no state grows with the rows or with the distinct values.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .profile import _col

#: Bits of a round; the number of a task's counters is 2 to this power for each column and wanted cell.
DIGIT = 13
_SIGN = np.uint64(1 << 63)
_FOUND = "col int, cell int, digit int, n long, low long, high long"


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers in the same order; both zeros are one, and NaN is above all."""
    values = np.where(np.isnan(values), np.nan, values + 0.0)
    bits = np.ascontiguousarray(values, np.float64).view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def _value(bits: int) -> float:
    raw = bits ^ (1 << 63) if bits >> 63 else bits ^ ((1 << 64) - 1)
    return float(np.array([raw], np.uint64).view(np.float64)[0])


def _counter(wanted: list[list[int]], high: int, low: int):
    """Counts of each column's values by bits ``low`` to ``high``, within the wanted prefixes of the bits above."""
    size = 1 << (high - low)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [np.zeros(len(p) * size, np.int64) for p in wanted]
        least, most = [np.full(len(c), ~np.uint64(0)) for c in n], [np.zeros(len(c), np.uint64) for c in n]
        prefixes = [np.array(p, np.uint64) for p in wanted]
        for batch in batches:
            for i, own in enumerate(prefixes):
                column = batch.column(i).drop_null()
                if not len(own) or not len(column):
                    continue
                bits = ordered_bits(column.to_numpy(zero_copy_only=False))
                cell = np.zeros(len(bits), np.int64)
                if high < 64:
                    above = bits >> np.uint64(high)
                    cell = np.minimum(np.searchsorted(own, above), len(own) - 1)
                    inside = own[cell] == above
                    bits, cell = bits[inside], cell[inside]
                at = cell * size + ((bits >> np.uint64(low)) & np.uint64(size - 1)).astype(np.int64)
                n[i] += np.bincount(at, minlength=len(n[i]))
                np.minimum.at(least[i], at, bits)
                np.maximum.at(most[i], at, bits)
        for i, counts in enumerate(n):
            at = np.flatnonzero(counts)
            signed = lambda x: (x[at] ^ _SIGN).view(np.int64)  # noqa: B023, E731
            columns = [np.full(len(at), i, np.int32), (at // size).astype(np.int32), (at % size).astype(np.int32), counts[at], signed(least[i]), signed(most[i])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["col", "cell", "digit", "n", "low", "high"])

    return count


def select_ranks(df: DataFrame, ranks: dict[str, list[int]]) -> dict[str, dict[int, float]]:
    """The values at ranks (from 0, ascending, missing values left out) of numeric columns, read as doubles. One scan of the
    columns a round, five rounds at most; only the wanted ranks' cells come to the driver."""
    spark = df.sparkSession
    names = [c for c in ranks if ranks[c]]
    values = df.select(*[_col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)])
    # For each wanted rank: its prefix so far and its rank within it. No prefix yet: all values are one cell.
    state = {(i, r): (0, r) for i, c in enumerate(names) for r in ranks[c]}
    found: dict[tuple[int, int], float] = {}
    high = 64
    while len(found) < len(state):
        low = max(0, high - DIGIT)
        open_ = {k: v for k, v in state.items() if k not in found}
        wanted = [sorted({prefix for (i, _), (prefix, _) in open_.items() if i == j}) for j in range(len(names))]
        cells = values.mapInArrow(_counter(wanted, high, low), _FOUND).groupBy("col", "cell", "digit").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        upto = cells.withColumn("upto", F.sum("n").over(W.partitionBy("col", "cell").orderBy("digit")))
        asked = [(i, wanted[i].index(prefix), within, r) for (i, r), (prefix, within) in open_.items()]
        asked = spark.createDataFrame(asked, "col int, cell int, within long, rank long")
        met = upto.join(F.broadcast(asked), ["col", "cell"]).where("within < upto and within >= upto - n")
        for row in met.collect():
            least, most = row.low + (1 << 63), row.high + (1 << 63)
            if least == most:
                found[row.col, row["rank"]] = _value(least)
            state[row.col, row["rank"]] = (least >> low, row.within - (row.upto - row.n))
        high = low
    return {c: {r: found[i, r] for r in ranks[c]} for i, c in enumerate(names)}


def exact_quantiles(df: DataFrame, columns: list[str], points: list[float]) -> dict[str, list[float]]:
    """Of each column the quantiles at ``points``, between two values in proportion, as ``percentile`` gives them; a column
    without values has none. NaN is the greatest value."""
    counted = df.agg(*[F.count(_col(c)).alias(str(i)) for i, c in enumerate(columns)]).first() if columns else ()
    sizes = dict(zip(columns, counted))
    places = {c: [p * (n - 1) for p in points] if n else [] for c, n in sizes.items()}
    at = select_ranks(df, {c: sorted({x for p in own for x in (math.floor(p), math.ceil(p))}) for c, own in places.items()})

    def between(values: dict[int, float], place: float) -> float:
        low, high = math.floor(place), math.ceil(place)
        a, b = values[low], values[high]
        return a if low == high or a == b else (high - place) * a + (place - low) * b

    return {c: [between(at[c], p) for p in own] for c, own in places.items()}
