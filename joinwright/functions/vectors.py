"""Arrays of numbers as native expressions, and cosines of blocks of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """The Euclidean norm, 1 for zero vectors."""
    n = F.sqrt(dot(a, a))
    return F.when(n == 0, 1.0).otherwise(n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def mean(a: Column) -> Column:
    """The mean of the elements; null for an empty array or one with nulls."""
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def _by_size(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Size -> places, vectors and norms (1 for zero vectors) of the arrays of that size; those that are or hold null are left out."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy().astype(np.int64)
    flat = pc.list_flatten(column).cast(pa.float64())
    held = np.maximum(sizes, 0)
    starts = np.cumsum(held) - held
    missing = flat.is_null().to_numpy()
    sizes[np.repeat(np.arange(len(sizes)), held)[missing]] = -1
    values, found = flat.to_numpy(), {}
    for size in np.unique(sizes[sizes >= 0]).tolist():
        at = np.flatnonzero(sizes == size)
        rows = values[starts[at][:, None] + np.arange(size)]
        norms = np.sqrt((rows * rows).sum(1))
        found[size] = at, rows, np.where(norms == 0, 1.0, norms)
    return found


def cosine_block(left: pa.Table, right: pa.Table) -> pa.Table:
    """``a, b, cosine`` of every row of ``left`` (``a, e``) with every row of ``right`` (``b, e``): as ``cosine``, and 1 for equal ids."""
    shape = left.num_rows, right.num_rows
    value, known = np.zeros(shape), np.zeros(shape, bool)
    if min(shape):
        mine, theirs = _by_size(left["e"]), _by_size(right["e"])
        for size in mine.keys() & theirs.keys():
            (i, x, n), (j, y, m) = mine[size], theirs[size]
            with np.errstate(invalid="ignore"):
                value[np.ix_(i, j)] = (x @ y.T) / (n[:, None] * m[None, :])
            known[np.ix_(i, j)] = True
    a, b = pa.array(np.repeat(np.arange(shape[0]), shape[1])), pa.array(np.tile(np.arange(shape[1]), shape[0]))
    a, b = left["a"].take(a), right["b"].take(b)
    same = pc.fill_null(pc.equal(a, b), False).to_numpy()
    value, known = np.where(same, 1.0, value.ravel()), known.ravel() | same
    return pa.table({"a": a, "b": b, "cosine": pa.array(value, mask=~known)})
