"""Least squares from sums of products: one pass over the rows scores any number of columns, each added alone to a base."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A column of whose squares no more than this share is left beside the base adds nothing to it.
COLLINEAR = 1e-9


@dataclass(frozen=True)
class Part:
    """Sums over some rows: products of one, the base and the target (``core``), their products with each column
    (``cross``), and the columns' squares. Products of one column with another are not needed, so the number of sums is
    in proportion to the number of columns."""

    core: np.ndarray
    cross: np.ndarray
    squares: np.ndarray

    @property
    def rows(self) -> int:
        return int(round(self.core[0, 0]))


def part_moments(df: DataFrame, base: list[str], columns: list[str], target: str, test: Column) -> tuple[Part, Part]:
    """Sums over the rows that ``test`` is not true of, and over the others. All columns are numbers without missing
    values; they should be centred and scaled, as differences of sums of squares are taken later."""
    k, q = len(base) + 2, len(columns)
    wide = k + q
    names = [*base, target, *columns]
    values = df.select(F.coalesce(test, F.lit(False)).alias("__test"), *[F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(names)])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, squares = np.zeros((2, k, wide)), np.zeros((2, q))
        for batch in batches:
            inside = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            rows = np.column_stack([np.ones(batch.num_rows), *[batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(wide - 1)]])
            for part in (0, 1):
                x = rows[inside == part]
                products[part] += x[:, :k].T @ x
                squares[part] += (x[:, k:] ** 2).sum(axis=0)
        at = np.indices(products.shape).reshape(3, -1)
        own = np.indices(squares.shape).reshape(2, -1)
        place = [np.concatenate([at[0], own[0]]), np.concatenate([at[1], own[1] + k]), np.concatenate([at[2], own[1] + k])]
        arrays = [pa.array(p.astype(np.int32)) for p in place] + [pa.array(np.concatenate([products.ravel(), squares.ravel()]))]
        yield pa.RecordBatch.from_arrays(arrays, ["part", "i", "j", "value"])

    found = values.mapInArrow(sums, "part int, i int, j int, value double").groupBy("part", "i", "j").agg(F.sum("value").alias("value"))
    whole = np.zeros((2, wide, wide))
    for row in found.collect():  # as many as there are sums
        whole[row.part, row.i, row.j] = row.value
    return tuple(Part(w[:k, :k], w[:k, k:], np.diagonal(w)[k:]) for w in whole)


def added_r2(train: Part, test: Part) -> tuple[float | None, list[float | None]]:
    """R2 on the test rows of the base's least squares, and of those with each column added to it.

    The base's normal equations are solved once; each column then borders them. Of base columns that depend on each other
    the solution of least norm is taken; a column that depends on the base changes nothing. Without training rows, with
    fewer than two test rows or with equal targets in all of these there is no score (null).
    """
    k = len(train.core) - 1  # the target's place
    n, total, squares = test.rows, test.core[0, k], test.core[k, k]
    spread = squares - total * total / n if n else 0.0
    if not train.rows or n < 2 or spread <= 1e-12 * squares:
        return None, [None] * len(train.squares)
    inverse = np.linalg.pinv(train.core[:k, :k], rcond=1e-12, hermitian=True)
    base = inverse @ train.core[:k, k]
    along = inverse @ train.cross[:k]
    left = train.squares - (train.cross[:k] * along).sum(axis=0)
    told = left > COLLINEAR * train.squares
    slopes = np.divide(train.cross[k] - base @ train.cross[:k], left, out=np.zeros_like(left), where=told)
    weights = base[:, None] - along * slopes

    def error(b: np.ndarray) -> np.ndarray:
        return squares - 2 * test.core[k, :k] @ b + ((test.core[:k, :k] @ b) * b).sum(axis=0)

    added = error(weights) - 2 * slopes * test.cross[k] + 2 * slopes * (weights * test.cross[:k]).sum(axis=0) + slopes**2 * test.squares
    return float(1 - error(base) / spread), [float(x) for x in 1 - added / spread]
