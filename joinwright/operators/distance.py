"""Distance correlations of all rows: of two numbers and of a number and few different vectors without pairs of rows, and of
others from all pairs of different points in blocks.

For two numbers, sums over all pairs of |x_i - x_j| |y_i - y_j| come from row sums of distances (sorted order and prefix sums) and from sums
over the pairs in which both numbers rise. Both numbers are cut into ranges: pairs in different ranges of both are summed
from the cells of that grid, and pairs that share a range within one task for each range. A bound is a range of its own,
where differences are 0, so that a value that many rows have needs no task; the other ranges hold about as many rows each.

Vectors meet as different points with the numbers of their rows. With ``m`` different vectors x and a number y, the sum over
all pairs of |x_i - x_j| |y_i - y_j| is twice the integral over t of L(t)' A R(t), where A holds the distances of the vectors
and L and R count each vector's rows up to t and above it; it is cut into ranges of y, one task each. Others are compared in
blocks, each pair of blocks in one task: that work grows with the square of the number of different points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a range should hold, and the most ranges, which bounds the grid; beyond, ranges hold more rows.
STRIP, RANGES = 50_000, 512
#: Different vectors that meet a number without pairs of rows.
GROUPS = 1024
#: Bytes of a block of points, and the cells of a matrix that a task holds at once.
BLOCK_BYTES, CELLS = 1 << 24, 1 << 18

_SUMS = "rise double, ab double, aa double, bb double, a double, b double"


def rising(first: np.ndarray, second: np.ndarray, rows: np.ndarray, strict: bool = False) -> np.ndarray:
    """For each point the sums of ``rows`` (points x values) over the points that are lower in both coordinates; equal ones
    may count or not, but with ``strict`` those of an equal second coordinate do not."""
    by = np.argsort(first, kind="stable")
    second, rows = second[by], rows[by]
    out, n, half = np.zeros_like(rows), len(by), 1
    rank = np.unique(second, return_inverse=True)[1] if strict else np.argsort(np.argsort(second, kind="stable"), kind="stable")
    place = np.arange(n)
    while half < n:
        left = (place // half) % 2 == 0
        block = place // (2 * half)
        order = np.lexsort((left, rank, block))  # of equal ranks right ones come first
        sums = np.cumsum(np.where(left[:, None], rows, 0)[order], axis=0)
        begins = np.searchsorted(block[order], np.arange(block[-1] + 1))
        before = np.concatenate((np.zeros((1, rows.shape[1])), sums))[begins]
        out[order] += np.where(left[order][:, None], 0, sums - before[block[order]])
        half *= 2
    found = np.empty_like(out)
    found[by] = out
    return found


def _rise(x: np.ndarray, y: np.ndarray, w: np.ndarray, sums: np.ndarray) -> float:
    """Sum of w_i w_j (x_j - x_i) (y_j - y_i) where ``sums`` are those of w, w x, w y and w x y over the lower points."""
    return float((w * (x * y * sums[:, 0] - x * sums[:, 2] - y * sums[:, 1] + sums[:, 3])).sum())


def _weighted(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.column_stack((w, w * x, w * y, w * x * y))


def ranges_of(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """2 i between bounds i - 1 and i, and 2 i + 1 for bound i itself."""
    at = np.searchsorted(bounds, values)
    return 2 * at + (bounds[np.minimum(at, len(bounds) - 1)] == values)


class _Axis:
    """One number's bounds with, for each range, the weight and the sum of the values below it and of all."""

    def __init__(self, bounds: np.ndarray, weights: np.ndarray, sums: np.ndarray):
        self.bounds = bounds
        self.below = np.concatenate(([0], np.cumsum(weights)[:-1])), np.concatenate(([0], np.cumsum(sums)[:-1]))
        self.n, self.total = weights.sum(), sums.sum()

    def _row_sums(self, v: np.ndarray, weight: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Of distances to all rows, from the weight and sum of the values up to each."""
        return v * weight - total + (self.total - total) - v * (self.n - weight)

    def at_bounds(self, v: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Of rows at bounds, whose own value adds nothing to their sums."""
        return self._row_sums(v, self.below[0][of], self.below[1][of])

    def inside(self, v: np.ndarray, w: np.ndarray, of: int) -> np.ndarray:
        """Of all rows between two bounds."""
        by = np.argsort(v, kind="stable")
        out = np.empty(len(v))
        out[by] = self._row_sums(v[by], self.below[0][of] + np.cumsum(w[by]), self.below[1][of] + np.cumsum((w * v)[by]))
        return out


def _columns(batch: pa.RecordBatch | pa.Table, names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy() for n in names.split()]


def _table(kind: type, **columns: np.ndarray):
    return kind.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))


def _sums(kind: type, w: np.ndarray, a: np.ndarray, b: np.ndarray, rise: float):
    cells = {"rise": rise, "ab": w @ (a * b), "aa": w @ (a * a), "bb": w @ (b * b), "a": w @ a, "b": w @ b}
    return _table(kind, **{k: np.array([v], float) for k, v in cells.items()})


def distance_correlation_of_numbers(rows: DataFrame, strip: int = STRIP) -> float:
    """Of the columns ``x`` and ``y`` of finite doubles: 0 where a variance is 0, NaN under two rows."""
    about = rows.agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    if about.n < 2:
        return float("nan")
    if about.x0 == about.x1 or about.y0 == about.y1:
        return 0.0
    # Centred and scaled, which the correlation does not depend on, so that sums lose no digits.
    scaled = lambda c: ((F.col(c) - about[c]) / (about[c + "1"] - about[c + "0"])).alias(c)
    points = rows.select(scaled("x"), scaled("y")).groupBy("x", "y").agg(F.count("*").cast("double").alias("w"))
    cuts = min(RANGES, max(1, about.n // strip))
    shares = [i / (cuts + 1) for i in range(1, cuts + 1)]
    found = rows.select(scaled("x"), scaled("y")).agg(*[F.percentile_approx(c, shares, 100 * (cuts + 1)).alias(c) for c in "xy"]).first()
    bounds = [np.unique(np.array(found[c], float)) for c in "xy"]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, w = _columns(batch, "x y w")
            yield _table(pa.RecordBatch, x=x, y=y, w=w, p=ranges_of(x, bounds[0]), q=ranges_of(y, bounds[1]))

    points = points.mapInArrow(placed, "x double, y double, w double, p long, q long")
    of = lambda c, v: points.groupBy(c).agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col(v)).alias("s")).collect()
    axes = []
    for c, v, own in (("p", "x", bounds[0]), ("q", "y", bounds[1])):  # at most 2 * RANGES + 1 rows each
        weights, sums = np.zeros(2 * len(own) + 1), np.zeros(2 * len(own) + 1)
        for r in of(c, v):
            weights[r[c]], sums[r[c]] = r.w, r.s
        axes.append(_Axis(own, weights, sums))

    def across(table: pa.Table) -> pa.Table:
        """Row sums of x, and the pairs of this range of x in different ranges of y."""
        x, y, w, p, q = _columns(table, "x y w p q")
        rise = np.zeros(len(x))
        rise[0] = _rise(x, y, w, rising(x, q, _weighted(x, y, w), strict=True))
        return _table(pa.Table, y=y, w=w, x=x, q=q, a=axes[0].inside(x, w, int(p[0])), rise=rise)

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, w, p, q = _columns(batch, "x y w p q")
            yield _table(pa.RecordBatch, y=y, w=w, x=x, q=q, a=axes[0].at_bounds(x, p), rise=np.zeros(len(x)))

    def strips(table: pa.Table) -> pa.Table:
        """The pairs of this range of y."""
        y, w, x, q, a, rise = _columns(table, "y w x q a rise")
        return _sums(pa.Table, w, a, axes[1].inside(y, w, int(q[0])), rise.sum() + _rise(x, y, w, rising(x, y, _weighted(x, y, w))))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, w, x, q, a, rise = _columns(batch, "y w x q a rise")
            yield _sums(pa.RecordBatch, w, a, axes[1].at_bounds(y, q), rise.sum())

    def grid(table: pa.Table) -> pa.Table:
        p, q, w, x, y, xy = _columns(table, "p q w x y xy")
        shape = len(axes[0].bounds) * 2 + 2, len(axes[1].bounds) * 2 + 2
        rise = 0.0
        for own, other, sign in ((xy, w, 1), (x, y, -1), (y, x, -1), (w, xy, 1)):
            cells = np.zeros(shape)
            cells[p + 1, q + 1] = other
            rise += sign * float((own * cells.cumsum(0).cumsum(1)[p, q]).sum())
        none = np.zeros(0)
        return _sums(pa.Table, none, none, none, rise)

    kept = "y double, w double, x double, q long, a double, rise double"
    odd = lambda c: F.col(c) % 2 == 1
    left = points.where(~odd("p")).groupBy("p").applyInArrow(across, kept).union(points.where(odd("p")).mapInArrow(along, kept))
    cells = points.groupBy("p", "q").agg(F.sum("w").alias("w"), *[F.sum(F.col("w") * v).alias(n) for n, v in (("x", F.col("x")), ("y", F.col("y")), ("xy", F.col("x") * F.col("y")))])
    parts = left.where(~odd("q")).groupBy("q").applyInArrow(strips, _SUMS).union(left.where(odd("q")).mapInArrow(ends, _SUMS))
    parts = parts.union(cells.withColumn("whole", F.lit(0)).groupBy("whole").applyInArrow(grid, _SUMS))
    one = points.agg(*[F.sum(F.col("w") * v).alias(n) for n, v in (("x", F.col("x")), ("y", F.col("y")), ("xy", F.col("x") * F.col("y")), ("xx", F.col("x") ** 2), ("yy", F.col("y") ** 2))]).first()
    s = parts.agg(*[F.sum(c).alias(c) for c in ("rise", "ab", "aa", "bb", "a", "b")]).first()
    n = float(about.n)
    products = 2 * (2 * s.rise - (n * one.xy - one.x * one.y))
    pq = products - 2 / n * s.ab + s.a * s.b / n**2
    pp = 2 * (n * one.xx - one.x**2) - 2 / n * s.aa + s.a**2 / n**2
    qq = 2 * (n * one.yy - one.y**2) - 2 / n * s.bb + s.b**2 / n**2
    return float(np.sqrt(max(0.0, pq) / np.sqrt(pp * qq))) if pp > 0 and qq > 0 else 0.0


def _ratio(pq: float, pp: float, qq: float) -> float:
    if np.isnan(pp) or np.isnan(qq):
        return float("nan")
    return float(np.sqrt(max(0.0, pq) / np.sqrt(pp * qq))) if pp > 0 and qq > 0 else 0.0


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean, of every row of ``a`` to every row of ``b``; from differences, as products lose the digits of near rows."""
    found = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        found += (a[:, i, None] - b[None, :, i]) ** 2
    return np.sqrt(found)


def _is_sparse(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)


def _wide(values: list) -> np.ndarray:
    """Vectors as rows of a matrix; sparse ones get a place for each category that any of them has."""
    if not values or not values[0] or not isinstance(values[0][0], tuple):
        if not any(isinstance(e, tuple) for v in values for e in v):
            return np.array(values, float)
    places = {c: i for i, c in enumerate(sorted({c for v in values for c, _ in v}))}
    found = np.zeros((len(values), len(places)))
    for i, v in enumerate(values):
        for c, x in v:
            found[i, places[c]] = x
    return found


def _wide_columns(points: DataFrame) -> DataFrame:
    """``x`` and ``y`` as arrays of doubles."""
    for c in "xy":
        kind = points.schema[c].dataType
        if _is_sparse(kind):
            category, value = kind.elementType.names
            every = points.select(F.explode(F.col(c)[category]).alias("c")).distinct().agg(F.sort_array(F.collect_list("c")).alias("__all"))
            points = points.withColumn(c, F.map_from_entries(c)).join(F.broadcast(every))  # one row of categories
            points = points.withColumn(c, F.transform("__all", lambda k: F.coalesce(F.try_element_at(F.col(c), k), F.lit(0.0)))).drop("__all")  # noqa: B023
        elif not isinstance(kind, T.ArrayType):
            points = points.withColumn(c, F.array(c))
    return points.select("x", "y", "w")


def distance_correlation_of_points(points: DataFrame, strip: int = STRIP, groups: int = GROUPS, block: int | None = None) -> float:
    """Of the columns ``x`` and ``y``, where each different point is one row with the number of its rows, ``w``: 0 where a
    variance is 0, NaN under two rows. A column holds doubles, arrays of doubles, or sparse vectors: sorted arrays of pairs of a
    category and its value, other than which all are 0. It reads the points several times."""
    width = lambda c: F.max(F.size(c)) if isinstance(points.schema[c].dataType, T.ArrayType) and not _is_sparse(points.schema[c].dataType) else F.lit(0)
    about = points.agg(F.count("*").alias("points"), F.sum("w").alias("n"), width("x").alias("x"), width("y").alias("y")).first()
    if (about.n or 0) < 2:
        return float("nan")
    for c in "xy":
        if about[c] == 1:
            points = points.withColumn(c, F.col(c)[0])
    for own, other in (("x", "y"), ("y", "x")):
        if not isinstance(points.schema[other].dataType, T.ArrayType):
            few = [r[0] for r in points.select(own).distinct().limit(groups + 1).collect()]
            if len(few) <= groups:
                table = points.sparkSession.createDataFrame(list(enumerate(few)), T.StructType([T.StructField("g", T.LongType()), T.StructField(own, points.schema[own].dataType)]))
                numbers = points.join(F.broadcast(table), own).select("g", F.col(other).alias("y"), "w")
                vectors = _wide([v if isinstance(v, list) else [v] for v in few])
                return _of_groups(numbers, vectors, about.points, strip) if vectors.shape[1] else float("nan")
    return _of_blocks(_wide_columns(points), about.points, about.n, block)


def _of_groups(numbers: DataFrame, vectors: np.ndarray, count: int, strip: int) -> float:
    """Of ``g, y, w``: the vector's number, the finite number and the rows of each different point."""
    ends = numbers.agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.avg("y").alias("mean")).first()
    if len(vectors) == 1 or ends.y0 == ends.y1:
        return 0.0
    if not np.isfinite(ends.y1 - ends.y0) or not np.isfinite(vectors).all():
        return float("nan")
    near, m = _distances(vectors, vectors), len(vectors)
    scaled = lambda v: (v - ends.mean) / (ends.y1 - ends.y0)
    numbers = numbers.withColumn("y", scaled(F.col("y")))
    cuts = min(RANGES, max(1, count // strip))
    found = numbers.agg(F.percentile_approx("y", [i / (cuts + 1) for i in range(1, cuts + 1)], 100 * (cuts + 1))).first()[0]
    bounds = np.unique(np.array(found, float))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, y, w = _columns(batch, "g y w")
            yield _table(pa.RecordBatch, g=g, y=y, w=w, r=np.searchsorted(bounds, y))

    numbers = numbers.mapInArrow(placed, "g long, y double, w double, r long")
    # At most RANGES + 1 times GROUPS sums: what each range has below it.
    r, g, w, s = _columns(numbers.groupBy("r", "g").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("s")).toArrow(), "r g w s")
    rows, sums = np.zeros((len(bounds) + 1, m)), np.zeros(len(bounds) + 1)
    np.add.at(rows, (r, g), w)
    np.add.at(sums, r, s)
    below, below_sum, every, whole = rows.cumsum(0) - rows, sums.cumsum() - sums, rows.sum(0), float(sums.sum())
    n, row_sums = float(every.sum()), near @ every
    starts, stops = np.append(scaled(ends.y0), bounds), np.append(bounds, scaled(ends.y1))

    def integrate(table: pa.Table) -> pa.Table:
        g, y, w, r = _columns(table, "g y w r")
        by = np.argsort(y, kind="stable")
        g, y, w, r = g[by], y[by], w[by], int(r[0])
        held, summed, at = below[r], below_sum[r], starts[r]
        ab, a_b, b, bb = held @ near @ (every - held) * (y[0] - at), 0.0, 0.0, 0.0
        left, mine = held.sum(), held @ row_sums
        a_b += (mine * (n - left) + left * (every @ row_sums - mine)) * (y[0] - at)
        b += left * (n - left) * (y[0] - at)
        after, size = np.append(y[1:], stops[r]) - y, max(1, CELLS // m)
        for i in range(0, len(y), size):
            j = min(len(y), i + size)
            upto = np.zeros((j - i, m))
            upto[np.arange(j - i), g[i:j]] = w[i:j]
            upto = upto.cumsum(0) + held
            totals = summed + (w[i:j] * y[i:j]).cumsum()
            left, mine, gap = upto.sum(1), upto @ row_sums, after[i:j]
            ab += gap @ ((upto @ near) * (every - upto)).sum(1)
            a_b += gap @ (mine * (n - left) + left * (every @ row_sums - mine))
            b += gap @ (left * (n - left))
            bb += w[i:j] @ (y[i:j] * (2 * left - n) + whole - 2 * totals) ** 2
            held, summed = upto[-1], totals[-1]
        return _table(pa.Table, **{k: np.array([v], float) for k, v in {"ab": ab, "a_b": a_b, "b": b, "bb": bb}.items()})

    s = numbers.groupBy("r").applyInArrow(integrate, "ab double, a_b double, b double, bb double").agg(*[F.sum(c).alias(c) for c in ("ab", "a_b", "b", "bb")]).first()
    one = numbers.agg(F.sum(F.col("w") * F.col("y") ** 2).alias("yy")).first()
    a, b = float(every @ row_sums), 2 * s.b
    pq = 2 * s.ab - 2 / n * s.a_b + a * b / n**2
    pp = float(every @ near**2 @ every) - 2 / n * float(every @ row_sums**2) + a**2 / n**2
    qq = 2 * (n * one.yy - whole**2) - 2 / n * s.bb + b**2 / n**2
    return _ratio(pq, pp, qq)


def _of_blocks(points: DataFrame, count: int, n: float, block: int | None) -> float:
    """Of all pairs of points: they are dealt into blocks by a hash, and each pair of blocks is one task's."""
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = points.select((F.size("x") + F.size("y")).alias("n")).first().n
    if not width:
        return float("nan")
    block = block or max(1, BLOCK_BYTES // (8 * (width + 1)))
    blocks = max(-(-count // block), min(int(np.sqrt(2 * tasks)) + 1, -(-count // 2000)))
    own = F.pmod(F.xxhash64("x", "y"), F.lit(blocks))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    met = points.withColumn("own", own).withColumn("other", other)
    met = met.select("x", "y", "w", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def sides(table: pa.Table) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Each block's number, vectors and weights, in an order of its own points alone."""
        mine = table["own"].to_numpy()
        x, y = (table[c].combine_chunks().flatten().to_numpy().reshape(len(mine), -1) for c in "xy")
        w, found = table["w"].to_numpy(), []
        for b in np.unique(mine):
            at = np.flatnonzero(mine == b)
            at = at[np.lexsort(np.column_stack((w[at], x[at], y[at])).T)]
            found.append((int(b), x[at], y[at], w[at]))
        return found

    def compare(table: pa.Table) -> pa.Table:
        """For each point of both blocks its sums of distances to the other block's, and once for a pair of blocks its products."""
        found = sides(table)
        (i, x, y, w), (j, u, v, q) = found[0], found[-1]
        if i == j and table["lo"][0] != table["hi"][0]:  # the other block has no points
            return _table(pa.Table, own=np.zeros(0, np.int64), place=np.zeros(0, np.int64), **{c: np.zeros(0) for c in ("w", "a", "b", "ab", "aa", "bb")})
        rows, columns = np.zeros((2, len(x))), np.zeros((2, len(u)))
        ab = aa = bb = 0.0
        size = max(1, CELLS // len(u))
        for k in range(0, len(x), size):
            a, b = _distances(x[k : k + size], u), _distances(y[k : k + size], v)
            some = w[k : k + size]
            rows[:, k : k + size] = a @ q, b @ q
            columns += some @ a, some @ b
            ab, aa, bb = (t + some @ (p @ q) for t, p in ((ab, a * b), (aa, a * a), (bb, b * b)))
        twice = 1 if i == j else 2
        parts = [(i, w, rows)] if i == j else [(i, w, rows), (j, q, columns)]
        owner, place, weight, sums = (np.concatenate(c, axis=-1) for c in zip(*[(np.full(len(p), b), np.arange(len(p)), p, s) for b, p, s in parts]))
        once = lambda value: np.append(twice * value, np.zeros(len(owner) - 1))
        return _table(pa.Table, own=owner, place=place, w=weight, a=sums[0], b=sums[1], ab=once(ab), aa=once(aa), bb=once(bb))

    pairs = blocks * (blocks + 1) // 2
    met = met.repartition(min(pairs, 4_000), "lo", "hi")  # a stated number: the work is not in proportion to the bytes
    found = met.groupBy("lo", "hi").applyInArrow(compare, "own long, place long, w double, a double, b double, ab double, aa double, bb double")
    by = found.groupBy("own", "place").agg(F.max("w").alias("w"), *[F.sum(c).alias(c) for c in ("a", "b", "ab", "aa", "bb")])
    w = F.col("w")
    s = by.agg(*[F.sum(c).alias(c) for c in ("ab", "aa", "bb")], *[F.sum(w * e).alias(k) for k, e in (("a", F.col("a")), ("b", F.col("b")), ("a_b", F.col("a") * F.col("b")), ("a_a", F.col("a") ** 2), ("b_b", F.col("b") ** 2))]).first()
    return _ratio(s.ab - 2 / n * s.a_b + s.a * s.b / n**2, s.aa - 2 / n * s.a_a + s.a**2 / n**2, s.bb - 2 / n * s.b_b + s.b**2 / n**2)
