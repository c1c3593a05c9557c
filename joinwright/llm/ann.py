"""Nearest neighbours by a hash-prefix forest.

Each tree gives every vector a string of 64 bits, the signs of its products with random directions, and keeps the strings in a
sorted array. The arrays are cut into ranges by prefix, a table with a row for each range. A query descends each tree to the
range of its longest prefix, and then ascends all trees together, one bit a round: at depth d its candidates are the vectors
that share its first d bits in any tree, so a round asks those ranges only that hold the strings with the first d bits and
the next one flipped. It stops as soon as a vector as near as its k-th best so far would already have been met with
probability ``recall``. Clear neighbours are found deep in the trees, unclear ones cost more candidates; there is no cap.

The vectors themselves are dealt into blocks by a hash. Queries go to those blocks that hold candidates of theirs, with the
candidates' places. Equal vectors are one entry, which keeps its smallest ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .storage import materialise, partitions, small

BITS = 64
_ONES, _TOP = (1 << BITS) - 1, np.uint64(1 << (BITS - 1))
#: Queries of a group that meets a range, or a block of vectors, at once.
ASKING, SCORING = 4096, 1024


@dataclass(frozen=True)
class ForestParams:
    """``range`` strings make a range of a tree at most, and about ``block`` vectors a block (32,768 at most). A query's first
    round has about ``start`` candidates, or a quarter of the vectors if that is less."""

    k: int = 5
    trees: int = 64
    recall: float = 0.87
    range: int = 8192
    block: int = 16384
    start: int = 8192
    seed: int = 1


def hash_strings(vectors: np.ndarray, params: ForestParams) -> np.ndarray:
    """Strings [vector, tree]; the first bit of a string is the highest of the number."""
    n, size = vectors.shape
    directions = np.random.default_rng((params.seed, size)).standard_normal((size, params.trees * BITS))
    out = np.empty((n, params.trees), np.uint64)
    for i in range(0, n, 512):
        out[i : i + 512] = np.packbits(vectors[i : i + 512] @ directions > 0, axis=1).view(">u8")
    return out


def _sortable(strings: np.ndarray) -> np.ndarray:
    """Signed numbers in the order of the strings."""
    return (strings ^ _TOP).view(np.int64)


def _bucket(strings: np.ndarray, depth: int) -> np.ndarray:
    return (strings >> np.uint64(BITS - depth)).astype(np.int64) if depth else np.zeros(len(strings), np.int64)


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Vectors of one length each, with their rows."""
    vectors = batch.column(batch.schema.get_field_index("v"))
    sizes = np.diff(vectors.offsets.to_numpy())
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        yield size, rows, vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _strings(params: ForestParams):
    """Rows (place, v): a row (size, tree, key, place) for each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = np.arange(params.trees, dtype=np.int32)
        for whole in batches:
            for begin in range(0, whole.num_rows, 1024):
                batch = whole.slice(begin, 1024)
                for size, rows, vectors in _by_size(batch):
                    places = batch.column(0).take(pa.array(rows)).to_numpy()
                    keys, n = _sortable(hash_strings(vectors, params)), len(rows)
                    columns = [np.full(n * params.trees, size, np.int32), np.tile(trees, n), keys.ravel(), np.repeat(places, params.trees)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["size", "tree", "key", "place"])

    return run


def _ranges(params: ForestParams, depth: int):
    """Rows of ``_strings`` in order: a row for each range, which is part of one bucket, the first ``depth`` bits."""
    names = ["size", "tree", "bucket", "low", "high", "keys", "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def cut(table: np.ndarray, last: bool) -> tuple[list, np.ndarray]:
            buckets = _bucket(table[2].view(np.uint64) ^ _TOP, depth)
            changes = (np.diff(table[0]) != 0) | (np.diff(table[1]) != 0) | (np.diff(buckets) != 0)
            edges = [0, *(np.flatnonzero(changes) + 1).tolist(), table.shape[1]]
            made, rest = [], table[:, :0]
            for a, b in zip(edges, edges[1:]):
                for i in range(a, b, params.range):
                    j = min(b, i + params.range)
                    if j == table.shape[1] and not last and j - i < params.range:
                        rest = table[:, i:j]
                    else:
                        keys = table[2, i:j]
                        made.append((int(table[0, i]), int(table[1, i]), int(buckets[i]), int(keys[0]), int(keys[-1]), keys.tobytes(), table[3, i:j].tobytes()))
            return made, rest

        def rows(made: list) -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*made), kinds)], names)

        for batch in batches:
            held.append(np.stack([c.to_numpy().astype(np.int64) for c in batch.columns]))
            made, rest = cut(np.concatenate(held, 1), False) if batch.num_rows else ([], held.pop())
            held = [rest]
            if made:
                yield rows(made)
        if held and held[0].shape[1] and (made := cut(held[0], True)[0]):
            yield rows(made)

    return run


def _asked(params: ForestParams, depth: int, first: bool, cut: int):
    """Rows (query, size, strings): for each tree the strings that are candidates at this depth and weren't before, as a
    row (size, tree, bucket, query, low, high) for each bucket of the first ``cut`` bits."""
    names = ["size", "tree", "bucket", "query", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strings = batch.column(2).flatten().to_numpy().view(np.uint64)
            bits = depth if first else depth + 1
            if not first:
                strings = strings ^ np.uint64(1 << (BITS - 1 - depth))
            rest = np.uint64(_ONES >> bits)
            low, high = strings & ~rest, strings | rest
            a, b = _bucket(low, cut), _bucket(high, cut)
            times = b - a + 1
            bucket = np.repeat(a, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            of = pa.array(np.repeat(np.arange(batch.num_rows), params.trees)).take(pa.array(np.repeat(np.arange(len(strings)), times)))
            tree = np.repeat(np.tile(np.arange(params.trees, dtype=np.int32), batch.num_rows), times)
            ends = [pa.array(np.repeat(_sortable(x), times)) for x in (low, high)]
            yield pa.RecordBatch.from_arrays([batch.column(1).take(of), pa.array(tree), pa.array(bucket), batch.column(0).take(of), *ends], names)

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (size, keys, places, asks): the candidates' places in each block, for each query."""
    for batch in batches:
        for r in range(batch.num_rows):
            size = batch.column(0)[r].as_py()
            keys, places = (np.frombuffer(batch.column(i)[r].as_py(), np.int64) for i in (1, 2))
            asks = batch.column(3)[r].values
            queries = asks.field("query")
            begin = np.searchsorted(keys, asks.field("low").to_numpy())
            end = np.searchsorted(keys, asks.field("high").to_numpy(), "right")
            of, blocks, lists = [], [], []
            for i in np.flatnonzero(end > begin).tolist():
                own = np.sort(places[begin[i] : end[i]])
                edges = np.flatnonzero(np.diff(own >> 16, prepend=-1))
                for a, b in zip(edges, [*edges[1:], len(own)]):
                    of.append(i)
                    blocks.append(int(own[a] >> 16))
                    lists.append((own[a:b] & 0xFFFF).astype(np.uint16).tobytes())
            made = [queries.take(pa.array(of, pa.int64())), pa.array([size] * len(of), pa.int32()), pa.array(blocks, pa.int64()), pa.array(lists, pa.binary())]
            yield pa.RecordBatch.from_arrays(made, ["query", "size", "block", "places"])


def _scored(wanted: int):
    """Rows (entries, vectors, asks): each query's ``wanted`` best candidates of the block, ties to smaller ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                entries = batch.column(0)[r].values
                vectors = batch.column(1)[r].values.flatten().to_numpy(zero_copy_only=False).reshape(len(entries), -1)
                norms = np.sqrt((vectors * vectors).sum(1))
                asks = batch.column(2)[r].values
                of, best, scores = [], [], []
                for i, ask in enumerate(asks):
                    query = ask["v"].values.to_numpy(zero_copy_only=False)
                    own = np.unique(np.frombuffer(b"".join(ask["lists"].as_py()), np.uint16)).astype(np.int64)
                    norm = np.sqrt((query * query).sum())
                    near = (vectors[own] @ query) / (norms[own] * norm)
                    if len(own) > wanted:
                        own = own[near >= np.partition(near, len(near) - wanted)[len(near) - wanted] - 1e-9]
                    # In an order of summation that doesn't depend on the other rows.
                    exact = (vectors[own] * query).sum(1) / (norms[own] * norm)
                    order = np.lexsort((own, -exact))[: wanted]  # places are in the order of the ids
                    of += [i] * len(order)
                    best += own[order].tolist()
                    scores += exact[order].tolist()
                made = [asks.field("query").take(pa.array(of, pa.int64())), entries.take(pa.array(best, pa.int64())), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(made, ["query", "entry", "score"])

    return run


def nearest(vectors: DataFrame, is_query: Column, params: ForestParams = ForestParams(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row that ``is_query`` (a column) holds for, its ``k`` nearest other rows found, or all if there are
    fewer: ``query_id``, ``rank`` from 1, ``id_col``, ``score`` (the cosine in double precision); ties to smaller ids.

    Rows with a null id, and vectors that are null, empty, zero, or hold null or non-finite components, take no part.
    Vectors of different lengths are never compared. Repeated vectors are neighbours with score 1; a row is never
    its own neighbour, and rows with the same id count as the same row. Other columns are ignored, whatever their names,
    and an empty table gives an empty result.
    """
    k, extra = params.k, params.k + 1
    spark, n_parts = vectors.sparkSession, partitions(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(finite & F.exists("v", lambda x: x != 0)).distinct()
    id_type = rows.schema["id"].dataType.simpleString()
    rows = materialise(rows, "vectors")

    # One entry for equal vectors: the smallest ids can be in results, one more than k as one may be the query's own.
    rank = F.row_number().over(W.partitionBy("v").orderBy("id"))
    entries = rows.select("id", "v").withColumn("rank", rank).where(F.col("rank") <= extra)
    entries = entries.groupBy("v").agg(F.min("id").alias("entry"), F.sort_array(F.collect_list("id")).alias("ids"))
    entries = materialise(entries.withColumn("size", F.size("v")), "entries")
    n = entries.count()
    if not n:
        return spark.createDataFrame([], f"query_id {id_type}, rank int, `{id_col}` {id_type}, score double")
    asking = rows.where("asks").select("id", "v").join(entries.select("v", "entry"), "v").select("id", "entry")
    asking = materialise(asking, "asking")
    queries = entries.join(asking.select("entry").distinct(), "entry", "left_semi").select(F.col("entry").alias("query"), "size", "v")
    queries = materialise(queries, "queries")

    # Blocks of vectors, in which a vector's place is its number in the order of the ids.
    block = F.expr(f"pmod(xxhash64(entry), {math.ceil(n / params.block)})")
    at = F.row_number().over(W.partitionBy("size", "block").orderBy("entry")) - 1
    placed = materialise(entries.withColumn("block", block).withColumn("at", at).select("size", "block", "at", "entry", "v"), "placed")
    member = F.sort_array(F.collect_list(F.struct("at", "entry", "v")))
    blocks = placed.groupBy("size", "block").agg(member.alias("m")).select("size", "block", F.col("m.entry").alias("entries"), F.col("m.v").alias("vectors"))
    blocks = materialise(blocks, "blocks")

    # The sorted arrays of all trees, cut into ranges.
    cut = max(0, math.floor(math.log2(n / params.range)) + 1)
    strings = placed.select((F.shiftleft("block", 16) + F.col("at")).alias("place"), "v").mapInArrow(_strings(params), "size int, tree int, key long, place long")
    order = ["size", "tree", "key", "place"]
    ranges = strings.repartitionByRange(n_parts, *order).sortWithinPartitions(*order).mapInArrow(_ranges(params, cut), "size int, tree int, bucket long, low long, high long, keys binary, places binary")
    ranges = materialise(ranges.withColumn("range", F.monotonically_increasing_id()), "ranges")
    directory = ranges.select("size", "tree", "bucket", "range", F.col("low").alias("from"), F.col("high").alias("upto"))

    def strings_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, own, some in _by_size(batch):
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * params.trees), pa.array(hash_strings(some, params).view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), pa.array(np.full(len(own), size, np.int32)), lists], ["query", "size", "strings"])

    active = materialise(queries.select("query", "v").mapInArrow(strings_of, f"query {id_type}, size int, strings array<long>"), "active")
    best = spark.createDataFrame([], f"query {id_type}, entry {id_type}, score double")
    depth = min(BITS, max(0, math.ceil(math.log2(params.trees * n / min(params.start, max(1, n / 4))))))
    first, left = True, active.count()
    while left:
        asked = active.mapInArrow(_asked(params, depth, first, cut), f"size int, tree int, bucket long, query {id_type}, low long, high long")
        asked = asked.join(directory, ["size", "tree", "bucket"]).where("low <= upto and high >= `from`")
        part = F.expr(f"pmod(xxhash64(query), {math.ceil(left / ASKING)})").alias("part")
        asked = asked.groupBy("range", part).agg(F.collect_list(F.struct("query", "low", "high")).alias("asks")).drop("part")
        asked = materialise(asked, "asked")
        met = ranges.join(small(asked), "range").select("size", "keys", "places", "asks").mapInArrow(_met, f"query {id_type}, size int, block long, places binary")
        lists = met.groupBy("size", "block", "query").agg(F.collect_list("places").alias("lists"))
        part = F.expr(f"pmod(xxhash64(query), {math.ceil(left / SCORING)})").alias("part")
        lists = lists.join(small(queries.select("query", "v")), "query").groupBy("size", "block", part).agg(F.collect_list(F.struct("query", "v", "lists")).alias("asks")).drop("part")
        lists = materialise(lists, "candidates")
        found = blocks.join(lists, ["size", "block"]).select("entries", "vectors", "asks").mapInArrow(_scored(extra), best.schema)
        rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "entry"))
        best = materialise(best.union(found).distinct().withColumn("rank", rank).where(F.col("rank") <= extra).drop("rank"), "best")
        share = 1 - F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.min("score")))) / math.pi
        enough = best.groupBy("query").agg(F.count("*").alias("n"), (1 - F.pow(1 - F.pow(share, F.lit(float(depth))), F.lit(float(params.trees)))).alias("p"))
        enough = enough.where((F.col("n") >= extra) & (F.col("p") >= params.recall))
        if not depth:
            break
        active = materialise(active.join(enough.select("query"), "query", "left_anti"), "active")
        depth, first, left = depth - 1, False, active.count()

    far = (-F.col("score")).alias("far")
    neighbours = best.join(entries.select("entry", "ids"), "entry").select("query", F.explode("ids").alias("id"), "score")
    neighbours = neighbours.groupBy("query").agg(F.sort_array(F.collect_list(F.struct(far, "id", "score"))).alias("best"))
    answers = asking.join(neighbours, asking["entry"] == neighbours["query"]).select(F.col("id").alias("query_id"), F.slice(F.filter("best", lambda x: x["id"] != F.col("id")), 1, k).alias("best"))
    answers = answers.select("query_id", F.posexplode("best").alias("at", "x"))
    return answers.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias(id_col), F.col("x.score").alias("score"))
