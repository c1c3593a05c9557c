"""Near-duplicate documents: MinHash bands, sequential Bayesian pruning, exact verification, components.

1. One pass over the texts makes each document's set key (a 128-bit hash of its shingle set), set size, band keys
   and an 8-bit signature. Documents with equal sets form a class, which its smallest id represents.
2. Representatives that share a band key are candidates. Each band bucket is a star around its smallest id, so a
   bucket of n costs n candidates, however large.
3. A candidate's signatures are compared batch by batch. After each batch it is dropped if the posterior
   probability (uniform prior) that its similarity reaches the threshold is below ``miss``.
4. The survivors' full sets are intersected; links are those with intersection >= threshold * union, in integers.
5. Components are formed from the links. Buckets whose members lie in more than one component may hide links
   between members that are not the centre: the members outside a bucket's largest component are compared with
   all others in salted blocks, only across components, by steps 3 and 4 inside the block's task, which returns
   no more links than it has documents; then the components are formed anew.

A pair at the threshold is missed with probability ``miss`` at most by the bands and ``miss`` by the pruning.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import materialise, partitions, rows_by_id
from .words import mix, shingle_sets

#: Rows of one side of a block in step 5, and partners of a centre that one group of step 4 holds.
BLOCK = 256


@dataclass(frozen=True)
class NearDupParams:
    """Shingles of ``shingle`` words; links at ``percent`` hundredths of Jaccard similarity or more."""

    shingle: int = 5
    percent: int = 80
    rows: int = 5
    miss: float = 1e-7
    batch: int = 32
    seed: int = 1

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log1p(-((self.percent / 100) ** self.rows)))

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    def least_matches(self) -> list[tuple[int, int]]:
        """(n, m): of the first n hashes at least m must agree, or the posterior probability of a link is below
        ``miss``. Two 8-bit values agree by chance once in 256 times."""
        c = self.percent / 100
        c += (1 - c) / 256
        rule = []
        for n in [*range(self.batch, self.hashes, self.batch), self.hashes]:
            tail, m = 0.0, -1
            while tail < self.miss and m < n:
                m += 1
                tail += comb(n + 1, m) * c**m * (1 - c) ** (n + 1 - m)
            rule.append((n, m))
        return rule


def _signatures(params: NearDupParams):
    make = np.random.default_rng(params.seed)
    xors = make.integers(0, 1 << 32, params.hashes, dtype=np.uint32)
    odds = make.integers(0, 1 << 31, params.hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    weights = make.integers(0, 1 << 62, params.rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, sets in shingle_sets(batch.column(1), params.shingle):
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                values = np.empty((len(full), params.hashes), np.uint32)
                keys = np.zeros((len(sets), 2), np.uint64)
                if len(full):
                    every = np.concatenate([sets[r] for r in full])
                    begin = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
                    low = (every >> np.uint64(32)).astype(np.uint32)
                    work = np.empty_like(low)
                    for h in range(params.hashes):
                        np.bitwise_xor(low, xors[h], out=work)
                        np.multiply(work, odds[h], out=work)
                        values[:, h] = np.minimum.reduceat(work, begin)
                    for half in range(2):  # of a set, so the order of its words doesn't matter
                        keys[full, half] = np.add.reduceat(mix(every + np.uint64(half)), begin)
                        keys[full, half] = mix(keys[full, half] + sizes[full].astype(np.uint64))
                banded = (values.reshape(len(full), params.bands, params.rows).astype(np.uint64) * weights).sum(-1, dtype=np.uint64)
                banded = mix(banded + np.arange(params.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                width = np.zeros(len(sets) + 1, np.int32)
                width[full + 1] = params.bands
                signed = np.zeros((len(sets), params.hashes), np.uint8)
                signed[full] = (values >> np.uint32(13)).astype(np.uint8)
                none = pa.array(sizes == 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, len(sets)),
                        pa.array(sizes, pa.int64()),
                        pa.array(keys[:, 0].view(np.int64), mask=none.to_numpy(zero_copy_only=False)),
                        pa.array(keys[:, 1].view(np.int64), mask=none.to_numpy(zero_copy_only=False)),
                        pa.ListArray.from_arrays(pa.array(np.cumsum(width, dtype=np.int32)), pa.array(banded.ravel())),
                        pa.array([s.tobytes() for s in signed], pa.binary()),
                    ],
                    ["id", "n_shingles", "key_a", "key_b", "bands", "signature"],
                )

    return run


def _passing(a: np.ndarray, b: np.ndarray, rule: list[tuple[int, int]]) -> np.ndarray:
    """Indices of the rows of ``a`` and ``b`` that agree often enough after each batch."""
    left = np.arange(len(a))
    matches, before = np.zeros(len(a), np.int32), 0
    for n, m in rule:
        matches = matches + (a[left, before:n] == b[left, before:n]).sum(1, dtype=np.int32)
        kept = matches >= m
        left, matches, before = left[kept], matches[kept], n
    return left


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def _prune(params: NearDupParams):
    rule, width = params.least_matches(), params.hashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = _passing(_matrix(batch.column("signature_a"), width), _matrix(batch.column("signature_b"), width), rule)
            yield batch.select(["a", "b"]).take(pa.array(kept))

    return run


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the adjacent rows that agree in ``keys``."""
    held: list[pa.Table] = []
    at = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        marks = list(zip(*(table.column(k).to_pylist() for k in keys)))
        begin = 0
        for r in range(1, len(marks) + 1):
            if r < len(marks) and marks[r] == marks[begin]:
                continue
            if held and at != marks[begin]:
                yield pa.concat_tables(held)
                held = []
            at = marks[begin]
            held.append(table.slice(begin, r - begin))
            begin = r
    if held:
        yield pa.concat_tables(held)


def _take_part(params: NearDupParams):
    """Rows sorted by (key, i, j): those that survive the pruning with a row of the other side and of another
    component. A pair counts in the first band only that its documents share."""
    rule, width = params.least_matches(), params.hashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, ["key", "i", "j"]):
            key = table.column("key")[0].as_py()
            left = table.column("left").to_numpy()
            _, part = np.unique(table.column("component").to_numpy(zero_copy_only=False), return_inverse=True)
            marks = _matrix(table.column("signature"), width)
            bands = np.array(table.column("bands").to_pylist(), np.int64).reshape(len(left), -1)
            right = np.flatnonzero(~left)
            used = np.zeros(len(left), bool)
            for r in np.flatnonzero(left):
                other = right[part[right] != part[r]]
                other = other[_passing(np.broadcast_to(marks[r], (len(other), width)), marks[other], rule)]
                first = (bands[other] == bands[r]).argmax(1)
                other = other[bands[r][first] == key]
                used[other] = True
                used[r] |= len(other) > 0
            yield from table.select(["key", "i", "j", "left", "id", "component"]).filter(pa.array(used)).combine_chunks().to_batches()

    return run


def _intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sorted sets, each of ``left`` with each of ``right``."""
    shared = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.int64)
    for begin in range(0, len(shared), 8192):
        some = shared[begin : begin + 8192]
        a, b = (np.zeros((len(x), len(some)), np.float32) for x in (left, right))
        for matrix, sets in ((a, left), (b, right)):
            for r, own in enumerate(sets):
                matrix[r, np.searchsorted(some, np.intersect1d(own, some, assume_unique=True))] = 1
        out += (a @ b.T).astype(np.int64)
    return out


def _verify_blocks(params: NearDupParams):
    """Rows sorted by (key, i, j): links between the sides, of each two components one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, ["key", "i", "j"]):
            sets = [x for _, some in shingle_sets(table.column("text"), params.shingle) for x in some]
            left = np.flatnonzero(table.column("left").to_numpy())
            right = np.flatnonzero(~table.column("left").to_numpy())
            if not len(left) or not len(right):
                continue
            _, part = np.unique(table.column("component").to_numpy(zero_copy_only=False), return_inverse=True)
            sizes = np.array([len(x) for x in sets])
            both = _intersections([sets[r] for r in left], [sets[r] for r in right])
            linked = (100 * both >= params.percent * (sizes[left][:, None] + sizes[right] - both)) & (part[left][:, None] != part[right])
            x, y = np.nonzero(linked)
            ends = np.sort(np.stack([part[left[x]], part[right[y]]], 1), 1)
            _, one = np.unique(ends, axis=0, return_index=True)
            ids = table.column("id").combine_chunks()
            yield pa.RecordBatch.from_pydict({"a": ids.take(pa.array(left[x[one]])), "b": ids.take(pa.array(right[y[one]]))})

    return run


def _verify(params: NearDupParams):
    """Rows sorted by (centre, salt), the centre's own first: the links between the centre and the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, []
        for batch in batches:
            centres, ids = batch.column("centre").to_pylist(), batch.column("id").to_pylist()
            a, b = [], []
            for i, sets in shingle_sets(batch.column("text"), params.shingle):
                for r, shingles in enumerate(sets, i):
                    if centres[r] == ids[r]:
                        own = own if centre == ids[r] else []
                        centre = ids[r]
                        own = [*own, shingles]
                        continue
                    for other in own if centre == centres[r] else ():
                        both = len(np.intersect1d(other, shingles, assume_unique=True))
                        if both and 100 * both >= params.percent * (len(other) + len(shingles) - both):
                            a.append(centres[r])
                            b.append(ids[r])
            id_type = batch.column("id").type
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, id_type), "b": pa.array(b, id_type)})

    return run


def _links(pairs: DataFrame, docs: DataFrame, params: NearDupParams) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. A centre with many partners is dealt out in salted
    groups of about ``BLOCK``, each with the centre's text once; the texts are shuffled by id once."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("salts"))
    pairs = pairs.join(sizes, "a").withColumn("salt", F.expr("pmod(xxhash64(b), salts)"))
    members = pairs.select(F.col("a").alias("centre"), "salt", F.col("b").alias("id"))
    members = members.union(pairs.select(F.col("a").alias("centre"), "salt", F.col("a").alias("id")).distinct())
    n = partitions(docs.sparkSession)
    return (
        members.join(rows_by_id(docs, members), "id")
        .select("centre", "salt", "id", "text")
        .repartition(n, "centre", "salt")
        .sortWithinPartitions("centre", "salt", F.col("id") != F.col("centre"))
        .mapInArrow(_verify(params), pairs.select("a", "b").schema)
        .distinct()
    )


def near_duplicates(docs: DataFrame, params: NearDupParams = NearDupParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, ``n_shingles`` (set size), ``component_id`` (smallest id
    reachable over links, itself included) and ``kept`` (it is that smallest one).

    Null text counts as empty; a document without words has an empty set and is linked with nothing. Rows with
    equal texts are one class and stay rows of the result. Rows that share an id count as versions of one
    document. A row with a null id has a null component and is kept. Other columns are ignored, whatever their
    names; an empty table gives an empty result. Very long texts are handled whole, one at a time.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = docs.schema["id"].dataType.simpleString()
    fingerprints = materialise(
        docs.mapInArrow(_signatures(params), f"id {id_type}, n_shingles long, key_a long, key_b long, bands array<long>, signature binary"),
        "signatures",
    )
    # Classes of equal sets. Only those of several rows need a join.
    classes = fingerprints.where("key_a is not null").groupBy("key_a", "key_b").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    classes = materialise(classes.where("n > 1 and first is not null").drop("n"), "classes")
    filed = fingerprints.select("id", "n_shingles", "key_a", "key_b").join(classes, ["key_a", "key_b"], "left")
    filed = materialise(filed.select("id", "n_shingles", F.coalesce("first", "id").alias("first")), "filed")
    represented = fingerprints.join(classes, ["key_a", "key_b"], "left").where("id is not null and n_shingles > 0 and (first is null or first = id)")
    represented = materialise(represented.select("id", "bands", "signature").dropDuplicates(["id", "bands"]), "represented")

    banded = represented.select(F.explode("bands").alias("key"), "id")
    buckets = banded.groupBy("key").agg(F.min("id").alias("centre"), F.max("id").alias("last"), F.count("*").alias("n"))
    buckets = materialise(buckets.where("centre <> last"), "buckets")
    members = materialise(banded.join(buckets, "key").select("key", "id", "centre", "n"), "members")
    signatures = represented.select("id", "signature")

    def side(x: str) -> DataFrame:
        return signatures.withColumnsRenamed({"id": x, "signature": f"signature_{x}"})

    pair_type = f"a {id_type}, b {id_type}"
    stars = members.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    stars = materialise(stars.join(side("a"), "a").join(side("b"), "b").mapInArrow(_prune(params), pair_type).distinct(), "stars")
    links = materialise(_links(stars, docs, params), "links")
    labels = connected_components(links)

    # Buckets whose members are not all in one component: those outside the largest (left) against all (right).
    placed = members.where("n > 2").join(labels, members["id"] == labels["node"], "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    placed = materialise(placed, "placed")
    parts = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("major"), F.max("n").alias("most"), F.sum("n").alias("all"))
    mixed = mixed.where("most < `all`").select("key", "major", F.expr(f"ceil((`all` - most) / {BLOCK})").alias("lefts"), F.expr(f"ceil(`all` / {BLOCK})").alias("rights"))
    placed = placed.join(mixed, "key")
    shown = ["key", "i", "j", "left", "id", "component"]
    lefts = placed.where("component <> major").selectExpr("key", "pmod(xxhash64(id), lefts) AS i", "explode(sequence(0, rights - 1)) AS j", "true AS left", "id", "component")
    rights = placed.selectExpr("key", "explode(sequence(0, lefts - 1)) AS i", "pmod(xxhash64(id), rights) AS j", "false AS left", "id", "component")
    n = partitions(docs.sparkSession)
    blocks = lefts.union(rights).join(represented, "id").select(*shown, "signature", "bands")
    blocks = blocks.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    part_type = f"key long, i long, j long, left boolean, id {id_type}, component {id_type}"
    blocks = materialise(blocks.mapInArrow(_take_part(params), part_type), "blocks")
    if not blocks.isEmpty():
        blocks = blocks.join(rows_by_id(docs, blocks), "id").select(*shown, "text").repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j")
        labels = connected_components(links.union(blocks.mapInArrow(_verify_blocks(params), pair_type)))

    found = filed.join(labels, filed["first"] == labels["node"], "left").select("id", "n_shingles", F.coalesce("component", "first").alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id", kept.alias("kept"))
