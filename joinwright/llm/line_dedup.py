"""Removal of lines that many documents share, incremental and reversible.

The state is an exact table of reference counts (line key -> number of documents that have it) and, by shard of the
key, a cuckoo filter of the frequent keys. Inserting or deleting documents adds signed counts; keys that cross
the threshold are inserted into or deleted from their shard's filter. So deleting what was inserted
restores the state, and every decision follows the exact counts: keys below the threshold that a filter takes for
frequent ones are found by probing the count table and are excepted.

A line's key is its bytes without ASCII white space at both ends, A-Z lower-cased, as a 128-bit hash. A document is all
rows of one id; rows without an id are one document for each distinct text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cuckoo import CuckooFilter
from .storage import materialise, partitions, rows_by_id, small

#: Keys that a partition counts before it passes the counts on.
HELD = 250_000
#: Bytes of filters, and excepted keys, up to which decisions are made where the texts are; beyond either, by joins.
FILTER_BYTES, EXCEPTED = 64 << 20, 200_000
#: Frequent keys of a shard at which their number is raised.
SHARD_KEYS = 1 << 17
_BLANK = b" \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class LineDedupParams:
    """Keys of at least ``min_chars`` code points that at least ``min_docs`` documents have are frequent. ``keep``:
    "none" drops their lines everywhere, "first" keeps them in the document with the smallest id (if none of the key's
    documents has one, with the smallest hash of the text). ``shards`` is the least number of shards."""

    min_docs: int = 10
    min_chars: int = 1
    shards: int = 64
    keep: str = "none"


@dataclass(frozen=True)
class LineState:
    """``counts(key_a, key_b, n_docs)`` and ``filters(shard, filter)``."""

    counts: DataFrame
    filters: DataFrame
    shards: int


def _digests(text: str | None, min_chars: int) -> list[bytes]:
    """The key of each line; empty for lines whose key is too short."""
    out = []
    for line in (text or "").encode().split(b"\n"):
        key = line.strip(_BLANK).lower()
        long_enough = len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars)
        out.append(xxhash.xxh3_128_digest(key) if key and long_enough else b"")
    return out


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def _keys(halves: list[list[int]] | None) -> frozenset[bytes]:
    return frozenset(np.array(x, np.int64).tobytes() for x in halves or ())


def _count_lines(min_chars: int, with_first: bool):
    """Rows (text, id), each a document: keys with the number of these and the smallest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        first: dict = {}
        id_type = pa.null()

        def emit() -> pa.RecordBatch:
            a, b = _halves(list(counts))
            columns = {"key_a": a, "key_b": b, "n_docs": pa.array(counts.values(), pa.int64())}
            if with_first:
                columns["id"] = pa.array([first[k] for k in counts], id_type)
            counts.clear()
            first.clear()
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            id_type = batch.column(1).type
            for text, own in zip(batch.column(0), batch.column(1).to_pylist()):
                for key in {*_digests(text.as_py(), min_chars)} - {b""}:
                    counts[key] = counts.get(key, 0) + 1
                    if with_first and (key not in first or own < first[key]):
                        first[key] = own
                if len(counts) >= HELD:
                    yield emit()
        if counts:
            yield emit()

    return run


def _keys_of(min_chars: int):
    """Rows (text, id, hash): a row (id, hash, key) for each different key of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted({*_digests(t, min_chars)} - {b""}) for t in batch.column(0).to_pylist()]
            a, b = _halves([k for x in own for k in x])
            rows = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
            yield pa.RecordBatch.from_arrays([batch.column(1).take(rows), batch.column(2).take(rows), pa.array(a), pa.array(b)], ["id", "hash", "key_a", "key_b"])

    return run


def line_counts(docs: DataFrame, params: LineDedupParams, text_col: str = "text", id_col: str = "doc_id", with_first: bool = False) -> DataFrame:
    """``(key_a, key_b, n_docs)`` of all documents, and with ``with_first`` which one is the first: ``first``, a struct
    ``(late, id, hash)``. Rows whose id is unique, as is usual, are counted where they are; only those that share an id
    or have none are compared first."""
    docs = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"))
    id_type = docs.schema["id"].dataType.simpleString()
    ids = materialise(docs.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null").select("id"), "repeated_ids")
    count = lambda rows: rows.mapInArrow(_count_lines(params.min_chars, with_first), "key_a long, key_b long, n_docs long" + (f", id {id_type}" if with_first else ""))
    first = lambda i, h: F.struct(F.col(i).isNull().alias("late"), F.col(i).alias("id"), h.alias("hash"))
    nothing = F.lit(None).cast("long")
    if ids.isEmpty():
        parts = count(docs)
    else:
        known = ids.where("id is not null")
        parts = count(rows_by_id(docs.where("id is not null"), known, having=False).select("text", "id"))
        shared = rows_by_id(docs.where("id is not null"), known).select("text", "id").union(docs.where("id is null").select("text", "id"))
        shared = shared.select("text", "id", F.when(F.col("id").isNull(), F.xxhash64("text")).alias("hash"))
        keys = shared.mapInArrow(_keys_of(params.min_chars), f"id {id_type}, hash long, key_a long, key_b long").distinct()
        if with_first:
            parts = parts.select("key_a", "key_b", "n_docs", first("id", nothing).alias("first"))
            keys = keys.select("key_a", "key_b", F.lit(1).cast("long").alias("n_docs"), first("id", F.col("hash")).alias("first"))
        else:
            keys = keys.select("key_a", "key_b", F.lit(1).cast("long").alias("n_docs"))
        parts = parts.union(keys)
    if with_first and "first" not in parts.columns:
        parts = parts.select("key_a", "key_b", "n_docs", first("id", nothing).alias("first"))
    return parts.groupBy("key_a", "key_b").agg(F.sum("n_docs").alias("n_docs"), *([F.min("first").alias("first")] if with_first else []))


def _changed_filter(old: pa.Table, changes: pa.Table) -> pa.Table:
    shard = (old if old.num_rows else changes).column("shard")[0].as_py()
    a, b = (np.ascontiguousarray(changes.column(c).to_numpy()) for c in ("key_a", "key_b"))
    entering = changes.column("entering").to_numpy()
    data = old.column("filter")[0].as_py() if old.num_rows else None
    held = CuckooFilter.from_bytes(data) if data else CuckooFilter(int(entering.sum()))
    held.delete(a[~entering], b[~entering])
    made = held.to_bytes() if held.insert(a[entering], b[entering]) else None
    return pa.table({"shard": pa.array([shard], pa.int32()), "filter": pa.array([made], pa.binary())})


def _built_filter(keys: pa.Table) -> pa.Table:
    a, b = (np.ascontiguousarray(keys.column(c).to_numpy()) for c in ("key_a", "key_b"))
    capacity = 2 * len(a)
    while not (held := CuckooFilter(capacity)).insert(a, b):
        capacity *= 2
    return pa.table({"shard": keys.column("shard").slice(0, 1), "filter": pa.array([held.to_bytes()], pa.binary())})


def _shard(shards: int) -> Column:
    return F.expr(f"cast(pmod(shiftright(key_a, 24), {shards}) AS int)").alias("shard")


def update_lines(state: LineState | None, inserts: DataFrame | None, deletes: DataFrame | None, params: LineDedupParams, text_col: str = "text", id_col: str = "doc_id") -> LineState:
    """The state after inserting and deleting documents. ``state`` None is the empty one. Documents to insert must have
    new ids, and those to delete must be some that were inserted, with all their rows and the same texts; counts never
    fall below zero. The number of shards follows the number of frequent keys; where it is raised, all filters are built
    anew from the exact counts."""
    signed = [line_counts(d, params, text_col, id_col).withColumn("n_docs", F.col("n_docs") * sign) for d, sign in ((inserts, 1), (deletes, -1)) if d is not None]
    if not signed:
        raise ValueError("give documents to insert or to delete")
    delta = signed[0] if len(signed) == 1 else signed[0].union(signed[1]).groupBy("key_a", "key_b").agg(F.sum("n_docs").alias("n_docs"))
    if state is None:
        merged = delta.select("key_a", "key_b", F.lit(0).cast("long").alias("before"), F.greatest("n_docs", F.lit(0)).alias("n_docs"))
    else:
        old = state.counts.select("key_a", "key_b", F.col("n_docs").alias("before"))
        n = F.greatest(F.coalesce("before", F.lit(0)) + F.coalesce("n_docs", F.lit(0)), F.lit(0)).alias("n_docs")
        merged = old.join(delta, ["key_a", "key_b"], "full").select("key_a", "key_b", F.coalesce("before", F.lit(0)).alias("before"), n)
    merged = materialise(merged, "line_counts")
    counts = merged.where("n_docs > 0").select("key_a", "key_b", "n_docs")
    frequent = counts.where(f"n_docs >= {params.min_docs}")
    needed = max(params.shards, 1 << math.ceil(math.log2(max(1, frequent.count() / SHARD_KEYS))))
    filter_type = "shard int, filter binary"
    if state is None or needed > 2 * state.shards:
        filters = frequent.select(_shard(needed), "key_a", "key_b").groupBy("shard").applyInArrow(_built_filter, filter_type)
        return LineState(counts, materialise(filters, "line_filters"), needed)
    shard = _shard(state.shards)
    crossing = merged.where(f"(before >= {params.min_docs}) <> (n_docs >= {params.min_docs})")
    crossing = crossing.select(shard, "key_a", "key_b", (F.col("n_docs") >= params.min_docs).alias("entering"))
    filters = state.filters.groupBy("shard").cogroup(crossing.groupBy("shard")).applyInArrow(_changed_filter, filter_type)
    filters = materialise(filters, "line_filters")
    full = filters.where("filter is null").select("shard")
    if not full.isEmpty():  # too full to insert into: built anew from the exact counts
        rebuilt = frequent.select(shard, "key_a", "key_b").join(full, "shard", "left_semi").groupBy("shard").applyInArrow(_built_filter, filter_type)
        filters = materialise(filters.where("filter is not null").union(rebuilt), "line_filters")
    return LineState(counts, filters, state.shards)


class _Probe:
    """The filters of all shards, for keys of any."""

    def __init__(self, filters: dict[int, bytes], shards: int):
        self.filters = {s: CuckooFilter.from_bytes(f) for s, f in filters.items()}
        self.shards = shards

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), bool)
        shard = (a >> np.int64(24)) % self.shards
        for s in np.unique(shard).tolist():
            if s in self.filters:
                of = shard == s
                out[of] = self.filters[s].contains(a[of], b[of])
        return out


def _probe_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, salt, filter, id, hash, key) sorted by shard and salt, a filter before its keys: the keys' rows that it
    takes for frequent. One filter is held at once."""
    of, held = None, None
    for batch in batches:
        shard, salt = (batch.column(i).to_numpy() for i in (0, 1))
        a, b = (np.ascontiguousarray(batch.column(i).to_numpy()) for i in (5, 6))
        heads = np.flatnonzero(batch.column(2).is_valid().to_numpy(zero_copy_only=False))
        hit = np.zeros(batch.num_rows, bool)
        for begin, end in zip([-1, *heads.tolist()], [*heads.tolist(), batch.num_rows]):
            if begin >= 0:
                of, held = (shard[begin], salt[begin]), CuckooFilter.from_bytes(batch.column(2)[begin].as_py())
            if held is not None:
                rows = np.arange(begin + 1, end)
                rows = rows[(shard[rows] == of[0]) & (salt[rows] == of[1])]
                hit[rows] = held.contains(a[rows], b[rows])
        yield pa.RecordBatch.from_arrays(batch.columns[3:], ["id", "hash", "key_a", "key_b"]).filter(pa.array(hit))


def _drop(params: LineDedupParams, shards: int, shared, listed: bool, exempt: bool, names: list[str]):
    """Columns: text, then (``listed``) the keys to drop, then (``exempt``) keys to keep, then those to pass on."""
    min_chars = params.min_chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe, excepted = None, frozenset()
        if shared is not None:
            filters, excepted = shared.value
            probe = _Probe(filters, shards)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            keys = [_digests(t, min_chars) for t in texts]
            flat = [k for own in keys for k in own if k]
            if listed:
                drops = [_keys(x) for x in batch.column(1).to_pylist()]
            else:
                a, b = _halves(flat)
                hit = iter(probe(a, b).tolist())
                drops = [frozenset([k for k in own if k and next(hit) and k not in excepted]) for own in keys]
            if exempt:
                drops = [d - _keys(x) for d, x in zip(drops, batch.column(1 + listed).to_pylist())]
            kept, dropped = [], []
            for text, own, drop in zip(texts, keys, drops):
                lines = (text or "").split("\n")
                left = [line for line, key in zip(lines, own) if key not in drop] if drop else lines
                kept.append("\n".join(left))
                dropped.append(len(lines) - len(left))
            rest = batch.columns[1 + listed + exempt :]
            made = [pa.array(map(len, keys), pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([*rest, *made], names)

    return run


def drop_frequent_lines(
    docs: DataFrame, state: LineState, params: LineDedupParams = LineDedupParams(), keep_cols: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text",
    first: DataFrame | None = None, filter_bytes: int = FILTER_BYTES, inserted: bool = False,
) -> DataFrame:
    """``keep_cols`` (default: ``id_col``) with ``n_lines`` (before dropping), ``n_dropped`` and ``kept_text``.

    Null and empty texts are one empty line, whose key is too short to be frequent. A document may lose all its lines;
    its kept text is then empty. Repeated rows get equal results, other columns are ignored, kept columns with a result's
    name give way to it, and an empty table gives an empty result. Very long texts are handled whole, one at a time.
    ``first(key_a, key_b, first)`` names for "first" the documents that keep a key's lines.

    The documents' keys are dealt out by shard, each shard (in salted parts) with its filter, those that a filter takes for
    frequent are joined with the exact counts, and the texts with what is left. If all documents are ``inserted`` in the
    state, so that it has counted every key of theirs, and all filters together have at most ``filter_bytes``, the filters
    and the counted keys that they take for frequent by mistake are sent to the tasks instead, and no text is shuffled.
    Both ways are exact.
    """
    made = {"n_lines": "long", "n_dropped": "long", "kept_text": "string"}
    keep_cols = [c for c in keep_cols or [id_col] if c not in made]
    frequent = state.counts.where(F.col("n_docs") >= params.min_docs).select("key_a", "key_b")
    spark = docs.sparkSession
    schema = docs.select(*keep_cols).schema
    for c, kind in made.items():
        schema = schema.add(c, kind)
    text = F.col(text_col).cast("string")
    docs = docs.select(text.alias("text"), F.col(id_col).alias("id"), *[F.col(c).alias(str(i)) for i, c in enumerate(keep_cols)])
    passed = [str(i) for i in range(len(keep_cols))]
    key, shards = F.expr("array(key_a, key_b)"), state.shards

    shared, listed = None, False
    size = state.filters.agg(F.sum(F.length("filter"))).first()[0] or 0
    if inserted and size <= filter_bytes:
        filters = {r.shard: bytes(r.filter) for r in state.filters.collect()}
        sent = spark.sparkContext.broadcast(filters)

        def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            probe = _Probe(sent.value, shards)
            for batch in batches:
                a, b = (np.ascontiguousarray(batch.column(i).to_numpy()) for i in (0, 1))
                yield batch.filter(pa.array(probe(a, b)))

        rare = state.counts.where(F.col("n_docs") < params.min_docs).select("key_a", "key_b")
        wrong = materialise(rare.mapInArrow(taken, "key_a long, key_b long"), "excepted")
        if wrong.count() <= EXCEPTED:
            excepted = _keys([[r.key_a, r.key_b] for r in wrong.collect()])
            shared = spark.sparkContext.broadcast((filters, excepted))
    if shared is None:
        listed = True
        n = partitions(spark)
        salts = max(1, math.ceil(n / shards))
        docs = docs.withColumn("hash", F.xxhash64("text"))
        id_type = docs.schema["id"].dataType.simpleString()
        lines = docs.select("text", "id", "hash").mapInArrow(_keys_of(params.min_chars), f"id {id_type}, hash long, key_a long, key_b long")
        lines = lines.select(_shard(shards), F.expr(f"cast(pmod(xxhash64(id, hash, key_b), {salts}) AS int)").alias("salt"), F.lit(None).cast("binary").alias("filter"), "id", "hash", "key_a", "key_b")
        heads = state.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "filter", F.lit(None).cast(id_type), *[F.lit(0).cast("long")] * 3)
        dealt = lines.union(heads).repartition(n, "shard", "salt").sortWithinPartitions("shard", "salt", F.col("filter").isNull())
        found = dealt.mapInArrow(_probe_shards, f"id {id_type}, hash long, key_a long, key_b long").distinct().join(frequent, ["key_a", "key_b"])
        drops = found.groupBy(F.col("id").alias("of"), F.col("hash").alias("with")).agg(F.collect_set(key).alias("drop"))
        docs = docs.join(drops, docs["id"].eqNullSafe(drops["of"]) & docs["hash"].eqNullSafe(drops["with"]), "left")
    if first is not None:
        owned = small(first.groupBy("first").agg(F.collect_list(key).alias("exempt")).select(F.col("first.id").alias("owner"), F.col("first.hash").alias("owner_hash"), "exempt"))
        docs = docs.withColumn("who", F.when(F.col("id").isNull(), F.xxhash64("text")))
        docs = docs.join(owned, docs["id"].eqNullSafe(owned["owner"]) & docs["who"].eqNullSafe(owned["owner_hash"]), "left")
    columns = ["text", *(["drop"] if listed else []), *(["exempt"] if first is not None else []), *passed]
    return docs.select(*columns).mapInArrow(_drop(params, shards, shared, listed, first is not None, schema.names), schema)


def dedup_lines(docs: DataFrame, params: LineDedupParams = LineDedupParams(), keep_cols: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Insert ``docs`` into an empty state and drop their frequent lines; see :func:`drop_frequent_lines`."""
    state = update_lines(None, docs, None, params, text_col, id_col)
    first = None
    if params.keep == "first":
        first = line_counts(docs, params, text_col, id_col, with_first=True).where(F.col("n_docs") >= params.min_docs).select("key_a", "key_b", "first")
        first = materialise(first, "first_documents")
    return drop_frequent_lines(docs, state, params, keep_cols, id_col, text_col, first, inserted=True)
