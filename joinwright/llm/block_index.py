"""Ranked lexical search over an index of compressed blocks (block-max WAND).

Each task indexes its documents into segments of bounded size, in which documents are numbered by id. A term's postings in
a segment are cut into blocks of a fixed number, stored as gaps and counts in the fewest bytes that hold them, each with
the largest impact in it. A search goes over a segment in windows of documents. Shallow moves find the blocks that overlap
a window from their bounds alone; a window whose maxima cannot beat the k-th best score is skipped, and so are the blocks
of the weaker terms once no document of the window can: blocks that are skipped are never decompressed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .storage import materialise, partitions, small, text_batches
from .words import chunks, string_buffers

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Terms are runs of ASCII letters and digits and of all characters that are not ASCII; these stand between them.
TERM, BETWEEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: A segment's documents are in rows of the term '' (``ids`` and ``norms``); all other rows are blocks.
INDEX = "segment long, term string, first int, last int, n int, most long, widths int, payload binary, ids array<long>, norms array<long>"
_ARROW = pa.schema([("segment", pa.int64()), ("term", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("n", pa.int32()), ("most", pa.int64()), ("widths", pa.int32()), ("payload", pa.binary()), ("ids", pa.list_(pa.int64())), ("norms", pa.list_(pa.int64()))])
_WIDE = {1: np.uint8, 2: np.uint16, 4: np.uint32}


@dataclass(frozen=True)
class IndexParams:
    """``block``: postings of a block. ``segment``: postings after which a segment ends (one document may exceed it).
    ``window``: documents that a search considers at once. ``chunk``: pairs of item and term that are sent to the tasks
    at once; more are searched in several jobs."""

    block: int = 128
    segment: int = 1_000_000
    window: int = 1024
    chunk: int = 500_000


def impacts(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """A posting's score before its term's weight, in thousands of the saturated count, rounded down."""
    return 1_000_000_000 * tf // (1000 * tf + 12 * norm)


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """Of one chunk: all terms in order, A-Z lower-cased, and the number of terms of each row."""
    first, last = int(offsets[0]), int(offsets[-1])
    part, bounds = data[first:last], offsets - first
    inside = _TERM[part]
    edge = np.zeros(len(part) + 1, bool)
    edge[bounds] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1 : len(part)]
    starts = np.flatnonzero(start)
    before = np.concatenate(([0], np.cumsum(inside)))  # bytes of terms before each byte
    ends = np.append(before[starts], before[-1])
    texts = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(_LOWER[part[inside]]))
    return texts, np.diff(np.searchsorted(starts, bounds))


def corpus_stats(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """How many documents have a term, and how many terms all have."""
    text_batches(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_buffers(batch.column(0))
            n = [terms_of(data, offsets[i : j + 1])[1] for i, j in chunks(offsets)]
            n = np.concatenate(n) if n else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], names=["docs", "terms"])

    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(counted, "docs long, terms long").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    return found.docs or 0, found.terms or 0


class _Segment:
    """Postings of documents as they come, until they are written."""

    def __init__(self):
        self.docs, self.postings = 0, 0
        self.ids, self.lengths, self.parts = [], [], []

    def add(self, ids: pa.Array, texts: pa.LargeStringArray, counts: np.ndarray) -> None:
        coded = texts.dictionary_encode()
        size = max(1, len(coded.dictionary))
        keys = np.repeat(np.arange(len(counts)), counts) * size + coded.indices.to_numpy(zero_copy_only=False)
        keys, tf = np.unique(keys, return_counts=True)
        self.parts.append((keys // size + self.docs, keys % size, tf, coded.dictionary))
        self.ids.append(ids)
        self.lengths.append(counts)
        self.docs += len(counts)
        self.postings += len(keys)

    def rows(self, number: int, n_docs: int, n_terms: int, params: IndexParams) -> Iterator[pa.RecordBatch]:
        ids = pa.concat_arrays(self.ids)
        order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
        place = np.empty(self.docs, np.int64)
        place[order] = np.arange(self.docs)
        norms = 75 + 25 * np.concatenate(self.lengths)[order].astype(np.int64) * n_docs // max(1, n_terms)
        dictionary = pa.chunked_array([d for *_, d in self.parts], pa.large_string()).combine_chunks()
        if isinstance(dictionary, pa.ChunkedArray):
            dictionary = pa.concat_arrays(dictionary.chunks)
        coded = dictionary.dictionary_encode()
        codes, begins = coded.indices.to_numpy(zero_copy_only=False), np.cumsum([0] + [len(d) for *_, d in self.parts])
        doc = place[np.concatenate([p[0] for p in self.parts])]
        term = np.concatenate([codes[p[1] + b] for p, b in zip(self.parts, begins)])
        tf = np.concatenate([p[2] for p in self.parts])
        by = np.lexsort((doc, term))
        doc, term, tf = doc[by], term[by], tf[by]
        one = lambda values, kind: pa.array([values], kind)
        yield pa.RecordBatch.from_arrays([one(number, pa.int64()), one("", pa.string()), *[one(0, pa.int32())] * 3, one(0, pa.int64()), one(0, pa.int32()), one(b"", pa.binary()), pa.ListArray.from_arrays([0, self.docs], ids.take(pa.array(order))), pa.ListArray.from_arrays([0, self.docs], pa.array(norms))], schema=_ARROW)
        if not len(doc):
            return
        new = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
        inside = np.arange(len(doc)) - np.repeat(new, np.diff(np.append(new, len(doc))))
        cuts = np.flatnonzero(inside % params.block == 0)
        stops = np.append(cuts[1:], len(doc))
        gaps = np.concatenate(([0], np.diff(doc)))
        gaps[cuts] = 0
        width = lambda top: np.where(top < 256, 1, np.where(top < 65536, 2, 4))
        gap_width, tf_width = width(np.maximum.reduceat(gaps, cuts)), width(np.maximum.reduceat(tf, cuts))
        most = np.maximum.reduceat(impacts(tf, norms[doc]), cuts)
        for i in range(0, len(cuts), 20_000):
            some = slice(i, i + 20_000)
            shape = list(zip(cuts[some].tolist(), stops[some].tolist(), gap_width[some].tolist(), tf_width[some].tolist()))
            payload = [gaps[a:b].astype(_WIDE[g]).tobytes() + tf[a:b].astype(_WIDE[t]).tobytes() for a, b, g, t in shape]
            a, b, none = cuts[some], stops[some], pa.nulls(len(shape), pa.list_(pa.int64()))
            columns = [np.full(len(a), number), coded.dictionary.take(pa.array(term[a])).cast(pa.string()), doc[a], doc[b - 1], b - a, most[some], gap_width[some] * 16 + tf_width[some]]
            columns = [pa.array(c).cast(f.type) for c, f in zip(columns, _ARROW)] + [pa.array(payload, pa.binary()), none, none]
            yield pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def build_index(docs: DataFrame, n_docs: int, n_terms: int, id_col: str = "doc_id", text_col: str = "text", params: IndexParams = IndexParams()) -> DataFrame:
    """The index of all documents (see ``INDEX``), written to the shared folder; ``n_docs`` and ``n_terms`` are those of
    :func:`corpus_stats`. Nothing is shuffled: each task writes segments of its own documents."""
    text_batches(docs.sparkSession)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number, segment = TaskContext.get().partitionId() << 32, 0, _Segment()
        for batch in batches:
            data, offsets = string_buffers(batch.column(1))
            for i, j in chunks(offsets):
                segment.add(batch.column(0).slice(i, j - i), *terms_of(data, offsets[i : j + 1]))
                if segment.postings >= params.segment:
                    yield from segment.rows(base + number, n_docs, n_terms, params)
                    number, segment = number + 1, _Segment()
        if segment.docs:
            yield from segment.rows(base + number, n_docs, n_terms, params)

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return materialise(chosen.mapInArrow(indexed, INDEX), "block_index")


class _Postings:
    """A term's blocks in one segment: bounds as arrays, and the blocks that were decompressed."""

    def __init__(self, table: pa.Table):
        order = np.argsort(table.column("first").to_numpy())
        self.first, self.last, self.n, self.most, self.widths = (table.column(c).to_numpy()[order] for c in ("first", "last", "n", "most", "widths"))
        self.payload, self.order, self.open = table.column("payload"), order, {}

    def maxima(self, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each window: the first block that may overlap it, the first beyond it, and the largest impact of those between."""
        low, high = np.searchsorted(self.last, starts), np.searchsorted(self.first, starts + window)
        top = np.zeros(len(starts), np.int64)
        full = low < high
        ends = np.append(self.most, 0)
        pairs = np.column_stack((low[full], high[full])).ravel()
        if len(pairs):
            top[full] = np.maximum.reduceat(ends, pairs)[::2]
        return low, high, top

    def block(self, i: int, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block's documents and impacts."""
        if i not in self.open:
            raw, n, (g, t) = self.payload[int(self.order[i])].as_py(), int(self.n[i]), divmod(int(self.widths[i]), 16)
            doc = int(self.first[i]) + np.cumsum(np.frombuffer(raw, _WIDE[g], n).astype(np.int64))
            tf = np.frombuffer(raw, _WIDE[t], n, g * n).astype(np.int64)
            self.open[i] = doc, impacts(tf, norms[doc])
        return self.open[i]


def best_of_segment(lists: list[tuple[_Postings, int]], norms: np.ndarray, k: int, window: int, opened: set | None = None) -> list[tuple[int, int]]:
    """``(score, number)`` of the segment's ``k`` best documents with a score above 0 for terms and their weights, best
    first; of equal ones those of smaller numbers. Documents are met in the order of their numbers, so that a later one
    must beat the k-th best."""
    starts = np.arange(0, len(norms), window)
    moves = [p.maxima(starts, window) for p, _ in lists]
    bounds = np.array([w * m[2] for (_, w), m in zip(lists, moves)]).reshape(len(lists), len(starts))
    total = bounds.sum(axis=0)
    heap: list[tuple[int, int]] = []  # of (score, -number)
    for j in np.flatnonzero(total > 0):
        least = heap[0][0] if len(heap) == k else 0
        rest = int(total[j])
        if rest <= least:
            continue
        start = int(starts[j])
        scores = np.zeros(min(window, len(norms) - start), np.int64)
        for t in np.argsort(-bounds[:, j], kind="stable"):
            if not bounds[t, j] or int(scores.max()) + rest <= least:
                break
            rest -= int(bounds[t, j])
            postings, weight = lists[t]
            for b in range(int(moves[t][0][j]), int(moves[t][1][j])):
                near = scores[max(0, int(postings.first[b]) - start) : int(postings.last[b]) - start + 1]
                if not len(near) or int(near.max()) + int(bounds[t, j]) + rest <= least:
                    continue  # none of the documents that the block may hold can become one of the best
                doc, impact = postings.block(b, norms)
                if opened is not None:
                    opened.add((t, b))
                low, high = np.searchsorted(doc, (start, start + len(scores)))
                scores[doc[low:high] - start] += weight * impact[low:high]
        found = np.flatnonzero(scores > least)
        for i in found[np.lexsort((found, -scores[found]))[:k]]:
            entry = (int(scores[i]), -(start + int(i)))
            if len(heap) < k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
    return [(score, -number) for score, number in sorted(heap, reverse=True)]


def _searcher(items: pa.Table, k: int, window: int):
    """Finds the best documents of one segment's rows for all items."""

    def search(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        terms = table.column("term").dictionary_encode().combine_chunks()
        terms = terms.chunk(0) if isinstance(terms, pa.ChunkedArray) else terms
        codes = terms.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        cuts = np.searchsorted(codes[order], np.arange(len(terms.dictionary) + 1))
        of = {name: table.take(pa.array(order[a:b])) for name, a, b in zip(terms.dictionary.to_pylist(), cuts, cuts[1:])}
        own = of.pop("")
        ids, norms = own.column("ids")[0].values, own.column("norms")[0].values.to_numpy()
        lists = {name: _Postings(t) for name, t in of.items()}
        found: list[tuple[int, int | None, int]] = []
        for item, names, weights in zip(*(items.column(c).to_pylist() for c in ("item", "terms", "weights"))):
            here = [(lists[t], w) for t, w in zip(names, weights) if t in lists and w > 0]
            if here:
                found += [(item, ids[number].as_py(), score) for score, number in best_of_segment(here, norms, k, window)]
        return pa.table({"item": pa.array([x[0] for x in found], pa.int64()), "doc_id": pa.array([x[1] for x in found], pa.int64()), "score": pa.array([x[2] for x in found], pa.int64())})

    return search


def query_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item, term, times)`` of the queries; rows of one id are one query."""
    text = F.translate(F.col(text_col).cast("string"), _UPPER, _UPPER.lower())
    found = items.select(F.col(item_col).cast("long").alias("item"), F.explode(F.split(text, BETWEEN)).alias("term"))
    return found.where("term <> ''").groupBy("item", "term").agg(F.count("*").alias("times"))


def search_index(index: DataFrame, n_docs: int, items: DataFrame, item_col: str = "item_id", text_col: str = "text", k: int = 20, params: IndexParams = IndexParams()) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's ``k`` best documents of the index, equal scores by ascending id.

    Items of null texts or without terms, and terms that no document has, find nothing; a null item id is an id; a
    document with a null id comes after all others of its score.
    """
    spark = index.sparkSession
    asked = materialise(query_terms(items, item_col, text_col), "query_terms")
    used = index.where("term <> ''").join(small(asked.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1)))
    weighted = materialise(asked.join(used, "term").select("item", "term", (F.col("times") * weight).alias("weight")), "weighted_terms")
    per_item = weighted.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("own"))
    per_item = per_item.select("item", F.col("own.term").alias("terms"), F.col("own.weight").alias("weights"))
    chunk_count = max(1, -(-weighted.count() // params.chunk))
    found = None
    for c in range(chunk_count):
        here = F.pmod(F.xxhash64("item"), F.lit(chunk_count)) == c
        sent = per_item.where(here).toArrow()
        chosen = index.where("term <> ''").join(F.broadcast(weighted.where(here).select("term").distinct()), "term", "left_semi")
        rows = index.where("term = ''").select(*index.columns).union(chosen.select(*index.columns))
        # A stated number of parts, which is not lowered for their few bytes: it is the search that takes the time.
        part = rows.repartition(partitions(spark), "segment").groupBy("segment").applyInArrow(_searcher(sent, k, params.window), "item long, doc_id long, score long")
        found = part if found is None else found.union(part)
    best = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias("item_id"), "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20, params: IndexParams = IndexParams()) -> DataFrame:
    """Index ``docs`` (``doc_id, text``) and search it for ``items`` (``item_id, text``).

    Null and empty texts have no terms and are never found; each row is a document, so repeated rows are found each; a text
    of any length is indexed whole; other columns are ignored, whatever their names; empty tables give an empty result.
    """
    n_docs, n_terms = corpus_stats(docs)
    return search_index(build_index(docs, n_docs, n_terms, params=params), n_docs, items, k=k, params=params)
