"""Document fingerprints by consistent weighted sampling of words, and their comparison with neighbours.

A document is a set of words weighted by how often they occur. For each of ``samples`` positions, every word has
gamma variables r, c and a uniform b, from hashes of the word: t = floor(ln(weight) / r + b) and
ln a = ln c - r (t - b) - r. The position's sample is (word, t) of the word with the smallest a. Two documents
agree in a position with a probability of their generalised Jaccard similarity, the sum of smaller weights over the
sum of larger ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import partitions
from .words import chunks, mix, string_buffers, word_hashes

SAMPLES = 64
#: Words whose variables are held at once.
PART = 1 << 15
BLOCK = 256
_POSITIONS = np.arange(SAMPLES)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _uniforms(words: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers in (0, 1) for each word and position."""
    positions = mix(np.arange(SAMPLES, dtype=np.uint64) + np.uint64(salt * 1_000_003))
    bits = mix(words[:, None] ^ positions)
    scale = 1.0 / (1 << 32)
    return ((bits >> np.uint64(32)).astype(np.float64) + 0.5) * scale, ((bits & np.uint64(0xFFFFFFFF)).astype(np.float64) + 0.5) * scale


def _variables(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r and b, and ln a at weight 1. Made for ``BLOCK`` words at a time, whose numbers stay in a core's cache."""
    out = tuple(np.empty((len(words), SAMPLES), np.float32) for _ in range(3))
    for i in range(0, len(words), BLOCK):
        some = words[i : i + BLOCK]
        u, v = _uniforms(some, 1)
        r = -np.log(np.multiply(u, v, out=u))
        u, v = _uniforms(some, 2)
        log_c = np.log(-np.log(np.multiply(u, v, out=u)))
        b, _ = _uniforms(some, 3)
        for held, values in zip(out, (r, b, log_c + r * b - r)):
            held[i : i + BLOCK] = values
    return out


def sample_signatures(texts: pa.Array) -> np.ndarray:
    """One row of ``SAMPLES`` 16-bit samples for each text; all 0 for texts without words."""
    data, offsets = string_buffers(texts)
    out = np.zeros((len(texts), SAMPLES), np.uint16)
    for i, j in chunks(offsets):
        hashes, rows, _, _ = word_hashes(data, offsets[i : j + 1])
        if not len(hashes):
            continue
        terms, at = np.unique(hashes, return_inverse=True)
        begin = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=j - i))))
        low = np.full((j - i, SAMPLES), np.inf, np.float32)
        for part in range(0, len(terms), PART):  # one part, but for long texts
            some = terms[part : part + PART]
            r, b, unit = _variables(some)
            for row in range(j - i):
                own, times = np.unique(at[begin[row] : begin[row + 1]], return_counts=True)
                inside = slice(*np.searchsorted(own, (part, part + len(some))))
                own, times = own[inside] - part, times[inside]
                if not len(own):
                    continue
                value, more = unit[own], np.flatnonzero(times > 1)
                t = np.floor(np.log(times[more].astype(np.float32))[:, None] / r[own[more]] + b[own[more]])
                value[more] -= r[own[more]] * t
                best = value.argmin(0)
                least = value[best, _POSITIONS]
                steps = np.zeros(len(own), np.int64)
                steps[more] = np.arange(1, len(more) + 1)
                step = np.concatenate((np.zeros((1, SAMPLES)), t))[steps[best], _POSITIONS]
                sample = (mix(some[own[best]] + (step + 1).astype(np.uint64) * _STEP) >> np.uint64(48)).astype(np.uint16)
                lower = least < low[row]
                low[row][lower], out[i + row][lower] = least[lower], sample[lower]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of positions in which two signatures agree; an empty text is like empty texts only."""
    if not a.any() or not b.any():
        return float(not a.any() and not b.any())
    return float((a == b).mean())


def _bucket(bounds: list[int], value: Column) -> Column:
    """How many of the ascending bounds are less than the value, by binary search."""
    table = F.array(*[F.lit(b) for b in bounds])

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["low"] + s["high"]) / 2).cast("int")
        less = F.element_at(table, F.least(mid + 1, F.lit(len(bounds)))) < value
        go = s["low"] < s["high"]
        return F.struct(F.when(go & less, mid + 1).otherwise(s["low"]).alias("low"), F.when(go & ~less, mid).otherwise(s["high"]).alias("high"))

    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1))
    found = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high")), halve)
    return F.coalesce(found["low"], F.lit(0))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, guest, id, text) in order: each row's fingerprint, its edited text's, and their likenesses."""
    last: tuple | None = None

    def pairs(batch: pa.RecordBatch) -> Iterator[tuple]:
        nonlocal last
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if last is not None and row[0] == last[0] and not last[1]:
                yield last, row
            last = row

    for batch in batches:
        found = list(pairs(batch))
        for begin in range(0, len(found), 256):
            some = found[begin : begin + 256]
            texts = [row[3] or "" for row, _ in some]
            following = [row[3] or "" for _, row in some]
            edited = [x[: len(x) - len(x) // 3] + y[: len(x) // 3] for x, y in zip(texts, following)]
            distinct = {x: i for i, x in enumerate(dict.fromkeys([*texts, *following, *edited]))}
            marks = sample_signatures(pa.array(distinct, pa.large_string()))
            own, next_, changed = (marks[[distinct[x] for x in group]] for group in (texts, following, edited))
            yield pa.RecordBatch.from_pydict(
                {
                    "id": pa.array([row[2] for row, _ in some], batch.schema.field("id").type),
                    "n_chars": pa.array(map(len, texts), pa.int64()),
                    "edited_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in edited],
                    "fingerprint": [x.astype(">u2").tobytes().hex() for x in own],
                    "edited_fingerprint": [x.astype(">u2").tobytes().hex() for x in changed],
                    "near_edited": [likeness(x, y) for x, y in zip(own, changed)],
                    "near_next": [likeness(x, y) for x, y in zip(own, next_)],
                }
            )


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` with ``fingerprint``, in hex: one row for each row. Null texts count as empty, whose fingerprint is 0;
    very long texts take memory by the part. Other columns are ignored, whatever their names."""
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, fingerprint string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = sample_signatures(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.astype(">u2").tobytes().hex() for x in marks], pa.string())], ["id", "fingerprint"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints every text and its edited form, whose last third of code points is replaced by the first as many
    of the next document in descending order of the integer id (after the last: the first), and compares both
    with the text. Equal ids are in the order of their texts' hashes; null ids come last.

    The documents are dealt by id into ranges, shuffled once, and read in order. The first document of each
    range also goes to the range before, as a guest; there are as many guests as ranges.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = docs.schema["id"].dataType
    n = partitions(spark)
    points = [i / (4 * n) for i in range(1, 4 * n)]
    bounds = sorted(set(docs.agg(F.percentile_approx("id", points, 100 * n)).first()[0] or ()))
    placed = docs.select("id").withColumn("range", F.lit(len(bounds)) - _bucket(bounds, F.col("id"))) if bounds else docs.select("id").withColumn("range", F.lit(0))
    heads = sorted((r.range, r.id) for r in placed.groupBy("range").agg(F.max("id").alias("id")).collect())
    guests = [(head, heads[i - 1][0]) for i, (_, head) in enumerate(heads)]
    guests = spark.createDataFrame(guests, f"head {id_type.simpleString()}, host int")
    ranged = docs.withColumn("range", F.lit(len(bounds)) - _bucket(bounds, F.col("id")) if bounds else F.lit(0))
    ranged = ranged.join(F.broadcast(guests), ranged["id"].eqNullSafe(guests["head"]), "left")
    own = F.struct("range", F.lit(False).alias("guest"))
    places = F.when(F.col("host").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("host").alias("range"), F.lit(True).alias("guest"))))
    dealt = ranged.select(F.explode(places).alias("place"), "id", "text").select("place.range", "place.guest", "id", "text")
    dealt = dealt.repartition(n, "range").sortWithinPartitions("range", "guest", F.desc_nulls_last("id"), F.xxhash64("text"))
    schema = f"id {id_type.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(_compared, schema).withColumnRenamed("id", id_col)
