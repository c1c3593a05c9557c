"""Language identification by words first, then by ever shorter character n-grams.

Training counts the words of labelled documents by language, and the n-grams of these words. A word of the model costs
``-log10`` of its share in each language. A word outside the model costs the mean of its known n-grams of the
greatest length at which any is known. The language with the lowest mean cost of all words of a text is predicted.

Words and n-grams are 64-bit hashes in sorted arrays, and costs are stored for those languages only that have them, so
that a model takes a few bytes for each entry however many languages there are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import materialise
from .words import mix

_word = re.compile(r"[^\W\d_]+")
#: Words that a partition counts before it passes the counts on; characters of unseen words that are looked up at once.
HELD, PART = 100_000, 1 << 18


@dataclass(frozen=True)
class LangIdParams:
    """The model is fitted on labelled documents of at most about ``max_chars`` characters together, chosen by a hash of
    the id (of the text too where that is null). It holds all their words, and all n-grams of ``lengths`` of these, that
    occur at least ``least_count`` times in a language. ``absent`` is the cost in a language of what only other
    languages have, and of words without a known n-gram.

    Each language is sampled by itself with the same quota; what smaller languages leave of theirs goes to the larger
    ones. A language keeps at least ``least_chars`` characters or all, so with very many languages the bound is
    ``least_chars`` times their number."""

    max_chars: int = 60_000_000
    least_chars: int = 400_000
    least_count: int = 2
    lengths: tuple[int, ...] = (5, 4, 3, 2, 1)
    absent: float = 7.0


def word_key(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode())


def gram_keys(points: np.ndarray, n: int) -> np.ndarray:
    """Of each place in a row of code points the key of the ``n`` that begin there."""
    if len(points) < n:
        return np.empty(0, np.uint64)
    joined = np.full(len(points) - n + 1, n, np.uint64)
    for i in range(n):
        joined = mix(joined * np.uint64(0x9E3779B97F4A7C15) + points[i : len(points) - n + 1 + i])
    return joined


def _padded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of the words with a space before and after each, and where each begins; its end is the next's
    beginning."""
    points = np.frombuffer("".join([f" {w} " for w in words]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    return points, np.concatenate(([0], np.cumsum([len(w) + 2 for w in words])))


def _grams(points: np.ndarray, begin: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams within words, and the number of each one's word."""
    keys = gram_keys(points, n)
    word = np.searchsorted(begin, np.arange(len(keys)), "right") - 1
    inside = np.arange(len(keys)) + n <= begin[word + 1]
    return keys[inside], word[inside]


class Costs:
    """Sorted keys, each with the languages that have it and what it costs there less ``absent``."""

    def __init__(self, keys: np.ndarray, langs: np.ndarray, costs: np.ndarray):
        order = np.lexsort((langs, keys))
        keys, self.langs, self.costs = keys[order], langs[order].astype(np.int32), costs[order]
        self.keys, first = np.unique(keys, return_index=True)
        self.begin = np.append(first, len(keys)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 without one."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def sums(self, rows: np.ndarray, weights: np.ndarray, groups: np.ndarray, n_groups: int, n_langs: int) -> np.ndarray:
        """Weighted sums of the rows by group and language."""
        counts = self.begin[rows + 1] - self.begin[rows]
        at = np.arange(counts.sum()) + np.repeat(self.begin[rows] - (np.cumsum(counts) - counts), counts)
        cell = np.repeat(groups, counts) * n_langs + self.langs[at]
        return np.bincount(cell, np.repeat(weights, counts) * self.costs[at], n_groups * n_langs).reshape(n_groups, n_langs)


class LangModel:
    def __init__(self, langs: list[str], words: Costs, grams: Costs, lengths: tuple[int, ...], absent: float):
        self.langs, self.words, self.grams, self.lengths, self.absent = langs, words, grams, lengths, absent

    def unseen(self, words: list[str]) -> np.ndarray:
        """Costs, by language, of words outside the model: of the n-grams of the greatest length at which any is known."""
        points, begin = _padded(words)
        out = np.full((len(words), len(self.langs)), self.absent)
        left = np.ones(len(words), bool)
        for n in self.lengths:
            keys, word = _grams(points, begin, n)
            keys, word = keys[left[word]], word[left[word]]
            rows = self.grams.find(keys)
            rows, word = rows[rows >= 0], word[rows >= 0]
            if len(rows):
                known = np.bincount(word, minlength=len(words))
                sums = self.grams.sums(rows, np.ones(len(rows)), word, len(words), len(self.langs))
                some = known > 0
                out[some] += sums[some] / known[some, None]
                left &= ~some
            if not left.any():
                break
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """Of each text the language, its probability if words were drawn independently, and the share of its words that
        the model has; ``und``, 0 and 0 without a letter."""
        counts = [Counter(_word.findall(t.lower())) if t and self.langs else Counter() for t in texts]
        counts = [c if any(x.isalpha() for w in c for x in w) else Counter() for c in counts]
        words = [w for c in counts for w in c]
        if not words:
            return [("und", 0.0, 0.0)] * len(texts)
        text = np.repeat(np.arange(len(texts)), [len(c) for c in counts])
        times = np.array([n for c in counts for n in c.values()], float)
        rows = self.words.find(np.array([word_key(w) for w in words], np.uint64))
        seen, other = rows >= 0, np.flatnonzero(rows < 0)
        total = self.words.sums(rows[seen], times[seen], text[seen], len(texts), len(self.langs))
        total += (self.absent * np.bincount(text[seen], times[seen], len(texts)))[:, None]
        begin, size = 0, 0
        for i, place in enumerate(other):
            size += len(words[place]) + 2
            if size >= PART or i + 1 == len(other):
                some = other[begin : i + 1]
                np.add.at(total, text[some], times[some, None] * self.unseen([words[j] for j in some]))
                begin, size = i + 1, 0
        best = total.argmin(1)
        score = 1 / np.exp((total.min(1)[:, None] - total) * np.log(10)).sum(1)
        known = np.bincount(text[seen], times[seen], len(texts)) / np.maximum(np.bincount(text, times, len(texts)), 1)
        return [(self.langs[b], float(s), float(k)) if c else ("und", 0.0, 0.0) for b, s, k, c in zip(best, score, known, counts)]


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def quota(sizes: list[int], most: int, least: int) -> float:
    """The largest size of each class such that all classes together have at most ``most``; at least ``least``."""
    left = most
    for i, n in enumerate(sorted(sizes)):
        share = left / (len(sizes) - i)
        if n > share:
            return max(share, least)
        left -= n
    return max([least, *sizes])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}

    def emit() -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(own), pa.string()), "word": pa.array(own.keys(), pa.string()), "n": pa.array(own.values(), pa.int64())})
        counts.clear()

    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
            counts.setdefault(lang, Counter()).update(_word.findall(text.as_py().lower()))
            if sum(map(len, counts.values())) > HELD:
                yield from emit()
    yield from emit()


def _count_grams(lengths: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, words, times = (c.to_pylist() for c in batch.columns)
            named = sorted(set(langs))
            lang = np.array([named.index(x) for x in langs]) if len(named) < 50 else np.searchsorted(named, langs)
            points, begin = _padded(words)
            weight = np.array(times, np.int64)
            for n in lengths:
                keys, word = _grams(points, begin, n)
                for i, name in enumerate(named):
                    own = lang[word] == i
                    found, at = np.unique(keys[own], return_inverse=True)
                    sums = np.bincount(at, weight[word[own]], len(found)).astype(np.int64)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(found), pa.string()), "length": pa.array([n] * len(found), pa.int32()), "key": found.view(np.int64), "n": sums})

    return run


def _key_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = np.array([word_key(w) for w in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), batch.column(2)], ["lang", "key", "n"])


def fit_lang_model(docs: DataFrame, params: LangIdParams = LangIdParams(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LangModel:
    """Learns from the texts and labels of ``docs``; rows without either are left out, repeated rows count as often as
    they come, other columns are ignored, and a table without labelled texts gives a model without languages.

    What the driver gets is the model: at most one row for each language and key that occurs ``least_count`` times in
    the bounded sample."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    labelled = docs.groupBy("lang").agg(F.sum(F.length("text")).alias("n"))
    sizes = {r.lang: r.n for r in labelled.collect()}
    most = quota(list(sizes.values()), params.max_chars, params.least_chars)
    if large := {lang: most / n for lang, n in sizes.items() if n > most}:
        shares = F.create_map(*[F.lit(x) for pair in large.items() for x in pair])
        drawn = F.pmod(F.xxhash64("id", F.when(F.col("id").isNull(), F.col("text"))), F.lit(1 << 30))
        docs = docs.where(drawn < F.coalesce(F.try_element_at(shares, F.col("lang")), F.lit(1.0)) * (1 << 30))
    words = docs.select("text", "lang").mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = materialise(words, "lang_words")
    grams = words.mapInArrow(_count_grams(params.lengths), "lang string, length int, key long, n long").groupBy("lang", "length", "key").agg(F.sum("n").alias("n"))
    grams = materialise(grams, "lang_grams")
    totals = {(r.lang, 0): r.n for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    totals |= {(r.lang, r.length): r.n for r in grams.groupBy("lang", "length").agg(F.sum("n").alias("n")).collect()}
    langs = sorted({lang for lang, _ in totals})
    place = {lang: i for i, lang in enumerate(langs)}

    numbers = F.create_map(*[F.lit(x) for lang in langs for x in (lang, place[lang])]) if langs else None
    of = np.array([[totals.get((lang, n), 1) for n in range(max(params.lengths) + 1)] for lang in langs], float)

    def costs(counts: DataFrame) -> Costs:
        if numbers is None:
            return Costs(np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0))
        table = counts.where(F.col("n") >= params.least_count).select(numbers[F.col("lang")].alias("lang"), "length", "key", "n").toArrow()
        lang, length, key, n = (table.column(i).to_numpy() for i in range(4))
        return Costs(key.view(np.uint64), lang, -np.log10(n / of[lang, length]) - params.absent)

    return LangModel(langs, costs(words.mapInArrow(_key_words, "lang string, key long, n long").withColumn("length", F.lit(0))), costs(grams), params.lengths, params.absent)


def predict_languages(docs: DataFrame, model: LangModel, keep_cols: list[str], text_col: str = "text", known_col: str | None = None) -> DataFrame:
    """``keep_cols`` with ``lang_pred`` and ``score`` (0 to 1), from the whole text alone, and if named with
    ``known_col``, the share of the text's words that the model has. Null texts and texts without a letter, and all
    texts if the model has no language, are ``und`` with 0. Ties go to the first language. Equal texts, so also repeated
    rows, get equal results; an empty table gives an empty result; very long texts are handled whole, their unseen
    words by the part. Kept columns whose names are those of results give way to these."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["lang_pred", "score", *([known_col] if known_col else [])]
    keep_cols = [c for c in keep_cols if c not in names]
    schema = T.StructType([*docs.select(*keep_cols).schema.fields, *[T.StructField(c, T.StringType() if c == "lang_pred" else T.DoubleType()) for c in names]])
    carried = text_col in keep_cols and isinstance(docs.schema[text_col].dataType, T.StringType)  # then the text goes to Python once
    text = [] if carried else [F.col(text_col).cast("string").alias("text")]
    docs = docs.select(*[F.col(c).alias(str(i)) for i, c in enumerate(keep_cols)], *text)
    at, kept = keep_cols.index(text_col) if carried else len(keep_cols), len(keep_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                some = batch.slice(i, 64)
                found = list(zip(*shared.value.predict(some.column(at).to_pylist())))
                made = [pa.array(found[0], pa.string()), *[pa.array(x, pa.float64()) for x in found[1 : len(names)]]]
                yield pa.RecordBatch.from_arrays([*some.columns[:kept], *made], schema.names)

    return docs.mapInArrow(run, schema)
