"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

P(grade > g) = sigmoid(score - threshold_g) with one score, a weighted sum of the text's features shared by all grades, and
ascending thresholds. Features are the presence of words, and of beginnings and ends of words, of the model's
vocabulary.

Labels say toxic or not, so the grades to learn are made from them: 0 for texts that are not toxic, and 1 to 3 for toxic
ones by terciles of the number of different words that are at least ``lift`` times as frequent in toxic texts as in
others. The labelled texts are dealt into two halves, and each half's words are judged on the other, so that no text
takes part in choosing the words that grade it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import materialise

#: Words whose features a worker keeps at once.
HELD = 200_000
_word = re.compile(r"[^\W_]+")


def features_of(word: str) -> list[str]:
    """The word, and its beginnings (``x-``) and ends (``-x``) of 4 to 6 letters that aren't all of it."""
    return [word, *[word[:n] + "-" for n in (4, 5, 6) if n < len(word)], *["-" + word[-n:] for n in (4, 5, 6) if n < len(word)]]


@dataclass(frozen=True)
class ToxicityParams:
    """The model is fitted on at most about ``max_docs`` labelled texts, chosen by a hash of the id, half of them toxic
    where there are enough, and weighted by how many labelled texts each stands for. The vocabulary is all features that
    at least ``min_docs`` of these texts have and that tell toxic texts from others by ``least`` standard errors or more."""

    max_docs: int = 4_000
    min_docs: int = 4
    least: float = 3.0
    grades: int = 3
    lift: float = 8.0
    steps: int = 600
    rate: float = 0.1
    ridge: float = 1e-5
    seed: int = 1


@dataclass
class OrdinalModel:
    """``thresholds`` ascend; none, if there was nothing to learn, means grade 0 for every text."""

    words: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray
    held: dict[str, list[int]] = field(default_factory=dict)

    def numbers(self, word: str) -> list[int]:
        """Numbers of the word's features that are in the vocabulary."""
        if (known := self.held.get(word)) is None:
            if len(self.held) >= HELD:
                self.held.clear()
            known = self.held[word] = [self.words[f] for f in features_of(word) if f in self.words]
        return known

    def features(self, text: str | None) -> np.ndarray:
        """Numbers of the vocabulary's features in the text."""
        found = {i for w in set(_word.findall(text.lower())) for i in self.numbers(w)} if text and self.words else ()
        return np.fromiter(sorted(found), np.int64, len(found))

    def beyond(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > g) for g = 0, 1, ... in columns."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds, -40, 40)))

    def predict(self, texts: list[str | None]) -> np.ndarray:
        return self.beyond(np.array([self.weights[self.features(t)].sum() for t in texts]))


def fit_thresholds(rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, width: int, weight: np.ndarray, params: ToxicityParams) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on the penalised likelihood; the thresholds are a first one and positive steps."""
    n, levels = len(grades), int(grades.max())
    balance = weight / weight.sum()
    share = np.clip([balance[grades > g].sum() for g in range(levels)], 1e-3, 1 - 1e-3)
    start = np.log((1 - share) / share)
    state = np.concatenate((np.zeros(width), [start[0]], np.log(np.maximum(np.diff(start), 0.1))))
    first, second = np.zeros_like(state), np.zeros_like(state)
    for step in range(1, params.steps + 1):
        weights, gaps = state[:width], np.exp(state[width + 1 :])
        thresholds = state[width] + np.concatenate(([0], np.cumsum(gaps)))
        scores = np.bincount(rows, weights[columns], n)
        p = 1 / (1 + np.exp(-np.clip(scores[:, None] - thresholds, -40, 40)))
        bounds = np.concatenate((np.ones((n, 1)), p, np.zeros((n, 1))), 1)
        at = np.arange(n)
        upper, lower = bounds[at, grades], bounds[at, grades + 1]
        likely = np.maximum(upper - lower, 1e-12)
        d_upper, d_lower = upper * (1 - upper) / likely, lower * (1 - lower) / likely
        d_scores = balance * (d_upper - d_lower)
        d_thresholds = np.zeros(levels)
        for g in range(levels):
            d_thresholds[g] = (balance * d_lower)[grades == g].sum() - (balance * d_upper)[grades == g + 1].sum()
        d_weights = np.bincount(columns, d_scores[rows], width) - params.ridge * weights
        gradient = np.concatenate((d_weights, [d_thresholds.sum()], np.cumsum(d_thresholds[::-1])[::-1][1:] * gaps))
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        state = state + params.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return state[:width], state[width] + np.concatenate(([0], np.cumsum(np.exp(state[width + 1 :]))))


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (toxic, half, text): features with the number of texts of each kind and half that have them."""
    counts: list[Counter] = [Counter() for _ in range(4)]

    def emit() -> pa.RecordBatch:
        features = sorted(set().union(*counts))
        made = [pa.array(features, pa.string()), *[pa.array([c[f] for f in features], pa.int64()) for c in counts]]
        for c in counts:
            c.clear()
        return pa.RecordBatch.from_arrays(made, ["feature", "bad0", "bad1", "good0", "good1"])

    for batch in batches:
        for toxic, half, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            words = set(_word.findall(text.as_py().lower()))
            counts[2 * (not toxic) + half].update({f for w in words for f in features_of(w)})
            if sum(map(len, counts)) > HELD:
                yield emit()
    yield emit()


def fit_toxicity(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> OrdinalModel:
    """Learns from the labelled rows of ``docs``. Without labelled texts of both kinds every text gets grade 0. Null ids,
    texts and labels are left out, equal labels of an id count once and both of contrary ones, repeated rows count as often
    as they come, and other columns are ignored, whatever their names."""
    labels = labels.select(F.col(id_col).alias("id"), (F.col(label_col) != 0).alias("toxic")).where("id is not null and toxic is not null").distinct()
    counts = {r.toxic: r.n for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return OrdinalModel({}, np.empty(0), np.empty(0))
    room = {True: max(params.max_docs // 2, params.max_docs - counts[False]), False: max(params.max_docs // 2, params.max_docs - counts[True])}
    share = F.when(F.col("toxic"), room[True] / counts[True]).otherwise(room[False] / counts[False])
    chosen = labels.where(F.pmod(F.xxhash64("id", F.lit(params.seed)), F.lit(1 << 30)) < share * (1 << 30))

    half = (F.pmod(F.xxhash64("id", F.lit(params.seed + 1)), F.lit(2)) == 1).alias("half")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    texts = texts.join(F.broadcast(chosen), "id").select("toxic", half, "text")  # chosen has at most about max_docs rows
    sample = materialise(texts, "toxicity_sample")
    totals = {(r.toxic, r.half): r.n for r in sample.groupBy("toxic", "half").agg(F.count("*").alias("n")).collect()}
    of = {toxic: sum(n for (t, _), n in totals.items() if t == toxic) for toxic in (True, False)}
    if not of[True] or not of[False]:
        return OrdinalModel({}, np.empty(0), np.empty(0))

    counted = sample.mapInArrow(_count_features, "feature string, bad0 long, bad1 long, good0 long, good1 long")
    counted = counted.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("bad0", "bad1", "good0", "good1")])
    counted = materialise(counted.where(F.col("bad0") + F.col("bad1") + F.col("good0") + F.col("good1") >= params.min_docs), "toxicity_features")
    rate = lambda n, total: (n + 0.5) / (total + 1)
    bad, good = rate(F.col("bad0") + F.col("bad1"), of[True]), rate(F.col("good0") + F.col("good1"), of[False])
    telling = F.abs(bad - good) / F.sqrt(bad / of[True] + good / of[False])
    vocabulary = {r.feature: i for i, r in enumerate(sorted(counted.where(telling >= params.least).select("feature").collect()))}
    lifted = [rate(F.col(f"bad{h}"), totals.get((True, bool(h)), 0)) / rate(F.col(f"good{h}"), totals.get((False, bool(h)), 0)) >= params.lift for h in (0, 1)]
    seen = [F.col(f"bad{h}") + F.col(f"good{h}") >= params.min_docs / 2 for h in (0, 1)]
    whole = ~F.col("feature").contains("-")
    marks = [{r.feature for r in counted.where(whole & lifted[h] & seen[h]).select("feature").collect()} for h in (0, 1)]

    # At most about max_docs rows of at most the vocabulary's numbers each.
    shared = sample.sparkSession.sparkContext.broadcast((vocabulary, marks))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, marked = shared.value
        for batch in batches:
            kept, rates = [], []
            for half, text in zip(batch.column(1).to_pylist(), batch.column(2)):
                words = set(_word.findall(text.as_py().lower()))
                kept.append(sorted({numbers[f] for w in words for f in features_of(w) if f in numbers}))
                rates.append(float(len(words & marked[not half])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.list_(pa.int32())), pa.array(rates, pa.float64())], ["toxic", "numbers", "rate"])

    data = sample.mapInArrow(reduce, "toxic boolean, numbers array<int>, rate double").collect()
    shared.unpersist()
    data.sort(key=lambda r: (r.toxic, r.rate, list(r.numbers)))
    rates = np.array([r.rate for r in data if r.toxic])
    cuts = np.quantile(rates, np.arange(1, params.grades) / params.grades)
    grades = np.array([1 + int((r.rate > cuts).sum()) if r.toxic else 0 for r in data])
    _, grades = np.unique(grades, return_inverse=True)
    rows = np.repeat(np.arange(len(data)), [len(r.numbers) for r in data])
    columns = np.array([c for r in data for c in r.numbers], np.int64)
    stands = np.array([counts[r.toxic] / of[r.toxic] for r in data])
    weights, thresholds = fit_thresholds(rows, columns, grades, len(vocabulary), stands, params)
    return OrdinalModel(vocabulary, weights, thresholds)


def predict_toxicity(docs: DataFrame, model: OrdinalModel, keep_cols: list[str], text_col: str = "text") -> DataFrame:
    """``keep_cols`` with ``severity`` (the expected grade), ``grade`` (the most probable one) and ``toxic`` (grade 1 or
    more is as probable as 0 or more so), from the whole text, however long. Null and empty texts have no features; of
    grades that tie the smaller one is taken; equal texts, so also repeated rows, get equal results; an empty table gives
    an empty result; kept columns with a result's name give way to it."""
    keep_cols = [c for c in keep_cols if c not in ("severity", "grade", "toxic")]
    schema = T.StructType([*docs.select(*keep_cols).schema.fields])
    schema = schema.add("severity", "double").add("grade", "integer").add("toxic", "boolean")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(str(i)) for i, c in enumerate(keep_cols)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            beyond = shared.value.predict(batch.column(0).to_pylist())
            shares = -np.diff(np.concatenate((np.ones((len(beyond), 1)), beyond, np.zeros((len(beyond), 1))), 1), axis=1)
            toxic = beyond[:, 0] >= 0.5 if beyond.shape[1] else np.zeros(len(beyond), bool)
            made = [pa.array(beyond.sum(1)), pa.array(shares.argmax(1), pa.int32()), pa.array(toxic)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], schema.names)

    return docs.mapInArrow(run, schema)
