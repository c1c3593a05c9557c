"""Seeded perturbation of data and of metadata: noise, bins, shuffled rows, replaced words."""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from joinwright.functions.text import replace_words

from .profile import _col, numeric_columns
from .quantiles import exact_quantiles


def uniform(seed: int, *values: Column) -> Column:
    """A number in (0, 1) from a hash: the same on every run, whatever the partitions."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[v.cast("string") for v in values])), 1, 13), 16, 10)
    return (h.cast("double") + 0.5) / F.lit(float(1 << 52))


def gaussian(seed: int, *values: Column) -> Column:
    u, v = uniform(seed, *values), uniform(seed + 1, *values)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def add_noise(df: DataFrame, key: str, beta: float, columns: list[str] | None = None, exclude: list[str] = (), seed: int = 42) -> DataFrame:
    """Numbers plus normal noise of ``beta`` sample deviations; missing values stay missing; columns with deviation 0 or
    fewer than two values stay as they are."""
    columns = columns or numeric_columns(df, [key, *exclude])
    row = df.agg(*[F.stddev_samp(_col(c)).alias(str(i)) for i, c in enumerate(columns)]).first()
    noisy = {c: (_col(c) + beta * s * gaussian(seed + 2 * i, _col(key))) for i, (c, s) in enumerate(zip(columns, row)) if s}
    return df.select(*[noisy.get(c, _col(c)).alias(c) for c in df.columns])


def freedman_diaconis(df: DataFrame, column: str) -> dict[str, float]:
    """Number of bins, least value and width; one bin where the values are all equal, and the square root of their number
    of bins where the quartiles are equal."""
    c = _col(column)
    row = df.agg(F.min(c).alias("low"), F.max(c).alias("high"), F.count(c).alias("n")).first()
    if not row.n or row.low == row.high:
        return {"bins": 1, "low": row.low, "width": 1.0}
    lower, upper = exact_quantiles(df, [column], [0.25, 0.75])[column]
    spread = upper - lower
    width = 2 * spread * row.n ** (-1 / 3) if spread else (row.high - row.low) / math.ceil(math.sqrt(row.n))
    bins = math.ceil((row.high - row.low) / width)
    return {"bins": bins, "low": row.low, "width": (row.high - row.low) / bins}


def add_bins(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``<column>_bin``, from 0, of the column's values before any noise."""
    for c in columns:
        fd = freedman_diaconis(df, c)
        place = F.floor((_col(c) - fd["low"]) / fd["width"])
        df = df.withColumn(f"{c}_bin", F.least(place, F.lit(fd["bins"] - 1)).cast("long"))
    return df


def joint_shuffle(df: DataFrame, key: str, target: str, beta: float, seed: int = 42, n_rows: int | None = None) -> DataFrame:
    """The same permutation of ``floor(beta * rows)`` rows for ``floor(beta * features)`` features; key and target stay.

    Rows and features are chosen by hashes. The chosen rows are numbered by one hash order and take the features of the row
    with their number in another, so one join on that number moves all features together. Ranks come from sorted
    ranges, not from one task.
    """
    features = [c for c in df.columns if c not in (key, target)]
    chosen = sorted(features, key=lambda c: random.Random(f"{seed}:{c}").random())[: math.floor(beta * len(features))]
    n = math.floor(beta * (df.count() if n_rows is None else n_rows))
    if not chosen or n < 2:
        return df
    ranked = _ranked(df.select(key), key, seed).where(F.col("rank") <= n).select(key, "rank")
    moved = _ranked(ranked.select(key), key, seed + 7).select(F.col(key).alias("__from"), "rank")
    pairs = ranked.join(moved, "rank").select(key, "__from")
    given = df.select(F.col(key).alias("__from"), F.struct(*[_col(c) for c in chosen]).alias("__new"))
    joined = df.join(pairs.join(given, "__from").drop("__from"), key, "left")
    return joined.select(*[F.when(F.col("__new").isNotNull(), F.col("__new")[c]).otherwise(_col(c)).alias(c) if c in chosen else _col(c) for c in df.columns])


def _ranked(keys: DataFrame, key: str, seed: int, cells: int = 1024) -> DataFrame:
    """Adds ``rank`` from 1 in the order of a hash of the key: counts of hash ranges give each range its first rank."""
    keys = keys.withColumn("__u", uniform(seed, F.col(key))).withColumn("__cell", F.floor(F.col("__u") * cells))
    sizes = keys.groupBy("__cell").agg(F.count("*").alias("__n"))
    starts = sizes.select("__cell", (F.sum("__n").over(W.orderBy("__cell")) - F.col("__n")).alias("__before"))
    within = F.row_number().over(W.partitionBy("__cell").orderBy("__u", key))
    return keys.withColumn("__at", within).join(F.broadcast(starts), "__cell").withColumn("rank", F.col("__before") + F.col("__at")).drop("__u", "__cell", "__at", "__before")


def perturb_tokens(original: list[str], synonyms: Mapping[str, list[str]], tau: float, seed: int = 42) -> tuple[dict[str, str], float]:
    """Replaces words by synonyms, those outside the original set first, one at a time in a seeded order, until the token
    sets' Jaccard similarity is at most ``tau``. Returns the replacements and the similarity reached."""
    choose = random.Random(seed)
    before, now, changed = set(original), set(original), {}
    order = sorted(w for w in before if synonyms.get(w))
    choose.shuffle(order)
    similar = lambda: len(before & now) / len(before | now) if before | now else 0.0
    for word in order:
        if similar() <= tau:
            break
        fresh = [s for s in synonyms[word] if s not in before] or list(synonyms[word])
        new = choose.choice(sorted(fresh))
        now = (now - {word}) | {new}
        changed[word] = new
    return changed, similar()


def perturb_metadata(metadata: DataFrame, columns: list[str], replacements: Mapping[str, str]) -> DataFrame:
    """Whole-word replacements in the text columns of a metadata table."""
    return metadata.withColumns({c: replace_words(F.col(c), replacements) for c in columns})


def perturb_header(df: DataFrame, replacements: Mapping[str, str]) -> DataFrame:
    names = df.sparkSession.createDataFrame([(c,) for c in df.columns], "c string").select(replace_words(F.col("c"), replacements)).collect()
    return df.toDF(*[r[0] for r in names])


@dataclass(frozen=True)
class Perturbation:
    tau: float
    beta: float
    seed: int = 42


def perturb_table(df: DataFrame, key: str, target: str, how: Perturbation, replacements: Mapping[str, str] | None = None) -> DataFrame:
    """Noise on all numbers but key and target, then the joint shuffle, then the header's words."""
    noisy = add_noise(df, key, how.beta, exclude=[target], seed=how.seed)
    shuffled = joint_shuffle(noisy, key, target, how.beta, how.seed)
    return perturb_header(shuffled, replacements) if replacements else shuffled


def run_cell(df: DataFrame, key: str, target: str, how: Perturbation, synonyms: Mapping[str, list[str]]) -> tuple[DataFrame, float]:
    """The table of one cell of the grid: words of its header replaced down to the similarity ``tau``, its values perturbed
    by ``beta``. Returns the table and the similarity reached. The words of key and target stay."""
    fixed = {w for c in (key, target) for w in header_words([c])}
    words = [w for w in header_words(df.columns) if w not in fixed]
    changed, reached = perturb_tokens(words, synonyms, how.tau, how.seed)
    return perturb_table(df, key, target, how, changed or None), reached


def run_grid(df: DataFrame, key: str, target: str, cells: list[Perturbation], synonyms: Mapping[str, list[str]]) -> Iterator[tuple[Perturbation, DataFrame, float]]:
    """Each cell with its table and the similarity reached, one after the other, so that a caller may write each."""
    for how in cells:
        yield (how, *run_cell(df, key, target, how, synonyms))


def header_words(columns: list[str]) -> list[str]:
    """The whole words of column names, each once."""
    return list(dict.fromkeys(w for c in columns for w in re.findall(r"\w+", c)))


def grid(taus: list[float], betas: list[float], seed: int = 42) -> list[Perturbation]:
    return [Perturbation(t, b, seed) for t in taus for b in betas]
