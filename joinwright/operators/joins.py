"""Joins on normal forms, with missing keys, with deduplication and by similarity, and their validation."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joinwright.functions.keys import normalize_key, upper_key
from joinwright.functions.similarity import folded, folded_ratio, weighted_ratio_udf

MATCH_RATE, EXPLOSION = 0.1, 2.0
#: Longest folded keys that meet by equal segments; the number of segments grows with the length.
SEGMENT_CHARS = 64
#: Keys of either side that are compared in one task, and most tasks.
BLOCK, MOST_TASKS = 500, 4_000


def _on(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], form) -> Column:
    return reduce(lambda a, b: a & b, [form(left[f"`{x}`"]) == form(right[f"`{y}`"]) for x, y in pairs])


def join_normalized(left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str]) -> DataFrame:
    """Inner join of upper-case trimmed keys; missing ones match each other. Both sides' keys stay; names that clash
    are the right side's with ``_right``."""
    if len(left_on) != len(right_on):
        raise ValueError("as many keys on either side")
    right = right.withColumnsRenamed({c: f"{c}_right" for c in right.columns if c in left.columns})
    names = [f"{c}_right" if c in left.columns else c for c in right_on]
    return left.join(right, _on(left, right, list(zip(left_on, names)), upper_key), "inner")


def join_nullsafe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equality of raw keys, under which null equals null. The left side's keys stay."""
    other = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [left[f"`{k}`"].eqNullSafe(other[f"`__{k}`"]) for k in keys])
    return left.join(other, on, how).drop(*[f"__{k}" for k in keys])


def first_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each raw key, in the given order."""
    columns = [c for c in df.columns if c not in keys]
    rest = F.min_by(F.struct(*[F.col(f"`{c}`") for c in columns]), F.struct(*[F.col(f"`{c}`") for c in order])) if columns else None
    if rest is None:
        return df.distinct()
    # min_by combines before the shuffle, unlike a ranking, so that frequent keys are no hot groups.
    return df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(rest.alias("__rest")).select(*keys, "__rest.*").select(*[F.col(f"`{c}`") for c in df.columns])


def rename_collisions(right: DataFrame, taken: list[str], keys: list[str], table_id: str) -> DataFrame:
    suffix = "_" + table_id.replace("-", "_")
    return right.withColumnsRenamed({c: c + suffix for c in right.columns if c in taken and c not in keys})


def join_left_dedup(left: DataFrame, right: DataFrame, keys: list[str], order: list[str], table_id: str = "right") -> DataFrame:
    """Left join with the first right row of each raw key, on normal forms, missing ones equal. Keys are
    deduplicated before they are normalised, so spellings of one key may still multiply rows."""
    right = rename_collisions(first_by_key(right, keys, order), left.columns, keys, table_id)
    forms = {f"__{k}": normalize_key(F.col(f"`{k}`")) for k in keys}
    return left.withColumns(forms).join(right.withColumns(forms).drop(*keys), [*forms], "left").drop(*forms)


def merge_outer(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Full outer join of partial results by key."""
    return reduce(lambda a, b: a.join(b, keys, "full"), parts)


def semi_filter(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys, on, "left_semi")


def anti_filter(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys, on, "left_anti")


def normalized_key_filter(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows whose key's normal form is one of the first column of ``keys``; the key becomes that form."""
    wanted = keys.select(normalize_key(F.col(keys.columns[0])).alias(key)).distinct()
    return df.withColumn(key, normalize_key(F.col(key))).join(wanted, key, "left_semi").select(*df.columns)


def lookup_join(df: DataFrame, key: str, values: Mapping[str, Mapping], kinds: Mapping[str, str]) -> DataFrame:
    """New columns from dictionaries that a caller gives: name -> {key: value}."""
    for name, table in values.items():
        found = F.create_map(*[F.lit(x) for pair in table.items() for x in pair]) if table else None
        df = df.withColumn(name, F.try_element_at(found, F.col(key)).cast(kinds[name]) if found is not None else F.lit(None).cast(kinds[name]))
    return df


def _parts(rows: DataFrame, own: str, other: str, mine: Column, theirs: Column) -> DataFrame:
    """Each row in a part of its own side, once for each part of the other side."""
    part = F.pmod(F.xxhash64(*rows.columns), mine.cast("long"))
    return rows.withColumn(own, part).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), theirs.cast("long") - 1)))


def _in_blocks(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` next to all rows of ``right``, ``BLOCK`` of either in a task."""
    a, b = [max(1, -(-side.count() // BLOCK)) for side in (left, right)]
    n = min(a * b, MOST_TASKS)
    sides = _parts(left, "part_l", "part_r", F.lit(a), F.lit(b)), _parts(right, "part_r", "part_l", F.lit(b), F.lit(a))
    left, right = [side.repartition(n, "part_l", "part_r") for side in sides]  # a stated number, which is not coalesced
    return left.join(right, ["part_l", "part_r"]).drop("part_l", "part_r")


def _meet(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Equality join in which a key with more than ``BLOCK`` rows of a side is split into parts."""
    sides = left.select(*on, F.lit(1).alias("l"), F.lit(0).alias("r")).union(right.select(*on, F.lit(0), F.lit(1)))
    counts = sides.groupBy(*on).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    large = counts.where((F.col("l") > BLOCK) | (F.col("r") > BLOCK))
    large = large.select(*on, *[F.greatest(F.lit(1), F.ceil(F.col(c) / BLOCK)).alias(f"parts_{c}") for c in "lr"])
    parts = {c: F.coalesce(f"parts_{c}", F.lit(1)) for c in "lr"}

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        out = _parts(rows.join(large, on, "left"), f"part_{own}", f"part_{other}", parts[own], parts[other])
        return out.drop("parts_l", "parts_r")

    keys = [*on, "part_l", "part_r"]
    return dealt(left, "l", "r").join(dealt(right, "r", "l"), keys).drop(*keys)


def _by_segments(candidate: DataFrame, query: DataFrame, least: float) -> DataFrame:
    """All pairs of keys that may reach the edit ratio, some more than once.

    A query key is cut into one segment more than it may have edits, so one of them is whole in every partner, shifted by
    no more than the edits left of it; pairs meet by length, number and text of the segment.
    """
    share = least / 100
    query = query.withColumn("lq", F.length("fq"))
    cut = "cast(floor(lq * {0}D + 1e-9) as int)".format((1 - share) / share)  # most edits with any partner
    begin, size = "cast(i * lq div (most + 1) as int)", "cast((i + 1) * lq div (most + 1) - i * lq div (most + 1) as int)"

    def numbered(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("most", F.expr(cut)).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("most"))))
        return rows.withColumn("begin", F.expr(begin)).withColumn("size", F.expr(size))

    whole = numbered(query).select("query", "fq", "lq", "i", F.expr("substring(fq, begin + 1, size)").alias("segment"))
    rows = candidate.withColumn("lc", F.length("fc"))
    lengths = F.sequence(F.ceil(F.col("lc") * share - 1e-9).cast("int"), F.floor(F.col("lc") / share + 1e-9).cast("int"))
    rows = numbered(rows.withColumn("lq", F.explode(lengths)))
    rows = rows.withColumn("edits", F.floor(F.greatest("lc", "lq") * (1 - share) + 1e-9).cast("int"))
    rows = rows.withColumn("low", F.expr("greatest(0, cast(begin - floor((edits - (lc - lq)) / 2) as int))"))
    rows = rows.withColumn("high", F.expr("least(lc - size, cast(begin + floor((edits + (lc - lq)) / 2) as int))")).where("low <= high")
    texts = F.expr("array_distinct(transform(sequence(low, high), x -> substring(fc, x + 1, size)))")
    return _meet(rows.select("candidate", "fc", "lq", "i", F.explode(texts).alias("segment")), whole, ["lq", "i", "segment"])


def fuzzy_map(query_keys: DataFrame, candidate_keys: DataFrame, least: float = 80.0, scorer: str = "edit") -> DataFrame:
    """``candidate, query, score``: each distinct candidate key's most similar query key, ties to the smaller one. Keys
    without a letter or digit match nothing.

    Equal folded keys meet by an equality join. Of the others, those of up to ``SEGMENT_CHARS`` characters meet by equal
    segments if the edit ratio must be over 50; longer keys, lower ratios and the weighted scorer, which bounds no part of
    a key, compare the query keys with all candidates in blocks. All ways are exact, for any number of keys.
    """
    query = query_keys.select(F.col(query_keys.columns[0]).cast("string").alias("query")).where("query is not null").distinct()
    candidate = candidate_keys.select(F.col(candidate_keys.columns[0]).cast("string").alias("candidate")).where("candidate is not null").distinct()
    query = query.withColumn("fq", folded(F.col("query"))).where("fq <> ''")
    candidate = candidate.withColumn("fc", folded(F.col("candidate"))).where("fc <> ''")
    exact = candidate.join(query, F.col("fc") == F.col("fq")).groupBy("candidate").agg(F.min("query").alias("query"))
    exact = exact.select("candidate", "query", F.lit(100.0).alias("score"))
    rest = candidate.join(exact, "candidate", "left_anti")
    if scorer == "edit" and least > 50:
        longer = SEGMENT_CHARS * least / 100
        pairs = _in_blocks(rest.where(F.length("fc") > longer), query.where(F.length("fq") > longer))
        pairs = pairs.where(F.greatest(F.length("fc"), F.length("fq")) > SEGMENT_CHARS)
        short = [side.where(F.length(c) <= SEGMENT_CHARS) for side, c in ((rest, "fc"), (query, "fq"))]
        pairs = pairs.unionByName(_by_segments(*short, least).select(*pairs.columns))
    else:
        pairs = _in_blocks(rest, query)
    score = folded_ratio(F.col("fc"), F.col("fq")) if scorer == "edit" else weighted_ratio_udf(F.col("candidate"), F.col("query"))
    pairs = pairs.withColumn("score", score).where(F.col("score") >= least)
    best = pairs.groupBy("candidate").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("query"))).alias("b"))
    return exact.unionByName(best.select("candidate", "b.query", (-F.col("b.s")).alias("score")))


def join_fuzzy(left: DataFrame, right: DataFrame, key: str, least: float = 80.0, scorer: str = "edit") -> DataFrame:
    """Inner join of each right row with the left rows whose key its key resembles most."""
    mapped = fuzzy_map(left.select(key), right.select(key), least, scorer)
    other = right.withColumn("__candidate", F.col(key).cast("string")).drop(key).join(mapped.withColumnRenamed("candidate", "__candidate"), "__candidate").drop("__candidate", "score")
    other = other.withColumnsRenamed({c: f"{c}_right" for c in other.columns if c in left.columns})
    return left.join(other, left[key].cast("string") == other["query"]).drop("query")


@dataclass(frozen=True)
class JoinReport:
    base_rows: int
    merged_rows: int
    match_rate: float
    valid: bool
    reason: str


def validate_join(left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str], least: float = MATCH_RATE, most: float = EXPLOSION) -> JoinReport:
    """Counts an inner join from the key frequencies of either side, without making its rows."""
    if len(left_on) != len(right_on):
        return JoinReport(0, 0, 0.0, False, "the sides have different numbers of keys")
    forms = [[upper_key(F.col(f"`{c}`")).alias(f"k{i}") for i, c in enumerate(on)] for on in (left_on, right_on)]
    names = [f"k{i}" for i in range(len(left_on))]
    a, b = (df.select(*f).groupBy(*names).agg(F.count("*").alias(n)) for df, f, n in ((left, forms[0], "a"), (right, forms[1], "b")))
    row = a.join(b, names, "left").agg(F.sum("a").alias("base"), F.sum(F.col("a") * F.coalesce("b", F.lit(0))).alias("merged")).first()
    base, merged = int(row.base or 0), int(row.merged or 0)
    rate = merged / base if base else 0.0
    reason = "match rate too low" if rate < least else "rows multiply" if merged > base * most else "ok"
    return JoinReport(base, merged, rate, reason == "ok", reason)


def join_coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``query_keys, matched_keys, coverage``."""
    keys = left.select(normalize_key(F.col(key)).alias("k")).distinct()
    other = right.select(normalize_key(F.col(key)).alias("k"), F.lit(1).alias("hit")).distinct()
    found = keys.join(other, "k", "left").agg(F.count("*").alias("query_keys"), F.count("hit").alias("matched_keys"))
    return found.withColumn("coverage", F.coalesce(F.try_divide("matched_keys", "query_keys"), F.lit(0.0)))


def decompose(df: DataFrame, keys: list[str], label: str) -> tuple[DataFrame, DataFrame]:
    """A feature table and a label table that share the keys."""
    return df.drop(label), df.select(*keys, label)


def rejoin(features: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    return join_nullsafe(features, labels, keys)


def table_differences(a: DataFrame, b: DataFrame, key: str, tolerance: float = 1e-5) -> DataFrame:
    """``column, differing``: cells that differ by more than the tolerance, null equal to null, over the outer join on
    the key; rows of one side only differ in every column."""
    if sorted(a.columns) != sorted(b.columns):
        raise ValueError("the tables have different columns")
    names = [c for c in sorted(a.columns) if c != key]
    left = a.select(key, F.struct(*[F.col(f"`{c}`") for c in names]).alias("x"))
    right = b.select(F.col(key).alias("__key"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("y"))
    both = left.join(right, left[key].eqNullSafe(right["__key"]), "full")
    cells = []
    for c in names:
        x, y = F.col("x")[c], F.col("y")[c]
        numeric = isinstance(a.schema[c].dataType, (T.NumericType,)) and isinstance(b.schema[c].dataType, (T.NumericType,))
        same = x.eqNullSafe(y) if not numeric else x.eqNullSafe(y) | F.coalesce(F.abs(x.cast("double") - y.cast("double")) <= tolerance, F.lit(False))
        missing = F.col("x").isNull() | F.col("y").isNull()
        cells.append(F.struct(F.lit(c).alias("column"), F.count_if(missing | ~same).alias("differing")))
    return both.agg(F.array(*cells).alias("p")).select(F.inline("p"))


def same_shape(a: DataFrame, b: DataFrame) -> bool:
    return sorted(a.columns) == sorted(b.columns) and a.count() == b.count()


def top_keys_filter(df: DataFrame, key: str, order: str, n: int = 500) -> DataFrame:
    """Rows of the first ``n`` distinct keys in the given order."""
    keys = df.groupBy(key).agg(F.min(order).alias("__at")).orderBy("__at", key).limit(n)
    return df.join(keys.select(key), key, "left_semi")


def exclude_existing(features: DataFrame, existing: list[str], column: str = "feature") -> DataFrame:
    names = [e.strip().lower() for e in existing]
    return features.where(~F.lower(F.trim(column)).isin(*names)) if names else features
