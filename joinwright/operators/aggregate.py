"""Candidates aggregated to one row for each join key: numbers, category distributions, texts, targets."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import merge_outer, semi_filter
from .profile import binary_target, column_classes, convert_numeric_columns
from .texts import text_subsets

FUNCTIONS: Mapping[str, Callable[[Column], Column]] = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "median": F.median, "count": F.count, "std": F.stddev_samp}


def _present(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.na.drop(subset=keys)


def aggregate_numeric(df: DataFrame, keys: list[str], columns: list[str], function: str = "mean") -> DataFrame:
    """One row for each key without missing parts; missing values are skipped."""
    return _present(df, keys).groupBy(*keys).agg(*[FUNCTIONS[function](F.col(f"`{c}`")).alias(c) for c in columns])


def category_shares(df: DataFrame, keys: list[str], column: str, proportion: bool = True) -> DataFrame:
    """``<column>_vector``: for each key the categories that it has and their shares (or counts), as a sorted array of pairs.
    Every distinct key of the table has a row, with an empty array if it has no category, missing keys too; the rows of a missing
    key are not counted."""
    present = reduce(lambda x, y: x & y, [F.col(f"`{k}`").isNotNull() for k in keys])
    counts = df.groupBy(*[F.col(f"`{k}`") for k in keys], F.col(f"`{column}`").cast("string").alias("category")).agg(F.count("*").alias("value"))
    counted = F.when(present & F.col("category").isNotNull(), F.col("value"))
    own = counts.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.array_sort(F.collect_list(F.when(counted.isNotNull(), F.struct("category", "value")))).alias("own"), F.sum(counted).alias("total"))
    value = (lambda e: e["value"] / F.col("total")) if proportion else (lambda e: e["value"].cast("double"))
    return own.select(*[F.col(f"`{k}`") for k in keys], F.transform("own", lambda e: F.struct(e["category"].alias("category"), value(e).alias("value"))).alias(f"{column}_vector"))


def with_all_categories(shares: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """Each ``<column>_vector`` of ``category_shares`` with a value for all categories of ``df`` in sorted order, and
    ``<column>_categories`` after it. Vectors are as long as there are categories, so rows should be joined and sorted before."""
    for column in columns:
        vector, names = f"{column}_vector", f"{column}_categories"
        categories = df.select(F.col(f"`{column}`").cast("string").alias("c")).where("c is not null").distinct().agg(F.sort_array(F.collect_list("c")).alias("__all"))
        held = shares.withColumn(vector, F.map_from_entries(F.col(f"`{vector}`"))).join(F.broadcast(categories))  # one row of categories
        has = F.col(f"`{vector}`")
        made = F.when(has.isNotNull(), F.transform("__all", lambda c: F.coalesce(F.try_element_at(has, c), F.lit(0.0)))).alias(vector)  # noqa: B023
        every = F.when(has.isNotNull(), F.col("__all")).alias(names)
        shares = held.select(*[x for c in shares.columns for x in ((made, every) if c == vector else (F.col(f"`{c}`"),))])
    return shares


def aggregate_category_vector(df: DataFrame, keys: list[str], column: str, proportion: bool = True) -> DataFrame:
    """``<column>_vector``: for each key the shares (or counts) of all categories in sorted order, and
    ``<column>_categories``. Every distinct key of the table has a row, with zeros if it has no category, missing
    keys too; the rows of a missing key are not counted."""
    return with_all_categories(category_shares(df, keys, column, proportion), df, [column])


def aggregate_category_onehot(df: DataFrame, keys: list[str], column: str, proportion: bool = True) -> DataFrame:
    """One column ``<column>_<category>`` for each category; categories are read first, and the pivot is planned with them."""
    categories = [r[0] for r in df.select(F.col(f"`{column}`").cast("string")).distinct().orderBy(F.col(f"`{column}`").cast("string")).collect() if r[0] is not None]
    own = F.col(f"`{column}`").cast("string")
    counts = _present(df, keys).groupBy(*keys).agg(F.count(F.col(f"`{column}`")).alias("__total"), *[F.count_if(own == c).alias(f"__{i}") for i, c in enumerate(categories)])
    value = (lambda i: F.coalesce(F.try_divide(f"__{i}", "__total"), F.lit(0.0))) if proportion else (lambda i: F.col(f"__{i}"))
    return counts.select(*keys, *[value(i).alias(f"{column}_{c}") for i, c in enumerate(categories)])


def aggregate_text(df: DataFrame, keys: list[str], column: str, k: int = 5, separator: str = " | ") -> DataFrame:
    """``<column>_text``: up to ``k`` texts that cover each key's texts best, joined."""
    subsets = text_subsets(_present(df, keys), keys, column, k)
    return subsets.select(*keys, F.coalesce(F.array_join("texts", separator), F.lit("")).alias(f"{column}_text"))


def candidate_parts(df: DataFrame, keys: list[str], declared: Mapping[str, str] | None = None, function: str = "mean", k: int = 5) -> tuple[DataFrame, list[str]]:
    """All aggregates of a candidate table by key: numbers in one pass, then shares of each key's own categories and texts, merged
    by key, and the columns that are categories. A table without any gives its distinct keys."""
    classes = {c: kind for c, kind in column_classes(df.drop(*keys), declared).items()}
    of = lambda kind: [c for c, x in classes.items() if x == kind]
    numbers = [c for c in of("numerical") if dict(df.dtypes)[c] not in ("string", "date", "timestamp")]
    parts = [aggregate_numeric(df, keys, numbers, function)] if numbers else []
    parts += [_present(category_shares(df, keys, c), keys) for c in of("categorical")]
    parts += [aggregate_text(df, keys, c, k) for c in of("text")]
    merged = merge_outer(parts, keys) if parts else _present(df, keys).select(*keys).distinct()
    return merged, of("categorical")


def aggregate_candidate(df: DataFrame, keys: list[str], declared: Mapping[str, str] | None = None, function: str = "mean", k: int = 5) -> DataFrame:
    """All aggregates of a candidate table by key: numbers in one pass, then vectors and texts, merged by key. A table
    without any gives its distinct keys."""
    df = convert_numeric_columns(df, keys)
    merged, categorical = candidate_parts(df, keys, declared, function, k)
    return with_all_categories(merged, df, categorical)


def aggregate_tables(lake: Mapping[str, DataFrame], chosen: Mapping[str, list[str]], query_keys: list[str], keys: DataFrame, **options) -> dict[str, DataFrame]:
    """Candidates whose chosen columns match the query's keys in number: filtered to those keys, renamed and aggregated."""
    found = {}
    for table_id, columns in chosen.items():
        if len(columns) == len(query_keys):
            renamed = lake[table_id].withColumnsRenamed(dict(zip(columns, query_keys)))
            found[table_id] = aggregate_candidate(semi_filter(renamed, keys, query_keys), query_keys, **options)
    return found


def target_parts(df: DataFrame, keys: list[str], target: str, kind: str | None = None) -> tuple[DataFrame, DataFrame, str]:
    """The target by key, its rows as they are counted, and its kind; of categories the shares of each key's own."""
    df = binary_target(convert_numeric_columns(df.select(*keys, target), keys), target)
    kind = kind or column_classes(df.select(target)).get(target)
    if kind == "numerical":
        return aggregate_numeric(df, keys, [target]), df, kind
    if kind == "categorical":
        return category_shares(df, keys, target), df, kind
    raise ValueError(f"the target is neither numerical nor categorical: {kind}")


def aggregate_target(df: DataFrame, keys: list[str], target: str, kind: str | None = None) -> tuple[DataFrame, str]:
    """Numbers by their mean, two-valued texts as 0 and 1, categories as vectors; other classes are an error."""
    found, df, kind = target_parts(df, keys, target, kind)
    return (with_all_categories(found, df, [target]) if kind == "categorical" else found), kind


def pivot_latest(log: DataFrame, row: str, column: str, value: str, order: str, columns: list) -> DataFrame:
    """A matrix of the latest value of each cell."""
    cells = [F.max_by(F.when(F.col(column) == c, F.col(value)), F.when(F.col(column) == c, F.col(order))).alias(f"{column}_{c}") for c in columns]
    return log.groupBy(row).agg(*cells)


def impute_vectors(df: DataFrame, column: str) -> DataFrame:
    """Missing vectors become the mean by position, which is one row."""
    means = df.select(F.posexplode(column).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"))
    mean = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("__mean"))
    return df.join(F.broadcast(mean)).withColumn(column, F.coalesce(F.col(column), F.col("__mean"))).drop("__mean")


def expand_vector(df: DataFrame, column: str, size: int) -> DataFrame:
    return df.select(*[c for c in df.columns if c != column], *[F.col(column)[i].alias(f"{column}_{i}") for i in range(size)])


def run_summary(scores: DataFrame, value: str) -> DataFrame:
    return scores.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min"))
