"""Augmentation end to end: find tables, join columns and features, join them, and tell whether they help."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinwright.functions.keys import normalize_key
from joinwright.operators.aggregate import candidate_parts, target_parts
from joinwright.operators.assoc import feature_correlations
from joinwright.operators.joins import exclude_existing, join_coverage, join_left_dedup, join_nullsafe, semi_filter
from joinwright.operators.profile import convert_numeric_columns
from joinwright.operators.sketch import propose_join_columns
from joinwright.sources.catalog import catalog_of

from . import choices
from .evaluate import Metrics, baseline_features, evaluate, improvement


@dataclass
class AugmentResult:
    table: DataFrame
    proposals: DataFrame
    correlations: DataFrame
    selected: dict[str, tuple[str, ...]]
    coverage: dict[str, float]
    baseline: Metrics | None = None
    augmented: Metrics | None = None
    report: dict = field(default_factory=dict)


def propose(query: DataFrame, task: choices.Task, lake: Mapping[str, DataFrame], select: Callable = choices.select_tables) -> DataFrame:
    """The join column of each selected table for each key of the query."""
    spark = query.sparkSession
    chosen = [r.id for r in select(catalog_of(spark, lake), task).collect()]
    tables = {t: lake[t] for t in chosen} or {t: df for t, df in lake.items() if t != task.table}
    return choices.select_join_columns(propose_join_columns(query, list(task.join_columns), tables))


def correlate(query: DataFrame, task: choices.Task, candidate: DataFrame, columns: list[str]) -> DataFrame:
    """The correlation table of one candidate with the target, both aggregated by the normalised key, over all keys."""
    keys = list(task.join_columns)
    normal = lambda df: df.na.drop(subset=keys).withColumns({k: normalize_key(F.col(k)) for k in keys})
    target, _, _ = target_parts(normal(query), keys, task.target)
    renamed = candidate.withColumnsRenamed(dict(zip(columns, keys))).drop(*[f"{task.target}{end}" for end in ("", "_vector", "_categories")])
    # Kept on disks, as profiles and aggregates read it, too.
    renamed = semi_filter(normal(renamed), target.select(*keys), keys).persist(StorageLevel.DISK_ONLY)
    joined = None
    try:
        # Vectors stay sparse: the rows that are joined, sorted and kept hold a key's own categories only.
        parts, categorical = candidate_parts(convert_numeric_columns(renamed, keys), keys)
        joined = join_nullsafe(parts, target, keys)
        if categorical and len(parts.columns) > len(keys) + 1:  # read for each vector and once for all others
            joined = joined.persist(StorageLevel.DISK_ONLY)
        found = exclude_existing(feature_correlations(joined, keys, task.target), query.columns)
        return query.sparkSession.createDataFrame(found.collect(), found.schema)  # one row for each feature
    finally:
        renamed.unpersist()
        if joined is not None:
            joined.unpersist()


def augment(query: DataFrame, task: choices.Task, lake: Mapping[str, DataFrame], order: Mapping[str, list[str]] | None = None, score: bool = True) -> AugmentResult:
    """``order``: for each table the columns that say which row of a key comes first; by default all of them."""
    spark = query.sparkSession
    keys = list(task.join_columns)
    proposals = propose(query, task, lake)
    by_table: dict[str, dict[str, str]] = {}
    for r in proposals.collect():
        by_table.setdefault(r.table_id, {})[r.query_column] = r.column
    table, correlations, selected, coverage = query, None, {}, {}
    for table_id in sorted(by_table):
        columns = by_table[table_id]
        if set(columns) != set(keys):
            continue
        candidate = lake[table_id]
        own = [columns[k] for k in keys]
        found = correlate(query, task, candidate, own).withColumn("table_id", F.lit(table_id))
        correlations = found if correlations is None else correlations.unionByName(found)
        pruned = choices.prune_columns(found)
        kept = [c for c in pruned.selected if c in candidate.columns]
        selected[table_id] = tuple(kept)
        if kept:
            right = candidate.withColumnsRenamed(dict(zip(own, keys))).select(*keys, *kept)
            coverage[table_id] = join_coverage(query, right, keys[0]).first().coverage
            ordered = (order or {}).get(table_id) or kept
            table = join_left_dedup(table, right, keys, ordered, table_id)
    if correlations is None:
        correlations = spark.createDataFrame([], "feature string, metric string, value double, feature_type string, table_id string")
    result = AugmentResult(table, proposals, correlations, selected, coverage)
    if score:
        result.baseline = evaluate(query, task.target, baseline_features(query.columns, task.target, keys), task.task)
        result.augmented = evaluate(table, task.target, baseline_features(table.columns, task.target, keys), task.task)
        result.report = improvement(result.baseline.score, result.augmented.score)
    return result
