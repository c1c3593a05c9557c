"""Association of features with a target: Pearson and distance correlation, and the table of all features."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joinwright.functions import vectors

from .distance import distance_correlation_of_numbers, distance_correlation_of_points
from .profile import is_numeric
from .texts import Embedder, embed, hashed_ngrams


def feature_columns(df: DataFrame, keys: list[str], target: str) -> dict[str, str]:
    """Feature -> ``numerical``, ``categorical`` (a vector) or ``text``, by type and by the ends of names."""
    found = {}
    for c in df.columns:
        if c in keys or c in (target, f"{target}_vector") or c.endswith("_categories"):
            continue
        if c.endswith("_vector") and isinstance(df.schema[c].dataType, T.ArrayType):
            found[c] = "categorical"
        elif c.endswith("_text"):
            found[c] = "text"
        elif is_numeric(df, c):
            found[c] = "numerical"
    return found


def base_name(feature: str) -> str:
    return feature.removesuffix("_vector").removesuffix("_text")


def pearson(df: DataFrame, pairs: list[tuple[str, Column, Column]]) -> DataFrame:
    """``feature, value`` for (name, x, y): all in one aggregation, each over the rows with both; NaN under two rows."""
    cells = []
    for name, x, y in pairs:
        x, y = x.cast("double"), y.cast("double")
        both = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
        value = F.when(F.count_if(both) >= 2, F.corr(F.when(both, x), F.when(both, y))).otherwise(float("nan"))
        cells.append(F.struct(F.lit(name).alias("feature"), F.coalesce(value, F.lit(float("nan"))).alias("value")))
    return df.agg(F.array(*cells).alias("p")).select(F.inline("p"))


def _complete(df: DataFrame, x: str, y: str) -> DataFrame:
    """``x, y``: the rows that have both columns, as doubles, arrays of doubles or sparse vectors."""
    cells, rule = [], F.lit(True)
    for name, c in (("x", x), ("y", y)):
        kind, value = df.schema[c].dataType, F.col(f"`{c}`")
        if not isinstance(kind, T.ArrayType):
            value = value.cast("double")
            rule &= ~F.isnan(name)
        elif not isinstance(kind.elementType, T.StructType):
            value = F.transform(value, lambda v: v.cast("double"))
            rule &= (F.size(name) > 0) & F.forall(name, lambda v: v.isNotNull() & ~F.isnan(v))
        cells.append(value.alias(name))
    return df.select(*cells).where("x is not null and y is not null").where(rule)


def distance_correlation_of_vectors(df: DataFrame, x: str, y: str) -> float:
    """Of two columns, one of which at least holds vectors, over the rows that have both."""
    # A row for each different point, read several times.
    points = _complete(df, x, y).groupBy("x", "y").agg(F.count("*").cast("double").alias("w")).persist(StorageLevel.DISK_ONLY)
    try:
        return distance_correlation_of_points(points)
    finally:
        points.unpersist()


def distance_correlation(df: DataFrame, x: str, y: str, most: int | None = None) -> DataFrame:
    """One row ``value``: the distance correlation of two numeric or vector columns over the rows that have both, 0 where
    a variance is 0, NaN under two rows. Two numbers need no pairs of rows, nor does a number with few different vectors;
    else all pairs of different points are compared in blocks. With ``most``, more than so many rows with a vector are
    refused."""
    if any(isinstance(df.schema[c].dataType, T.ArrayType) for c in (x, y)):
        if most is not None and _complete(df, x, y).limit(most + 1).count() > most:
            raise ValueError(f"more than {most} rows")
        value = distance_correlation_of_vectors(df, x, y)
    else:
        numbers = df.select(F.col(f"`{x}`").cast("double").alias("x"), F.col(f"`{y}`").cast("double").alias("y"))
        value = distance_correlation_of_numbers(numbers.where("x is not null and y is not null and not isnan(x) and not isnan(y)"))
    return df.sparkSession.createDataFrame([(value,)], "value double")


def feature_correlations(df: DataFrame, keys: list[str], target: str, embedder: Embedder = hashed_ngrams) -> DataFrame:
    """``feature, metric, value, feature_type`` for every feature, over all rows. Numbers with a number: Pearson. Vectors,
    sparse ones too, on either side: distance correlation. Texts: their embeddings, as the mean with a number and as vectors otherwise."""
    vector = target if target in df.columns and isinstance(df.schema[target].dataType, T.ArrayType) else f"{target}_vector"
    numeric = target in df.columns and not isinstance(df.schema[target].dataType, T.ArrayType)
    goal = target if numeric else vector
    features = feature_columns(df, keys, target)
    for c, kind in features.items():
        if kind == "text":
            df = df.withColumn(f"__{c}", embed(F.col(f"`{c}`"), embedder))
    linear = [(c, F.col(f"`{c}`"), F.col(f"`{goal}`")) for c, kind in features.items() if kind == "numerical" and numeric]
    linear += [(c, vectors.mean(F.col(f"`__{c}`")), F.col(f"`{goal}`")) for c, kind in features.items() if kind == "text" and numeric]
    parts = [pearson(df, linear).withColumn("metric", F.lit("pearson"))] if linear else []
    told = {name for name, _, _ in linear}
    rest = [c for c in features if c not in told]
    if rest:
        values = [distance_correlation_of_vectors(df, f"__{c}" if features[c] == "text" else c, goal) for c in rest]
        distances = df.sparkSession.createDataFrame(list(zip(rest, values)), "feature string, value double")
        parts.append(distances.withColumn("metric", F.lit("distance")))
    if not parts:
        return df.sparkSession.createDataFrame([], "feature string, metric string, value double, feature_type string")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    kinds = F.create_map(*[F.lit(x) for pair in features.items() for x in pair])
    base = F.regexp_replace("feature", "(_vector|_text)$", "")
    return found.select(base.alias("feature"), "metric", "value", kinds[F.col("feature")].alias("feature_type"))
