"""Models and metrics that tell whether added columns help."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joinwright.operators import mlprep
from joinwright.operators.joins import join_nullsafe, validate_join
from joinwright.operators.moments import added_r2, part_moments
from joinwright.operators.profile import is_numeric


@dataclass(frozen=True)
class Metrics:
    """``score`` is R2 for regression and weighted F1 for classification."""

    task: str
    score: float
    details: dict[str, float]
    rows: int


def baseline_features(columns: list[str], target: str, keys: list[str]) -> list[str]:
    """All columns but target and keys; without any, the keys."""
    rest = [c for c in columns if c != target and c not in keys]
    return rest or [c for c in columns if c != target]


def _finite(df: DataFrame, column: str) -> Column:
    """A number as a double, null where it is not finite; other columns as texts."""
    value = F.col(f"`{column}`")
    if not is_numeric(df, column):
        return value.cast("string")
    return F.when(F.abs(value.cast("double")) < float("inf"), value.cast("double"))


def prepare(df: DataFrame, target: str, features: list[str], task: str, carry: list[str] = ()) -> tuple[DataFrame, list[str]]:
    """Rows with a target, imputed, encoded and scaled features ``f0, f1, ...``, a numeric ``label``, and the columns
    ``carry``. Scaling sees all rows, test rows included. NaN and infinite numbers are missing ones."""
    kept = df.where(_finite(df, target).isNotNull())
    columns = [_finite(kept, c).alias(f"f{i}") for i, c in enumerate(features)]
    rest = [F.col(f"`{target}`").alias("label"), *carry]
    filled = [f"f{i}" for i in range(len(features))]
    kept = kept.select(*columns, *rest)
    present = mlprep.drop_null_columns(kept.select(*filled)).columns if filled else []
    kept = mlprep.drop_sparse_rows(mlprep.impute(kept.select(*present, "label", *carry), only=present), present)
    kept = mlprep.numeric_or_encode(kept, present)
    if task == "classification":
        kept = mlprep.label_encode(mlprep.drop_rare_classes(kept, "label"), "label")
    return mlprep.standard_scale(kept, present).withColumn("label", F.col("label").cast("double")), present


def evaluate(df: DataFrame, target: str, features: list[str], task: str = "regression", key: str | None = None, position: str | None = None) -> Metrics:
    """Trains on 70 % of the rows and scores the others. The rows are split by a permutation of ``position`` where given,
    and else by a hash of ``key`` or of the whole row; for classification each class is."""
    carried = df.withColumn("__split", F.col(f"`{position}`") if position else F.col(f"`{key}`") if key else F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if not isinstance(df.schema[c].dataType, T.MapType)]))
    # The table is made once, as each step of the preparation reads it, and kept until the prepared rows are.
    carried = carried.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*features, target])], "__split").persist(StorageLevel.DISK_ONLY)
    rows = None
    try:
        rows, names = prepare(carried, target, features, task, ["__split"])
        rows = VectorAssembler(inputCols=names, outputCol="x", handleInvalid="skip").transform(rows).select("x", "label", "__split").persist(StorageLevel.DISK_ONLY)
        n = rows.count()
        carried.unpersist()
        if position:
            train, test = mlprep.split_by_position(rows, "__split")
        elif task == "regression":
            train, test = mlprep.split_by_hash(rows, "__split")
        else:
            train, test = mlprep.split_stratified(rows, "label", "__split")
        if task == "regression":
            model = LinearRegression(featuresCol="x", solver="normal").fit(train)
            found = model.transform(test)
            of = lambda m: RegressionEvaluator(metricName=m).evaluate(found)
            details = {"r2": of("r2"), "mse": of("mse"), "mae": of("mae")}
            return Metrics(task, details["r2"], details, n)
        classes = rows.select("label").distinct().count()
        model = GBTClassifier(featuresCol="x", maxIter=20, seed=42) if classes == 2 else RandomForestClassifier(featuresCol="x", numTrees=50, seed=42)
        found = model.fit(train).transform(test)
        of = lambda m: MulticlassClassificationEvaluator(metricName=m).evaluate(found)
        details = {"f1": of("f1"), "accuracy": of("accuracy"), "precision": of("weightedPrecision"), "recall": of("weightedRecall")}
        return Metrics(task, details["f1"], details, n)
    finally:
        carried.unpersist()
        if rows is not None:
            rows.unpersist()


def improvement(baseline: float, augmented: float) -> dict[str, float | bool]:
    """Difference, percentage of the baseline (of 1, if that is 0), and whether it is one."""
    gain = augmented - baseline
    return {"improvement": gain, "percent": 100 * gain / abs(baseline) if baseline else 100 * gain, "is_valid": gain > 0}


def integration_quality(query: DataFrame, candidate: DataFrame, query_keys: list[str], candidate_keys: list[str]) -> float:
    """Matched rows over base rows; above 1 where rows multiply."""
    return validate_join(query, candidate, query_keys, candidate_keys).match_rate


def added_scores(df: DataFrame, target: str, base: list[str], columns: list[str], keys: list[str], share: float = 0.3, seed: int = 42) -> tuple[float | None, dict[str, float | None]]:
    """R2 of a linear model of the columns ``base``, and of those with each of ``columns`` added alone. All are found from
    one pass over the prepared rows (``operators.moments``), and trained and scored on the same rows, which are told apart
    by a hash of ``keys``: rows of equal keys are on the same side, on every run."""
    rows, names = prepare(df.withColumn("__test", mlprep.held_out(keys, share, seed)), target, [*base, *columns], "regression", ["__test"])
    rows = mlprep.standard_scale(rows, ["label"])
    used, added = ([n for n in names if (int(n[1:]) < len(base)) == first] for first in (True, False))
    score, scores = added_r2(*part_moments(rows, used, added, "label", F.col("__test")))
    by_name = dict(zip(added, scores))
    return score, {c: by_name.get(f"f{len(base) + i}", score) for i, c in enumerate(columns)}  # a column without values adds nothing


def feature_importance(df: DataFrame, target: str, features: list[str], column: str, task: str = "regression", key: str | None = None) -> float | None:
    """The score with a column less the score without; null with fewer than 3 rows or no other feature. For regression
    both come from one pass; rows are split by a hash of ``key`` or of all columns."""
    rest = [c for c in features if c != column]
    if not rest or df.limit(3).count() < 3:
        return None
    if task == "regression":
        without, scores = added_scores(df, target, rest, [column], [key] if key else df.columns)
        return None if without is None else scores[column] - without
    return evaluate(df, target, [*rest, column], task, key).score - evaluate(df, target, rest, task, key).score


def utility_gain(quality: float, importance: float | None) -> float | None:
    return None if importance is None else quality * importance


def column_effects(features: DataFrame, labels: DataFrame, keys: list[str], target: str, columns: list[str], task: str = "regression", least: float = 0.01) -> DataFrame:
    """Each column alone joined to the label table: ``column, baseline, score, difference, effect``.

    For regression all columns are joined at once, which gives each the rows that it has when joined alone, and one pass
    over them scores all; rows are split by a hash of the keys. A score that can't be told is null, and its effect
    negative.
    """
    spark = features.sparkSession
    base_columns = baseline_features(labels.columns, target, keys)
    if task == "regression":
        base, _ = added_scores(labels, target, base_columns, [], keys)
        joined = join_nullsafe(labels, features.select(*keys, *columns), keys)
        scores = added_scores(joined, target, base_columns, columns, keys)[1]
    else:
        base = evaluate(labels, target, base_columns, task).score
        scores = {c: evaluate(join_nullsafe(labels, features.select(*keys, c), keys), target, [*base_columns, c], task).score for c in columns}
    gains = {c: None if base is None or s is None else s - base for c, s in scores.items()}
    rows = [(c, base, s, gains[c], "positive" if gains[c] is not None and gains[c] >= least else "negative") for c, s in scores.items()]
    return spark.createDataFrame(rows, "column string, baseline double, score double, difference double, effect string")


def effect_summary(effects: DataFrame) -> DataFrame:
    positive: Column = F.count_if(F.col("effect") == "positive")
    return effects.agg(F.count("*").alias("n"), positive.alias("positive"), F.coalesce(F.try_divide(positive, F.count("*")), F.lit(0.0)).alias("share"))
