"""The choices that a language model could make, as protocols with deterministic stand-ins."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinwright.operators.profile import primary_key, uniqueness
from joinwright.sources import catalog as catalogs

#: Places and the domains that serve their data; answers that are no keyword.
DOMAINS = {"chicago": "data.cityofchicago.org", "nyc": "data.cityofnewyork.us", "new york": "data.cityofnewyork.us"}
NO_WORDS = ("done", "skip", "all")


@dataclass(frozen=True)
class Task:
    """What to augment: a query table, its keys, a target, and the kind of model."""

    table: str
    join_columns: tuple[str, ...]
    target: str
    task: str = "regression"
    intent: Mapping[str, str] = field(default_factory=dict)

    @staticmethod
    def of(table: str, join_column: str | list[str], target: str, task: str = "regression", **intent: str) -> Task:
        keys = tuple(c.strip() for c in join_column.split(",")) if isinstance(join_column, str) else tuple(join_column)
        return Task(table, keys, target, task, intent)


def search_parameters(intent: Mapping[str, str]) -> tuple[list[str], list[str]]:
    """Words and domains: the place gives the domains, other dimensions give words."""
    place = intent.get("place", "").lower()
    domains = sorted({d for name, d in DOMAINS.items() if name in place})
    words = [w for name, text in intent.items() if name != "place" for w in text.lower().replace(",", " ").split() if w not in NO_WORDS]
    return list(dict.fromkeys(words)), domains


class TableSelector(Protocol):
    def __call__(self, catalog: DataFrame, task: Task) -> DataFrame: ...


def select_tables(catalog: DataFrame, task: Task, most: int | None = None) -> DataFrame:
    """``id, score``: words of the intent in name and description, and two points for a possible join column; tables
    with any point, best first, the query table excluded."""
    words, _ = search_parameters(task.intent)
    text = F.lower(F.concat_ws(" ", "name", "description"))
    hits = sum([text.contains(w).cast("int") for w in words], F.lit(0))
    scored = catalogs.possible_join_columns(catalog, list(task.join_columns)).withColumn("score", hits + 2 * (F.size("matching") > 0).cast("int"))
    found = scored.where((F.col("score") > 0) & (F.lower("id") != task.table.lower())).select("id", "score").orderBy(F.desc("score"), "id")
    return found.limit(most) if most is not None else found


def select_join_columns(proposals: DataFrame) -> DataFrame:
    """The best proposal of each query key and table; equal scores go to a column of the key's name, then by name."""
    alike = (F.lower("column") == F.lower("query_column")).cast("int")
    best = F.min_by(F.struct("column", "score"), F.struct((-F.col("score")).alias("s"), (-alike).alias("a"), F.col("column")))
    return proposals.groupBy("query_column", "table_id").agg(best.alias("b")).select("query_column", "table_id", "b.column", "b.score")


@dataclass(frozen=True)
class Pruned:
    selected: tuple[str, ...]
    dropped: tuple[str, ...]


def checked_partition(features: list[str], selected: list[str], dropped: list[str]) -> Pruned:
    """A choice must put each feature into exactly one part."""
    if sorted([*selected, *dropped]) != sorted(features):
        raise ValueError("selected and dropped features must be disjoint and make up all features")
    return Pruned(tuple(selected), tuple(dropped))


def prune_columns(correlations: DataFrame, least: float = 0.05) -> Pruned:
    """Features with a value of at least ``least`` in size, of those with equal values the first; ids and NaN go."""
    selected, dropped, seen = [], [], set()
    for r in correlations.orderBy("feature").collect():
        value = r.value
        ok = value is not None and value == value and abs(value) >= least and not r.feature.lower().endswith("_id") and round(value, 12) not in seen
        (selected if ok else dropped).append(r.feature)
        if ok:
            seen.add(round(value, 12))
    return checked_partition([*selected, *dropped], selected, dropped)


@dataclass(frozen=True)
class SplitDesign:
    keys: tuple[str, ...]
    feature_columns: tuple[str, ...]
    label_columns: tuple[str, ...]


def design_split(df: DataFrame, target: str) -> SplitDesign:
    """A feature and a label table that share a primary key, or else the most distinct column other than the target."""
    key = primary_key(df.drop(target))
    if key is None:
        key = uniqueness(df.drop(target)).orderBy(F.desc("uniqueness"), "column").first().column
    rest = [c for c in df.columns if c not in (key, target)]
    return SplitDesign((key,), (key, *rest), (key, target))


ValueGenerator = Callable[[str, list], Mapping]


def generate_values(df: DataFrame, key: str, columns: list[str], generator: ValueGenerator, most: int = 500) -> DataFrame:
    """Columns whose values a generator gives for the first ``most`` distinct keys (its budget of calls), joined by key."""
    keys = [r[0] for r in df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key).limit(most).collect()]
    for c in columns:
        values = [(k, None if v is None else str(v)) for k, v in generator(c, keys).items()]
        table = df.sparkSession.createDataFrame(values, f"`{key}` {df.schema[key].dataType.simpleString()}, `{c}` string")
        df = df.join(table, key, "left")
    return df
