"""Bottom-k sketches of columns, and the join columns that they propose.

A sketch is a set of rows ``(table_id, column, hash)``: the k smallest hashes of a column's distinct normal forms. All columns
of all tables are sketched by one plan. Only the first ``k_max`` hashes of each column can be in a sketch, so most
others are dropped before the ranking's shuffle.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from joinwright.functions.keys import hash_prefix, normalize_key
from joinwright.functions.vectors import cosine

from .texts import Embedder, embed, hashed_ngrams

#: Fixed values of the effective size.
K, K_MIN, RATIO, K_MAX = 512, 256, 0.1, 10_000


def effective_k(n: Column, k: int = K, ratio: float = RATIO, k_max: int = K_MAX) -> Column:
    return F.least(F.least(F.greatest(F.ceil(n * ratio), F.lit(K_MIN), F.lit(k)), F.lit(k_max)), n)


def long_values(df: DataFrame, table_id: str, columns: list[str] | None = None) -> DataFrame:
    """``table_id, column, ordinal, value``: all columns in one pass, values as texts."""
    columns = columns or df.columns
    cells = [F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(columns)]
    return df.select(F.lit(table_id).alias("table_id"), F.inline(F.array(*cells))).select("table_id", "column", "ordinal", "value")


def _smallest(hashes: DataFrame, extra: list[str], k: int, ratio: float, k_max: int) -> DataFrame:
    """Of distinct rows ``(table_id, column, hash, *extra)``; n is their number in the column. Hashes are counted by their first
    three digits, and only those up to the digits with which a column has ``k_max`` are ranked, so no task sorts a column."""
    keys = ["table_id", "column"]
    digits = F.substring("hash", 1, 3)
    counts = hashes.groupBy(*keys, digits.alias("digits")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy(*keys).orderBy("digits"))
    edges = counts.withColumn("upto", upto).groupBy(*keys).agg(F.sum("n").alias("n"), F.min(F.when(F.col("upto") >= k_max, F.col("digits"))).alias("edge"))
    first = hashes.join(F.broadcast(edges), keys).where(F.col("edge").isNull() | (digits <= F.col("edge")))  # a row for each column
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("hash", *extra))
    kept = first.withColumn("rank", rank).where(F.col("rank") <= effective_k(F.col("n"), k, ratio, k_max))
    return kept.select(*keys, "hash", *extra)


def bottom_k(values: DataFrame, k: int = K, ratio: float = RATIO, k_max: int = K_MAX) -> DataFrame:
    """Sketches of ``(table_id, column, value)``. Missing values are a member, ``__NA__``."""
    hashes = values.select("table_id", "column", hash_prefix(normalize_key(F.col("value"))).alias("hash")).distinct()
    return _smallest(hashes, [], k, ratio, k_max)


def bottom_k_with_samples(values: DataFrame, k: int = K, ratio: float = RATIO, k_max: int = K_MAX) -> DataFrame:
    """As ``bottom_k`` of the distinct values that aren't null, which it keeps; values of one normal form repeat its
    hash."""
    distinct = values.where("value is not null").select("table_id", "column", "value").distinct()
    return _smallest(distinct.withColumn("hash", hash_prefix(normalize_key(F.col("value")))), ["value"], k, ratio, k_max)


def sketch_table(df: DataFrame, table_id: str, columns: list[str] | None = None, k: int = K) -> DataFrame:
    return bottom_k(long_values(df, table_id, columns), k)


def scores(query: DataFrame, candidates: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Each query column against each candidate column that shares a hash: ``query_column, table_id, column, shared,
    jaccard, containment`` (of the query in the candidate) and their larger one, ``score``. ``sizes`` of the candidates'
    sketches (``table_id, column, size``) where they are known; ``candidates`` may then lack hashes the query has not."""
    query = query.select(F.col("column").alias("query_column"), "hash").distinct()
    candidates = candidates.select("table_id", "column", "hash").distinct()
    query_sizes = query.groupBy("query_column").agg(F.count("*").alias("query_size"))
    if sizes is None:
        sizes = candidates.groupBy("table_id", "column").agg(F.count("*").alias("size"))
    shared = candidates.join(query, "hash").groupBy("query_column", "table_id", "column").agg(F.count("*").alias("shared"))
    found = shared.join(query_sizes, "query_column").join(sizes, ["table_id", "column"])
    jaccard = F.col("shared") / (F.col("query_size") + F.col("size") - F.col("shared"))
    found = found.withColumn("jaccard", jaccard).withColumn("containment", F.col("shared") / F.col("query_size"))
    return found.select("query_column", "table_id", "column", "shared", "jaccard", "containment", F.greatest("jaccard", "containment").alias("score"))


def top_columns(scored: DataFrame, k: int = 5, least: float = 0.1, score: str = "score", order: str = "column") -> DataFrame:
    """The best ``k`` columns of each table for each query column, with a score of at least ``least``."""
    rank = F.row_number().over(W.partitionBy("query_column", "table_id").orderBy(F.desc(score), order))
    return scored.where(F.col(score) >= least).withColumn("rank", rank).where(F.col("rank") <= k)


def propose_join_columns(query: DataFrame, keys: list[str], lake: dict[str, DataFrame], k: int = 5, least: float = 0.1) -> DataFrame:
    """Join columns of every table of a lake for each key of a query table, found when this is called."""
    candidates = None
    for table_id, df in lake.items():
        values = long_values(df, table_id)
        candidates = values if candidates is None else candidates.union(values)
    # Sketches are small and read several times; without this, each time from all values.
    sketches = [bottom_k(long_values(query, "query", keys)).persist(StorageLevel.DISK_ONLY), bottom_k(candidates, k=1024).persist(StorageLevel.DISK_ONLY)]
    try:
        found = top_columns(scores(*sketches), k, least)
        return query.sparkSession.createDataFrame(found.collect(), found.schema)  # at most k rows for each key and table
    finally:
        for s in sketches:
            s.unpersist()


def best_score(chosen: DataFrame) -> DataFrame:
    return chosen.groupBy("table_id").agg(F.max("score").alias("best"))


def overlap_statistics(query: DataFrame, key: Column, candidate: DataFrame, table_id: str) -> DataFrame:
    """Exact overlap of a key with every column of a table, on trimmed lower-case texts: ``column, jaccard,
    query_in_candidate, candidate_in_query, uniqueness`` (missing counts as a value) and ``missing``."""
    form = lambda c: F.lower(F.trim(c))
    keys = query.select(form(key.cast("string")).alias("value")).where("value is not null").distinct()
    n_keys = keys.agg(F.count("*").alias("n_keys"))
    values = long_values(candidate, table_id)
    stats = values.groupBy("column").agg(
        F.count("*").alias("n"), (F.count_distinct("value") + F.max(F.col("value").isNull().cast("int"))).alias("distinct"), F.avg(F.col("value").isNull().cast("double")).alias("missing")
    )
    own = values.select("column", form(F.col("value")).alias("value")).where("value is not null").distinct()
    sizes = own.groupBy("column").agg(F.count("*").alias("size"))
    shared = own.join(keys, "value").groupBy("column").agg(F.count("*").alias("shared"))
    found = stats.join(sizes, "column", "left").join(shared, "column", "left").na.fill(0, ["size", "shared"]).join(F.broadcast(n_keys))  # one row
    union = F.col("n_keys") + F.col("size") - F.col("shared")
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return found.select(
        "column", ratio(F.col("shared"), union).alias("jaccard"), ratio(F.col("shared"), F.col("n_keys")).alias("query_in_candidate"),
        ratio(F.col("shared"), F.col("size")).alias("candidate_in_query"), (F.col("distinct") / F.col("n")).alias("uniqueness"), "missing",
    )


def top_overlaps(statistics: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` columns with the largest of the three overlaps, ties by name, without these."""
    three = ["jaccard", "query_in_candidate", "candidate_in_query"]
    return statistics.orderBy(F.greatest(*three).desc(), "column").limit(n).drop(*three)


def with_name_similarity(statistics: DataFrame, name: str, embedder: Embedder = hashed_ngrams) -> DataFrame:
    """Adds ``name_similarity``: the cosine of the embeddings of the column's name and ``name``, 0 for an empty one."""
    own = [float(v) for v in embedder([name])[0]]
    there = embed(F.col("column"), embedder)
    return statistics.withColumn("name_similarity", cosine(there, F.array(*[F.lit(v) for v in own])))
