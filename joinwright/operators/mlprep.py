"""Preparation for models: imputation, filters, encoding, scaling, binning, vocabularies, splits."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from joinwright.functions.keys import parse_number
from joinwright.functions.text import all_digits, text_tokens, word_pieces

from .perturb import uniform
from .profile import NUMERIC, _col, is_numeric, null_counts
from .quantiles import exact_quantiles

#: Rows that ``numbered`` looks at to cut the order into ranges, the number of ranges, and of bounds that are met together.
SAMPLE, RANGES, STEP = 4096, 64, 8


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``: 1, 2, ... in the ascending order of columns that together differ on every row.

    Bounds from a hash sample cut the order into ranges. A row's number is its place in its range after the counts of the
    ranges before, so that no task sorts all rows.
    """
    keys = [f"__o{i}" for i in range(len(order))]
    keyed = df.withColumns(dict(zip(keys, order)))
    sample = keyed.select(*keys).orderBy(F.xxhash64(*keys), *keys).limit(SAMPLE).orderBy(*keys).collect()
    bounds = sample[:: SAMPLE // RANGES][1:] if len(sample) == SAMPLE else []
    kinds = [keyed.schema[k].dataType for k in keys]
    bounds = [F.struct(*[F.lit(v).cast(t).alias(k) for v, t, k in zip(b, kinds, keys)]) for b in bounds]
    upto = lambda some: F.size(F.filter(some, lambda b: b <= F.struct(*keys)))
    groups = [bounds[i : i + STEP] for i in range(0, len(bounds), STEP)]
    if bounds:  # first which group of bounds, then which of its own
        keyed = keyed.withColumn("__group", upto(F.array(*[g[-1] for g in groups[:-1]])))
        celled = keyed.withColumn("__cell", F.col("__group") * STEP + F.coalesce(upto(F.get(F.array(*[F.array(*g) for g in groups]), "__group")), F.lit(0))).drop("__group")
    else:
        celled = keyed.withColumn("__cell", F.lit(0))
    counts = celled.groupBy("__cell").agg(F.count("*").alias("__n"))  # a row for each range
    before = counts.select("__cell", (F.sum("__n").over(W.orderBy("__cell")) - F.col("__n")).alias("__before"))
    place = F.row_number().over(W.partitionBy("__cell").orderBy(*keys)) + F.col("__before")
    return celled.join(F.broadcast(before), "__cell").withColumn(name, place).drop("__cell", "__before", *keys)


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    return df.na.drop(subset=[target])


def drop_null_columns(df: DataFrame) -> DataFrame:
    """Without the columns that have no value at all."""
    counts = df.agg(*[F.count(_col(c)).alias(str(i)) for i, c in enumerate(df.columns)]).first()
    return df.select(*[_col(c) for i, c in enumerate(df.columns) if counts[i]])


def drop_sparse_rows(df: DataFrame, features: list[str], most: float = 0.5) -> DataFrame:
    """Without rows with more missing features than this share, and then without those with any."""
    if not features:
        return df
    missing = null_counts(df.select(*[_col(c) for c in features]))
    return df.where(missing <= most * len(features)).na.drop(subset=features)


def mode(df: DataFrame, column: str):
    """The most frequent value, of equal ones the smallest."""
    row = df.where(_col(column).isNotNull()).groupBy(_col(column).alias("v")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "v").first()
    return row.v if row else None


def impute(df: DataFrame, target: str | None = None, only: list[str] | None = None) -> DataFrame:
    """Numbers get their column's mean, other features ``Unknown``, the target its mode. ``only``: these columns."""
    columns = [c for c in (df.columns if only is None else only) if c != target]
    numeric = [c for c in columns if is_numeric(df, c)]
    means = df.agg(*[F.avg(_col(c)).alias(str(i)) for i, c in enumerate(numeric)]).first() if numeric else ()
    fill = {c: F.coalesce(_col(c).cast("double"), F.lit(m).cast("double")) for c, m in zip(numeric, means)}
    for c in columns:
        if c not in fill and isinstance(df.schema[c].dataType, T.StringType):
            fill[c] = F.coalesce(_col(c), F.lit("Unknown"))
    if target is not None:
        fill[target] = F.coalesce(_col(target), F.lit(mode(df, target)).cast(df.schema[target].dataType))
    return df.select(*[fill.get(c, _col(c)).alias(c) for c in df.columns])


def drop_rare_classes(df: DataFrame, label: str, least: int = 5) -> DataFrame:
    """Rows whose class has at least ``least`` rows; counted before the shuffle, so a frequent class is no hot key."""
    kept = df.groupBy(_col(label)).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).drop("__n")
    return df.join(kept, label, "left_semi").select(*[_col(c) for c in df.columns])


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """``value, code``: codes from 0 in the order of the values as texts."""
    values = df.select(_col(column).cast("string").alias("value")).where("value is not null").distinct()
    return numbered(values, [F.col("value")], "code").withColumn("code", F.col("code") - 1)


def label_encode(df: DataFrame, column: str) -> DataFrame:
    codes = label_codes(df, column).withColumnRenamed("code", "__code")
    joined = df.join(codes, _col(column).cast("string") == codes["value"], "left")
    return joined.select(*[F.col("__code").alias(c) if c == column else _col(c) for c in df.columns])


def numeric_or_encode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Texts of which more than half are numbers become numbers, with the mean for the others; the rest codes."""
    for c in columns:
        if isinstance(df.schema[c].dataType, NUMERIC):
            continue
        number = parse_number(_col(c).cast("string"))
        row = df.agg(F.count(number).alias("n"), F.count("*").alias("rows"), F.avg(number).alias("mean")).first()
        df = df.withColumn(c, F.coalesce(number, F.lit(row["mean"]))) if row.n > 0.5 * row.rows else label_encode(df, c)
    return df


def standard_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """Less the mean, over the population deviation; over 1 where that is 0. One aggregation for all columns."""
    if not columns:
        return df
    row = df.agg(*[x for i, c in enumerate(columns) for x in (F.avg(_col(c)).alias(f"m{i}"), F.stddev_pop(_col(c)).alias(f"s{i}"))]).first()
    scaled = {c: (_col(c) - row[f"m{i}"]) / (row[f"s{i}"] or 1.0) for i, c in enumerate(columns)}
    return df.select(*[scaled.get(c, _col(c)).alias(c) for c in df.columns])


def split_positions(n: int, share: float = 0.3, seed: int = 42) -> np.ndarray:
    """Row positions of the test part: the first ``ceil(share * n)`` of a seeded permutation."""
    return np.random.RandomState(seed).permutation(n)[: int(np.ceil(share * n))]


def split_by_position(df: DataFrame, position: str, share: float = 0.3, seed: int = 42, most: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by the permutation of positions 0 to n-1. For small tables that must be split the same way
    elsewhere; see ``split_by_hash`` for others."""
    n = df.count()
    if n > most:
        raise ValueError(f"more than {most} rows; use split_by_hash")
    test = df.sparkSession.createDataFrame([(int(i),) for i in split_positions(n, share, seed)], "__test long")
    on = df[position] == test["__test"]
    return df.join(test, on, "left_anti"), df.join(test, on, "left_semi")


def held_out(keys: list[str], share: float = 0.3, seed: int = 42) -> Column:
    """Whether a row is in the test part, by a hash of its keys as texts."""
    return uniform(seed, *[_col(k) for k in keys]) < share


def split_by_hash(df: DataFrame, key: str, share: float = 0.3, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the key: the same on every run, without a shuffle."""
    test = held_out([key], share, seed)
    return df.where(~test), df.where(test)


def _sortable(f: T.StructField) -> Column:
    """The column as a value that can be hashed and sorted; maps and variants as JSON."""
    loose = any(x in f.dataType.simpleString() for x in ("map<", "variant"))
    return F.to_json(F.struct(_col(f.name))) if loose else _col(f.name)


def split_stratified(df: DataFrame, label: str, key: str, share: float = 0.3, seed: int = 42, cells: int = 1024, classes: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Train and test rows with ``share`` of each class in the test part, rounded, by a hash of the key and the rest of the
    row. A class of one row goes to the training part; null is a class. The hash is cut into ``cells`` ranges: those below a
    class's edge are in the test part, those above it in the training part, and only the rows of the edge itself are shuffled
    and ranked, so that no class and no repeated key meets in one task. Edges are found when this is called; those of up to
    ``classes`` classes go to every task. Rows of equal hashes are ordered by all their columns, so only equal rows tie, and
    train and test are parts of the same ranking however often it is made; columns of user-defined types are not looked at,
    so where there are some the key must tell rows apart."""
    told = [_sortable(f) for f in df.schema if not isinstance(f.dataType, T.UserDefinedType)]
    rows = df.withColumn("__u", F.pmod(F.xxhash64(_col(key), *told, F.lit(seed)), F.lit(1 << 40))).withColumn("__cell", F.shiftright("__u", 20) * cells / (1 << 20))
    rows = rows.withColumn("__cell", F.floor("__cell"))
    sizes = rows.groupBy(_col(label).alias("__class"), F.col("__cell").alias("__of")).agg(F.count("*").alias("__n"))
    whole = W.partitionBy("__class")
    total, upto = F.sum("__n").over(whole), F.sum("__n").over(whole.orderBy("__of"))
    wanted = F.when(total > 1, F.round(share * total)).otherwise(0)
    takes = sizes.select("__class", "__of", "__n", (wanted - (upto - F.col("__n"))).alias("__take"))
    same = _col(label).eqNullSafe(F.col("__class"))
    # The edge is the first cell that isn't taken as a whole; with none, it is after the last.
    open_ = F.when(F.col("__take") < F.col("__n"), F.col("__of"))
    edges = takes.groupBy("__class").agg(F.coalesce(F.min(open_), F.lit(cells)).alias("__edge"), F.coalesce(F.min_by("__take", open_), F.lit(0)).alias("__take"))
    few = edges.limit(classes + 1).collect()
    if len(few) <= classes:
        found = rows.join(F.broadcast(df.sparkSession.createDataFrame(few, edges.schema)), same)
    else:
        edge = F.when(F.col("__take") >= F.col("__n"), F.col("__of") + 1).when(F.col("__take") <= 0, F.col("__of") - 1).otherwise(F.col("__of"))
        found = rows.join(takes.select("__class", "__of", "__take", edge.alias("__edge")), same & (F.col("__cell") == F.col("__of")))
    place = F.row_number().over(W.partitionBy("__class", "__cell").orderBy("__u", _col(key), *told))
    ranked = found.where("__cell = __edge").withColumn("__test", place <= F.col("__take"))
    plain = lambda part: part.select(*[_col(x) for x in df.columns])
    parts = (("__cell > __edge", ~F.col("__test")), ("__cell < __edge", F.col("__test")))
    return tuple(plain(found.where(side)).union(plain(ranked.where(own))) for side, own in parts)


def sample_rows(df: DataFrame, n: int, how: str = "sorted", seed: int = 42) -> DataFrame:
    """``n`` rows: the first ones by all columns that can be sorted (``sorted``), by a seeded hash of the row, the same on
    every run (``random``), or any (``head``)."""
    if how == "head":
        return df.limit(n)
    plain = [_col(f.name) for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    if how == "random":
        return df.orderBy(F.xxhash64(*plain, F.lit(seed)), *plain).limit(n)
    if how != "sorted":
        raise ValueError(f"how is sorted, random or head, not {how!r}")
    return df.orderBy(*plain).limit(n)


@dataclass(frozen=True)
class Preprocessor:
    """Fitted encodings of one or more tables; plain values, so it may be pickled or written as JSON."""

    edges: dict[str, list[float]] = field(default_factory=dict)
    categories: dict[str, dict[str, int]] = field(default_factory=dict)
    vocabulary: dict[str, int] = field(default_factory=dict)


def quantile_edges(df: DataFrame, columns: list[str], bins: int = 10) -> dict[str, list[float]]:
    """Distinct exact quantiles of each column."""
    points = [i / bins for i in range(bins + 1)]
    return {c: sorted(set(found)) for c, found in exact_quantiles(df, columns, points).items()}


def bin_column(value: Column, edges: list[float]) -> Column:
    """The number of the bin ``(low, high]``, the lowest edge included; missing values and those outside the edges are
    in the last."""
    last = max(0, len(edges) - 2)
    found = F.lit(last)
    for i in range(last, -1, -1):
        if len(edges) > 1:
            inside = (value <= edges[i + 1]) & ((value >= edges[i]) if i == 0 else (value > edges[i]))
            found = F.when(inside, i).otherwise(found)
    return found.cast("int")


def category_ids(df: DataFrame, column: str, order: str) -> DataFrame:
    """``value, id``: ids from 1 in order of first appearance; 0 is for unseen values."""
    firsts = df.where(_col(column).isNotNull()).groupBy(_col(column).cast("string").alias("value")).agg(F.min(order).alias("at"))
    return numbered(firsts, [F.col("at"), F.col("value")], "id").select("value", "id")


def _lower(df: DataFrame, column: str, limit: int | None = None) -> Column:
    text = _col(column).cast("string")
    return F.lower(text if limit is None else F.substring(text, 1, limit))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words, _ in word_pieces(batch.column(0)):
            found = pc.value_counts(words)
            found = found.filter(pc.invert(all_digits(found.field(0))))
            yield pa.record_batch({"token": found.field(0).cast(pa.string()), "n": found.field(1)})


def vocabulary(df: DataFrame, column: str, least: int = 2, size: int | None = None, limit: int | None = None) -> DataFrame:
    """``token, n, id``: tokens of at least ``least`` occurrences, most frequent first, ties by the token; ids from 3,
    after padding 0, unknown 1 and numbers 2. Whole texts count, or with ``limit`` their first characters, which hold no more
    words than that. Words are counted piece by piece of the texts before they are shuffled."""
    counted = df.select(_lower(df, column, limit).alias("text")).mapInArrow(_count_words, "token string, n long")
    counts = counted.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    ranked = numbered(counts, [-F.col("n"), F.col("token")], "id").withColumn("id", F.col("id") + 2)
    return ranked.where(F.col("id") < size) if size else ranked


def encode_text(df: DataFrame, column: str, words: dict[str, int], length: int, limit: int | None = None) -> DataFrame:
    """Adds ``<column>_ids`` of a fixed length: unknown words 1, numbers 2, padding 0. For vocabularies that a model holds;
    see ``encode_whole_text`` for others."""
    table = F.create_map(F.lit("<NUM>"), F.lit(2), *[F.lit(x) for pair in words.items() for x in pair])
    ids = F.transform(F.slice(text_tokens(_col(column), limit, limit), 1, length), lambda t: F.coalesce(F.try_element_at(table, t), F.lit(1)))
    return df.withColumn(f"{column}_ids", F.concat(ids, F.array_repeat(F.lit(0), F.lit(length) - F.size(ids))))


def _block_words(block: pa.Table) -> pa.Table:
    """``block, token``: the distinct words of a block's texts, without numbers."""
    found = [pc.unique(words) for words, _ in word_pieces(block["text"])]
    words = pa.chunked_array(found, pa.large_string()).unique()
    words = words.filter(pc.invert(all_digits(words))).cast(pa.string())
    return pa.table({"block": pa.repeat(block["block"][0], len(words)), "token": words})


def _block_ids(names: list[str]):
    """A block's rows with the ids of their words, from its known words."""

    def encode(known: pa.Table, block: pa.Table) -> pa.Table:
        tokens, ids = known["token"].combine_chunks().cast(pa.large_string()), known["id"].to_numpy()
        found = []
        for words, counts in word_pieces(block["text"]):
            coded = words.dictionary_encode()
            own = np.where(all_digits(coded.dictionary).to_numpy(zero_copy_only=False), 2, 1)
            at = pc.index_in(coded.dictionary, tokens)
            hit = at.is_valid().to_numpy(zero_copy_only=False)
            own[hit] = ids[at.drop_null().to_numpy()]
            ends = np.append(0, np.cumsum(counts)).astype(np.int32)
            found.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(own[coded.indices.to_numpy()], pa.int64())))
        made = pa.chunked_array(found, pa.list_(pa.int64()))
        return pa.table([*[block[f"k{i}"] for i in range(len(names) - 1)], made], names=names)

    return encode


def encode_whole_text(df: DataFrame, keys: list[str], column: str, words: DataFrame, size: int = 1 << 24) -> DataFrame:
    """``keys..., <column>_ids`` of every word of each text, unknown words 1 and numbers 2, by a join with all of
    ``vocabulary``.

    Rows are dealt by a hash into blocks of about ``size`` bytes of text at most, which a task holds; their number is found
    when this is called. The distinct words of each block meet the vocabulary, so that a frequent word is one row of a block,
    and each block's texts are encoded with the words it knows. Rows with equal keys and texts fall into the same block."""
    names = [*keys, f"{column}_ids"]
    total = df.agg(F.sum(F.octet_length(_col(column).cast("string")))).first()[0] or 0
    blocks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-total // min(max(total // blocks, size // 4, 1), size)))
    told = [_sortable(f) for f in df.select(*[_col(k) for k in keys]).schema if not isinstance(f.dataType, T.UserDefinedType)]
    block = F.pmod(F.xxhash64(*told, _col(column)), F.lit(blocks))
    rows = df.select(block.alias("block"), _lower(df, column).alias("text"), *[_col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    rows = rows.repartition(blocks, "block").groupBy("block")  # a stated number, which is not coalesced
    own = rows.applyInArrow(_block_words, "block long, token string")
    known = own.join(words.select("token", "id"), "token").select("block", "token", F.col("id").cast("long").alias("id"))
    schema = T.StructType([*df.select(*[_col(k) for k in keys]).schema, T.StructField(names[-1], T.ArrayType(T.LongType()))])
    return known.groupBy("block").cogroup(rows).applyInArrow(_block_ids(names), schema)


def fit_preprocessor(df: DataFrame, numeric: list[str], categorical: list[str], text: list[str], order: str, words: int = 10_000) -> Preprocessor:
    """Edges, the ids of categorical columns (which have few values by their class), and at most ``words`` words."""
    ids = {c: {r.value: r.id for r in category_ids(df, c, order).collect()} for c in categorical}
    found: dict[str, int] = {}
    if text:
        joined = df.select(F.concat_ws(" ", *[_col(c) for c in text]).alias("t"))
        found = {r.token: r.id for r in vocabulary(joined, "t", size=words).collect()}
    return Preprocessor(quantile_edges(df, numeric) if numeric else {}, ids, found)


def fit_tables(tables: Mapping[str, DataFrame], kinds: Mapping[str, Mapping[str, str]], order: Mapping[str, str], words: int = 10_000) -> dict[str, Preprocessor]:
    """A preprocessor for each table, by the kinds of its columns (``numerical``, ``categorical``, ``text``); ``order`` names
    the column by which a table's values appear. Edges and ids are of each column, the vocabulary is of all texts of all
    tables together."""
    of = lambda table, kind: [c for c in tables[table].columns if kinds[table].get(c) == kind]
    columns = [df.select(_col(c).alias("t")) for table, df in tables.items() for c in of(table, "text")]
    found: dict[str, int] = {}
    if columns:
        found = {r.token: r.id for r in vocabulary(reduce(DataFrame.union, columns), "t", size=words).collect()}
    fitted = {t: fit_preprocessor(df, of(t, "numerical"), of(t, "categorical"), [], order[t]) for t, df in tables.items()}
    return {t: replace(f, vocabulary=found) for t, f in fitted.items()}


def save_preprocessors(spark: SparkSession, fitted: Mapping[str, Preprocessor], path: str) -> None:
    """One row of JSON for each table."""
    rows = [(name, json.dumps(asdict(f))) for name, f in fitted.items()]
    spark.createDataFrame(rows, "table_id string, fitted string").coalesce(1).write.mode("overwrite").parquet(path)


def load_preprocessors(spark: SparkSession, path: str) -> dict[str, Preprocessor]:
    return {r.table_id: Preprocessor(**json.loads(r.fitted)) for r in spark.read.parquet(path).collect()}


def apply_preprocessor(df: DataFrame, fitted: Preprocessor, text: list[str] = (), length: int = 32) -> DataFrame:
    for c, edges in fitted.edges.items():
        df = df.withColumn(c, bin_column(_col(c), edges))
    for c, ids in fitted.categories.items():
        table = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair]) if ids else None
        df = df.withColumn(c, F.coalesce(F.try_element_at(table, _col(c).cast("string")), F.lit(0)) if ids else F.lit(0))
    for c in text:
        df = encode_text(df, c, fitted.vocabulary, length)
    return df
