"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

A source's target is its share of all words by weight, at most ``cap`` times its own words; what is above goes to
the other sources by weight. Every document of a source is taken ``floor(target / source words)`` times for certain.
For the rest, documents get inclusion probabilities proportional to a power of their size, at most 1, that make up
the missing words in expectation. They are ranked by the odds of a uniform random number (from a hash of the
id) over their inclusion odds, and taken in that order up to the missing words, ending at whichever document
comes nearest.

The place where a source's order is cut is found by two rounds of sums over 4,096 bins of the rank, and one exact
pass over the documents in the last bin. No source is ever sorted or collected as a whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .storage import materialise

#: A table of one row for each source is broadcast up to this many sources and bytes of their names, and joined by a
#: shuffle beyond.
SOURCES, NAME_BYTES = 100_000, 16 << 20
BINS = 4096


@dataclass(frozen=True)
class MixParams:
    """``weights`` repeat over the sources in code point order, null last. ``tilt``: 0 gives each document of a source
    the same chance of its last copy, 1 a chance proportional to its size."""

    weights: tuple[float, ...] = (5, 2, 1)
    cap: int = 3
    tilt: float = 0.5
    seed: int = 1


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def filled(df: DataFrame, parts: list[str], weight: str, cap: str, total: str, order: Column) -> DataFrame:
    """Adds ``level``: with it, ``least(cap, level * weight)`` adds up to ``total`` in each part. ``order`` sorts by
    ``cap / weight``, smallest first; it is null where even all caps together are less than the total."""
    ordered = W.partitionBy(*parts).orderBy(order)
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    left = F.col(total) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    rest = F.sum(weight).over(ordered.rowsBetween(0, W.unboundedFollowing))
    level = F.try_divide(left, rest)
    df = df.withColumn("__level", level).withColumn("__free", F.col("__level") * F.col(weight) <= F.col(cap))
    first = F.min(F.when(F.col("__free"), F.struct(F.try_divide(F.col(cap), F.col(weight)).alias("at"), F.col("__level").alias("level"))))
    return df.withColumn("level", first.over(W.partitionBy(*parts)).getField("level")).drop("__level", "__free")


def _with_sources(docs: DataFrame, sources: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    sources = sources.select(F.col("source").alias("__source"), *columns)
    size = sources.agg(F.count("*").alias("n"), F.sum(F.octet_length("__source")).alias("bytes")).first()
    if size.n <= SOURCES and (size.bytes or 0) <= NAME_BYTES:
        sources = F.broadcast(sources)
    return docs.join(sources, docs["__s"].eqNullSafe(sources["__source"]), how).drop("__source")


def _ranked(docs: DataFrame, params: MixParams) -> DataFrame:
    """Adds ``__pi``, the inclusion probability, and the rank: (``__z``, ``__h``), where ``__z`` is q / (1 + q) for the
    ratio q of the odds."""
    uniform = (F.conv(F.substring("__h", 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    pi = F.when((F.col("__size") > 0) & F.col("level").isNotNull(), F.least(F.lit(1.0), F.col("level") * F.pow(F.col("__size").cast("double"), F.lit(params.tilt)))).otherwise(0.0)
    docs = docs.withColumn("__pi", F.coalesce(pi, F.lit(0.0))).withColumn("__u", uniform)
    a, b = F.col("__u") * (1 - F.col("__pi")), (1 - F.col("__u")) * F.col("__pi")
    return docs.withColumn("__z", F.try_divide(a, a + b))


def _prepared(docs: DataFrame, params: MixParams, id_col: str, text_col: str, source_col: str) -> DataFrame:
    ids = F.md5(F.concat(F.lit(f"{params.seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return docs.withColumns({"__s": F.col(source_col), "__size": words(F.col(text_col)), "__h": ids})


def mix_plan(docs: DataFrame, params: MixParams = MixParams(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """One row for each source, with its words, target, whole copies, and where its order is cut; and the table of
    sizes ``(__id, __s, __size, __h)`` that it was made from."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    sized = _prepared(docs, params, "id", "text", "source").select(F.col("id").alias("__id"), "__s", "__size", "__h")
    sized = materialise(sized, "sizes")
    histogram = materialise(sized.groupBy("__s", "__size").agg(F.count("*").alias("n")), "histogram")

    sources = histogram.groupBy(F.col("__s").alias("source")).agg(F.sum(F.col("n") * F.col("__size")).alias("source_size"))
    position = F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1
    weights = F.array(*[F.lit(float(w)) for w in params.weights])
    sources = sources.withColumn("weight", F.element_at(weights, (position % len(params.weights) + 1).cast("int")))
    sources = sources.withColumn("total", F.sum("source_size").over(W.partitionBy()).cast("double"))
    sources = sources.withColumn("most", (F.col("source_size") * params.cap).cast("double"))
    sources = filled(sources, [], "weight", "most", "total", F.asc(F.col("most") / F.col("weight")))
    target = F.least(F.col("most"), F.coalesce(F.col("level") * F.col("weight"), F.col("most")))
    sources = sources.withColumn("target", target).drop("level", "weight", "total", "most")
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")
    sources = sources.withColumn("whole", whole).withColumn("missing", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    sources = materialise(sources, "sources")

    sizes = _with_sources(histogram, sources, ["missing"]).where("__size > 0 and missing > 0")
    sizes = sizes.withColumn("weight", F.col("n") * F.pow(F.col("__size").cast("double"), F.lit(1 + params.tilt))).withColumn("most", (F.col("n") * F.col("__size")).cast("double"))
    sizes = filled(sizes, ["__s"], "weight", "most", "missing", F.desc("__size"))
    levels = sizes.groupBy(F.col("__s").alias("source")).agg(F.max("level").alias("level"))
    levels = materialise(levels, "levels")

    sampled = _ranked(_with_sources(sized, levels, ["level"]), params).where("__pi > 0")
    certain = sampled.where("__pi >= 1").groupBy("__s").agg(F.sum("__size").alias("certain"))
    plan = sources.join(levels, sources["source"].eqNullSafe(levels["source"]), "left").drop(levels["source"])
    plan = plan.join(certain, plan["source"].eqNullSafe(certain["__s"]), "left").drop("__s")
    plan = materialise(plan.withColumn("missing", F.col("missing") - F.coalesce("certain", F.lit(0))).drop("certain"), "plan")

    # The bin, then the part of that bin, in which the sum of the sizes reaches the missing words.
    edges = plan.select("source", "missing", F.lit(0).cast("long").alias("before"))
    ranked = materialise(sampled.where("__pi < 1").select("__s", "__size", "__h", "__z"), "ranked")
    bins = {"first": F.floor(F.col("__z") * BINS), "second": F.pmod(F.floor(F.col("__z") * BINS * BINS), F.lit(BINS))}
    for name, bin_ in bins.items():
        within = _with_sources(ranked, edges, [c for c in edges.columns if c != "source"]).withColumn("bin", bin_)
        if name == "second":
            within = within.where(bins["first"] == F.col("first"))
        carried = ["missing", "before", *(["first"] if name == "second" else [])]
        sums = within.groupBy("__s", "bin", *carried).agg(F.sum("__size").alias("n"))
        upto = F.sum("n").over(W.partitionBy("__s").orderBy("bin"))
        sums = sums.withColumn("upto", F.col("before") + upto).where(F.col("upto") > F.col("missing"))
        found = sums.groupBy("__s").agg(F.min_by(F.struct("bin", "upto", "n", *carried), "bin").alias("x"))
        edges = found.select(F.col("__s").alias("source"), "x.missing", (F.col("x.upto") - F.col("x.n")).alias("before"), F.col("x.bin").alias(name), *(["x.first"] if name == "second" else []))
        edges = materialise(edges, "edges")
    last = _with_sources(ranked, edges, ["missing", "before", "first", "second"]).where((bins["first"] == F.col("first")) & (bins["second"] == F.col("second")))
    upto = F.col("before") + F.sum("__size").over(W.partitionBy("__s").orderBy("__z", "__h"))
    last = last.withColumn("upto", upto).where(F.col("upto") > F.col("missing"))
    ends = last.groupBy("__s").agg(F.min(F.struct("__z", "__h", "upto", "__size", "missing")).alias("x"))
    near = F.col("x.upto") - F.col("x.missing") < F.col("x.missing") - (F.col("x.upto") - F.col("x.__size"))
    ends = ends.select("__s", F.col("x.__z").alias("cut_z"), F.col("x.__h").alias("cut_h"), near.alias("cut_in"))
    plan = plan.join(ends, plan["source"].eqNullSafe(ends["__s"]), "left").drop("__s", "missing")
    return materialise(plan, "plan"), sized


def _taken(docs: DataFrame, plan: DataFrame, params: MixParams) -> DataFrame:
    docs = _ranked(_with_sources(docs, plan, ["source_size", "target", "whole", "level", "cut_z", "cut_h", "cut_in"], "left"), params)
    here, cut = F.struct("__z", "__h"), F.struct(F.col("cut_z").alias("__z"), F.col("cut_h").alias("__h"))
    inside = F.when(F.col("__pi") >= 1, True).when(F.col("__pi") <= 0, False).when(F.col("cut_z").isNull(), True)
    inside = inside.otherwise((here < cut) | ((here == cut) & F.col("cut_in")))
    return docs.withColumn("copies", F.coalesce(F.col("whole") + inside.cast("long"), F.lit(0).cast("long")))


def mix_table(docs: DataFrame, params: MixParams = MixParams(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """For each row of ``docs``: ``id_col``, ``size`` (words; null text: 0), ``source_size``, ``target`` (its source's) and
    ``taken`` (size times copies). A null source is a source; null and empty texts have size 0 and are never taken but
    with whole copies, which add no words. Equal ids, so also repeated rows and null ids, rank alike and are taken
    together; an empty table gives an empty result; other columns are ignored, whatever their names."""
    plan, sized = mix_plan(docs, params, id_col, text_col, source_col)
    taken = _taken(sized, plan, params)
    return taken.select(F.col("__id").alias(id_col), F.col("__size").alias("size"), "source_size", "target", (F.col("__size") * F.col("copies")).alias("taken"))


def mix_documents(docs: DataFrame, params: MixParams = MixParams(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs``, each row repeated as often as the mix takes it, copies next to each other. The texts are not shuffled.
    Null texts and sources, repeated rows, ids that tie and empty tables are as in :func:`mix_table`; columns may have
    any name, as the rows are carried by place."""
    plan, _ = mix_plan(docs, params, id_col, text_col, source_col)
    whole = docs.select(F.struct(*[docs[f"`{c}`"].alias(str(i)) for i, c in enumerate(docs.columns)]).alias("__row"))
    of = lambda c: F.col("__row")[str(docs.columns.index(c))].alias(c)
    named = whole.select("__row", *[of(c).alias(x) for c, x in ((id_col, "__i"), (text_col, "__t"), (source_col, "__o"))])
    taken = _taken(_prepared(named, params, "__i", "__t", "__o"), plan, params).where("copies > 0")
    copies = taken.select("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return copies.select(*[F.col("__row")[str(i)].alias(c) for i, c in enumerate(docs.columns)])
