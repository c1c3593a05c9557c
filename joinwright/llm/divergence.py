"""How the sources of a language differ in the words they use, with relational operations alone.

Terms are exploded from the texts and counted by (language, source); the groups of a language are crossed with the terms
that it keeps, so that absent terms have a count of zero; that table is joined with itself on language and term, the
terms' differences are summed, and windows rank them. All arithmetic is in integers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .storage import materialise, partitions, small

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Terms are maximal runs of ASCII letters and of all characters that are not ASCII, and these stand between them.
TERM, BETWEEN = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class AuditParams:
    """A language keeps the terms that at least ``min_docs`` of its documents have; the best ``top`` terms of a group are
    reported; shares are in units of 1 / ``scale``, and every count is raised by ``prior``."""

    min_docs: int = 10
    top: int = 10
    scale: int = 1_000_000_000
    prior: int = 2


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``(lang, source, term, n, docs)``: how often the group's texts have the term, and how many of its rows. A row's
    terms are sorted, so that the first of equal ones counts the row, and no row has to be told from another. The texts
    are split where no term is, which gives the matches of ``TERM`` and takes time in proportion to a text's length;
    ``regexp_extract_all`` copies the whole text for each match."""
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), _UPPER, _UPPER.lower())
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    terms = docs.select(name(lang_col).alias("lang"), name(source_col).alias("source"), F.sort_array(F.split(text, BETWEEN)).alias("terms"))
    pairs = F.arrays_zip(F.col("terms").alias("term"), F.concat(F.array(F.lit("")), "terms").alias("before"))
    found = terms.select("lang", "source", F.inline(pairs)).where("term <> ''")
    return found.groupBy("lang", "source", "term").agg(F.count("*").alias("n"), F.sum((F.col("term") != F.col("before")).cast("long")).alias("docs"))


def _share(params: AuditParams, count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(scale * (count + prior) / (total + prior * kept)), exact at any size of the counts."""
    whole = lambda x: x.cast("decimal(19,0)")
    top = F.lit(params.scale).cast("decimal(10,0)") * whole(count + params.prior)
    return F.call_function("div", top, whole(total + params.prior * kept)) + 1


def _difference(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)); both are at most a little over ``scale``, so that the square fits."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _crossed(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """Each language's groups with each of its kept terms. Groups are broadcast if they are few; else both sides are dealt
    out over salts of the language, as one language may hold most terms."""
    sent = small(groups)
    if sent is not groups:
        return kept.join(sent, "lang")
    salts = partitions(kept.sparkSession)
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int"))
    return salted.join(groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["lang", "salt"]).drop("salt")


def source_divergence(docs: DataFrame, params: AuditParams = AuditParams(), text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``(lang, source, part, item, value, rank)``. Part ``pair``: each other source of the language, with the sum of
    floor((p - q)^2 / (p + q)) over the kept terms, p and q being the two groups' shares of a term (0 if the language
    keeps no term). Part ``term``: the ``top`` terms that the group has and uses more than its language does.

    Null texts, languages and sources are empty ones; a group whose texts are empty or have no term still gives each kept
    term the share of a count of zero. Each row is a document, so repeated rows count each; a text of any length is
    counted whole; other columns are ignored, whatever their names; equal values are ranked by item in the order of its
    UTF-8 bytes; an empty table gives an empty result.
    """
    name = lambda c, as_: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(as_)
    groups = materialise(docs.select(name(lang_col, "lang"), name(source_col, "source")).distinct(), "groups")
    counts = materialise(term_counts(docs, text_col, lang_col, source_col), "term_counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= params.min_docs)
    kept = materialise(kept.drop("docs"), "kept_terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))

    dense = _crossed(kept, groups).join(counts.drop("docs"), ["lang", "source", "term"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    dense = materialise(dense.select("lang", "source", "term", "n", "lang_n"), "dense")
    totals = dense.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    known = small(totals.join(langs, "lang"))
    shares = dense.join(known, ["lang", "source"])
    shares = shares.select("lang", "source", "term", "n", _share(params, F.col("n"), F.col("total"), F.col("kept")).alias("p"), _share(params, F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q"))

    one, other = (shares.select("lang", "term", F.col("source").alias(s), F.col("p").alias(v)) for s, v in (("source", "p"), ("item", "q")))
    summed = one.join(other, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(_difference("p", "q")).alias("value"))
    both = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    summed = summed.select("lang", F.explode(both).alias("of"), "value").select("lang", "of.*", "value")
    bare = groups.join(langs, "lang", "left_anti")  # languages that keep no term
    bare = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    best = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = summed.unionByName(bare.select(*summed.columns)).withColumn("rank", F.row_number().over(best))

    typical = shares.where("n > 0 and p > q").select("lang", "source", F.col("term").alias("item"), _difference("p", "q").alias("value"))
    typical = typical.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= params.top)
    shown = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return shown(pairs, "pair").union(shown(typical, "term"))
