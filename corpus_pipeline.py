"""From raw documents to token ids: language, repeated lines, near-duplicates, source mix, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joinwright.llm.bpe import BpeCodec
from joinwright.llm.lang_id import fit_lang_model, predict_languages
from joinwright.llm.line_dedup import LineDedupParams, dedup_lines
from joinwright.llm.mixing import MixParams, mix_documents
from joinwright.llm.near_dedup import NearDupParams, near_duplicates
from joinwright.llm.storage import materialise, rows_by_id, text_batches

#: Of texts with at least so many words, the share of them that the language model must know.
LEAST_WORDS, LEAST_KNOWN = 5, 0.05


def _placed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns named by place, so that no column of a result can meet one of theirs, and these names."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _named(docs: DataFrame, names: dict[str, str], **made: Column) -> DataFrame:
    return docs.select(*[made.get(c, F.col(place)).alias(c) for c, place in names.items()])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts too), and those of several words of which next to none are
    words of any learned language; short texts whose languages tie stay. Repeated rows go or stay together. Very long
    texts are judged whole, an empty table gives an empty one, and columns of any name stay as they are."""
    text_batches(spark)
    placed, names = _placed(docs)
    text = names["text"]
    model = fit_lang_model(placed, id_col=names["doc_id"], text_col=text, lang_col=names["lang"])
    found = predict_languages(placed, model, placed.columns, text, known_col="known")
    strange = (F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")) >= LEAST_WORDS) & (F.col("known") < LEAST_KNOWN)
    return _named(found.where((F.col("lang_pred") != "und") & ~strange), names)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least ten documents have stay in the first of them only. Documents that lose all their words go;
    ``n_chars`` follows the text. Repeated rows are one document, so none of their lines is lost. Null texts are one empty
    line and stay, very long texts are handled whole, an empty table gives an empty one, and columns of any name stay."""
    text_batches(spark)
    placed, names = _placed(docs)
    kept = dedup_lines(placed, LineDedupParams(min_docs=10, min_chars=1, keep="first"), placed.columns, names["doc_id"], names["text"])
    left = (F.col("n_dropped") == 0) | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]")
    return _named(kept.where(left), names, text=F.col("kept_text"), n_chars=F.length("kept_text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id. Of rows that repeat an id and its
    text one stays; rows without words, or without an id, stay. Very long texts are compared whole, an empty table gives
    an empty one, and columns of any name stay as they are."""
    text_batches(spark)
    placed, names = _placed(docs)
    own, text = names["doc_id"], names["text"]
    found = materialise(near_duplicates(placed, NearDupParams(shingle=5, percent=80), own, text), "near_duplicates")
    kept = rows_by_id(placed, found.where("not kept"), own, having=False)
    if not found.where(F.col(own).isNotNull()).groupBy(own).count().where("count > 1").isEmpty():  # rows that repeat an id and its text
        known = kept.where(F.col(own).isNotNull()).withColumn("same", F.xxhash64(text)).dropDuplicates([own, "same"]).drop("same")
        kept = known.union(kept.where(F.col(own).isNull()))
    return _named(kept, names)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them; equal ids, so also repeated rows, are taken together. Null sources
    are a source; texts without words are taken with whole copies only. Texts of any length are carried whole, an empty
    table gives an empty one, and columns of any name stay as they are."""
    return mix_documents(docs, MixParams(weights=(5, 2, 1), cap=3))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, ids, n_tokens``; copies next to each other are encoded once. Null and empty texts have no
    ids, very long ones are encoded whole, an empty table gives an empty one, and other columns are left out."""
    text_batches(spark)
    codec = BpeCodec(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return codec.encode(docs, ["doc_id", "lang", "source"]).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources", source_mixing),
    ("BPE encoding", bpe_encoding),
]

#: Languages, near-duplicates and token ids cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. The tables between stages stay in the shared folder until ``storage.release``, which the
    caller may call once the rows are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
