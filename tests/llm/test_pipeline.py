"""The stages of the corpus pipeline, each on what its predecessor kept."""

import collections
import random

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F
from test_llm import ascii_lower, brute_components, brute_language, words

from joinwright.llm import lang_id, oracle
from joinwright.llm.storage import materialise

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus():
    """Texts of two languages and of neither, repeated lines, exact and near copies, a null source, and odd ones."""
    make = random.Random(31)
    vocabulary = {k: ["".join(make.choice(x) for _ in range(make.randint(2, 6))) for _ in range(60)] for k, x in {"xx": "abcdefg", "yy": "fghijkl"}.items()}
    sentence = lambda k, n: " ".join(make.choice(vocabulary[k]) for _ in range(n))
    rows = []
    for i in range(70):
        k = "xx" if i % 3 else "yy"
        text = sentence(k, make.randint(12, 40)) + ("\n Shared Line of words " if i % 4 == 0 else "") + "\n" + sentence(k, 10)
        rows.append([i, text, k, ["a", "b", None][i % 3], len(text)])
    for i, of in enumerate((3, 3, 5, 10)):  # exact copies, and near ones that differ in their last word
        rows.append([100 + i, rows[of][1] + (" end" if i % 2 else ""), rows[of][2], "a", 0])
    strange = [(200, None), (201, ""), (202, "12 34 !"), (203, "ωω ψψ χχ φφ υυ ττ"), (204, "shared line of words"), (205, sentence("xx", 20_000))]
    return [tuple(r) for r in rows] + [(i, t, None, "b", 0) for i, t in strange]


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    extra = spark.createDataFrame([(10_001, None, "en", "src0", 0), (10_002, "12 34", "en", "src1", 5)], docs.schema)
    whole = docs.union(extra)
    kept = []
    now = whole
    for name, stage in corpus_pipeline.STAGES:
        now = materialise(stage(spark, now, data), "stage")
        kept.append(now)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == docs.columns
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    assert ids[0] == {r.doc_id for r in docs.select("doc_id").collect()}
    assert ids[0] >= ids[1] >= ids[2] >= ids[3] == ids[4]
    assert kept[2].count() == len(ids[2]) < len(ids[1])
    assert kept[1].where(F.length("text") != F.col("n_chars")).count() == 0
    assert kept[3].count() == kept[4].count() and kept[4].where("size(ids) <> n_tokens or n_tokens = 0").count() == 0


def test_run_against_a_plain_version(spark, corpus, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    spark.createDataFrame(corpus, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()

    said = brute_language([(i, t, lang) for i, t, lang, *_ in corpus], lang_id.LangIdParams(), [r[1] for r in corpus])
    rows = [list(r) for r, (lang, _, known) in zip(corpus, said) if lang != "und" and not (len(words(r[1])) >= 5 and known < 0.05)]
    assert {r[0] for r in corpus} - {r[0] for r in rows} == {200, 201, 202, 203}

    key = lambda line: ascii_lower(line.strip(" \t\n\v\f\r"))
    first, n = {}, collections.Counter()
    for i, text, *_ in sorted(rows, key=lambda r: r[0]):
        for k in {key(x) for x in text.split("\n")} - {""}:
            first.setdefault(k, i)
            n[k] += 1
    kept = []
    for i, text, lang, source, _ in rows:
        lines = text.split("\n")
        left = [x for x in lines if n[key(x)] < 10 or first[key(x)] == i]
        if len(left) == len(lines) or words("\n".join(left)):
            kept.append((i, "\n".join(left), lang, source))
    assert {r[0] for r in rows} - {r[0] for r in kept} == {204}

    kept.sort(key=lambda r: r[0])
    _, label = brute_components([r[1] for r in kept], 5, 80)
    single = [r for j, r in enumerate(kept) if label[j] == j]
    assert {100, 101, 102, 103}.isdisjoint({r[0] for r in single})

    spark.createDataFrame(single, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/single")
    taken = duckdb.sql(oracle.MIXING.replace("FROM documents", f"FROM '{tmp_path}/single/*.parquet'")).df()
    copies = {int(i): round(t / s) if s else 0 for i, s, t in zip(taken.doc_id, taken["size"], taken.taken)}

    encode = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    expected = collections.Counter()
    for i, text, lang, source in single:
        ids = encode(text, add_special_tokens=False).ids
        expected[i, lang, source, tuple(ids), len(ids)] += copies[i]
    assert collections.Counter((r.doc_id, r.lang, r.source, tuple(r.ids), r.n_tokens) for r in found) == +expected


def test_stages_carry_every_column(spark, corpus, data):
    """Names that results have, repeated rows, rows without an id, and a table without rows."""
    own = ("score", "lang_pred", "known", "n_lines", "n_dropped", "kept_text", "__same", "same", "component_id", "kept", "size", "copies", "c0", "id")
    docs = spark.createDataFrame(corpus + [corpus[0], corpus[0], (None, *corpus[7][1:]), (None, *corpus[7][1:])], SCHEMA).withColumns({c: F.concat(F.lit(f"{c} "), F.col("text")) for c in own})
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, data)
        assert left.columns == docs.columns
        rows = left.collect()
        assert rows and all(r[c] == before[r.doc_id][c] for r in rows for c in own), name
        n = collections.Counter(r.doc_id for r in rows)
        if name == "MinHash near-dedup":
            assert n[0] == 1 and n[None] == 2
        elif name != "mixing sources":
            assert n[0] == 3 and n[None] == 2
        nothing = stage(spark, docs.where("doc_id < 0"), data)
        assert nothing.columns == docs.columns and nothing.collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("doc_id < 0"), data).collect() == []


def test_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
