"""The search against plain scores of all documents, and on nulls, empty and long texts, ties, repeated rows and odd names."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import ascii_lower

from joinwright.llm import block_index
from joinwright.llm.block_index import IndexParams


def terms(text):
    return re.findall(block_index.TERM, ascii_lower(text or ""))


def brute(docs, items, k):
    counted = [(i, collections.Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counted), sum(c.total() for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    out = set()
    asked = collections.defaultdict(list)
    for item, text in items:
        asked[item] += terms(text)
    for item, own in asked.items():
        found = []
        for i, c in counted:
            m = 75 + 25 * c.total() * n_docs // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in own if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out |= {(item, rank, None if none else i, -score) for rank, (score, none, i) in enumerate(sorted(found)[:k], 1)}
    return out


@pytest.fixture(scope="module")
def docs():
    make = random.Random(3)
    vocabulary = ["".join(make.choice("abcXYé漢𝒳7") for _ in range(make.randint(1, 5))) for _ in range(300)]
    weights = [1 / (1 + i) for i in range(300)]
    ids = make.sample(range(10_000), 700)
    rows = [(i, make.choice([" ", "_", "\n. ", "\x00"]).join(make.choices(vocabulary, weights, k=make.randint(0, 60)))) for i in ids]
    rows += [rows[5]] * 3 + [(20_000 + i, rows[6][1]) for i in range(30)]  # repeated rows, and texts that tie
    rows += [(30_000, None), (30_001, ""), (30_002, "., _"), (None, vocabulary[0]), (None, rows[6][1]), (30_003, "long " * 70_000 + "Tail " * 300 + vocabulary[1]), (30_004, "� " + "q" * 90_000)]
    return rows


@pytest.fixture(scope="module")
def items(docs):
    texts = [docs[6][1], docs[9][1] + " " + docs[10][1], "tail TAIL long", docs[20][1].upper(), "nowhere", "", None, "a b c 7 é É", "q" * 90_000]
    return [*enumerate(texts), (0, "tail"), (None, docs[30][1])]


PARAMS = [IndexParams(), IndexParams(block=4, segment=500, window=16), IndexParams(block=1, segment=1, window=3, chunk=20), IndexParams(block=16, segment=4000, window=64, chunk=40)]


@pytest.mark.parametrize("params", PARAMS)
def test_against_plain_scores(spark, docs, items, params):
    clash = {c: F.lit("mine") for c in ("term", "segment", "ids", "norms", "score", "rank", "item", "n", "first")}
    corpus = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumns(clash)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns(clash)
    found = [(r.item_id, r["rank"], r.doc_id, r.score) for r in block_index.search(corpus, asked, 7, params).collect()]
    assert collections.Counter(found) == collections.Counter(brute(docs, items, 7))


def test_whole_terms_of_a_batch(docs):
    import pyarrow as pa

    data, offsets = block_index.string_buffers(pa.array([t for _, t in docs]))
    found, counts = block_index.terms_of(data, offsets)
    assert counts.tolist() == [len(terms(t)) for _, t in docs] and found.to_pylist() == [x for _, t in docs for x in terms(t)]


def test_blocks_are_skipped_before_they_are_decompressed():
    import pyarrow as pa

    def lists(blocks):
        schema = pa.schema([f for f in block_index._ARROW if f.name in ("first", "last", "n", "most", "widths", "payload")])
        return block_index._Postings(pa.Table.from_pylist([dict(zip(schema.names, b)) for b in blocks], schema))

    norms = np.full(64, 75)
    block = lambda first, tf: (first, first + 3, 4, int(block_index.impacts(np.array(max(tf)), np.array(75))), 17, bytes([0, 1, 1, 1]) + bytes(tf))
    rare, common = lists([block(0, [9, 9, 9, 9])]), lists([block(i, [1, 1, 1, 1]) for i in range(0, 64, 4)])
    opened = set()
    best = block_index.best_of_segment([(rare, 5000), (common, 10)], norms, 2, 4, opened)
    assert [number for _, number in best] == [0, 1] and opened == {(0, 0), (1, 0)}  # the other 15 blocks stay closed
    assert len(common.open) == 1


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    asked = lambda df: df.withColumnRenamed("doc_id", "item_id")
    assert block_index.search(none, asked(one)).collect() == [] and block_index.search(one, asked(none)).collect() == []
    assert [tuple(r) for r in block_index.search(one, asked(one)).collect()] == [tuple(x) for x in brute([(1, "a b")], [(1, "a b")], 20)]
