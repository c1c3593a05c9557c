"""The audit of sources against plain Python, and on nulls, empty and long texts, ties, repeated rows and odd names."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F
from test_llm import ascii_lower

from joinwright.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"


def brute(rows, params):
    terms = [(lang or "", source or "", re.findall(divergence.TERM, ascii_lower(text or ""))) for _, text, lang, source in rows]
    groups = sorted({(a, b) for a, b, _ in terms})
    docs, counts, totals = collections.Counter(), collections.Counter(), collections.Counter()
    for lang, source, own in terms:
        docs.update((lang, t) for t in set(own))
        counts.update((lang, source, t) for t in own)
        totals.update((lang, t) for t in own)
    out = set()
    share = lambda c, n, v: 1 + params.scale * (c + params.prior) // (n + params.prior * v)
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {a for a, _ in groups}:
        kept = sorted(t for (a, t), n in docs.items() if a == lang and n >= params.min_docs)
        sources = [b for a, b in groups if a == lang]
        n = {s: sum(counts[lang, s, t] for t in kept) for s in sources}
        p = {s: {t: share(counts[lang, s, t], n[s], len(kept)) for t in kept} for s in sources}
        q = {t: share(totals[lang, t], sum(totals[lang, x] for x in kept), len(kept)) for t in kept}
        for s in sources:
            pair = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            term = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s, t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, len(pair)), ("term", term, params.top)):
                for rank, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


@pytest.fixture(scope="module")
def rows():
    make = random.Random(5)
    vocabulary = ["".join(make.choice("abcdeÉé漢𝒳Z") for _ in range(make.randint(1, 4))) for _ in range(50)]
    found = []
    for i in range(120):
        own = make.choices(vocabulary, [1 + (j % 7 == i % 7) * 5 for j in range(50)], k=make.randint(0, 30))
        found.append((i, make.choice([" ", "1", "_\n"]).join(own), ["xx", "yy", None][i % 3], ["s1", "s2", None, "é", "Z"][i % 5]))
    found += [found[3]] * 3 + [(200, None, "xx", "bare"), (201, "", "xx", "empty"), (202, "12 34", "yy", "digits"), (203, "rare", "zz", "a"), (204, "other", "zz", "b"), (205, None, None, None)]
    return found + [(300, "a " * 60_000 + "Long", "xx", "s1"), (None, "É é", "yy", "s2")]


@pytest.mark.parametrize("sent", [True, False])
def test_against_plain_counts(spark, rows, sent, monkeypatch):
    if not sent:  # groups that are too many to send
        monkeypatch.setattr(divergence, "small", lambda df: df)
    clash = {c: F.lit("mine") for c in ("term", "terms", "n", "p", "q", "item", "value", "before", "kept")}
    docs = spark.createDataFrame(rows, SCHEMA).withColumns(clash)
    for params in (divergence.AuditParams(min_docs=5), divergence.AuditParams(min_docs=2, top=3)):
        found = [tuple(r) for r in divergence.source_divergence(docs, params).collect()]
        assert len(found) == len(set(found)) and set(found) == brute(rows, params)
    assert any(x[0] == "zz" and x[2] == "pair" and x[4] == 0 for x in brute(rows, divergence.AuditParams(min_docs=5)))


def test_counts_beyond_64_bits_and_empty_tables(spark):
    big = spark.createDataFrame([(4 * 10**15, 9 * 10**15, 3)], "c long, n long, v long")
    found = big.select(divergence._share(divergence.AuditParams(), F.col("c"), F.col("n"), F.col("v")).alias("p")).first().p
    assert found == 1 + 10**9 * (4 * 10**15 + 2) // (9 * 10**15 + 6)
    none = spark.createDataFrame([], SCHEMA)
    assert divergence.source_divergence(none).collect() == []
    renamed = spark.createDataFrame([(1, "a b", "xx", "s")], "doc_id long, body string, tongue string, origin string")
    assert divergence.source_divergence(renamed, divergence.AuditParams(min_docs=1), "body", "tongue", "origin").collect() == []
