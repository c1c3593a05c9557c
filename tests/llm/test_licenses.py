"""The scan for notices against all places and edits, and on nulls, empty and long texts, repeated rows and odd names."""

import random
import re

import pytest
from pyspark.sql import functions as F
from test_llm import ascii_lower

from joinwright.llm import licenses
from joinwright.llm.licenses import BASE, NOTICES, Notice

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, ascii_lower(text or ""))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def places(own, notice):
    """Runs of whole words that are within the notice's edits of it, with their edits."""
    out = {}
    for i in range(len(own)):
        for j in range(i + 1, len(own) + 1):
            run = " ".join(own[i:j])
            if len(run) > len(notice.words) + notice.edits:
                break
            if len(run) >= len(notice.words) - notice.edits and (n := edits(run, notice.words)) <= notice.edits:
                out[i, j] = n
    return out


@pytest.fixture(scope="module")
def texts():
    make = random.Random(11)
    alphabet = "abcdegilmnoprstuy "
    out = []
    for _ in range(160):
        parts = []
        for _ in range(make.randint(1, 4)):
            chars = list(make.choice(NOTICES).words)
            for _ in range(make.choice([0, 0, 1, 2, 4, 7])):
                at = make.randrange(len(chars))
                chars[at : at + make.randint(0, 1)] = make.choice(["", make.choice(alphabet), make.choice(alphabet).upper()])
                chars = chars or ["x"]
            parts.append("".join(chars).replace(" ", make.choice([" ", "  ", "-", "\n", ", "])))
            parts.append(make.choice(["", "the", "a", "é漢", "by cc by cc", "X1", "a MIT license mit license"]))
        out.append(" ".join(parts))
    out += [None, "", " .,\n", "mit", "MIT LICENSE", "xmit license", "mit licensee", "mit_license", "Mit license", "cc by" * 3, "𝒳 cc-BY-nc 4.0 é", "gnu general public", "K mit license"]
    return out + ["lorem ipsum " * 30_000 + "the MIT Lisense", "mit licens " * 3000, "cc by " * 2000]


def scanned(spark, texts, notices=NOTICES):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("spans", "n_words", "__raw", "labels", "score")})
    return licenses.scan_licenses(frame, ["doc_id"], notices=notices)


def test_against_all_places(spark, texts):
    found = scanned(spark, texts)
    spans = {r.doc_id: r for r in found.collect()}
    shown = {r.doc_id: r for r in licenses.summarise(found, ["doc_id"]).collect()}
    assert len(spans) == len(texts)
    for i, text in enumerate(texts):
        own, r = words(text), shown[i]
        assert spans[i].n_words == r.n_words == len(own)
        base = sorted((at, n.label) for n in BASE for at in range(len(own)) if own[at : at + len(n.words.split())] == n.words.split())
        assert (r.n_base, r.first_word, r.last_word) == (len(base), base[0][0] if base else None, base[-1][0] if base else None)
        assert r.base_labels == ",".join(sorted({label for _, label in base}))
        for s in spans[i].spans:  # each span is a run of words within the edits that it states
            notice = next(n for n in NOTICES if n.words == s.notice and n.label == s.label and n.edits >= s.edits)
            run = " ".join(own[s.first_word : s.end_word])
            assert edits(run, notice.words) <= s.edits <= notice.edits
            assert " ".join(words(text[s.first_char : s.end_char])) == run and re.fullmatch(WORD, ascii_lower(text[s.first_char] + text[s.end_char - 1]))
        if len(own) < 200:
            every = {(n.label, n.words): places(own, n) for n in NOTICES}
            assert r.labels == ",".join(sorted({label for (label, _), at in every.items() if at})), text
    assert shown[len(texts) - 3].labels == "mit" and shown[len(texts) - 2].labels == "mit" and shown[len(texts) - 1].n_base == 2000


def test_score_and_spans_of_one_text(spark):
    text = "é: Released under the M.I.T. licence; (C) all rights resrved."
    r = scanned(spark, [text], (Notice("mit license", "mit", 3), Notice("all rights reserved", "reserved", 2))).first()
    assert [(s.label, text[s.first_char : s.end_char], s.edits) for s in r.spans] == [("mit", "M.I.T. licence", 3), ("reserved", "all rights resrved", 1)]
    assert licenses.summarise(scanned(spark, [text, "x"]), ["doc_id"]).select("labels", "base_labels").collect()[1] == ("", "")
    assert licenses.summarise(scanned(spark, ["Apache License", "apache licence", "none"]), ["doc_id"]).select("score").collect() == [(1.0,), (1 - 1 / 14,), (0.0,)]


def test_names_empty_tables_and_wrong_notices(spark):
    assert scanned(spark, []).collect() == [] and licenses.summarise(scanned(spark, []), ["doc_id"]).collect() == []
    other = spark.createDataFrame([("k", 1, "cc by")] * 2, "key string, part int, body string")
    assert [tuple(r) for r in licenses.summarise(licenses.scan_licenses(other, ["key", "part"], "body"), ["key", "part"]).collect()] == [("k", 1, 2, 1, 0, 0, "cc-by", "cc-by", 1.0)] * 2
    with pytest.raises(ValueError):
        licenses._machines((Notice("ab", "x", 2),))
