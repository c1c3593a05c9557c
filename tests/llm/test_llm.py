"""Each operator against a brute-force version, and on nulls, empty and very long texts, ties, repeated rows, empty
tables and extra columns with clashing names."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from joinwright.llm import ann, bpe, chat, components, fingerprint, lang_id, line_dedup, mixing, near_dedup, token_counts, toxicity
from joinwright.llm.cuckoo import CuckooFilter
from joinwright.llm.lexicon import Lexicon, compile_lexicon
from joinwright.llm.storage import shared_dir
from joinwright.llm.words import shingle_sets

SPACE = "\x20\x09-\x0d"
#: Columns with the names that operators use inside.
EXTRA = {"id": "x", "text_": "y", "bands": "z", "component": "c", "key": "k", "n": "n", "rank": "r", "label": "l", "__text": "t", "size": "s", "a": "a", "b": "b"}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text):
    return re.findall(f"[^{SPACE}]+", text or "")


@pytest.fixture(scope="module")
def texts():
    make = random.Random(7)
    vocabulary = ["".join(make.choice("abcdefghijklmnop") for _ in range(make.randint(1, 7))) for _ in range(400)]
    sentence = lambda n: " ".join(make.choice(vocabulary) for _ in range(n))
    rows = [sentence(make.randint(0, 80)) for _ in range(60)]
    base = sentence(120).split()
    for _ in range(40):  # near copies: each differs from the base in up to three words
        copy = list(base)
        for _ in range(make.randint(0, 3)):
            copy[make.randrange(len(copy))] = make.choice(vocabulary)
        rows.append(" ".join(copy))
    chain = sentence(100).split()
    for i in range(12):  # a chain: neighbours are similar, its ends are not
        chain = chain[5:] + sentence(5).split()
        rows.append(" ".join(chain))
    rows += [None, "", "   \n\t", "one", "One", "one two", "\x1cone", rows[60], rows[60].upper(), rows[61] + "\n", sentence(30_000), "é 漢字 𝒳 x", "a" * 50_000]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", None, "de"][i % 3], ["src1", None, "é", "src0", "Z"][i % 5], *EXTRA.values()) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in EXTRA))
    return frame.union(frame.where("doc_id in (3, 60)"))  # repeated rows


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id < 0")


def brute_components(texts, k, percent):
    sets = []
    for t in texts:
        w = words(ascii_lower(t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    label = list(range(len(sets)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((root(i), root(j)))
            label[b] = a
    return [len(s) for s in sets], [root(i) for i in range(len(sets))]


@pytest.mark.parametrize(("shingle", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, texts, shingle, percent):
    found = near_dedup.near_duplicates(docs, near_dedup.NearDupParams(shingle=shingle, percent=percent)).collect()
    sizes, labels = brute_components(texts, shingle, percent)
    assert len(found) == len(texts) + 2
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found} == {(i, s, c, i == c) for i, (s, c) in enumerate(zip(sizes, labels))}


def test_near_duplicates_without_rows_or_ids(spark, none):
    assert near_dedup.near_duplicates(none).collect() == []
    odd = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, None)], "doc_id long, text string")
    found = {r.doc_id: (r.component_id, r.kept) for r in near_dedup.near_duplicates(odd).collect()}
    assert found == {None: (1, True), 1: (1, True), 2: (2, True)} or found == {None: (None, True), 1: (1, True), 2: (2, True)}


def test_near_duplicate_star_whose_centre_is_not_the_smallest_id(spark):
    """Copies that resemble the base only: links exist, but not with the smallest id of a bucket."""
    make = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(40):
        copy = list(base)
        for p in make.sample(range(200), 5):
            copy[p] = f"x{i}_{p}"
        rows.append((i, " ".join(copy)))
    rows.append((40, " ".join(base)))
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), near_dedup.NearDupParams(shingle=3, percent=85)).collect()
    _, labels = brute_components([t for _, t in rows], 3, 85)
    assert {(r.doc_id, r.component_id) for r in found} == set(enumerate(labels))


def test_pruning_rule_keeps_links():
    params = near_dedup.NearDupParams(percent=85)
    make = np.random.default_rng(1)
    a = make.integers(0, 256, (20_000, params.hashes), dtype=np.uint8)
    b = np.where(make.random(a.shape) < 0.85, a, make.integers(0, 256, a.shape, dtype=np.uint8))
    assert len(near_dedup._passing(a, b, params.least_matches())) >= len(a) - 2
    far = np.where(make.random(a.shape) < 0.4, a, make.integers(0, 256, a.shape, dtype=np.uint8))
    assert len(near_dedup._passing(a, far, params.least_matches())) < 20


def test_components(spark):
    make = random.Random(5)
    pairs = [(make.randrange(300), make.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)] + [(1, 1)]
    label = {}

    def root(i):
        while label.setdefault(i, i) != i:
            i = label[i]
        return i

    for a, b in pairs:
        if a != b:
            x, y = sorted((root(a), root(b)))
            label[y] = x
    found = components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {(r.node, r.component) for r in found} == {(i, root(i)) for i in label}


def test_line_dedup(spark, docs, texts):
    lines = [f" Line {i % 4} " if i % 2 else f"line {i % 4}" for i in range(60)]
    rows = [(i, None if t is None else t + "\n" + lines[i] + "\n" + "  \n" + lines[i]) for i, t in enumerate(texts[:60])] + [(1000, ""), (1001, None), (1002, "no\r\nline\x1c")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(1)).withColumn("key_a", F.lit(2))
    strip = lambda x: ascii_lower(x.strip(" \t\n\v\f\r"))
    counts = collections.Counter(k for _, t in rows for k in {strip(x) for x in (t or "").split("\n")})
    frequent = {k for k, n in counts.items() if n >= 10 and k}
    expected = set()
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if strip(x) not in frequent]
        expected.add((i, len(own), len(own) - len(kept), "\n".join(kept)))
    assert frequent and any(e[2] for e in expected)
    params = line_dedup.LineDedupParams()
    state = line_dedup.update_lines(None, frame, None, params)
    for size in (line_dedup.FILTER_BYTES, 0):  # where the texts are, and by joins
        found = line_dedup.drop_frequent_lines(frame, state, params, filter_bytes=size, inserted=True).collect()
        assert {(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in found} == expected
    first = line_dedup.dedup_lines(frame.withColumn("doc_id", F.col("doc_id") + 0), line_dedup.LineDedupParams(keep="first")).collect()
    left = collections.Counter(k for r in first for k in {strip(x) for x in r.kept_text.split("\n")} if k in frequent)
    assert set(left.values()) == {1} and set(left) == frequent
    assert line_dedup.dedup_lines(docs.where("doc_id < 0")).collect() == []


def test_lines_count_documents_and_not_rows(spark):
    long_ = "w " * 60_000
    rows = [(1, "Hello\nx")] * 12 + [(2, "hello \ny")] + [(i, f"often\n{i}") for i in range(3, 13)] + [(3, f"OFTEN\n{long_}"), (4, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("drop", "id", "hash", "n_lines", "exempt", "0")})
    params = line_dedup.LineDedupParams()
    state = line_dedup.update_lines(None, frame, None, params)
    for size in (line_dedup.FILTER_BYTES, 0):
        found = line_dedup.drop_frequent_lines(frame, state, params, ["doc_id", "drop", "0"], filter_bytes=size, inserted=True).collect()
        assert sorted((r.doc_id, r.n_dropped, r.kept_text) for r in found) == sorted((i, t.lower().count("often"), "\n".join(x for x in t.split("\n") if x.lower() != "often")) for i, t in rows)
        assert {(r.drop, r["0"]) for r in found} == {("mine", "mine")}
    # No line is lost, also where no document has an id.
    for ids in (frame, frame.withColumn("doc_id", F.lit(None).cast("long"))):
        kept = line_dedup.dedup_lines(ids, line_dedup.LineDedupParams(keep="first")).collect()
        assert sum(x.strip().lower() == "often" for r in kept for x in r.kept_text.split("\n")) == (2 if ids is frame else 1)
        assert any(long_ in r.kept_text for r in kept)
    gone = line_dedup.update_lines(state, None, frame.where("doc_id = 3"), params)
    assert {r.n_dropped for r in line_dedup.drop_frequent_lines(frame, gone, params).collect()} == {0}


def test_line_shards_grow(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 4)
    params = line_dedup.LineDedupParams(min_docs=2, shards=2)
    frame = lambda a, b: spark.createDataFrame([(1000 * a + i, "\n".join(f"line {j}" for j in range(a, b))) for i in range(3)], "doc_id long, text string")
    few, more = frame(0, 6), frame(6, 200)
    state = line_dedup.update_lines(None, few, None, params)
    grown = line_dedup.update_lines(state, more, None, params)
    assert state.shards == 2 and grown.shards == 64 and grown.filters.count() <= 64
    whole = few.union(more)
    for size in (line_dedup.FILTER_BYTES, 0):
        assert sum(r.n_dropped for r in line_dedup.drop_frequent_lines(whole, grown, params, filter_bytes=size, inserted=True).collect()) == 3 * 200


def test_line_state_is_reversible(spark):
    old = spark.createDataFrame([(i, f"a\nb\nu{i}") for i in range(12)], "doc_id long, text string")
    new = spark.createDataFrame([(i, f"B \nc\nu{i}") for i in range(20, 35)], "doc_id long, text string")
    params = line_dedup.LineDedupParams(shards=4)
    table = lambda s: {(r.key_a, r.key_b, r.n_docs) for r in s.counts.collect()}
    before = line_dedup.update_lines(None, old, None, params)
    during = line_dedup.update_lines(before, new, None, params)
    after = line_dedup.update_lines(during, None, new, params)
    assert table(after) == table(before) != table(during)
    assert table(during) == table(line_dedup.update_lines(None, old.union(new), None, params))
    dropped = lambda s: {r.doc_id: r.n_dropped for r in line_dedup.drop_frequent_lines(old, s, params).collect()}
    assert dropped(after) == dropped(before) == {i: 2 for i in range(12)}
    gone = line_dedup.update_lines(during, None, old.where("doc_id < 4"), params)  # a falls below ten documents
    assert dropped(gone) == {i: 1 for i in range(12)}


def test_no_line_of_other_documents_is_lost_by_mistakes_of_the_filters(spark, monkeypatch):
    frame = spark.createDataFrame([(i, f"often\nown {i}") for i in range(12)], "doc_id long, text string")
    others = spark.createDataFrame([(100 + i, f"Often \nnever seen {i}") for i in range(500)], "doc_id long, text string")
    params = line_dedup.LineDedupParams()
    state = line_dedup.update_lines(None, frame, None, params)
    full = CuckooFilter(64)  # takes every key for one of its own
    full.slots[:] = 1
    monkeypatch.setattr(CuckooFilter, "contains", lambda self, a, b: np.ones(len(a), bool))
    probe = line_dedup._Probe({0: full.to_bytes()}, 1)
    assert probe(np.zeros(3, np.int64), np.zeros(3, np.int64)).all()
    found = line_dedup.drop_frequent_lines(others, state, params, ["doc_id"]).collect()
    assert {(r.doc_id, r.n_dropped, r.kept_text) for r in found} == {(100 + i, 1, f"never seen {i}") for i in range(500)}


def test_cuckoo_filter():
    make = np.random.default_rng(2)
    a, b = (make.integers(-(1 << 62), 1 << 62, 5000) for _ in range(2))
    held = CuckooFilter(3000)
    assert held.insert(a[:3000], b[:3000])
    assert held.contains(a[:3000], b[:3000]).all() and not held.contains(a[3000:], b[3000:]).any()
    held = CuckooFilter.from_bytes(held.to_bytes())
    held.delete(a[:1000], b[:1000])
    assert held.contains(a[1000:3000], b[1000:3000]).all() and not held.contains(a[:1000], b[:1000]).any()
    assert not CuckooFilter(10).insert(a, b)


def test_bpe(docs, texts, none):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    reference = tokenizers.Tokenizer.from_file(path)
    odd = docs.unionByName(docs.sparkSession.createDataFrame([(9000, " a  b <|endoftext|> it's 12三 ՘֋ 　x\n\n y "), (9001, "<|endoftext|>")], "doc_id long, text string"), allowMissingColumns=True)
    codec = bpe.BpeCodec(odd, path, lexicon_size=100)
    clash = odd.withColumns({c: F.lit("mine") for c in ("__text", "__ids", "given", "0", "ids", "n_tokens")})
    kept = codec.round_trip(clash, ["doc_id", "__text", "given", "0", "n_tokens"]).collect()
    assert {(r["__text"], r.given, r["0"]) for r in kept} == {("mine",) * 3} and all(isinstance(r.n_tokens, int) for r in kept)
    assert codec.decode(codec.encode(clash, ["__ids", "ids"]), ["__ids"]).columns == ["__ids", "text"]
    encoded = codec.encode(odd, ["doc_id", "n"])
    held = {r.doc_id: r.text or "" for r in odd.select("doc_id", "text").collect()}
    rows = encoded.collect()
    assert len(rows) == len(texts) + 4
    for r in rows:
        assert r.ids == reference.encode(held[r.doc_id], add_special_tokens=False).ids
    decoded = codec.decode(encoded, ["doc_id"]).collect()
    assert {(r.doc_id, r.text) for r in decoded} == set(held.items())
    digest = codec.decode(encoded, ["doc_id"], digest=True).where("doc_id = 9000").first()
    ids = reference.encode(held[9000], add_special_tokens=False).ids
    assert (digest.n_tokens, digest.ids_sha256, digest.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(held[9000]))
    assert bpe.BpeCodec(none, path).encode(none, ["doc_id"]).collect() == []
    odd_ids = odd.sparkSession.createDataFrame([(1, [31373, None, 9_999_999, -5, 0]), (2, None), (3, []), (4, [9_999_999])], "doc_id long, ids array<int>")
    found = codec.decode(odd_ids, ["doc_id"]).collect()
    assert {(r.doc_id, r.text) for r in found} == {(1, reference.decode([31373, 0], skip_special_tokens=False)), (2, ""), (3, ""), (4, "")}
    assert [r.n_tokens for r in codec.decode(odd_ids, ["doc_id"], digest=True).orderBy("doc_id").collect()] == [2, 0, 0, 0]


def test_bpe_pieces_and_merges():
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    reference = tokenizers.Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        model = bpe.ByteBpe(file.read())
    encoder = bpe._Encoder(model, Lexicon(compile_lexicon([(b" the", (262,))])))
    make = random.Random(4)
    parts = [" ", "  ", "\n", "\t", "a", "the", "é", "ß", "'s", "'ll", "1", "23", "!", "...", "　", "\xa0", "\x1c", "漢字", "😀", "՘", "\x85", "​", "A"]
    for _ in range(3000):
        text = "".join(make.choice(parts) for _ in range(make.randint(0, 14)))
        assert np.frombuffer(encoder.text(text), np.int32).tolist() == reference.encode(text, add_special_tokens=False).ids, repr(text)
    long_ = "".join(make.choice("abcdef") for _ in range(20_000))
    assert np.frombuffer(encoder.text(long_), np.int32).tolist() == reference.encode(long_, add_special_tokens=False).ids


def test_all_merges_together_are_those_one_by_one():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        model = bpe.ByteBpe(file.read())
    make = random.Random(14)
    pieces = ["".join(make.choice("aeiounrst é漢'.x1") for _ in range(make.randint(1, 15))).encode() for _ in range(4000)] + [b"aaaa", b"a"] * 3
    pieces = [p for p in pieces if len(p) <= 64]
    assert [np.frombuffer(x, np.int32).tolist() for x in model.merge_all(pieces)] == [model.merge(p) for p in pieces]
    assert model.merge_all([]) == []


def test_late_code_points_are_those_of_the_library():
    """The table of late code points belongs to the versions of ``regex`` and ``tokenizers`` that are installed."""
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    reference = tokenizers.Tokenizer.from_file(path)
    edges = sorted({c + d for pair in bpe.LATE for c in pair for d in (-1, 0, 1)} | set(range(0x20, 0x3FFFF, 61)))
    for c in edges:
        if not 0xD800 <= c < 0xE000:
            text = f"a{chr(c)}1 {chr(c)}"
            assert [text[a:b] for _, (a, b) in reference.pre_tokenizer.pre_tokenize_str(text)] == bpe.split_pieces(text), hex(c)


def test_joined_parts_have_the_ids_of_each_alone():
    import public_tokenizers

    from joinwright.llm import bpe
    from joinwright.llm.lexicon import Lexicon, compile_lexicon

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        model = bpe.ByteBpe(file.read())
    encoder = bpe._Encoder(model, Lexicon(compile_lexicon([])))
    parts = ["the", "don't", "a\n\nb", "é" * 40, "x" * 70 + ".y", "42nd,", "😀", "'s", "՘z", "中文.", "end"]
    alone = [[i for p in bpe.split_pieces(" " + part) for i in model.merge(p.encode())] for part in parts]
    assert [np.frombuffer(x, np.int32).tolist() for x in encoder.merged(" " + " ".join(parts))] == alone
    assert [np.frombuffer(encoder.merged(" " + p)[0], np.int32).tolist() for p in parts] == alone


def test_lexicon_shares_endings_and_is_exact():
    make = random.Random(6)
    entries = {"".join(make.choice("abc") for _ in range(make.randint(1, 8))).encode(): tuple(make.randrange(5) for _ in range(make.randint(0, 4))) for _ in range(500)}
    held = Lexicon(compile_lexicon(entries.items()))
    for word in itertools.chain(entries, (bytes(w) for n in range(1, 6) for w in itertools.product(b"abc", repeat=n))):
        want = entries.get(word)
        assert held.get(word) == (None if want is None else list(want))
    one, many = (len(compile_lexicon([(p + b"ing", (1,)) for p in some])) for some in ([b"a"], [b"a", b"b", b"c", b"d"]))
    assert many - one < 3 * 40
    every = [b"", *entries, *(bytes(w) for n in range(1, 6) for w in itertools.product(b"abc", repeat=n)), b"abcx" * 5]
    assert held.accepts(every).tolist() == [w in entries for w in every]
    empty = Lexicon(compile_lexicon([]))
    assert empty.get(b"x") is None and not empty.accepts([b"x", b""]).any() and not empty.accepts([]).any()


def test_mixing(spark, docs, texts, none):
    params = mixing.MixParams()
    found = mixing.mix_table(docs, params).collect()
    again = mixing.mix_table(docs.repartition(7), params).collect()
    assert sorted(found) == sorted(again)
    size = {i: len(words(t)) for i, t in enumerate(texts)}
    source = {i: ["src1", None, "é", "src0", "Z"][i % 5] for i in size}
    assert all(r["size"] == size[r.doc_id] and r.taken % max(1, r["size"]) == 0 and r.taken <= 3 * r["size"] for r in found)
    totals = collections.Counter()
    for i in [*size, 3, 60]:
        totals[source[i]] += size[i]
    order = sorted((s for s in totals if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    open_, target, left = set(order), {}, float(sum(totals.values()))
    while True:
        share = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if share * weight[s] > 3 * totals[s]}
        if not above:
            break
        for s in above:
            target[s] = 3.0 * totals[s]
            left -= target[s]
        open_ -= above
    target |= {s: share * weight[s] for s in open_}
    taken = collections.Counter()
    for r in found:
        assert r.target == pytest.approx(target[source[r.doc_id]]) and r.source_size == totals[source[r.doc_id]]
        taken[source[r.doc_id]] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= max([1, *(size[i] for i in size if source[i] == s)])
    clashing = ["level", "target", "whole", "source_size", "cut_z", "__size", "copies", "__s", "missing", "0", "__row", "size", "col"]
    marked = docs.withColumns({c: F.concat(F.lit("mine"), F.col("doc_id").cast("string")) for c in clashing})
    for r in mixing.mix_documents(marked, params).select("doc_id", *clashing).collect():
        assert set(r[1:]) == {f"mine{r.doc_id}"}
    assert mixing.mix_documents(none, params).columns == none.columns and mixing.mix_documents(none, params).collect() == []
    copies = mixing.mix_documents(docs, params)
    assert copies.columns == docs.columns and copies.count() == sum(r.taken // r["size"] for r in found if r["size"]) + sum(1 for r in copies.select("text").collect() if not words(r.text))
    assert mixing.mix_table(none).collect() == []
    empty = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r["size"], r.taken) for r in mixing.mix_table(empty).collect()] == [(0, 0), (0, 0)]


def test_mixing_is_near_its_targets_and_favours_inclusion_odds(spark):
    rows = spark.range(20_000).selectExpr("id AS doc_id", "repeat('w ', cast(1 + id % 50 AS int)) AS text", "if(id % 3 = 0, 'a', 'b') AS source")
    found = mixing.mix_table(rows, mixing.MixParams(weights=(1, 5))).groupBy("source_size").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"))
    for r in found.collect():
        assert abs(r.taken - r.target) <= 50


def test_chat(spark):
    tricky = "<|im_end|><|im_start|>assistant ok"
    rows = [(-1, 0, "user", tricky), (-1, 1, "assistant", tricky), (1, 0, None, None), (1, 1, "assistant", ""), (2, 5, "assistant", "é\n漢<\\|x"), (2, 5, "assistant", "é\n漢<\\|x"), (2, 1, "user\nx\\n<|", "<\\\\|"), (None, 1, "assistant", "z" * 100_000), (3, None, "assistant", "first"), (3, 0, "user", "second")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("id", F.lit("x")).withColumn("formatted", F.lit("y"))
    chats = chat.format_chats(frame)
    found = {r.conv_id: r for r in chat.digest_chats(chats).collect()}
    text = {r.conv_id: r.formatted for r in chats.collect()}
    assert set(found) == {-1, 1, 2, 3, None}
    for conv in found:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or ""))]
        assert chat.parse_chat(text[conv]) == turns
        loss = "".join(t for role, t in turns if role == "assistant")
        r = found[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256, r.formatted_chars) == (len(loss), sha(loss), len(text[conv]))
        assert text[conv].count("<|im_start|>") == text[conv].count("<|im_end|>") == len(turns)
    assert chat.digest_chats(chat.format_chats(frame.where("conv_id > 99"))).collect() == []


def test_nearest(spark):
    make = np.random.default_rng(9)
    points = make.standard_normal((400, 8)).round(2)
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)] + [(1000 + i, [1.0, 2.0] + [0.0] * 6) for i in range(30)]
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (2004, []), (2005, [None] * 8), (None, [1.0] * 8), (2006, [1.0, 2.0, 3.0]), (2010, [2.0, 4.0, 6.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("v", F.lit(2)).withColumn("entry", F.lit(3))
    found = collections.defaultdict(list)
    for r in ann.nearest(frame.union(frame.where("vec_id = 3")), F.col("vec_id") % 10 == 0, ann.ForestParams(range=64, block=32)).collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    good = {i: np.array(v) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    hit = total = 0
    assert set(found) == {i for i in good if i % 10 == 0}
    for q, near in found.items():
        cosine = {i: float(v @ good[q] / np.sqrt((v @ v) * (good[q] @ good[q]))) for i, v in good.items() if i != q and len(v) == len(good[q])}
        best = sorted(cosine, key=lambda i: (-round(cosine[i], 12), i))[:5]
        near.sort()
        assert [r for r, _, _ in near] == list(range(1, len(best) + 1))
        assert all(s == pytest.approx(cosine[i], abs=1e-12) for _, i, s in near)
        hit, total = hit + len({i for _, i, _ in near} & set(best)), total + len(best)
        if 1000 <= q < 1030:
            assert [i for _, i, _ in near] == best
    assert hit >= 0.9 * total
    assert ann.nearest(frame.where("vec_id < 0"), F.lit(True)).collect() == []


def test_nearest_recall_on_the_tables(spark, data):
    frame = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, float) for r in frame.collect()}
    ids = sorted(rows)
    matrix = np.stack([rows[i] / np.linalg.norm(rows[i]) for i in ids])
    found = collections.defaultdict(set)
    for r in ann.nearest(frame, F.col("vec_id") % 10 == 0).collect():
        found[r.query_id].add(r.vec_id)
    hits = 0
    for q, near in found.items():
        scores = matrix @ matrix[ids.index(q)]
        scores[ids.index(q)] = -2
        hits += len(near & {ids[i] for i in np.argsort(-scores)[:5]})
    assert hits >= 0.9 * 5 * len(found)


def test_language(spark, none):
    make = random.Random(8)
    kinds = {"xx": "abcd", "yy": "efgh", "zz": "ijkl"}
    rows = [(i, " ".join("".join(make.choice(kinds[k]) for _ in range(make.randint(2, 6))) for _ in range(30)), k) for i, k in enumerate(make.choices(list(kinds), k=300))]
    rows += [(1000, None, "xx"), (1001, "", "xx"), (1002, "12 ² !?", "yy"), (1003, "ab", None), (1004, "ef " * 100_000, None), (1005, "Ω", None), (1006, "ijklijklijkl", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("id", F.lit(1)).withColumn("word", F.lit("w"))
    frame = frame.withColumn("held_out", lang_id.held_out("doc_id"))
    model = lang_id.fit_lang_model(frame.where("not held_out"))
    found = {r.doc_id: r for r in lang_id.predict_languages(frame, model, ["doc_id", "held_out", "word"]).collect()}
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found.values())
    out = [i for i, _, _ in rows[:300] if found[i].held_out]
    assert out and all(found[i].lang_pred == rows[i][2] for i in out)
    assert [found[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and found[1002].score == 0
    assert (found[1003].lang_pred, found[1004].lang_pred, found[1006].lang_pred) == ("xx", "yy", "zz") and found[1005].lang_pred in kinds
    nothing = lang_id.fit_lang_model(none)
    assert {r.lang_pred for r in lang_id.predict_languages(frame, nothing, ["doc_id"]).collect()} == {"und"}
    assert lang_id.predict_languages(none, model, ["doc_id"]).collect() == []


def test_rare_languages_stay_in_the_sample(spark):
    assert lang_id.quota([10, 1000, 5000], 1210, 1) == 600 and lang_id.quota([10, 20], 100, 5) == 20 and lang_id.quota([500] * 10, 100, 50) == 50
    own = lambda i: "own" + "".join(chr(97 + i // 26**p % 26) for p in range(3))
    rows = [(i, f"abba baab {own(i)}", "xx") for i in range(8000)] + [(9000 + i, "gilka kligi", "zz") for i in range(4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for ids in (frame, frame.withColumn("doc_id", F.lit(None).cast("long"))):
        model = lang_id.fit_lang_model(ids, lang_id.LangIdParams(max_chars=6400, least_chars=1, least_count=1))
        assert model.langs == ["xx", "zz"] and model.predict(["kligi gilka"])[0][0] == "zz"
        assert 300 < len(model.words.keys) < 500


def brute_language(rows, params, texts):
    """Training, prediction, score and share of known words, with strings and without numpy."""
    letters = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    grams = lambda w, n: [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)]
    counts = collections.defaultdict(collections.Counter)  # by language and length, words at 0
    for _, text, lang in rows:
        if text is not None and lang is not None:
            for w in letters(text):
                counts[lang, 0][w] += 1
                for n in params.lengths:
                    counts[lang, n].update(grams(w, n))
    langs = sorted({lang for (lang, n), c in counts.items() if c})
    known = {n: {x for lang in langs for x, k in counts[lang, n].items() if k >= params.least_count} for n in (0, *params.lengths)}

    def cost(x, n, lang):
        k = counts[lang, n][x]
        return -np.log10(k / sum(counts[lang, n].values())) if k >= params.least_count else params.absent

    def word_cost(w, lang):
        if w in known[0]:
            return cost(w, 0, lang)
        for n in params.lengths:
            if found := [g for g in grams(w, n) if g in known[n]]:
                return sum(cost(g, n, lang) for g in found) / len(found)
        return params.absent

    out = []
    for text in texts:
        own = letters(text)
        if not any(c.isalpha() for w in own for c in w) or not langs:
            out.append(("und", 0.0, 0.0))
            continue
        total = [sum(word_cost(w, lang) for w in own) for lang in langs]
        best = min(range(len(langs)), key=lambda i: total[i])
        out.append((langs[best], 1 / sum(10 ** (total[best] - t) for t in total), sum(w in known[0] for w in own) / len(own)))
    return out


def test_language_against_brute_force(spark):
    make = random.Random(21)
    rows = [(i, " ".join("".join(make.choice("abcde" if i % 3 else "cdefé") for _ in range(make.randint(1, 5))) for _ in range(12)), ["xx", "yy", "zz", None][i % 4]) for i in range(80)]
    rows += [(80, rows[3][1], "xx"), (80, rows[3][1], "xx"), (81, None, "xx"), (82, "", "yy"), (83, "1 2", "zz"), (84, "ΣΑΣ İx ﬁ 漢字 𝒳y", "zz"), (85, "ab " * 70_000 + "c1d_e", None), (86, "cd", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("mine") for c in ("score", "lang_pred", "0", "key", "n")})
    params = lang_id.LangIdParams(lengths=(4, 3, 2, 1))
    model = lang_id.fit_lang_model(frame, params)
    found = lang_id.predict_languages(frame, model, ["doc_id", "text", "score", "n"], known_col="known").collect()
    assert len(found) == len(rows) and found[0].n == "mine"
    expected = {t: e for t, e in zip([r[1] for r in rows], brute_language(rows, params, [r[1] for r in rows]))}
    for r in found:
        lang, score, known = expected[r.text]
        assert (r.lang_pred, r.score, r.known) == (lang, pytest.approx(score, abs=1e-9), pytest.approx(known)), r.text
    none = frame.where("doc_id < 0")
    assert lang_id.fit_lang_model(none).langs == [] and lang_id.predict_languages(none, model, ["doc_id"]).collect() == []


def test_language_on_held_out_documents(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", lang_id.held_out("doc_id"))
    model = lang_id.fit_lang_model(frame.where("not held_out"))
    found = lang_id.predict_languages(frame.where("held_out"), model, ["lang"]).collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found)


def test_fingerprints(spark, docs, texts, none):
    rows = {r.doc_id: r for r in fingerprint.compare_neighbours(docs.dropDuplicates(["doc_id"])).collect()}
    plain = {r.doc_id: r.fingerprint for r in fingerprint.fingerprint_documents(docs).collect()}
    assert len(rows) == len(texts)
    bag = lambda t: collections.Counter(words(ascii_lower(t)))

    def jaccard(a, b):
        return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0

    errors = []
    for i, t in enumerate(texts):
        own, after = t or "", texts[i - 1] or ""  # in descending order, and the first after the last
        edited = own[: len(own) - len(own) // 3] + after[: len(own) // 3]
        r = rows[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint) == (len(own), sha(edited), plain[i])
        errors += [r.near_edited - jaccard(bag(own), bag(edited)), r.near_next - jaccard(bag(own), bag(after))]
        assert 0 <= r.near_edited <= 1
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.1
    assert texts[115:117] == ["one", "One"] and rows[115].fingerprint == rows[116].fingerprint and rows[60].fingerprint == plain[60]
    assert fingerprint.compare_neighbours(none).collect() == []
    single = fingerprint.compare_neighbours(docs.where("doc_id = 7")).first()
    assert single.near_next == 1.0
    assert fingerprint.compare_neighbours(docs).count() == len(texts) + 2


def test_collision_rate_is_generalised_jaccard():
    import pyarrow as pa

    make = random.Random(11)
    errors = []
    for _ in range(60):
        a = collections.Counter({f"w{i}": make.randint(1, 9) for i in range(40)})
        b = collections.Counter({w: n if make.random() < 0.6 else make.randint(1, 9) for w, n in a.items() if make.random() < 0.9})
        marks = fingerprint.sample_signatures(pa.array([" ".join(a.elements()), " ".join(b.elements())]))
        errors.append(fingerprint.likeness(*marks) - sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(errors)) < 3 * 0.5 / np.sqrt(60 * fingerprint.SAMPLES)


def test_toxicity(spark, none):
    make = random.Random(12)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        text = make.choices(vocabulary, k=40)
        for _ in range(make.randint(1, 8) if toxic else 0):
            text[make.randrange(40)] = make.choice(["scum", "Idiot", "trash"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "scum idiot trash scum"), (1003, "w1 " * 50_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit("clash")).withColumn("word", F.lit("x"))
    marks = spark.createDataFrame([*labels, (None, 1), (5, None), (0, 1)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(frame, marks.where("doc_id < 400 or doc_id is null"))
    assert (np.diff(model.thresholds) > 0).all()
    found = {r.doc_id: r for r in toxicity.predict_toxicity(frame, model, ["doc_id", "word"]).collect()}
    held = [i for i, _ in labels if i >= 400]
    assert sum(found[i].toxic == (i % 4 == 0) for i in held) >= 0.95 * len(held)
    assert found[1002].severity > found[1003].severity and not found[1000].toxic and not found[1001].toxic and not found[1003].toxic
    assert all(0 <= r.severity <= 3 for r in found.values())
    for i, t in rows:  # features, probabilities, expected severity and grade by plain Python
        own = set()
        for w in re.findall(r"[^\W_]+", (t or "").lower()):
            own |= {w, *(w[:n] + "-" for n in (4, 5, 6) if n < len(w)), *("-" + w[-n:] for n in (4, 5, 6) if n < len(w))}
        score = sum(model.weights[model.words[f]] for f in own if f in model.words)
        beyond = [1 / (1 + math.exp(-(score - x))) for x in model.thresholds]
        shares = [a - b for a, b in zip([1, *beyond], [*beyond, 0])]
        assert found[i].severity == pytest.approx(sum(g * p for g, p in enumerate(shares)), abs=1e-9)
        assert found[i].grade == max(range(len(shares)), key=lambda g: (round(shares[g], 12), -g)) and found[i].toxic == (beyond[0] >= 0.5)
    twice = toxicity.predict_toxicity(frame.union(frame.where("doc_id in (3, 1000)")), model, ["doc_id"]).collect()
    assert len(twice) == len(rows) + 2 and {(r.doc_id, r.severity) for r in twice} == {(i, r.severity) for i, r in found.items()}
    assert {r.grade for r in toxicity.predict_toxicity(frame, toxicity.fit_toxicity(none, marks.limit(0)), ["doc_id"]).collect()} == {0}
    assert toxicity.predict_toxicity(none, model, ["doc_id"]).collect() == []


def test_thresholds_maximise_the_likelihood():
    make = np.random.default_rng(3)
    n, width = 400, 6
    present = make.random((n, width)) < 0.4
    grades = np.clip((present @ np.array([2.0, 1.0, 0.5, 0.0, -1.0, -2.0]) + make.standard_normal(n)).round(), 0, 3).astype(int)
    weight = make.random(n) + 0.5
    params = toxicity.ToxicityParams(steps=3000, rate=0.02, ridge=1e-3)
    weights, thresholds = toxicity.fit_thresholds(*np.nonzero(present), grades, width, weight, params)

    def likelihood(w, t):
        beyond = 1 / (1 + np.exp(-((present @ w)[:, None] - t)))
        bounds = np.hstack((np.ones((n, 1)), beyond, np.zeros((n, 1))))
        own = bounds[np.arange(n), grades] - bounds[np.arange(n), grades + 1]
        return (weight / weight.sum() * np.log(np.maximum(own, 1e-300))).sum() - params.ridge / 2 * (w @ w)

    best = likelihood(weights, thresholds)
    for i in range(width + 3):
        for step in (-0.05, 0.05):
            moved = np.concatenate((weights, thresholds))
            moved[i] += step
            assert likelihood(moved[:width], moved[width:]) < best


def test_token_ledger(spark, docs, texts, none):
    ledger = token_counts.TokenLedger(spark, f"{shared_dir(spark)}/ledger-{random.random()}")
    counted = token_counts.counted
    key = lambda rows: {(r.source, r.lang, r.version, r.docs, r.tokens) for r in rows}
    assert ledger.batches() == [] and ledger.totals().collect() == [] and not ledger.compact()
    part = docs.where("doc_id % 3 = 0")
    assert ledger.commit("a/1", token_counts.signed(counted(docs), 1)) and not ledger.commit("a/1", token_counts.signed(counted(docs), 1))
    whole = key(ledger.totals().collect())
    assert ledger.compact() and not ledger.compact() and key(ledger.totals().collect()) == whole
    assert ledger.commit("b", token_counts.revised(counted(part), counted(part.withColumn("text", F.lit("two words")))))
    assert ledger.commit("c", token_counts.signed(counted(docs.where("doc_id % 3 = 1")), -1)) and ledger.commit("d", token_counts.signed(counted(none), 1))
    now = docs.where("doc_id % 3 <> 1").withColumn("text", F.when(F.col("doc_id") % 3 == 0, "two words").otherwise(F.col("text")))
    direct = counted(now).groupBy("source", "lang", "version").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))
    for _ in range(3):
        assert key(ledger.totals().collect()) == key(direct.collect())
        ledger.compact()
    assert ledger.batches() == ["a/1", "b", "c", "d"] and not ledger.commit("c", token_counts.signed(counted(docs), 1))
    # Of two writers of a batch one is first, whose rows count; the other's are never read.
    late = token_counts.TokenLedger(spark, ledger.path)
    late.committed = lambda batch: False
    assert not late.commit("b", token_counts.signed(counted(docs), 1)) and key(late.totals().collect()) == key(direct.collect())


def test_token_counts_of_a_tokenizer(spark, docs, texts):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    reference = tokenizers.Tokenizer.from_file(path)
    marked = docs.withColumns({"tokens": F.lit("mine"), "version": F.lit("mine"), "n0": F.lit("mine")})
    codecs = {v: bpe.BpeCodec(docs, path, lexicon_size=50) for v in ("bpe-1", "bpe-2")}
    found = token_counts.counted(marked, {"words-1": token_counts.count_words}, id_col="doc_id", codecs=codecs).collect()
    rows = [*enumerate(texts), (3, texts[3]), (60, texts[60])]
    expected = [(i, v, len(reference.encode(t or "", add_special_tokens=False).ids) if v[0] == "b" else len(words(t))) for i, t in rows for v in ("words-1", "bpe-1", "bpe-2")]
    assert sorted((r.doc_id, r.version, r.tokens) for r in found) == sorted(expected)


def test_shingles_are_exact(texts):
    import pyarrow as pa

    for k in (3, 5):
        found = [len(s) for _, sets in shingle_sets(pa.array(texts, pa.string()), k) for s in sets]
        assert found == brute_components(texts, k, 101)[0]


def test_word_variables_do_not_depend_on_the_block(monkeypatch):
    words = np.random.RandomState(5).randint(0, 1 << 62, 700).astype(np.uint64)
    whole = [np.concatenate(x) for x in zip(*[fingerprint._variables(words[i : i + 1]) for i in range(len(words))])]
    for block in (1, 256, 1000):
        monkeypatch.setattr(fingerprint, "BLOCK", block)
        assert all((a == b).all() for a, b in zip(whole, fingerprint._variables(words)))
