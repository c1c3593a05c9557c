"""Rules that the queries don't reach: odd keys, missing values, files, models, streams."""

import collections
import json
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from joinwright.functions import keys, similarity, text, vectors
from joinwright.operators import aggregate, assoc, distance, joins, mlprep, perturb, profile, quantiles, sketch, texts
from joinwright.plans import augment, choices, evaluate
from joinwright.sources import catalog, tables
from joinwright.streaming import sketches

FORMS = {
    None: "__NA__", "": "__NA__", "   ": "__NA__", " Bronx ": "bronx", "14.0": "14", "1e5": "100000", "1.50": "1.5", "007": "7", "-3": "-3", "inf": "inf", "nan": "nan", "1d": "1d",
    "2020-01-02": "2020-01-02", "2020-1-2": "2020-01-02", "01/02/2020": "2020-01-02", "13/01/2020": "2020-01-13", "2020-01-01T10:11:12": "2020-01-01", "2020-01-01T10:11:12.000": "2020-01-01",
    "2020-01-01 00:00:00": "2020-01-01 00:00:00", "12345678901234567890": "12345678901234567890", "9007199254740992": "9007199254740992", "st-louis": "st-louis",
}


def test_key_forms(spark):
    frame = spark.createDataFrame([(v,) for v in FORMS], "v string").select("v", keys.normalize_key(F.col("v")).alias("k"))
    assert {r.v: r.k for r in frame.collect()} == FORMS
    typed = spark.sql("select true b, 7.0D d, date'2020-03-04' t, cast(null as int) n").select(*[keys.normalize_key(F.col(c)).alias(c) for c in "bdtn"]).first()
    assert (typed.d, typed.t, typed.n) == ("7", "2020-03-04", "__NA__")


def test_hash_matches_sha256(spark):
    import hashlib

    row = spark.sql("select 'abc' v").select(keys.hash_int(F.col("v")).alias("i"), keys.hash_unit(F.col("v")).alias("u"), keys.composite_key(F.lit(" A"), F.lit(1)).alias("c"), keys.composite_key(F.lit("a"), F.lit(None)).alias("n")).first()
    number = int.from_bytes(hashlib.sha256(b"abc").digest()[:8], "big")
    assert (int(row.i), row.c, row.n) == (number, "a||1", None) and row.u == pytest.approx(number / (2**64 - 1))


def test_similarity():
    assert similarity.weighted_ratio("New York", "new york!") == 100
    assert similarity.indel_ratio("kitten", "sitting") == pytest.approx(100 * 8 / 13)
    assert similarity.weighted_ratio("york new city", "new york city") == pytest.approx(95)
    assert similarity.weighted_ratio("", "x") == 0 and similarity.weighted_ratio(None, "x") == 0
    assert similarity.weighted_ratio("york", "the city of new york in the state") == pytest.approx(60)


def test_find_json():
    assert text.find_json('{"a": 1}') == {"a": 1}
    assert text.find_json("x {'b': 2} y {\"a\": {\"c\": 3}} z", "a") == {"a": {"c": 3}}
    assert text.find_json("```json\n{\"a\": [1]}\n```") == {"a": [1]}
    assert text.find_json("no {json") is None and text.find_json(None) is None and text.find_json("[1]") is None


def test_sketch_counts_missing_values_as_a_member(spark):
    frame = spark.createDataFrame([("a",), ("A ",), (None,), ("b",), ("1",), ("1.0",)], "v string")
    assert sketch.sketch_table(frame, "t").count() == 4
    assert sketch.bottom_k_with_samples(sketch.long_values(frame, "t")).count() == 5
    many = spark.range(30_000).selectExpr("cast(id as string) v")
    assert sketch.sketch_table(many, "t").count() == 3000
    empty = sketch.scores(sketch.sketch_table(frame.limit(0), "q"), sketch.sketch_table(frame, "t"))
    assert empty.count() == 0


def test_nulls_in_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "X ")], "i int, k string")
    b = spark.createDataFrame([(10, " x"), (20, None)], "i int, k string")
    assert {(r.i, r.i_right) for r in joins.join_normalized(a, b, ["k"], ["k"]).collect()} == {(1, 10), (3, 10), (2, 20)}
    assert {(r.i, r.j) for r in joins.join_nullsafe(a, b.withColumnRenamed("i", "j"), ["k"]).collect()} == {(2, 20)}
    left = joins.join_left_dedup(a, b.union(b), ["k"], ["i"], "some-id")
    assert {(r.i, r.i_some_id) for r in left.collect()} == {(1, 10), (3, 10), (2, 20)} and left.count() == 3
    assert joins.validate_join(a, b, ["k"], ["k", "i"]).valid is False
    report = joins.validate_join(a, b, ["k"], ["k"])
    assert (report.base_rows, report.merged_rows, report.valid) == (3, 3, True)
    assert joins.same_shape(a, a) and not joins.same_shape(a, b)
    assert [r.i for r in joins.normalized_key_filter(a, "k", b.select("k").where("k is not null")).orderBy("i").collect()] == [1, 3]


def test_fuzzy_ties_and_blanks(spark):
    q = spark.createDataFrame([("alpha",), ("alphb",), ("",), (None,)], "k string")
    c = spark.createDataFrame([("alphc",), ("ALPHA!",), ("zzz",), ("--",)], "k string")
    assert {(r.candidate, r.query) for r in joins.fuzzy_map(q, c).collect()} == {("alphc", "alpha"), ("ALPHA!", "alpha")}


def _nearest(queries, candidates, ratio, least):
    found = {}
    for c in candidates:
        scores = sorted((-s, q) for q in queries if (s := ratio(c, q)) >= least)
        if scores:
            found[c] = (scores[0][1], round(-scores[0][0], 6))
    return found


@pytest.mark.parametrize("least", [80.0, 60.0, 51.0, 40.0])
def test_fuzzy_map_equals_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(joins, "BLOCK", 3)
    rng = random.Random(int(least))

    def edited(text):
        for _ in range(rng.randrange(len(text) // 3 + 2)):
            at, what = rng.randrange(len(text) + 1), rng.choice(["", "a", "b", "é", " "])
            text = text[:at] + what + text[at + rng.randrange(2) :]
        return text

    queries = ["".join(rng.choices("abc é", k=n)) for n in [*range(1, 22), 40, 63, 66, 80] for _ in range(2)]
    candidates = sorted({edited(q) for q in queries for _ in range(3)})
    fold = lambda t: re.sub(r"[\W_]", " ", t).lower().strip(" ")

    def ratio(a, b):
        a, b = fold(a), fold(b)
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return (1 - row[-1] / max(len(a), len(b))) * 100 if a and b else 0.0

    frames = [spark.createDataFrame([(k,) for k in keys], "k string") for keys in (queries, candidates)]
    found = {r.candidate: (r.query, round(r.score, 6)) for r in joins.fuzzy_map(*frames, least).collect()}
    assert found == _nearest(set(queries), candidates, ratio, least)


def test_weighted_fuzzy_map_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(joins, "BLOCK", 3)
    queries = ["new york", "los angeles", "york", "saint paul", "paul"]
    candidates = ["city of new york", "angeles, los", "yorck", "st paul", "zzz", "PAUL"]
    frames = [spark.createDataFrame([(k,) for k in keys], "k string") for keys in (queries, candidates)]
    found = {r.candidate: (r.query, round(r.score, 6)) for r in joins.fuzzy_map(*frames, 60.0, "weighted").collect()}
    assert found == _nearest(queries, candidates, similarity.weighted_ratio, 60.0)


def test_category_vectors_keep_keys_without_categories(spark):
    frame = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", None), (None, "x")], "k string, c string")
    found = {r.k: (r.c_vector, r.c_categories) for r in aggregate.aggregate_category_vector(frame, ["k"], "c").collect()}
    assert found == {"a": ([0.5, 0.5], ["x", "y"]), "b": ([0.0, 0.0], ["x", "y"]), None: ([0.0, 0.0], ["x", "y"])}
    two = frame.withColumn("j", F.lit(1))
    assert aggregate.aggregate_category_vector(two, ["k", "j"], "c", proportion=False).where("k = 'a'").first().c_vector == [1.0, 1.0]


def test_greedy_cover():
    vectors = np.array([[1, 0], [1, 0.1], [0, 1], [0, 0.9], [1, 1]], float)
    near = texts.similarities(vectors)
    chosen = texts.greedy_cover(vectors, 2)
    assert chosen[0] == int(near.sum(0).argmax()) and len(chosen) == 2
    assert texts.greedy_cover(vectors, 9) == [0, 1, 2, 3, 4]
    of = np.repeat(np.arange(5), [1, 1, 3, 1, 1])
    assert texts.greedy_cover(vectors, 2, weights=np.array([1, 1, 3, 1, 1.0])) == of[texts.greedy_cover(vectors[of], 2)].tolist()
    assert texts.nominate(["b", "a"], [2.0, 3.0], 5) == (["a", "b"], [3.0, 2.0])


def test_text_subsets_equal_the_plain_cover_and_keep_dense_clusters(spark):
    words = ["red apple", "green pear", "blue plum", "old stone wall", "tall pine tree"]
    rows = [(k, f"{words[i % 5]} {i * k}") for k in (1, 2) for i in range(60)] + [(None, "one"), (None, "two"), (1, " "), (1, None)]
    frame = spark.createDataFrame(rows, "k int, t string")
    found = {r.k: r.texts for r in texts.text_subsets(frame, ["k"], "t", 4).collect()}
    for k in (1, 2):
        own = sorted({t for x, t in rows if x == k and t and t.strip()})
        assert found[k] == sorted(own[i] for i in texts.greedy_cover(texts.hashed_ngrams(own), 4))
    assert found[None] == ["one", "two"]
    assert [len(r.texts) for r in texts.text_subsets(frame.where("k = 1"), ["k"], "t", None).collect()] == [60]
    dense = spark.createDataFrame([(1, f"the same long sentence about rivers {i}") for i in range(300)] + [(1, f"{w} {i}") for w in words[:4] for i in range(3)], "k int, t string")
    assert "rivers" in texts.text_subsets(dense, ["k"], "t", 1, block=32).first().texts[0]
    assert len(texts.text_subsets(dense, ["k"], "t", 5, block=32).first().texts) == 5


def test_text_covers_are_those_of_the_plain_rule_and_each_text_is_embedded_once(spark, tmp_path):
    random = np.random.RandomState(7)
    for n, k in ((40, 6), (200, 24)):
        vectors, weights = random.normal(size=(n, 8)), random.randint(1, 4, n).astype(float)
        near = texts.similarities(vectors)
        plain = [int((weights @ near).argmax())]
        while len(plain) < k:
            gains = weights @ np.maximum(near - near[:, plain].max(1)[:, None], 0)
            gains[plain] = -1
            plain.append(int(gains.argmax()))
        assert texts.greedy_cover(vectors, k, weights=weights) == plain
    one = lambda t: texts.hashed_ngrams([t])[0]
    several = ["a red apple", "", " ", "é", "x" * 50, "a  Red\tapple"]
    assert all((a == one(t)).all() for a, t in zip(texts.hashed_ngrams(several, most_bytes=20), several))

    def counted(some):
        with open(f"{tmp_path}/seen", "a") as f:
            f.write("".join(f"{t}\n" for t in some))
        return texts.hashed_ngrams(some)

    frame = spark.range(320).selectExpr("id % 2 k", "concat('text number ', id) t")
    assert [len(r.texts) for r in texts.text_subsets(frame, ["k"], "t", 5, counted, block=32).collect()] == [5, 5]
    seen = collections.Counter((tmp_path / "seen").read_text().splitlines())
    # A text is embedded once for each of at most three rounds in which it is still a candidate.
    assert len(seen) == 320 and max(seen.values()) <= 3 and seen.total() <= 450
    few = spark.range(100).selectExpr("id div 2 k", "concat('other ', id) t")  # no key has more texts than wanted: no call
    assert [r.texts for r in texts.text_subsets(few, ["k"], "t", 2, counted).orderBy("k").collect()][:2] == [["other 0", "other 1"], ["other 2", "other 3"]]
    assert "other" not in (tmp_path / "seen").read_text()


def test_pearson_and_distance_correlation(spark):
    frame = spark.createDataFrame([(1.0, 2.0, None), (2.0, 4.0, None), (3.0, None, 1.0), (float("nan"), 1.0, None)], "x double, y double, z double")
    found = {r.feature: r.value for r in assoc.pearson(frame, [("y", F.col("x"), F.col("y")), ("z", F.col("x"), F.col("z"))]).collect()}
    assert found["y"] == pytest.approx(1) and np.isnan(found["z"])
    assert assoc.distance_correlation(frame, "x", "y").first().value == pytest.approx(1)
    assert np.isnan(assoc.distance_correlation(frame, "x", "z").first().value)
    with pytest.raises(ValueError):
        assoc.distance_correlation(spark.range(50).selectExpr("array(id) x", "id y"), "x", "y", most=10)


def test_column_classes_and_coercion(spark):
    frame = spark.createDataFrame([(str(i), "a" if i % 2 else "b", f"t{i}", [i], 5, "x" if i % 3 else str(i)) for i in range(100)], "n string, two string, t string, l array<int>, one int, third string")
    assert profile.column_classes(frame, {"n": "Number", "t": "text"}) == {"n": "numerical", "two": "numerical", "t": "text", "l": "ignore", "one": "ignore", "third": "ignore"}
    assert dict(profile.convert_numeric_columns(frame, ["two"]).dtypes)["n"] == "double" and dict(profile.convert_numeric_columns(frame).dtypes)["third"] == "string"
    assert profile.separator(frame.select(F.concat_ws("|", "n", "t").alias("s")), "s") == "|" and profile.separator(frame, "t") is None
    assert profile.text_columns(frame, {"t": "text"}) == ["t"] and profile.numeric_columns(frame) == ["one"]


def test_bins_and_encoders(spark):
    frame = spark.createDataFrame([(float(i), i) for i in range(11)] + [(None, 20), (99.0, 21)], "v double, i int")
    edges = {"v": [0.0, 5.0, 10.0]}
    found = {r.i: r.b for r in frame.select("i", mlprep.bin_column(F.col("v"), edges["v"]).alias("b")).collect()}
    assert [found[i] for i in (0, 5, 6, 10, 20, 21)] == [0, 0, 1, 1, 1, 1]
    fitted = mlprep.fit_preprocessor(spark.createDataFrame([("b", "x y x 12", 2), ("a", "y", 1)], "c string, t string, i int"), ["i"], ["c"], ["t"], "i")
    assert fitted.categories["c"] == {"a": 1, "b": 2} and fitted.vocabulary == {"x": 3, "y": 4}
    made = mlprep.apply_preprocessor(spark.createDataFrame([("zz", "y 7 q", 1)], "c string, t string, i int"), fitted, ["t"], 5).first()
    assert (made.c, made.t_ids, made.i) == (0, [4, 2, 1, 0, 0], 0)


def test_split_is_the_seeded_permutation(spark):
    assert mlprep.split_positions(10).tolist() == np.random.RandomState(42).permutation(10)[:3].tolist()
    train, test = mlprep.split_by_position(spark.range(10).withColumnRenamed("id", "p"), "p")
    assert {r.p for r in test.collect()} == set(mlprep.split_positions(10).tolist()) and train.count() == 7
    train, test = mlprep.split_by_hash(spark.range(2000), "id")
    assert train.count() + test.count() == 2000 and 450 < test.count() < 750


def test_models(spark):
    frame = spark.range(200).selectExpr("id", "cast(id % 17 as double) a", "if(id % 2 = 0, 'u', 'v') s", "cast(null as double) e", "3.0D * (id % 17) + if(id % 2 = 0, 5, 0) y", "if(id % 2 = 0, 'p', 'q') c")
    assert evaluate.evaluate(frame, "y", ["a", "s", "e"], position="id").score == pytest.approx(1, abs=1e-4)
    assert evaluate.evaluate(frame, "c", ["a", "s"], "classification", "id").score == pytest.approx(1)
    assert evaluate.feature_importance(frame, "y", ["a", "s"], "a", key="id") > 0.5 and evaluate.feature_importance(frame, "y", ["a"], "a") is None
    assert evaluate.improvement(0.0, 0.5) == {"improvement": 0.5, "percent": 50.0, "is_valid": True} and evaluate.utility_gain(2.0, None) is None
    assert evaluate.baseline_features(["k", "y"], "y", ["k"]) == ["k"]


def test_least_squares_are_those_of_numpy(spark):
    make = np.random.RandomState(3)
    x = make.rand(77, 3)
    y = x @ [1.0, -2.0, 0.5] + make.rand(77)
    frame = spark.createDataFrame([(i, *map(float, row), float(t)) for i, (row, t) in enumerate(zip(x, y))], "i long, a double, b double, c double, y double")
    out = mlprep.split_positions(77)
    inside = np.setdiff1d(np.arange(77), out)
    scaled = (x - x.mean(0)) / x.std(0)
    design = np.c_[np.ones(77), scaled]
    beta = np.linalg.lstsq(design[inside], y[inside], rcond=None)[0]
    expected = 1 - ((y[out] - design[out] @ beta) ** 2).sum() / ((y[out] - y[out].mean()) ** 2).sum()
    assert evaluate.evaluate(frame, "y", ["a", "b", "c"], position="i").score == pytest.approx(expected, abs=1e-6)


def test_column_effects_are_those_of_single_fits(spark):
    make = np.random.RandomState(5)
    n = 300
    a, b, c = make.rand(n), make.rand(n), make.rand(n)
    y = 1e6 + 3 * a - 2 * b + 0.3 * make.rand(n)
    frame = spark.createDataFrame([(i, *(float(v[i]) for v in (a, b, c, y))) for i in range(n)], "id long, a double, b double, c double, y double")
    labels = frame.select("id", "a", "y")
    holes = F.when(F.col("id") % 10 == 0, float("nan")).when(F.col("id") % 10 == 1, float("inf")).when(F.col("id") % 10 > 2, F.col("c"))
    features = frame.selectExpr("id", "b", "c", "2 * a - 1 as same", "cast(null as double) as `no ne`").withColumn("c", holes)
    columns = ["b", "c", "same", "no ne"]
    found = {r.column: r for r in evaluate.column_effects(features, labels, ["id"], "y", columns).collect()}
    out = np.array([r.t for r in frame.orderBy("id").select(mlprep.held_out(["id"]).alias("t")).collect()])
    place = np.arange(n) % 10
    filled = np.where(place > 2, c, c[place > 2].mean())

    def score(*x):
        design = np.column_stack([np.ones(n), *x])
        beta = np.linalg.lstsq(design[~out], y[~out], rcond=None)[0]
        return 1 - ((y[out] - design[out] @ beta) ** 2).sum() / ((y[out] - y[out].mean()) ** 2).sum()

    assert 60 < out.sum() < 120 and found["b"].effect == "positive" and found["c"].effect == "negative"
    for name, expected in (("b", score(a, b)), ("c", score(a, filled)), ("same", score(a)), ("no ne", score(a))):
        assert found[name].score == pytest.approx(expected, abs=1e-8) and found[name].baseline == pytest.approx(score(a), abs=1e-8)
    twice = features.union(features.where("id < 40"))
    alone = {x: evaluate.column_effects(twice.repartition(5), labels, ["id"], "y", [x]).first().score for x in columns}
    assert {r.column: r.score for r in evaluate.column_effects(twice, labels, ["id"], "y", columns).collect()} == pytest.approx(alone, abs=1e-8)
    for few in (labels.limit(0), labels.where("id < 1")):  # no row, and a part without rows
        none = evaluate.column_effects(features, few, ["id"], "y", ["b"]).first()
        assert (none.baseline, none.score, none.effect) == (None, None, "negative")
    assert evaluate.feature_importance(frame, "y", ["a", "b"], "b", key="id") == pytest.approx(score(a, b) - score(a), abs=1e-8)


def test_sketch_index_gives_the_scores_of_fresh_sketches(spark, tmp_path):
    from joinwright.sources.sketch_index import SketchIndex, ranked

    big = spark.range(30_000).selectExpr("id", "concat('n', id % 700) as name", "cast(null as string) as none")
    lake = {"big": big, "small": spark.range(50).selectExpr("id * 2 as k", "id % 3 as g"), "void": spark.range(0).selectExpr("id")}
    query = spark.range(0, 5000, 3).selectExpr("id", "concat('n', id % 900) as name")
    asked = sketch.bottom_k(sketch.long_values(query, "query"))

    def expected(tables):
        values = None
        for name, df in tables.items():
            own = sketch.long_values(df, name)
            values = own if values is None else values.union(own)
        return sorted(map(tuple, sketch.scores(asked, sketch.bottom_k(values, k=1024)).collect()))

    index = SketchIndex(spark, f"{tmp_path}/i ndex")
    got = lambda: sorted(map(tuple, index.scores(asked).collect()))
    assert got() == [] and index.columns().count() == 0 and index.stale({"big": "1"}) == ["big"]
    index.add({"big": lake["big"], "void": lake["void"]}, {"big": "1", "void": "7"})
    assert got() == expected({"big": big}) != [] and index.stale({"big": "1", "void": "7", "small": "1"}) == ["small"]
    index.add({"small": lake["small"]})
    assert got() == expected(lake)
    lake["big"] = big.where("id >= 9000")  # a changed table takes the place of the old one
    index.add({"big": lake["big"]}, {"big": "2"})
    assert got() == expected(lake) and index.stale({"big": "1"}) == ["big"] and index.stale({"big": "2"}) == []
    lost = sketch.sketch_table(spark.range(100), "lost")  # a writer that was lost between the two tables
    lost.selectExpr("*", "'000000000099-x' as batch", "'0-1' as prefix").write.partitionBy("batch", "prefix").mode("append").parquet(f"{tmp_path}/i ndex/entries")
    assert got() == expected(lake)
    before = got()
    plan = index.scores(asked.where("hash < '08'"))._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "prefix" in plan.split("PartitionFilters")[1]
    index.compact()
    assert got() == before and len(list((tmp_path / "i ndex" / "entries").glob("batch=*"))) == 1 and index.stale({"big": "2", "void": "7"}) == []
    index.remove(["big"])
    assert got() == expected({"small": lake["small"]}) and {r.table_id for r in index.entries().collect()} == {"small"}
    assert [(r.table_id, r["rank"]) for r in ranked(index, query, ["id"]).collect()] in ([], [("small", 1)])
    index.remove(["small", "void"])
    index.compact()
    assert got() == [] and index.stale({"void": "7"}) == ["void"]


def test_perturbation(spark):
    frame = spark.range(1000).selectExpr("id", "cast(id as double) x", "id % 7 g", "id % 5 y")
    noisy = perturb.add_noise(frame, "id", 0.1, ["x"])
    moved = noisy.join(frame.withColumnRenamed("x", "old"), "id").select((F.col("x") - F.col("old")).alias("d")).agg(F.stddev("d").alias("s"), F.avg("d").alias("m")).first()
    assert moved.s == pytest.approx(0.1 * 288.8, rel=0.1) and abs(moved.m) < 5
    assert sorted(noisy.collect()) == sorted(perturb.add_noise(frame.repartition(7), "id", 0.1, ["x"]).collect())
    shuffled = perturb.joint_shuffle(frame, "id", "y", 0.5)
    assert sorted(r.y for r in shuffled.collect()) == sorted(r.y for r in frame.collect()) and {(r.id, r.y) for r in shuffled.collect()} == {(r.id, r.y) for r in frame.collect()}
    changed, reached = perturb.perturb_tokens(["a", "b", "c"], {"a": ["x"], "b": ["y", "c"]}, 0.0, 1)
    assert reached <= 0.5 and set(changed) <= {"a", "b"} and changed.get("b", "y") == "y"
    assert perturb.perturb_header(frame, {"x": "extent"}).columns == ["id", "extent", "g", "y"]
    assert len(perturb.grid([0, 1], [0, 1])) == 4


def test_decomposition_finds_differences(spark):
    frame = spark.createDataFrame([(1, 2.0, None), (2, None, "b")], "k int, x double, s string")
    assert {r.column: r.differing for r in joins.table_differences(frame, frame.withColumn("x", F.col("x") + 1e-7), "k").collect()} == {"x": 0, "s": 0}
    assert joins.table_differences(frame, frame.where("k = 1"), "k").where("differing <> 1").count() == 0


def test_files(spark, tmp_path):
    frame = spark.createDataFrame([(1, 'a "q", b\nc', None), (2, "x", 1.5)], "i int, t string, v double")
    tables.write_csv(frame, f"{tmp_path}/c")
    read = tables.read_csv(spark, f"{tmp_path}/c", coerce=True)
    assert {(r.i, r.t, r.v) for r in read.collect()} == {(1.0, 'a "q", b\nc', None), (2.0, "x", 1.5)}
    assert tables.read_head(spark, f"{tmp_path}/c").count() == 2 and [tables.head_rows(n << 20) for n in (1, 60, 200)] == [None, 10_000, 5_000]
    (tmp_path / "log.jsonl").write_text('{"tau": 1, "v": 2}\nnot json\n{"tau": 3, "v": 4}\n')
    assert {(r.tau, r.v) for r in tables.read_log(spark, f"{tmp_path}/log.jsonl", "tau int, v int").collect()} == {(1, 2), (3, 4)}
    tables.append_log(frame, f"{tmp_path}/j")
    tables.append_log(frame, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 4
    tables.write_parquet(frame, f"{tmp_path}/lake/Demo 1.parquet")
    provider = tables.DirectoryProvider(spark, f"{tmp_path}/lake")
    assert provider.load(" demo").count() == 2 and provider.names() == ["Demo 1"]
    with pytest.raises(KeyError):
        provider.resolve("other")
    entries = spark.createDataFrame([(0, None, ["a"]), (1, None, []), (0, "e", ["a"])], "returncode int, error string, selected_candidate_tables array<string>")
    assert tables.failed_entries(entries).count() == 2 and tables.without_candidates(entries).count() == 1


def test_row_source(spark):
    def client(table_id, offset, limit):
        if table_id == "unknown":
            raise KeyError(table_id)
        if table_id == "broken" and offset == 20:
            raise OSError("down")
        return [{"a": i, "b": None} if i % 2 else {"a": i, "b": "x"} for i in range(offset, min(offset + limit, 2345))]

    tables.register_rows(spark, client)
    rows = lambda table, **options: spark.read.format("joinwright_rows").schema("a string, b string").options(table_id=table, page="10", **options).load()
    assert sorted(int(r.a) for r in rows("t").collect()) == [*range(2345)] and rows("t").where("b is null").count() == 1172
    assert sorted(int(r.a) for r in rows("t", max_rows="55", tasks="3").collect()) == [*range(55)]
    assert rows("unknown").collect() == []
    with pytest.raises(Exception, match="down"):
        rows("broken").collect()


def test_row_source_of_a_service_that_caps_its_pages(spark):
    tables.register_rows(spark, lambda table_id, offset, limit: [{"a": i} for i in range(offset, min(offset + min(limit, 100), 5000))])
    rows = lambda **options: [int(r.a) for r in spark.read.format("joinwright_rows").schema("a string").options(table_id="t", **options).load().collect()]
    assert sorted(rows(page="2000")) == sorted(rows(page="130", tasks="3")) == [*range(5000)]
    assert sorted(rows(page="250", tasks="2", max_rows="777")) == [*range(777)]


def test_metadata(spark, tmp_path):
    folder = tmp_path / "Demo"
    folder.mkdir()
    described = {"resource": {"name": "N", "description": "d" * 30, "columns_name": ["A", "B"], "columns_datatype": ["Number"], "columns_description": []}, "classification": {"categories": ["x"]}, "metadata": {"domain": "dom"}}
    (folder / "metadata.json").write_text(json.dumps(described, indent=1))
    entries = catalog.read_metadata(spark, f"{tmp_path}/*/metadata.json")
    assert entries.first().id == "Demo"
    assert [(r.column, r.datatype, r.description) for r in catalog.columns_of(entries).orderBy("ordinal").collect()] == [("A", "Number", ""), ("B", "unknown", "")]
    assert catalog.checked_ids(["a", {"id": "b"}]) == ["a", "b"] == catalog.checked_ids({"checked_tables": ["a", "b"]})
    renamed = entries.withColumn("name", F.lit(None).cast("string"))
    assert catalog.upsert(renamed, entries).first().name == "N"


def test_catalog_is_kept_by_domain_and_table(spark, tmp_path):
    kept = lambda *rows: spark.createDataFrame([(i, n, None, None, [], [], [], [], d) for i, n, d in rows], catalog.ENTRY)
    catalog.write_catalog(kept(("a b", "old", "x.org"), ("c", "C", "x.org"), ("7", "seven", "12"), ("n", "N", None)), f"{tmp_path}/kept")
    catalog.write_catalog(kept(("a b", "new", "x.org")), f"{tmp_path}/kept")
    found = catalog.read_catalog(spark, f"{tmp_path}/kept")
    assert {(r.id, r.name, r.domain) for r in found.collect()} == {("a b", "new", "x.org"), ("c", "C", "x.org"), ("7", "seven", "12"), ("n", "N", None)}
    catalog.write_catalog(kept(("p q", "one", "y.org"), ("p_q", "two", "y.org"), ("p/q", "three", "y.org")), f"{tmp_path}/alike")
    catalog.write_catalog(kept(("p_q", "new", "y.org")), f"{tmp_path}/alike")
    assert {(r.id, r.name) for r in catalog.read_catalog(spark, f"{tmp_path}/alike").collect()} == {("p q", "one"), ("p_q", "new"), ("p/q", "three")}
    assert sorted(found.columns) == sorted(kept().columns)


def test_display_names(spark, tmp_path):
    (tmp_path / "T").mkdir()
    described = {"resource": {"columns_name": ["School Name", "", "Year", "extra"], "columns_field_name": ["school_name", "b", "year"]}}
    (tmp_path / "T" / "metadata.json").write_text(json.dumps(described))
    names = {r.field: r.name for r in catalog.field_names(spark, f"{tmp_path}/*/metadata.json").where("id = 'T'").collect()}
    assert names == {"school_name": "School Name", "year": "Year"}
    frame = spark.createDataFrame([(1, 2, 3)], "school_name int, b int, year int")
    assert catalog.with_display_names(frame, names).columns == ["School Name", "b", "Year"]
    assert catalog.with_display_names(frame, {"school_name": "B", "year": "b"}).columns == ["school_name", "b", "year"]
    chain = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    for renames, expected in (({"a": "b", "b": "c"}, "abc"), ({"a": "b", "b": "a"}, "bac"), ({"a": "b", "b": "d"}, "bdc"), ({"a": "d", "b": "d"}, "dbc"), ({"a": "c", "b": "a"}, "abc")):
        assert catalog.with_display_names(chain, renames).columns == [*expected]


def test_preprocessors_of_several_tables(spark, tmp_path):
    lake = {
        "a": spark.createDataFrame([(i, float(i), "uv"[i % 2], "red fox") for i in range(20)], "i int, x double, c string, t string"),
        "b": spark.createDataFrame([(0, "red sky"), (1, None)], "i int, s string"),
        "empty": spark.createDataFrame([], "i int, x double, c string, s string"),
    }
    kinds = {"a": {"x": "numerical", "c": "categorical", "t": "text"}, "b": {"s": "text"}, "empty": {"x": "numerical", "c": "categorical", "s": "text"}}
    fitted = mlprep.fit_tables(lake, kinds, dict.fromkeys(lake, "i"))
    assert fitted["a"].categories == {"c": {"u": 1, "v": 2}} and len(fitted["a"].edges["x"]) == 11
    assert fitted["a"].vocabulary == fitted["b"].vocabulary == {"red": 3, "fox": 4} and fitted["empty"].edges == {"x": []}
    mlprep.save_preprocessors(spark, fitted, f"{tmp_path}/fitted")
    assert mlprep.load_preprocessors(spark, f"{tmp_path}/fitted") == fitted
    assert mlprep.apply_preprocessor(lake["b"].where("i = 0"), fitted["b"], ["s"], 4).first().s_ids == [3, 1, 0, 0]


def test_cells_of_the_grid_are_run(spark):
    frame = spark.range(100).selectExpr("id", "cast(id as double) size", "id % 7 colour", "id % 5 y")
    synonyms = {"size": ["extent"], "colour": ["hue"], "id": ["number"], "y": ["target"]}
    cells = perturb.grid([0.0, 0.4, 1.0], [0.0, 0.5])
    found = {(how.tau, how.beta): (df, reached) for how, df, reached in perturb.run_grid(frame, "id", "y", cells, synonyms)}
    assert found[0.0, 0.5][0].columns == ["id", "extent", "hue", "y"] and found[0.0, 0.5][1] == 0
    assert found[0.4, 0.0][1] <= 0.4 and found[1.0, 0.5][0].columns == frame.columns
    assert sorted(found[1.0, 0.0][0].collect()) == sorted(frame.collect()) != sorted(found[1.0, 0.5][0].collect())


def test_choices(spark):
    words, domains = choices.search_parameters({"place": "Chicago", "topic": "school grades, all", "time": "skip"})
    assert words == ["school", "grades"] and len(domains) == 1
    table = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", -0.6), ("d", float("nan")), ("e", 0.01)], "feature string, value double")
    pruned = choices.prune_columns(table)
    assert pruned.selected == ("a", "c") and pruned.dropped == ("b", "d", "e")
    with pytest.raises(ValueError):
        choices.checked_partition(["a", "b"], ["a"], ["a"])
    assert choices.Task.of("t", "a, b", "y").join_columns == ("a", "b")


def test_augment(spark):
    query = spark.range(300).selectExpr("concat('K', id % 100) k", "cast((id % 100) * 2 + id % 3 as double) y")
    lake = {
        "good": spark.range(100).selectExpr("concat(' k', id) key", "cast(id as double) size", "cast(hash(id) % 50 as double) noise"),
        "other": spark.range(100).selectExpr("concat('z', id) name", "id v"),
    }
    result = augment.augment(query, choices.Task.of("query", "k", "y"), lake)
    assert result.selected["good"][0] in ("noise", "size") and "size" in result.selected["good"] and "other" not in result.selected
    assert result.coverage["good"] == 1.0 and result.table.count() == 300 and result.report["is_valid"]


def test_stream(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").select("event_id", "user_id", "ts")
    for i in range(3):
        events.where(f"event_id % 3 = {i}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    started = sketches.sketch_stream(stream, "events", ["user_id"], f"{tmp_path}/out", f"{tmp_path}/check", 50)
    started.awaitTermination(120)
    whole = sketch.bottom_k(sketch.long_values(events, "events", ["user_id"])).orderBy("hash").limit(50)
    last = spark.read.parquet(f"{tmp_path}/out/batch=2")
    assert sorted(r.hash for r in last.collect()) == [r.hash for r in whole.collect()]
    counted = sketches.windowed_counts(stream, "ts", "user_id").writeStream.format("memory").queryName("counted").outputMode("append").option("checkpointLocation", f"{tmp_path}/w").trigger(availableNow=True).start()
    counted.awaitTermination(120)
    assert spark.table("counted").count() > 0


def test_vocabulary_counts_whole_texts(spark):
    frame = spark.createDataFrame([(1, "a " * 300 + "late 7"), (2, "late"), (3, None)], "i int, t string")
    words = mlprep.vocabulary(frame, "t")
    assert {r.token: (r.n, r.id) for r in words.collect()} == {"a": (300, 3), "late": (2, 4)}
    found = {r.i: r.t_ids for r in mlprep.encode_whole_text(frame, ["i"], "t", words).collect()}
    assert found == {1: [3] * 300 + [4, 2], 2: [4], 3: []}
    assert {r.token for r in mlprep.vocabulary(frame, "t", limit=text.REFERENCE_LIMIT).collect()} == {"a"}


def test_words_meet_the_vocabulary_once_in_a_block(spark):
    odd = ["a_1 B-b\x0b7\t٣ 12é3", "x", None, "", " . ", "\u212aelvin \u0130I kelvin", "the 007 the", "ab", "cd", "a" * 300 + " tail", "n\xa0n\u2003n", "<NUM> num"]
    rows = [(i, odd[i % len(odd)] if i % 3 else "the end the " * 40 + f"w{i % 50} {i}") for i in range(600)] + [(None, "the"), (None, "the"), (7, None)]
    frame = spark.createDataFrame(rows, "`a.b` int, t string").repartition(3)
    tokens = frame.select("`a.b`", F.posexplode_outer(text.text_tokens(F.col("t"))).alias("at", "token")).collect()
    n = collections.Counter(r.token for r in tokens if r.token not in (None, "<NUM>"))
    ids = {w: i for i, w in enumerate(sorted((w for w in n if n[w] > 1), key=lambda w: (-n[w], w)), 3)} | {"<NUM>": 2}
    words = mlprep.vocabulary(frame, "t")
    assert {r.token: (r.n, r.id) for r in words.collect()} == {w: (n[w], i) for w, i in ids.items() if w != "<NUM>"}
    split = {r.t: r.w for r in frame.select("t", text.text_tokens(F.col("t")).alias("w")).distinct().collect()}
    wanted = collections.Counter((k, *[ids.get(w, 1) for w in split[t]]) for k, t in rows)
    for size in (64, 1 << 24):
        found = mlprep.encode_whole_text(frame, ["a.b"], "t", words, size)
        assert collections.Counter((r[0], *r[1]) for r in found.collect()) == wanted and found.columns == ["a.b", "t_ids"]
    # No shuffled row is a single occurrence: the plan explodes no text, and words meet the vocabulary once for each block.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "FlatMapCoGroupsInArrow" in plan
    pieces = list(text.word_pieces(pa.chunked_array([pa.array(["ab c", None, "", "d"]).slice(1), pa.array(["e_", "f"])]), 1))
    assert [(w.to_pylist(), c.tolist()) for w, c in pieces] == [(["d"], [0, 0, 1]), (["e_"], [1]), (["f"], [1])]
    assert mlprep.encode_whole_text(frame.limit(0), ["a.b"], "t", words).count() == 0


def test_values_are_numbered_by_ranges(spark):
    frame = spark.range(20_000).selectExpr("cast(id * 7919 % 20011 as string) v")
    found = mlprep.label_codes(frame, "v")
    assert [r.code for r in found.orderBy("value").collect()] == list(range(20_000))
    assert "hashpartitioning(__cell" in found._jdf.queryExecution().toString()


def test_separators_and_dates_of_all_rows(spark):
    frame = spark.range(2000).selectExpr("if(id < 1000, 'a', 'a|b') s", "if(id < 10, null, '2020-01-02T00:00:00Z') late", "if(id = 0, '2020-01-02', 'x-y') first", "'1-URGENT' p", "'20200102' digits", "'02/Jan/2020' m", "'2020-01-02' `order date`").coalesce(1)
    assert profile.separator(frame, "s") == "|"
    assert {r.separator: r.share for r in profile.separator_shares(frame, "s").collect()} == {"|": 0.5, ",": 0.0}
    assert profile.date_columns(frame) == ["late", "m", "order date"]


def test_cosines_meet_all_rows(spark, data):
    from joinwright import queries

    found = queries.queries()["cosine_matrix"](spark, data)
    rows = {r.vec_id: r.label for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()}
    asking = {i for i in rows if i % 20 == 0}
    expected = {(i, j) for i in asking for j in rows if rows[i] == rows[j]}
    assert {(r.a, r.b) for r in found.collect()} == expected


def test_cosines_of_blocks_are_those_of_pairs(spark):
    from joinwright import queries

    random = np.random.RandomState(3)
    kinds = [lambda i: random.normal(size=4).tolist(), lambda i: None, lambda i: [1.0, None, 2.0, 0.5], lambda i: [0.0] * 4, lambda i: [1.0, 2.0], lambda i: [], lambda i: [float("nan"), 1.0, 1.0, 1.0]]
    rows = [(i, kinds[i % 7 if i % 3 == 0 else 0](i), "xy"[i % 2] if i < 70 else None) for i in range(84)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    found = queries._cosines(frame.where("vec_id % 4 = 0"), frame, 3, 4)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()
    pairs = frame.where("vec_id % 4 = 0").selectExpr("vec_id a", "embedding ea", "label").join(frame.selectExpr("vec_id b", "embedding eb", "label l"), F.expr("label = l"))
    value = F.when(F.col("a") == F.col("b"), 1.0).otherwise(vectors.cosine(F.col("ea"), F.col("eb")))
    plain = {(r.a, r.b): r.c for r in pairs.select("a", "b", F.round(value, 6).alias("c")).collect()}
    blocks = {(r.a, r.b): r.cosine for r in found.collect()}
    assert blocks.keys() == plain.keys() and all(blocks[p] == c or str(blocks[p]) == str(c) for p, c in plain.items())


def test_plain_whole_numbers_are_their_own_key():
    plain = [s for s in ("0", "7", "-12", "123456789012345", "1234567890123456", "-0", "007", "+5", "1.0", "1e3", "", " 1", "1\n") if re.fullmatch(keys._PLAIN_WHOLE.strip("^$"), s)]
    assert plain == ["0", "7", "-12", "123456789012345"]


def test_only_edge_rows_of_a_stratified_split_are_ranked(spark):
    frame = spark.range(6000).selectExpr("id k", "if(id % 3 = 0, null, id % 3) c", "id % 7 v")
    u = F.pmod(F.xxhash64("k", "k", "c", "v", F.lit(42)), F.lit(1 << 40))
    plain = frame.withColumn("u", u).withColumn("r", F.expr("row_number() over (partition by c order by u, k, c, v)")).withColumn("n", F.expr("count(*) over (partition by c)"))
    expected = {r.k for r in plain.where("r <= round(0.3 * n)").collect()}
    for classes in (10, 1):  # edges sent to the tasks, and met by a join
        train, test = mlprep.split_stratified(frame, "c", "k", cells=16, classes=classes)
        assert {r.k for r in test.collect()} == expected and sorted(r.k for r in train.collect()) == sorted(set(range(6000)) - expected)
    _, test = mlprep.split_stratified(frame, "c", "k", cells=16)
    rows = test._jdf.queryExecution().optimizedPlan().toString()
    assert "__cell" in rows and rows.count("Window") == 1 and rows.index("Union") < rows.index("Window")
    assert mlprep.split_stratified(frame, "c", "k", share=1.0)[0].count() == 0


def test_augmentation_correlates_all_keys(spark):
    query = spark.range(1500).selectExpr("id k", "cast(if(id < 500, -id, id) as double) y")
    lake = spark.range(1500).selectExpr("id j", "cast(id as double) + 0.5 x", "concat('c', id % 3) c")
    found = {r.feature: (r.metric, r.value) for r in augment.correlate(query, choices.Task.of("query", "k", "y"), lake, ["j"]).collect()}
    expected = np.corrcoef(np.arange(1500), np.where(np.arange(1500) < 500, -np.arange(1500), np.arange(1500)))[0, 1]
    assert found["x"] == ("pearson", pytest.approx(expected)) and found["c"][0] == "distance" and found["c"][1] < 0.1


def test_augmentation_finds_vectors_that_tell_late_keys_alone(spark):
    query = spark.range(1500).selectExpr("id k", "cast(if(id < 500, 7 - id % 2, id % 3) as double) y")
    lake = spark.range(1500).selectExpr("id j", "concat('c', if(id < 500, hash(id) % 3, id % 3)) c")
    found = augment.correlate(query, choices.Task.of("query", "k", "y"), lake, ["j"])
    y = [7 - i % 2 if i < 500 else i % 3 for i in range(1500)]
    c = [r.c for r in lake.orderBy("j").collect()]
    a, b = (np.not_equal.outer(v, v).astype(float) for v in (c, y))  # the target has few values, which makes it a category
    a, b = (d - d.mean(0) - d.mean(1)[:, None] + d.mean() for d in (a, b))
    expected = np.sqrt((a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()))
    assert [(r.feature, r.metric) for r in found.collect()] == [("c", "distance")] and found.first().value == pytest.approx(expected)


def test_augmentation_with_composite_keys(spark):
    query = spark.range(600).selectExpr("concat(' K', id % 20) k", "cast(id % 5 as string) j", "cast(id % 20 * 10 + id % 5 as double) y")
    lake = spark.range(600).selectExpr("concat('k', id % 30, ' ') a", "cast(id % 5 as double) b", "cast(id % 30 * 10 + id % 5 as double) x", "array(1.0D) y_vector", "cast(id % 3 as double) y")
    found = {r.feature: r.value for r in augment.correlate(query, choices.Task.of("query", ["k", "j"], "y"), lake, ["a", "b"]).collect()}
    assert found == {"x": pytest.approx(1)}


def test_stratified_split_and_samples(spark):
    rows = [(i, "abc"[i % 3] if i < 90 else None) for i in range(100)] + [(100, "single")]
    frame = spark.createDataFrame(rows, "k long, c string")
    train, test = mlprep.split_stratified(frame, "c", "k", cells=4)
    counts = {r.c: r["count"] for r in test.groupBy("c").count().collect()}
    assert counts == {"a": 9, "b": 9, "c": 9, None: 3}
    assert sorted(r.k for r in train.union(test).collect()) == list(range(101))
    assert mlprep.split_stratified(frame.where("k < 0"), "c", "k")[1].count() == 0
    again = mlprep.split_stratified(frame.repartition(7), "c", "k", cells=4)[1]
    assert {r.k for r in again.collect()} == {r.k for r in test.collect()}
    one_key = spark.range(8000).selectExpr("1L k", "'x' c", "id % 4000 v", "map('m', id % 7) m")
    train, test = (collections.Counter(r.v for r in part.collect()) for part in mlprep.split_stratified(one_key, "c", "k"))
    assert test.total() == 2400 and train + test == collections.Counter(dict.fromkeys(range(4000), 2))
    moved = collections.Counter(r.v for r in mlprep.split_stratified(one_key.repartition(5, "v"), "c", "k")[1].collect())
    assert moved == test
    assert [r.k for r in mlprep.sample_rows(frame, 3).collect()] == [0, 1, 2]
    drawn = [[r.k for r in mlprep.sample_rows(f, 5, "random").collect()] for f in (frame, frame.repartition(5))]
    assert drawn[0] == drawn[1] and mlprep.sample_rows(frame, 5, "head").count() == 5


def test_name_similarity(spark):
    names = ["customer_id", "customer id", "price", ""]
    found = {r.column: r.name_similarity for r in sketch.with_name_similarity(spark.createDataFrame([(n,) for n in names], "column string"), "customer_id").collect()}
    own, other = texts.hashed_ngrams(["customer_id"])[0], texts.hashed_ngrams(["price"])[0]
    assert found["customer_id"] == pytest.approx(1) and found["price"] == pytest.approx(float(own @ other)) and found[""] == 0


def test_quantiles_are_those_of_all_values(spark):
    make = random.Random(8)
    special = [0.0, -0.0, 1e300, -1e300, 5e-324, -5e-324, float("inf"), float("-inf"), 2.0**53, 0.1, None]
    rows = [(make.gauss(0, 1), make.randint(-3, 3), make.choice(special), 10**12 + i, None, 7.5) for i in range(3000)]
    frame = spark.createDataFrame(rows, "a double, `b.c` int, s double, big long, none double, same double").repartition(5)
    points = [i / 10 for i in range(11)] + [0.123]
    columns = ["a", "b.c", "s", "big", "none", "same"]
    expected = frame.agg(*[F.percentile(F.col(f"`{c}`"), points).alias(str(i)) for i, c in enumerate(columns)]).first()
    found = quantiles.exact_quantiles(frame, columns, points)
    for i, c in enumerate(columns):
        assert [x for x in found[c] if x == x] == [x for x in expected[i] or [] if x == x] and len(found[c]) == len(expected[i] or [])
    ranks = [0, 1, 1499, 2999]
    assert list(quantiles.select_ranks(frame, {"a": ranks})["a"].values()) == [sorted(r[0] for r in rows)[i] for i in ranks]
    assert quantiles.exact_quantiles(frame.where("same < 0"), ["a"], [0.5]) == {"a": []} and quantiles.exact_quantiles(frame, [], [0.5]) == {}
    nan = spark.createDataFrame([(float("nan"),), (1.0,), (-2.0,)], "x double")
    found = quantiles.exact_quantiles(nan, ["x"], [0.0, 0.5, 1.0])["x"]
    assert found[:2] == [-2.0, 1.0] and found[2] != found[2]


@pytest.mark.parametrize("strip", [7, 60, 10_000])
def test_distance_correlation_of_numbers_is_that_of_all_pairs(spark, strip):
    make = np.random.RandomState(4)
    normal, few = make.randn(400), make.randint(0, 4, 400)
    hot = np.where(make.rand(400) < 0.4, 1.5, normal)
    for x, y in ((normal, normal**2 + make.randn(400)), (few, hot), (hot, make.randint(0, 2, 400)), (normal + 1e6, -normal), (few, few)):
        a, b = (np.abs(np.subtract.outer(v, v)).astype(float) for v in (x, y))
        a, b = (d - d.mean(0) - d.mean(1)[:, None] + d.mean() for d in (a, b))
        expected = np.sqrt(max(0, (a * b).sum()) / np.sqrt((a * a).sum() * (b * b).sum()))
        frame = spark.createDataFrame([(float(p), float(q)) for p, q in zip(x, y)], "x double, y double").repartition(3)
        assert distance.distance_correlation_of_numbers(frame, strip) == pytest.approx(expected, abs=1e-9)


def test_rising_sums_are_those_of_all_lower_points():
    make = np.random.RandomState(6)
    for n in (1, 2, 3, 17, 64, 101):
        x, y, rows = make.permutation(n), make.randint(0, 5, n), make.rand(n, 2)
        lower = (x[None, :] < x[:, None]) & (y[None, :] < y[:, None])
        assert np.allclose(distance.rising(x, y, rows, strict=True), lower @ rows)
        once = make.permutation(n)
        lower = (x[None, :] < x[:, None]) & (once[None, :] < once[:, None])
        assert np.allclose(distance.rising(x, once, rows), lower @ rows)


@pytest.mark.parametrize("strip, groups, block", [(7, 1024, None), (60, 1024, None), (10_000, 30, None), (100, 2, 40), (100, 2, 1000)])
def test_distance_correlation_of_vectors_is_that_of_all_pairs(spark, strip, groups, block):
    make = np.random.RandomState(5)
    few, y = np.eye(6)[make.randint(0, 6, 500)], make.randn(500).round(1)
    many, hot = make.rand(500, 3), np.where(make.rand(500) < 0.5, 2.5, make.randn(500))
    column = lambda v: v.reshape(len(v), -1)
    for x, y in ((few, y), (few, few @ np.arange(6) + hot), (hot, few), (many, y), (many, few), (few, 0 * hot), (many + 1e4, many @ np.ones(3))):
        x, y = column(x), column(y)
        a, b = (np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1)) for v in (x, y))
        a, b = (d - d.mean(0) - d.mean(1)[:, None] + d.mean() for d in (a, b))
        expected = np.sqrt(max(0, (a * b).sum()) / np.sqrt((a * a).sum() * (b * b).sum())) if (b * b).sum() > 1e-20 else 0.0
        rows = collections.Counter(zip(map(tuple, x.tolist()), map(tuple, y.tolist())))
        points = spark.createDataFrame([(list(p), list(q), float(w)) for (p, q), w in rows.items()], "x array<double>, y array<double>, w double").repartition(3)
        assert distance.distance_correlation_of_points(points, strip, groups, block) == pytest.approx(expected, abs=1e-9)


def test_feature_table_of_more_rows_than_are_compared_in_pairs(spark):
    frame = spark.range(21_000).selectExpr("id k", "array(cast(id % 2 as double), 0D) x_vector", "cast(if(id < 20500, id % 3, id % 2 * 9) as double) y")
    found = assoc.feature_correlations(frame, ["k"], "y").first()
    x, y = np.arange(21_000) % 2, np.where(np.arange(21_000) < 20_500, np.arange(21_000) % 3, np.arange(21_000) % 2 * 9)
    expected = distance.distance_correlation_of_numbers(spark.createDataFrame([(float(p), float(q)) for p, q in zip(x, y)], "x double, y double"))
    assert (found.feature, found.metric) == ("x", "distance") and found.value == pytest.approx(expected, abs=1e-9)


def test_augmentation_keeps_each_keys_own_categories_only(spark, monkeypatch):
    query = spark.range(900).selectExpr("id k", "cast(id % 20 as double) y")
    lake = spark.range(1800).selectExpr("id % 900 j", "concat('c', id % 26) c", "cast(id as double) x")
    seen, plain = [], augment.feature_correlations
    monkeypatch.setattr(augment, "feature_correlations", lambda df, *a: seen.append(df.select(F.max(F.size("c_vector")), F.max(F.size("y_vector"))).first()) or plain(df, *a))
    found = {r.feature: r.value for r in augment.correlate(query, choices.Task.of("query", "k", "y"), lake, ["j"]).collect()}
    assert tuple(seen[0]) == (2, 1)
    wide = aggregate.aggregate_candidate(lake.withColumnRenamed("j", "k"), ["k"]).join(aggregate.aggregate_target(query, ["k"], "y")[0], "k")
    assert wide.select(F.size("c_vector"), F.size("y_vector")).first() == (26, 20)
    assert found == {r.feature: pytest.approx(r.value, abs=1e-9) for r in plain(wide, ["k"], "y").collect()} and set(found) == {"c", "x"}


def test_a_model_makes_its_table_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        made.add(1)
        return float(v)

    frame = spark.range(300).withColumn("x", counted("id")).withColumn("y", F.col("id") * 2.0)
    assert evaluate.evaluate(frame.select("x", "y"), "y", ["x"]).score == pytest.approx(1) and made.value == 300


def test_sketches_rank_only_the_hashes_that_may_be_kept(spark):
    values = sketch.long_values(spark.range(30_000).selectExpr("id a", "id % 7 b"), "t")
    made = sketch.bottom_k(values, 50, 0.01, 200)
    found = collections.defaultdict(list)
    for r in made.collect():
        found[r.column].append(r.hash)
    hashes = values.where("column = 'a'").select(keys.hash_prefix(keys.normalize_key(F.col("value"))).alias("h"))
    assert sorted(found["a"]) == [r.h for r in hashes.orderBy("h").limit(200).collect()] and len(found["b"]) == 7
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "edge" in plan[plan.index("row_number") :]
