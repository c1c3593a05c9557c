"""The registered queries, each with SQL for the same result where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joinwright.functions import keys, text, vectors
from joinwright.operators import aggregate, assoc, joins, mlprep, perturb, profile, sketch, texts
from joinwright.plans import augment, choices, evaluate
from joinwright.sources import catalog, sketch_index, tables

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


class Tables:
    """``t.orders`` is a table of the folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function of ``Tables`` under its name."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        _queries[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


# Keys and hashes. SQL for the forms that the tables have: whole numbers, plain texts and ISO dates.
def _norm(value: str) -> str:
    v = f"lower(trim(cast({value} AS VARCHAR)))"
    return f"""CASE WHEN {value} IS NULL OR {v} = '' THEN '__NA__'
      WHEN regexp_full_match({v}, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') THEN strftime(try_strptime({v}, '%Y-%m-%d'), '%Y-%m-%d')
      WHEN regexp_full_match({v}, '[+-]?[0-9]+(\\.0*)?') AND length({v}) < 16 THEN cast(cast(cast({v} AS DOUBLE) AS BIGINT) AS VARCHAR) ELSE {v} END"""


def _hash(value: str) -> str:
    return f"substr(sha256({_norm(value)}), 1, 16)"


@query(f"""SELECT o_orderkey, {_norm("o_custkey")} AS by_int, {_norm("' '||upper(o_orderstatus)||' '")} AS by_text, {_norm("cast(cast(o_orderdate AS DATE) AS VARCHAR)")} AS by_date,
  {_norm("nullif(o_orderstatus, 'P')")} AS by_null, {_norm("cast(o_orderkey AS VARCHAR)||'.0'")} AS by_decimal FROM orders""")
def key_normalize(t: Tables) -> DataFrame:
    status = F.col("o_orderstatus")
    forms = {
        "by_int": F.col("o_custkey"), "by_text": F.concat(F.lit(" "), F.upper(status), F.lit(" ")), "by_date": F.col("o_orderdate").cast("date").cast("string"),
        "by_null": F.nullif(status, F.lit("P")), "by_decimal": F.concat(F.col("o_orderkey").cast("string"), F.lit(".0")),
    }
    return t.orders.select("o_orderkey", *[keys.normalize_key(c).alias(n) for n, c in forms.items()])


@query(f"""SELECT c_custkey, {_hash("c_name")} AS prefix, cast(('0x'||{_hash("c_name")})::UBIGINT AS DECIMAL(20,0)) AS number,
  round(('0x'||{_hash("c_name")})::UBIGINT::DOUBLE / 18446744073709551615.0, 9) AS unit FROM customer""")
def hash_prefix(t: Tables) -> DataFrame:
    n = keys.normalize_key(F.col("c_name"))
    return t.customer.select("c_custkey", keys.hash_prefix(n).alias("prefix"), keys.hash_int(n).alias("number"), F.round(keys.hash_unit(n), 9).alias("unit"))


def _sketch(table: str, column: str, k: int) -> str:
    return f"""SELECT hash FROM (SELECT hash, row_number() OVER (ORDER BY hash) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT {_hash(column)} AS hash FROM {table}))
      WHERE r <= least(greatest(ceil(0.1 * n), 256, {k}), 10000)"""


@query(_sketch("orders", "o_custkey", 512))
def bottom_k_sketch(t: Tables) -> DataFrame:
    return sketch.sketch_table(t.orders, "orders", ["o_custkey"]).select("hash")


@query(f"""SELECT hash, value FROM (SELECT *, row_number() OVER (ORDER BY hash, value) AS r, count(*) OVER () AS n FROM
  (SELECT DISTINCT p_type AS value, {_hash("p_type")} AS hash FROM part WHERE p_type IS NOT NULL)) WHERE r <= least(greatest(ceil(0.1 * n), 256, 512), 10000)""")
def sketch_with_samples(t: Tables) -> DataFrame:
    return sketch.bottom_k_with_samples(sketch.long_values(t.part, "part", ["p_type"])).select("hash", "value")


@query(f"""WITH v AS ({" UNION ALL ".join(f"SELECT '{c}' AS column, {_hash(c)} AS hash FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))}),
  d AS (SELECT DISTINCT * FROM v), r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY hash) AS r, count(*) OVER (PARTITION BY "column") AS n FROM d)
  SELECT "column", count(*) AS size, min(hash) AS low, max(hash) AS high FROM r WHERE r <= least(greatest(ceil(0.1 * n), 256, 512), 10000) GROUP BY 1""")
def sketch_all_columns(t: Tables) -> DataFrame:
    made = sketch.sketch_table(t.customer, "customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])
    return made.groupBy("column").agg(F.count("*").alias("size"), F.min("hash").alias("low"), F.max("hash").alias("high"))


_PAIR = f"""WITH q AS ({_sketch("orders", "o_custkey", 512)}), c AS ({_sketch("customer", "c_custkey", 1024)}), x AS (SELECT
  (SELECT count(*) FROM q JOIN c USING (hash)) AS shared, (SELECT count(*) FROM q) AS a, (SELECT count(*) FROM c) AS b)"""


def _pair(t: Tables) -> DataFrame:
    return sketch.scores(sketch.sketch_table(t.orders, "orders", ["o_custkey"]), sketch.sketch_table(t.customer, "customer", ["c_custkey"], 1024))


@query(f"{_PAIR} SELECT shared, round(shared / (a + b - shared), 6) AS jaccard FROM x")
def sketch_jaccard(t: Tables) -> DataFrame:
    return _pair(t).select("shared", r6("jaccard").alias("jaccard"))


@query(f"{_PAIR} SELECT shared, round(shared / a, 6) AS containment FROM x")
def sketch_containment(t: Tables) -> DataFrame:
    return _pair(t).select("shared", r6("containment").alias("containment"))


_LAKE = (("customer", "c_custkey"), ("customer", "c_nationkey"), ("supplier", "s_suppkey"), ("supplier", "s_nationkey"), ("part", "p_partkey"), ("part", "p_size"))


def _scored(name: str, query_: str, lake) -> str:
    values = " UNION ALL ".join(f"SELECT '{a}' AS table_id, '{b}' AS col, {_hash(b)} AS hash FROM {a}" for a, b in lake)
    return f"""{name} AS (WITH q AS ({query_}), v AS (SELECT DISTINCT * FROM ({values})),
      s AS (SELECT *, row_number() OVER (PARTITION BY table_id, col ORDER BY hash) AS r, count(*) OVER (PARTITION BY table_id, col) AS n FROM v),
      c AS (SELECT * FROM s WHERE r <= least(greatest(ceil(0.1 * n), 256, 1024), 10000))
      SELECT table_id, col AS "column", count(q.hash) AS shared, count(q.hash) / (count(*) + (SELECT count(*) FROM q) - count(q.hash)) AS jaccard,
      count(q.hash) / (SELECT count(*) FROM q) AS containment FROM c LEFT JOIN q USING (hash) GROUP BY 1, 2 HAVING count(q.hash) > 0)"""


@query(f"""WITH {_scored("z", _sketch("orders", "o_custkey", 512), _LAKE)}, y AS (SELECT *, greatest(jaccard, containment) AS score FROM z)
  SELECT table_id, "column", round(score, 6) AS score, row_number() OVER (PARTITION BY table_id ORDER BY score DESC, "column") AS rank FROM y WHERE score >= 0.1
  QUALIFY rank <= 5""")
def join_column_topk(t: Tables) -> DataFrame:
    lake = {a: getattr(t, a).select(*[b for x, b in _LAKE if x == a]) for a in ("customer", "supplier", "part")}
    return sketch.propose_join_columns(t.orders, ["o_custkey"], lake).select("table_id", "column", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@query(_sql["join_column_topk"])
def join_column_index(t: Tables) -> DataFrame:
    """The same from a kept index: two tables, then another, and then a changed one in place of what the index had."""
    lake = {a: getattr(t, a).select(*[b for x, b in _LAKE if x == a]) for a in ("customer", "supplier", "part")}
    index = sketch_index.SketchIndex(t.spark, tables.shared_path(t.spark, "sketch_index"))
    index.add({"customer": lake["customer"], "part": lake["part"].where("p_partkey % 2 = 0")}, {"customer": "1", "part": "1"})
    index.add({"supplier": lake["supplier"]}, {"supplier": "1"})
    index.add({x: lake[x] for x in index.stale({"customer": "1", "supplier": "1", "part": "2"})}, {"part": "2"})
    return index.propose(t.orders, ["o_custkey"]).select("table_id", "column", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_scored("a", _sketch("lineitem", "l_partkey", 512), _LAKE)}, {_scored("b", _sketch("lineitem", "l_suppkey", 512), _LAKE)}
  SELECT query_column, table_id, round(max(greatest(jaccard, containment)), 6) AS best FROM (SELECT 'l_partkey' AS query_column, * FROM a UNION ALL SELECT 'l_suppkey', * FROM b)
  WHERE greatest(jaccard, containment) >= 0.1 GROUP BY 1, 2""")
def join_column_composite(t: Tables) -> DataFrame:
    lake = {a: getattr(t, a).select(*[b for x, b in _LAKE if x == a]) for a in ("customer", "supplier", "part")}
    found = sketch.propose_join_columns(t.lineitem, ["l_partkey", "l_suppkey"], lake)
    return found.groupBy("query_column", "table_id").agg(r6(F.max("score")).alias("best"))


@query("""WITH k AS (SELECT DISTINCT lower(trim(cast(o_custkey AS VARCHAR))) AS v FROM orders), u AS (UNPIVOT (SELECT cast(c_custkey AS VARCHAR) AS c_custkey, c_name,
  cast(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM customer) ON c_custkey, c_name, c_nationkey, c_mktsegment INTO NAME col VALUE v),
  d AS (SELECT DISTINCT col, lower(trim(v)) AS v FROM u), s AS (SELECT col, count(*) AS size, count(k.v) AS shared FROM d LEFT JOIN k USING (v) GROUP BY 1)
  SELECT col AS "column", round(shared / (size + (SELECT count(*) FROM k) - shared), 6) AS jaccard, round(shared / (SELECT count(*) FROM k), 6) AS query_in_candidate,
  round(shared / size, 6) AS candidate_in_query, round((SELECT count(DISTINCT v) / count(*) FROM u WHERE u.col = s.col), 6) AS uniqueness, 0.0 AS missing FROM s""")
def exact_overlap_stats(t: Tables) -> DataFrame:
    found = sketch.overlap_statistics(t.orders, F.col("o_custkey"), t.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), "customer")
    return found.select("column", *[r6(c).alias(c) for c in ("jaccard", "query_in_candidate", "candidate_in_query", "uniqueness", "missing")])


@query("""WITH k AS (SELECT DISTINCT lower(trim(cast(o_custkey AS VARCHAR))) AS v FROM orders), u AS (UNPIVOT (SELECT cast(c_custkey AS VARCHAR) AS c_custkey, c_name,
  cast(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM customer) ON c_custkey, c_name, c_nationkey, c_mktsegment INTO NAME col VALUE v),
  d AS (SELECT DISTINCT col, lower(trim(v)) AS v FROM u), s AS (SELECT col, count(*) AS size, count(k.v) AS shared FROM d LEFT JOIN k USING (v) GROUP BY 1)
  SELECT col AS "column", round((SELECT count(DISTINCT v) / count(*) FROM u WHERE u.col = s.col), 6) AS uniqueness, 0.0 AS missing FROM s
  ORDER BY greatest(shared / (SELECT count(*) FROM k), shared / size) DESC, col LIMIT 3""")
def overlap_top(t: Tables) -> DataFrame:
    found = sketch.overlap_statistics(t.orders, F.col("o_custkey"), t.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), "customer")
    return sketch.top_overlaps(found, 3).select("column", *[r6(c).alias(c) for c in ("uniqueness", "missing")])


@query()
def column_name_similarity(t: Tables) -> DataFrame:
    columns = catalog.columns_of(catalog.catalog_of(t.spark, {n: getattr(t, n) for n in ("customer", "supplier", "nation")}))
    found = sketch.with_name_similarity(columns, "c_nationkey")
    return found.select("table_id", "column", r6("name_similarity").alias("name_similarity"))


@query("""SELECT l_returnflag, count(*) AS n, cast(CASE WHEN count(*) > 1 THEN round(0.3 * count(*)) ELSE 0 END AS BIGINT) AS n_test,
  count(DISTINCT l_orderkey * 10 + l_linenumber) AS n_rows, cast(sum(l_orderkey * 10 + l_linenumber) AS BIGINT) AS row_sum FROM lineitem GROUP BY 1""")
def stratified_split(t: Tables) -> DataFrame:
    """Several lines have the same key; a line in both parts or in neither changes the number and the sum of the rows."""
    lines = t.lineitem.select("l_returnflag", "l_orderkey", "l_linenumber", "l_quantity")
    train, test = mlprep.split_stratified(lines, "l_returnflag", "l_orderkey")
    both = train.withColumn("test", F.lit(0)).union(test.withColumn("test", F.lit(1))).withColumn("row", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    # Nearly all rows differ: dealt by row first, about a million to a task, no task holds those of a whole file split.
    parts = max(int(t.spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // 1_000_000))
    both = both.select("l_returnflag", "row", "test").repartition(parts, "l_returnflag", "row")
    return both.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("test").alias("n_test"), F.countDistinct("row").alias("n_rows"), F.sum("row").alias("row_sum"))


@query("SELECT l_linenumber, l_quantity, l_orderkey FROM lineitem ORDER BY ALL LIMIT 100")
def sampled_rows(t: Tables) -> DataFrame:
    """A sampling operator: its limit is the feature."""
    return mlprep.sample_rows(t.lineitem.select("l_linenumber", "l_quantity", "l_orderkey"), 100)


_TOKENS = "list_distinct(list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda x: length(x) > 1))"


@query(f"""WITH a AS (SELECT p_partkey, {_TOKENS.format("p_name")} AS x, {_TOKENS.format("p_type || ' ' || p_brand || ' small ring'")} AS y FROM part)
  SELECT p_partkey, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS jaccard FROM a""")
def token_jaccard(t: Tables) -> DataFrame:
    other = F.concat_ws(" ", "p_type", "p_brand", F.lit("small ring"))
    return t.part.select("p_partkey", r6(text.token_jaccard(text.tokens(F.col("p_name")), text.tokens(other))).alias("jaccard"))


# Profiles
@query("""WITH e AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'n/a' ELSE regexp_extract(props, '[0-9]+') END AS mostly, CASE WHEN event_id % 3 = 0 THEN '7' ELSE event_type END AS rarely FROM events)
  SELECT 'mostly' AS "column", count(mostly) AS n_values, count(try_cast(mostly AS DOUBLE)) AS n_numbers, count(try_cast(mostly AS DOUBLE)) >= 0.5 * count(mostly) AS numeric FROM e
  UNION ALL SELECT 'rarely', count(rarely), count(try_cast(rarely AS DOUBLE)), count(try_cast(rarely AS DOUBLE)) >= 0.5 * count(rarely) FROM e""")
def numeric_coercion_profile(t: Tables) -> DataFrame:
    third = F.col("event_id") % 3 == 0
    e = t.events.select(F.when(third, "n/a").otherwise(F.regexp_extract("props", "[0-9]+", 0)).alias("mostly"), F.when(third, "7").otherwise(F.col("event_type")).alias("rarely"))
    numeric = [c for c, kind in profile.convert_numeric_columns(e).dtypes if kind == "double"]
    return profile.profile(e).select("column", "n_values", "n_numbers", F.col("column").isin(*numeric).alias("numeric"))


def _classes(table: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{table}' AS table_id, '{c}' AS "column", CASE WHEN count(DISTINCT {c}) <= 1 THEN 'ignore' WHEN count(DISTINCT {c}) = 2 THEN 'numerical'
      WHEN count(DISTINCT {c}) / count(*) < 0.03 THEN 'categorical' WHEN '{kind}' IN ('number', 'checkbox') THEN 'numerical' WHEN '{kind}' = 'text' THEN 'text' ELSE 'ignore' END AS class FROM {table}"""
        for c, kind in columns.items()
    )


_KINDS = {
    "part": {"p_partkey": "number", "p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "number", "p_retailprice": "number"},
    "lineitem": {"l_orderkey": "number", "l_partkey": "number", "l_quantity": "number", "l_returnflag": "text", "l_linestatus": "text", "l_shipdate": "calendar date"},
    "events": {"event_id": "number", "ts": "calendar date", "user_id": "number", "event_type": "text", "value": "number", "props": "text"},
}


@query(" UNION ALL ".join(_classes(a, b) for a, b in _KINDS.items()))
def column_classes(t: Tables) -> DataFrame:
    parts = [profile.classify_columns(getattr(t, a).select(*b), b).select(F.lit(a).alias("table_id"), "column", "class") for a, b in _KINDS.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", CASE WHEN count(DISTINCT {c}) <= {20 if n else 100} THEN 'categorical' ELSE '{'numerical' if n else 'text'}' END AS type FROM part"""
  for c, n in {"p_partkey": 1, "p_name": 0, "p_brand": 0, "p_type": 0, "p_size": 1, "p_retailprice": 1}.items()))
def detected_types(t: Tables) -> DataFrame:
    return profile.detect_types(t.part)


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", round(100.0 * count(DISTINCT {c}) / count(*), 2) AS uniqueness FROM orders"""
  for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")))
def uniqueness_ratio(t: Tables) -> DataFrame:
    return profile.uniqueness(t.orders)


@query("SELECT 'customer' AS table_id, 'c_custkey' AS key UNION ALL SELECT 'orders', 'o_orderkey' UNION ALL SELECT 'nation', 'n_nationkey' UNION ALL SELECT 'lineitem', NULL")
def primary_key(t: Tables) -> DataFrame:
    found = [(n, profile.primary_key(getattr(t, n).drop("l_extendedprice"))) for n in ("customer", "orders", "nation", "lineitem")]
    return t.spark.createDataFrame(found, "table_id string, key string")


@query("""SELECT s AS separator, round(avg(CASE WHEN len(list_filter(string_split(v, s), lambda x: trim(x) <> '')) > 1 THEN 1.0 ELSE 0.0 END), 6) AS share
  FROM (SELECT replace(p_name, ' ', CASE WHEN p_partkey % 5 = 0 THEN '|' ELSE ',' END) AS v FROM part), (VALUES ('|'), (',')) x(s) GROUP BY 1""")
def separator_detect(t: Tables) -> DataFrame:
    v = F.replace("p_name", F.lit(" "), F.when(F.col("p_partkey") % 5 == 0, "|").otherwise(","))
    return profile.separator_shares(t.part.select(v.alias("v")), "v").select("separator", r6("share").alias("share"))


@query("SELECT 'orders' AS table_id, 'o_orderdate' AS \"column\" UNION ALL SELECT 'lineitem', 'l_shipdate' UNION ALL SELECT 'events', 'ts'")
def date_columns(t: Tables) -> DataFrame:
    found = [(n, c) for n in ("orders", "lineitem", "events") for c in profile.date_columns(getattr(t, n))]
    return t.spark.createDataFrame(found, "table_id string, `column` string")


@query("SELECT 'o_custkey' AS \"column\", 1 AS role UNION ALL SELECT 'o_totalprice', 0 UNION ALL SELECT unnest(['o_orderkey', 'o_orderstatus', 'o_orderdate', 'o_orderpriority']), 2")
def column_roles(t: Tables) -> DataFrame:
    columns = catalog.columns_of(catalog.catalog_of(t.spark, {"orders": t.orders})).select("column")
    return profile.roles(columns, " O_TotalPrice", ["O_CUSTKEY "])


@query("SELECT ['c_acctbal', 'c_mktsegment'] AS only_header, ['c_phone'] AS only_metadata")
def header_differences(t: Tables) -> DataFrame:
    described = F.array(*[F.lit(c) for c in ("c_custkey", "c_name", "c_nationkey", "c_phone")])
    a, b = profile.column_differences(F.array(*[F.lit(c) for c in t.customer.columns]), described)
    return t.spark.range(1).select(F.sort_array(a).alias("only_header"), F.sort_array(b).alias("only_metadata"))


# Joins
_UP = "coalesce(upper(trim(cast({0} AS VARCHAR))), 'NAN')"


@query(f"""SELECT c_custkey, n_name FROM customer JOIN (SELECT n_name, CASE WHEN n_nationkey % 2 = 0 THEN ' '||n_nationkey ELSE n_nationkey||' ' END AS key FROM nation) n
  ON {_UP.format("c_nationkey")} = {_UP.format("key")}""")
def join_inner_normalized(t: Tables) -> DataFrame:
    n = F.col("n_nationkey").cast("string")
    nation = t.nation.select("n_name", F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit(" "), n)).otherwise(F.concat(n, F.lit(" "))).alias("key"))
    return joins.join_normalized(t.customer, nation, ["c_nationkey"], ["key"]).select("c_custkey", "n_name")


@query("""WITH e AS (SELECT event_id, nullif(event_type, 'click') AS k FROM events), g AS (SELECT k, count(*) AS n FROM e GROUP BY 1) SELECT event_id, n FROM e JOIN g ON e.k IS NOT DISTINCT FROM g.k""")
def join_inner_nullsafe(t: Tables) -> DataFrame:
    e = t.events.select("event_id", F.nullif("event_type", F.lit("click")).alias("k"))
    return joins.join_nullsafe(e, e.groupBy("k").agg(F.count("*").alias("n")), ["k"]).select("event_id", "n")


@query("""SELECT o_orderkey, o_custkey, c.c_name, c.o_orderstatus AS o_orderstatus_customer FROM orders o LEFT JOIN
  (SELECT c_nationkey, c_name, c_mktsegment AS o_orderstatus, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer) c ON o.o_custkey = c.c_nationkey AND r = 1""")
def join_left_dedup(t: Tables) -> DataFrame:
    right = t.customer.select(F.col("c_nationkey").alias("o_custkey"), "c_custkey", "c_name", F.col("c_mktsegment").alias("o_orderstatus"))
    joined = joins.join_left_dedup(t.orders, right, ["o_custkey"], ["c_custkey"], "customer")
    return joined.select("o_orderkey", "o_custkey", "c_name", "o_orderstatus_customer")


@query("""WITH a AS (SELECT l_orderkey % 1000 AS k, sum(l_quantity) AS quantity FROM lineitem WHERE l_orderkey % 1000 < 700 GROUP BY 1),
  b AS (SELECT o_orderkey % 1000 AS k, count(*) AS orders FROM orders WHERE o_orderkey % 1000 > 300 GROUP BY 1) SELECT k, quantity, orders FROM a FULL JOIN b USING (k)""")
def merge_outer(t: Tables) -> DataFrame:
    a = t.lineitem.select((F.col("l_orderkey") % 1000).alias("k"), "l_quantity").where("k < 700").groupBy("k").agg(F.sum("l_quantity").alias("quantity"))
    b = t.orders.select((F.col("o_orderkey") % 1000).alias("k")).where("k > 300").groupBy("k").agg(F.count("*").alias("orders"))
    return joins.merge_outer([a, b], ["k"])


_FOLD = "trim(lower(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}]', ' ', 'g')))"
_MUTATED = "CASE WHEN n_nationkey % 3 = 0 THEN lower(n_name) || '.' WHEN n_nationkey % 3 = 1 THEN replace(n_name, 'I', 'Y') ELSE 'x' || substr(n_name, 1, 3) END"


@query(f"""WITH q AS (SELECT DISTINCT n_name AS q, {_FOLD.format("n_name")} AS f FROM nation), c AS (SELECT DISTINCT k AS c, {_FOLD.format("k")} AS f FROM (SELECT {_MUTATED} AS k FROM nation)),
  p AS (SELECT c.c AS candidate, q.q AS query, (1 - levenshtein(c.f, q.f) / greatest(length(c.f), length(q.f))) * 100 AS score FROM c, q)
  SELECT candidate, query, round(score, 6) AS score FROM p WHERE score >= 80 QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY score DESC, query) = 1""")
def join_fuzzy(t: Tables) -> DataFrame:
    n, name = F.col("n_nationkey") % 3, F.col("n_name")
    mutated = F.when(n == 0, F.concat(F.lower(name), F.lit("."))).when(n == 1, F.replace(name, F.lit("I"), F.lit("Y"))).otherwise(F.concat(F.lit("x"), F.substring(name, 1, 3)))
    return joins.fuzzy_map(t.nation.select("n_name"), t.nation.select(mutated.alias("k"))).select("candidate", "query", r6("score").alias("score"))


@query()
def join_fuzzy_weighted(t: Tables) -> DataFrame:
    other = t.nation.select(F.concat_ws(" ", F.lit("the"), F.lower("n_name")).alias("n_name"), "n_regionkey")
    return joins.join_fuzzy(t.nation.select("n_nationkey", "n_name"), other, "n_name", 60.0, "weighted")


@query("SELECT o_orderkey FROM orders SEMI JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') c ON o_custkey = c_custkey")
def semi_filter(t: Tables) -> DataFrame:
    chosen = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return joins.semi_filter(t.orders, chosen, ["o_custkey"]).select("o_orderkey")


@query("SELECT c_custkey FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') o ON c_custkey = o_custkey")
def anti_filter(t: Tables) -> DataFrame:
    done = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.anti_filter(t.customer, done, ["c_custkey"]).select("c_custkey")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 1.5 WHEN 'view' THEN 0.5 END AS weight FROM events")
def lookup_join(t: Tables) -> DataFrame:
    return joins.lookup_join(t.events, "event_type", {"weight": {"click": 1.5, "view": 0.5}}, {"weight": "double"}).select("event_id", F.col("weight").cast("decimal(2,1)").alias("weight"))


@query("""WITH m AS (SELECT (SELECT count(*) FROM orders) AS b1, (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey) AS m1,
  (SELECT count(*) FROM orders JOIN lineitem ON o_orderkey = l_orderkey) AS m2, (SELECT count(*) FROM orders JOIN region ON o_orderpriority = r_name) AS m3)
  SELECT 'customer' AS side, b1 AS base_rows, m1 AS merged_rows, round(m1 / b1, 6) AS match_rate, 'ok' AS reason FROM m UNION ALL
  SELECT 'lineitem', b1, m2, round(m2 / b1, 6), 'rows multiply' FROM m UNION ALL SELECT 'region', b1, m3, round(m3 / b1, 6), 'match rate too low' FROM m""")
def join_validation(t: Tables) -> DataFrame:
    found = []
    for name, left, right in (("customer", "o_custkey", "c_custkey"), ("lineitem", "o_orderkey", "l_orderkey"), ("region", "o_orderpriority", "r_name")):
        r = joins.validate_join(t.orders, getattr(t, name), [left], [right])
        found.append((name, r.base_rows, r.merged_rows, round(r.match_rate, 6), r.reason))
    return t.spark.createDataFrame(found, "side string, base_rows long, merged_rows long, match_rate double, reason string")


@query("""WITH q AS (SELECT DISTINCT o_custkey AS k FROM orders), c AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 0)
  SELECT count(*) AS query_keys, count(c.k) AS matched_keys, round(count(c.k) / count(*), 6) AS coverage FROM q LEFT JOIN c USING (k)""")
def join_coverage(t: Tables) -> DataFrame:
    right = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return joins.join_coverage(t.orders, right, "o_custkey").select("query_keys", "matched_keys", r6("coverage").alias("coverage"))


@query("""SELECT 'o_custkey' AS "column", 0 AS differing UNION ALL SELECT 'o_orderdate', 0 UNION ALL SELECT 'o_orderpriority', 0 UNION ALL SELECT 'o_orderstatus', 0
  UNION ALL SELECT 'o_totalprice', count(*) FILTER (o_orderkey % 10 = 0) FROM orders""")
def decompose_rejoin_equal(t: Tables) -> DataFrame:
    features, labels = joins.decompose(t.orders, ["o_orderkey"], "o_totalprice")
    changed = labels.withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") % 10 == 0, 0.01).otherwise(1e-7))
    return joins.table_differences(t.orders, joins.rejoin(features, changed, ["o_orderkey"]), "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY min(o_orderkey), o_custkey LIMIT 500)")
def topn_keys_filter(t: Tables) -> DataFrame:
    return joins.top_keys_filter(t.orders, "o_custkey", "o_orderkey").select("o_orderkey")


# Aggregation
@query("SELECT l_partkey, round(avg(l_quantity), 9) AS l_quantity, round(avg(l_tax), 9) AS l_tax FROM lineitem GROUP BY 1")
def agg_numeric_by_key(t: Tables) -> DataFrame:
    found = aggregate.aggregate_numeric(t.lineitem, ["l_partkey"], ["l_quantity", "l_tax"])
    return found.select("l_partkey", *[F.round(c, 9).alias(c) for c in ("l_quantity", "l_tax")])


@query(f"""SELECT l_suppkey, {", ".join(f"{sql} AS {name}" for name, sql in {"a_sum": "round(sum(l_quantity), 4)", "a_min": "min(l_quantity)", "a_max": "max(l_quantity)",
  "a_median": "median(l_quantity)", "a_count": "count(l_quantity)", "a_std": "round(stddev_samp(l_quantity), 6)"}.items())} FROM lineitem GROUP BY 1""")
def agg_numeric_functions(t: Tables) -> DataFrame:
    parts = [aggregate.aggregate_numeric(t.lineitem, ["l_suppkey"], ["l_quantity"], f).withColumnRenamed("l_quantity", f"a_{f}") for f in ("sum", "min", "max", "median", "count", "std")]
    return joins.merge_outer(parts, ["l_suppkey"]).withColumns({"a_sum": F.round("a_sum", 4), "a_std": r6("a_std")})


@query("""WITH v AS (SELECT list(c ORDER BY c) AS cs FROM (SELECT DISTINCT l_returnflag AS c FROM lineitem)), n AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2),
  m AS (SELECT l_suppkey, map_from_entries(list((l_returnflag, n))) AS m, sum(n) AS t FROM n GROUP BY 1)
  SELECT l_suppkey, list_transform(cs, lambda c: round(coalesce(m[c], 0) / t, 6)) AS l_returnflag_vector, cs AS l_returnflag_categories FROM m, v""")
def agg_category_vector(t: Tables) -> DataFrame:
    found = aggregate.aggregate_category_vector(t.lineitem, ["l_suppkey"], "l_returnflag")
    return found.withColumn("l_returnflag_vector", F.transform("l_returnflag_vector", r6))


@query(f"""SELECT l_suppkey, {", ".join(f"round(avg(CASE WHEN l_returnflag = '{c}' THEN 1.0 ELSE 0.0 END), 6) AS l_returnflag_{c}" for c in "ANR")} FROM lineitem GROUP BY 1""")
def agg_category_onehot(t: Tables) -> DataFrame:
    found = aggregate.aggregate_category_onehot(t.lineitem, ["l_suppkey"], "l_returnflag")
    return found.select("l_suppkey", *[r6(c).alias(c) for c in found.columns[1:]])


@query("SELECT l_suppkey, round(avg(l_quantity), 9) AS l_quantity, 'numerical' AS kind FROM lineitem GROUP BY 1")
def agg_target(t: Tables) -> DataFrame:
    found, kind = aggregate.aggregate_target(t.lineitem, ["l_suppkey"], "l_quantity", "numerical")
    return found.select("l_suppkey", F.round("l_quantity", 9).alias("l_quantity"), F.lit(kind).alias("kind"))


@query("SELECT l_orderkey, round(avg(CASE l_linestatus WHEN 'F' THEN 0.0 WHEN 'O' THEN 1.0 END), 6) AS l_linestatus FROM lineitem GROUP BY 1")
def agg_binary_target(t: Tables) -> DataFrame:
    found, _ = aggregate.aggregate_target(t.lineitem, ["l_orderkey"], "l_linestatus")
    return found.select("l_orderkey", r6("l_linestatus").alias("l_linestatus"))


@query()
def agg_text_by_key(t: Tables) -> DataFrame:
    lines = t.documents.select("lang", "source", F.explode(F.split("text", "\n")).alias("line"))
    return aggregate.aggregate_text(lines, ["lang", "source"], "line")


@query()
def agg_candidate(t: Tables) -> DataFrame:
    return aggregate.aggregate_candidate(t.part.drop("p_partkey"), ["p_brand"])


@query("""SELECT user_id % 10 AS tau, """ + ", ".join(f"max_by(CASE WHEN event_type = '{c}' THEN value END, CASE WHEN event_type = '{c}' THEN event_id END) AS event_type_{c}" for c in ("click", "view")) + """
  FROM (SELECT * FROM events WHERE event_type IN ('click', 'view')) GROUP BY 1""")
def experiment_pivot(t: Tables) -> DataFrame:
    log = t.events.where("event_type in ('click', 'view')").withColumn("tau", F.col("user_id") % 10)
    return aggregate.pivot_latest(log, "tau", "event_type", "value", "event_id", ["click", "view"])


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'replaced' ELSE event_type END AS event_type, value FROM events")
def log_replace(t: Tables) -> DataFrame:
    new = t.events.where("event_id % 7 = 0").select("event_id", F.lit("replaced").alias("event_type"), "value")
    new = new.union(t.spark.createDataFrame([(-1, "never inserted", 0.0)], new.schema))
    return tables.replace_entries(t.events.select("event_id", "event_type", "value"), new, ["event_id"])


@query("SELECT count(*) AS n, round(avg(value), 6) AS mean, max(value) AS max, min(value) AS min FROM events")
def run_summary(t: Tables) -> DataFrame:
    return aggregate.run_summary(t.events, "value").withColumn("mean", r6("mean"))


@query("""WITH m AS (SELECT list(m ORDER BY i) AS mean FROM (SELECT i, avg(x) AS m FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id % 5 <> 0) GROUP BY i))
  SELECT vec_id, """ + ", ".join(f"round(CASE WHEN vec_id % 5 = 0 THEN mean[{i + 1}] ELSE embedding[{i + 1}]::DOUBLE END, 5) AS v_{i}" for i in range(4)) + " FROM embeddings, m")
def vector_expand_impute(t: Tables) -> DataFrame:
    e = t.embeddings.select("vec_id", F.when(F.col("vec_id") % 5 != 0, F.col("embedding").cast("array<double>")).alias("v"))
    found = aggregate.expand_vector(aggregate.impute_vectors(e, "v"), "v", 4)
    return found.select("vec_id", *[F.round(c, 5).alias(c) for c in found.columns[1:]])


# Association
@query("""SELECT unnest(['l_discount', 'l_extendedprice', 'l_quantity', 'l_tax']) AS feature, 'pearson' AS metric, unnest([round(corr(l_discount, l_extendedprice), 6), 1.0,
  round(corr(l_quantity, l_extendedprice), 6), round(corr(l_tax, l_extendedprice), 6)]) AS value, 'numerical' AS feature_type FROM lineitem""")
def pearson_features(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice", F.col("l_extendedprice").alias("y"))
    found = assoc.feature_correlations(lines, ["l_orderkey"], "y")
    return found.withColumn("value", r6("value"))


@query("""WITH s AS (SELECT s_suppkey AS i, s_nationkey AS x, s_acctbal AS y FROM supplier), p AS (SELECT a.i, b.i AS j, abs(a.x - b.x) AS p, abs(a.y - b.y) AS q FROM s a, s b),
  c AS (SELECT p - avg(p) OVER (PARTITION BY i) - avg(p) OVER (PARTITION BY j) + avg(p) OVER () AS p, q - avg(q) OVER (PARTITION BY i) - avg(q) OVER (PARTITION BY j) + avg(q) OVER () AS q FROM p)
  SELECT round(sqrt(avg(p * q) / sqrt(avg(p * p) * avg(q * q))), 6) AS value FROM c""")
def distance_correlation(t: Tables) -> DataFrame:
    return assoc.distance_correlation(t.supplier, "s_nationkey", "s_acctbal").select(r6("value").alias("value"))


@query("""SELECT round(corr(list_avg(embedding::DOUBLE[]), label), 6) AS value FROM embeddings""")
def text_association(t: Tables) -> DataFrame:
    e = t.embeddings
    mean = vectors.mean(F.col("embedding").cast("array<double>"))
    return assoc.pearson(e, [("text", mean, F.col("label"))]).select(r6("value").alias("value"))


@query()
def feature_table_mixed(t: Tables) -> DataFrame:
    parts = aggregate.aggregate_candidate(t.part.select("p_brand", "p_size", "p_retailprice", "p_type"), ["p_brand"])
    target, _ = aggregate.aggregate_target(t.part, ["p_brand"], "p_partkey")
    return assoc.feature_correlations(parts.join(target, "p_brand"), ["p_brand"], "p_partkey").withColumn("value", r6("value"))


@query("""WITH c AS (SELECT event_type AS feature, round(corr(value, user_id), 6) AS value FROM events GROUP BY 1) SELECT * FROM c ORDER BY value, feature LIMIT 3""")
def bottom_text(t: Tables) -> DataFrame:
    c = t.events.groupBy(F.col("event_type").alias("feature")).agg(r6(F.corr("value", "user_id")).alias("value"))
    return texts.lowest(c, 3)


# Preparation and models
@query("""WITH o AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS p FROM orders)
  SELECT o_orderkey, coalesce(s, 'Unknown') AS s, round(coalesce(p, avg(p) OVER ()), 3) AS p FROM o""")
def impute(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("s"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("p"))
    return mlprep.impute(o).select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "s", F.round("p", 3).alias("p"))


@query("SELECT c_custkey, c_name FROM customer")
def drop_null_cols(t: Tables) -> DataFrame:
    return mlprep.drop_null_columns(t.customer.select("c_custkey", F.lit(None).cast("double").alias("empty"), "c_name"))


@query("SELECT p_partkey, p_size FROM part WHERE p_size IN (SELECT p_size FROM part GROUP BY 1 HAVING count(*) >= 40)")
def rare_class_filter(t: Tables) -> DataFrame:
    return mlprep.drop_rare_classes(t.part.select("p_partkey", "p_size"), "p_size", 40)


@query("SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS p_brand FROM part")
def label_encode(t: Tables) -> DataFrame:
    return mlprep.label_encode(t.part.select("p_partkey", "p_brand"), "p_brand")


@query("SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) AS p_size, 0.0 AS one FROM part")
def standard_scale(t: Tables) -> DataFrame:
    found = mlprep.standard_scale(t.part.select("p_partkey", "p_size", F.lit(1).alias("one")), ["p_size", "one"])
    return found.select("p_partkey", r6("p_size").alias("p_size"), "one")


@query("SELECT o_orderkey FROM orders WHERE (o_orderkey % 3 = 0)::INT + (o_orderkey % 5 = 0)::INT = 0")
def sparse_rows(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, 1).alias("a"), F.when(F.col("o_orderkey") % 5 != 0, 1).alias("b"))
    return mlprep.drop_sparse_rows(o, ["a", "b"]).select("o_orderkey")


@query("""SELECT round(regr_slope(p_retailprice, p_size), 6) AS slope, round(regr_intercept(p_retailprice, p_size), 6) AS intercept, round(regr_r2(p_retailprice, p_size), 6) AS r2 FROM part""")
def linear_r2(t: Tables) -> DataFrame:
    x, y = "p_size", "p_retailprice"
    return t.part.agg(r6(F.regr_slope(y, x)).alias("slope"), r6(F.regr_intercept(y, x)).alias("intercept"), r6(F.regr_r2(y, x)).alias("r2"))


def _fitted(rows: str) -> str:
    """SQL of least squares by x1 (f0), and by x1 and x2 (f1), for each item of ``rows`` (item, key, x1, x2, y): trained on
    seven tenths of the keys, ``f`` has the others with what they are fitted to."""
    return f"""d AS (SELECT *, (('0x'||substr(md5('42:'||key), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 < 0.3 AS test FROM ({rows})),
  m AS (SELECT item, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(x1) AS v1, var_pop(x2) AS v2, covar_pop(x1, x2) AS c, covar_pop(x1, y) AS p1, covar_pop(x2, y) AS p2 FROM d WHERE NOT test GROUP BY 1),
  b AS (SELECT *, p1 / v1 AS b0, (p1 * v2 - p2 * c) / (v1 * v2 - c * c) AS b1, (p2 * v1 - p1 * c) / (v1 * v2 - c * c) AS b2 FROM m),
  f AS (SELECT item, y, my + b0 * (x1 - m1) AS f0, my + b1 * (x1 - m1) + b2 * (x2 - m2) AS f1 FROM d JOIN b USING (item) WHERE test),
  r AS (SELECT item, 1 - sum((y - f0) ** 2) / (var_pop(y) * count(*)) AS r0, 1 - sum((y - f1) ** 2) / (var_pop(y) * count(*)) AS r1, avg((y - f1) ** 2) AS mse, avg(abs(y - f1)) AS mae FROM f GROUP BY 1)"""


@query(f"""WITH {_fitted("SELECT 0 AS item, l_orderkey AS key, l_quantity::DOUBLE AS x1, l_discount::DOUBLE AS x2, l_extendedprice::DOUBLE AS y FROM lineitem")}
  SELECT 'regression' AS task, (SELECT count(*) FROM d) AS n_rows, round(r1, 6) AS r2, round(mse, 1) AS mse, round(mae, 3) AS mae FROM r""")
def linear_model(t: Tables) -> DataFrame:
    m = evaluate.evaluate(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice"), "l_extendedprice", ["l_quantity", "l_discount"], "regression", "l_orderkey")
    return t.spark.createDataFrame([(m.task, m.rows, *[round(m.details[k], d) for k, d in (("r2", 6), ("mse", 1), ("mae", 3))])], "task string, n_rows long, r2 double, mse double, mae double")


@query()
def classify_f1(t: Tables) -> DataFrame:
    d = t.documents.join(t.labels, "doc_id").select("doc_id", "n_chars", "lang", "source", "quality")
    m = evaluate.evaluate(d, "quality", ["n_chars", "lang", "source"], "classification", "doc_id")
    return t.spark.createDataFrame([(m.task, m.rows, m.score, m.details["accuracy"])], "task string, n_rows long, f1 double, accuracy double")


@query("""SELECT round(count(c_custkey) / count(*), 6) AS quality FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o_custkey = c_custkey""")
def integration_quality(t: Tables) -> DataFrame:
    q = evaluate.integration_quality(t.orders, t.customer.where("c_acctbal > 0"), ["o_custkey"], ["c_custkey"])
    return t.spark.createDataFrame([(round(q, 6),)], "quality double")


@query(f"""WITH o AS (SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderstatus) AS code, c_acctbal, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey),
  {_fitted("SELECT 0 AS item, o_orderkey AS key, code::DOUBLE AS x1, c_acctbal::DOUBLE AS x2, o_totalprice::DOUBLE AS y FROM o")},
  g AS (SELECT count(c_custkey) / count(*) AS quality FROM orders LEFT JOIN customer ON o_custkey = c_custkey)
  SELECT round(quality, 6) AS quality, round(r1 - r0, 6) AS importance, round(quality * (r1 - r0), 6) AS gain FROM r, g""")
def utility_gain(t: Tables) -> DataFrame:
    d = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    importance = evaluate.feature_importance(d, "o_totalprice", ["o_orderstatus", "c_acctbal"], "c_acctbal", key="o_orderkey")
    quality = evaluate.integration_quality(t.orders, t.customer, ["o_custkey"], ["c_custkey"])
    found = t.spark.createDataFrame([(quality, importance, evaluate.utility_gain(quality, importance))], "quality double, importance double, gain double")
    return found.select(*[r6(c).alias(c) for c in found.columns])


@query(f"""WITH p AS (SELECT *, dense_rank() OVER (ORDER BY p_type) AS type, dense_rank() OVER (ORDER BY p_brand) AS brand FROM part),
  {_fitted("SELECT unnest(['p_size', 'p_type', 'p_brand']) AS item, p_partkey AS key, p_partkey::DOUBLE AS x1, unnest([p_size, type, brand])::DOUBLE AS x2, p_retailprice::DOUBLE AS y FROM p")}
  SELECT item AS "column", round(r0, 6) AS baseline, round(r1, 6) AS score, round(r1 - r0, 6) AS difference, if(r1 - r0 >= 0.01, 'positive', 'negative') AS effect FROM r""")
def column_effect(t: Tables) -> DataFrame:
    features, labels = joins.decompose(t.part.drop("p_name"), ["p_partkey"], "p_retailprice")
    found = evaluate.column_effects(features, labels, ["p_partkey"], "p_retailprice", ["p_size", "p_type", "p_brand"])
    return found.withColumns({c: r6(c) for c in ("baseline", "score", "difference")})


_DECILES = "SELECT list_distinct(quantile_cont(l_extendedprice, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS e FROM lineitem"


@query(f"""WITH q AS (SELECT list_sort(e) AS e FROM ({_DECILES})) SELECT l_orderkey, l_linenumber, l_extendedprice, greatest(len(list_filter(e, lambda x: x < l_extendedprice)) - 1, 0) AS bin FROM lineitem, q""")
def quantile_bins(t: Tables) -> DataFrame:
    edges = mlprep.quantile_edges(t.lineitem, ["l_extendedprice"])["l_extendedprice"]
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", mlprep.bin_column(F.col("l_extendedprice"), edges).cast("long").alias("bin"))


@query("SELECT p_brand AS value, row_number() OVER (ORDER BY min(p_partkey), p_brand) AS id FROM part GROUP BY 1")
def category_ids(t: Tables) -> DataFrame:
    return mlprep.category_ids(t.part, "p_brand", "p_partkey").withColumn("id", F.col("id").cast("long"))


_ALL_WORDS = """list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '')"""
_WHOLE_VOCABULARY = f"""SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + 2 AS id FROM (SELECT token, count(*) AS n FROM (SELECT unnest({_ALL_WORDS}) AS token FROM documents)
  WHERE NOT regexp_full_match(token, '[0-9]+') GROUP BY 1) WHERE n >= 2"""


@query(_WHOLE_VOCABULARY)
def vocab(t: Tables) -> DataFrame:
    return mlprep.vocabulary(t.documents, "text")


@query(f"""WITH v AS ({_WHOLE_VOCABULARY}), d AS (SELECT doc_id, {_ALL_WORDS} AS words FROM documents), w AS (SELECT doc_id, unnest(words) AS token, generate_subscripts(words, 1) AS pos FROM d),
  e AS (SELECT doc_id, list(CASE WHEN regexp_full_match(token, '[0-9]+') THEN 2 ELSE coalesce(id, 1) END ORDER BY pos) AS text_ids FROM w LEFT JOIN v USING (token) GROUP BY 1)
  SELECT doc_id, coalesce(text_ids, []) AS text_ids FROM documents LEFT JOIN e USING (doc_id)""")
def encode_text(t: Tables) -> DataFrame:
    return mlprep.encode_whole_text(t.documents, ["doc_id"], "text", mlprep.vocabulary(t.documents, "text"))


# Texts and vectors
def _cosines(asking: DataFrame, embeddings: DataFrame, a_rows: int = 1024, b_rows: int = 2048) -> DataFrame:
    """Cosines of one side's rows with the other's of their labels. Each label's rows are dealt into blocks of about ``a_rows``
    and ``b_rows``, and each block of one side meets each of the other in one product of matrices, which a task holds."""
    a, b = (x.select(F.col("vec_id").alias(n), F.col("embedding").alias("e"), F.col("label").alias("label")) for n, x in (("a", asking), ("b", embeddings)))
    parts = [x.groupBy(F.col("label").alias("label")).agg(F.ceil(F.count("*") / most).alias(f"parts_{n}")) for n, x, most in (("a", a, a_rows), ("b", b, b_rows))]
    parts, keys = parts[0].join(parts[1], "label"), ["label", "part_a", "part_b"]
    tasks = 2 * int(asking.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(x: DataFrame, own: str, other: str) -> DataFrame:
        x = x.join(parts, "label").withColumn(f"part_{own}", F.pmod(F.xxhash64(own), F.col(f"parts_{own}")))
        x = x.withColumn(f"part_{other}", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"parts_{other}") - 1)))
        return x.select(*keys, own, "e").repartition(tasks, *keys).groupBy(*keys)  # a stated number, which is not coalesced

    kinds = [asking.schema["vec_id"].dataType.simpleString(), embeddings.schema["vec_id"].dataType.simpleString()]
    found = dealt(a, "a", "b").cogroup(dealt(b, "b", "a")).applyInArrow(vectors.cosine_block, f"a {kinds[0]}, b {kinds[1]}, cosine double")
    return found.select("a", "b", r6("cosine").alias("cosine"))


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(CASE WHEN a.vec_id = b.vec_id THEN 1.0 ELSE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) END, 6) AS cosine
  FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 20 = 0""")
def cosine_matrix(t: Tables) -> DataFrame:
    """The stated query set, ids divisible by 20, against all rows of their labels."""
    return _cosines(t.embeddings.where("vec_id % 20 = 0"), t.embeddings)


@query()
def greedy_coverage(t: Tables) -> DataFrame:
    return texts.text_subsets(t.part, ["p_type"], "p_name", 3).withColumn("n", F.size("texts"))


@query("SELECT p_type, count(DISTINCT p_name) AS n_texts, string_agg(DISTINCT p_name, ' | ' ORDER BY p_name) AS p_name_text FROM part GROUP BY 1")
def text_join_all(t: Tables) -> DataFrame:
    found = texts.text_subsets(t.part, ["p_type"], "p_name", None)
    return found.select("p_type", F.size("texts").cast("long").alias("n_texts"), F.array_join("texts", " | ").alias("p_name_text"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(text, '[.!?]\s') THEN regexp_extract(text, '^(?s:(.*?[.!?]))\s', 1) ELSE text END AS text_summary
  FROM (SELECT doc_id, trim(replace(coalesce(text, ''), chr(10), ' ')) AS text FROM documents)""")
def summaries(t: Tables) -> DataFrame:
    flat = t.documents.select("doc_id", F.trim(F.replace("text", F.lit("\n"), F.lit(" "))).alias("text"))
    return texts.summarize(flat, "text").select("doc_id", "text_summary")


@query("SELECT conv_id, turn, json_extract_string('{\"k\": ' || length(text) || '}', '$.k') AS k FROM conversations")
def json_from_text(t: Tables) -> DataFrame:
    answer = F.concat(F.lit("Sure, here it is: {'k': "), F.length("text").cast("string"), F.lit("} and so on"))
    found = text.extract_json(answer, "k")
    return t.conversations.select("conv_id", "turn", F.get_json_object(found, "$.k").alias("k"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_field(t: Tables) -> DataFrame:
    return t.events.select("event_id", text.json_field(F.concat(F.lit("props: "), F.col("props")), "k").alias("k"))


@query("""SELECT p_partkey, regexp_replace(regexp_replace(p_name, '\\bring\\b', 'band', 'gi'), '\\bSMALL\\b', 'tiny', 'gi') AS p_name FROM part""")
def synonym_replace(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.replace_words(F.col("p_name"), {"ring": "band", "SMALL": "tiny"}).alias("p_name"))


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...[truncated]' ELSE text END AS text FROM documents")
def truncated_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.truncated(F.col("text"), 80).alias("text"))


@query()
def text_embeddings(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.transform(texts.embed(F.col("text")), r6).alias("embedding"))


# Perturbation
_U = "(('0x'||substr(md5('{0}:'||p_partkey), 1, 13))::BIGINT + 0.5) / 4503599627370496.0"
_GAUSS = lambda seed: f"sqrt(-2 * ln({_U.format(seed)})) * cos(2 * pi() * {_U.format(seed + 1)})"


@query(f"""WITH s AS (SELECT stddev_samp(p_size) AS a, stddev_samp(p_retailprice) AS b FROM part)
  SELECT p_partkey, p_name, p_brand, p_type, round(p_size + 0.1 * a * {_GAUSS(42)}, 6) AS p_size, round(p_retailprice + 0.1 * b * {_GAUSS(44)}, 6) AS p_retailprice FROM part, s""")
def noise(t: Tables) -> DataFrame:
    noisy = perturb.add_noise(t.part, "p_partkey", 0.1, ["p_size", "p_retailprice"])
    return noisy.withColumns({c: r6(c) for c in ("p_size", "p_retailprice")})


@query("""WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) AS n, quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS iqr FROM lineitem),
  b AS (SELECT lo, hi, ceil((hi - lo) / (2 * iqr * pow(n, -1.0 / 3))) AS bins FROM s)
  SELECT l_orderkey, l_linenumber, l_extendedprice, cast(least(floor((l_extendedprice - lo) / ((hi - lo) / bins)), bins - 1) AS BIGINT) AS l_extendedprice_bin FROM lineitem, b""")
def fd_bins(t: Tables) -> DataFrame:
    return perturb.add_bins(t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice"), ["l_extendedprice"])


@query(f"""WITH c AS (SELECT p_partkey, row_number() OVER (ORDER BY {_U.format(42)}, p_partkey) AS rank FROM part QUALIFY rank <= (SELECT floor(0.6 * count(*)) FROM part)),
  m AS (SELECT p_partkey AS origin, row_number() OVER (ORDER BY {_U.format(49)}, p_partkey) AS rank FROM c)
  SELECT p.p_partkey, coalesce(g.p_size, p.p_size) AS p_size, coalesce(g.p_brand, p.p_brand) AS p_brand, p.p_retailprice FROM part p LEFT JOIN c USING (p_partkey) LEFT JOIN m USING (rank) LEFT JOIN part g ON g.p_partkey = origin""")
def joint_shuffle(t: Tables) -> DataFrame:
    return perturb.joint_shuffle(t.part.select("p_partkey", "p_size", "p_brand", "p_retailprice"), "p_partkey", "p_retailprice", 1.0, n_rows=int(0.6 * t.part.count()))


@query(f"""WITH s AS (SELECT stddev_samp(p_size) AS sd FROM part), v AS (SELECT p_partkey, p_brand, p_type, p_size + 0.7 * sd * {_GAUSS(42)} AS p_size, p_retailprice FROM part, s),
  c AS (SELECT p_partkey, row_number() OVER (ORDER BY {_U.format(42)}, p_partkey) AS rank FROM part QUALIFY rank <= (SELECT floor(0.7 * count(*)) FROM part)),
  m AS (SELECT p_partkey AS origin, row_number() OVER (ORDER BY {_U.format(49)}, p_partkey) AS rank FROM c)
  SELECT p.p_partkey, p.p_brand AS p_brand, coalesce(g.p_type, p.p_type) AS p_type, round(coalesce(g.p_size, p.p_size), 6) AS p_extent, p.p_retailprice FROM v p LEFT JOIN c USING (p_partkey) LEFT JOIN m USING (rank) LEFT JOIN v g ON g.p_partkey = origin""")
def perturbed_table(t: Tables) -> DataFrame:
    """Noise, a shuffle of two of the three features, and a renamed column."""
    found = perturb.perturb_table(t.part.drop("p_name"), "p_partkey", "p_retailprice", perturb.Perturbation(0.5, 0.7), {"p_size": "p_extent"})
    return found.withColumn("p_extent", r6("p_extent"))


@query("SELECT 25 AS cells, 0.0 AS low, 1.0 AS high")
def perturbation_grid(t: Tables) -> DataFrame:
    cells = perturb.grid([0.0, 0.25, 0.5, 0.75, 1.0], [0.0, 0.25, 0.5, 0.75, 1.0])
    made = t.spark.createDataFrame([(p.tau, p.beta) for p in cells], "tau double, beta double")
    return made.agg(F.count("*").alias("cells"), F.min("beta").cast("decimal(2,1)").alias("low"), F.max("tau").cast("decimal(2,1)").alias("high"))


_BETAS = (0.0, 0.5, 1.0)


@query(" UNION ALL ".join(f"""SELECT {tau} AS tau, {b} AS beta, {1.0 if tau == 1.0 else 0.0} AS similarity, count(*) AS n_rows, count(DISTINCT p_partkey) AS n_keys, round(sum(p_retailprice), 2) AS target,
  '{'p_brand' if tau == 1.0 else 'p_label'}' AS brand FROM part""" for tau in (0.0, 1.0) for b in _BETAS))
def perturbation_cells(t: Tables) -> DataFrame:
    """Cells that are run: a table keeps its keys and its target's values, and its header loses all known words or none."""
    source = t.part.select("p_partkey", "p_size", "p_brand", "p_retailprice")
    synonyms = {"p_size": ["p_extent"], "p_brand": ["p_label"]}
    found = None
    for how, df, reached in perturb.run_grid(source, "p_partkey", "p_retailprice", perturb.grid([0.0, 1.0], list(_BETAS)), synonyms):
        seen = [F.lit(how.tau).alias("tau"), F.lit(how.beta).alias("beta"), F.lit(reached).alias("similarity")]
        counts = df.agg(F.count("*").alias("n_rows"), F.countDistinct("p_partkey").alias("n_keys"), F.round(F.sum("p_retailprice"), 2).alias("target"))
        row = counts.select(*seen, "n_rows", "n_keys", "target", F.lit(df.columns[2]).alias("brand"))
        found = row if found is None else found.union(row)
    return found


@query()
def metadata_perturbation(t: Tables) -> DataFrame:
    words = ["orders", "price", "customer", "status"]
    changed, reached = perturb.perturb_tokens(words, {"orders": ["purchases"], "price": ["cost", "charge"], "customer": ["client"]}, 0.4)
    made = t.spark.createDataFrame([(",".join(f"{a}={b}" for a, b in sorted(changed.items())), round(reached, 6))], "changed string, jaccard double")
    return made


# Catalog
_LAKE_TABLES = ("customer", "supplier", "part", "nation", "region", "orders")


def _lake(t: Tables) -> dict[str, DataFrame]:
    return {n: getattr(t, n) for n in _LAKE_TABLES}


_CATALOG = "(VALUES " + ", ".join(
    f"('{n}', '{n} with {', '.join(c)}', [{', '.join(repr(x) for x in c)}])"
    for n, c in {
        "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
        "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "region": ["r_regionkey", "r_name"],
        "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    }.items()
) + ") c(id, description, columns_name)"


@query(f"""SELECT id, (contains(description, 'nation'))::INT + (contains(description, 'acctbal'))::INT AS hits FROM {_CATALOG} WHERE hits > 0 AND id <> 'nation'""")
def catalog_search(t: Tables) -> DataFrame:
    return catalog.search(catalog.catalog_of(t.spark, _lake(t)), ["Nation", "acctbal"], ["LOCAL"], ["NATION"]).select("id", "hits")


@query(f"""SELECT id AS table_id, unnest(columns_name) AS "column", generate_subscripts(columns_name, 1) - 1 AS ordinal FROM {_CATALOG}""")
def catalog_columns(t: Tables) -> DataFrame:
    return catalog.columns_of(catalog.catalog_of(t.spark, _lake(t))).select("table_id", "column", F.col("ordinal").cast("long").alias("ordinal"))


@query(f"""SELECT id, CASE WHEN length(description) > 20 THEN substr(description, 1, 20) || '...[truncated]' ELSE description END AS description, list_slice(columns_name, 1, 2) AS columns_name FROM {_CATALOG} WHERE id IN ('part', 'region')""")
def catalog_lookup(t: Tables) -> DataFrame:
    ids = t.spark.createDataFrame([("part",), ("region",), ("none",)], "id string")
    return catalog.lookup(catalog.catalog_of(t.spark, _lake(t)), ids, 20, 2).select("id", "description", "columns_name")


@query(f"SELECT id, CASE id WHEN 'orders' THEN 'known' ELSE id END AS name, description FROM {_CATALOG}")
def catalog_upsert(t: Tables) -> DataFrame:
    """A known entry keeps its name, one without a name gets it, others are added."""
    whole = catalog.catalog_of(t.spark, _lake(t))
    known = whole.where("id in ('part', 'orders')").withColumn("name", F.when(F.col("id") == "orders", "known"))
    return catalog.upsert(known, whole).select("id", "name", "description")


@query("SELECT n_nationkey AS nation_id, n_name AS nation, n_regionkey FROM nation")
def display_names(t: Tables) -> DataFrame:
    """A field without a name to display keeps its own."""
    return catalog.with_display_names(t.nation, {"n_nationkey": "nation_id", "n_name": "nation", "other": "none"})


@query(f"SELECT id, 'any' AS rule FROM {_CATALOG} WHERE len(list_filter(columns_name, lambda c: contains(c, 'name') OR contains(c, 'acctbal'))) > 0 UNION ALL SELECT unnest(['customer', 'supplier']), 'all'")
def catalog_has_columns(t: Tables) -> DataFrame:
    whole = catalog.catalog_of(t.spark, _lake(t))
    any_, all_ = (catalog.has_columns(whole, ["NAME", "acctbal"], e).select("id", F.lit(r).alias("rule")) for e, r in ((False, "any"), (True, "all")))
    return any_.union(all_)


@query("SELECT 'customer' AS id, ['c_nationkey'] AS matching")
def possible_join_columns(t: Tables) -> DataFrame:
    found = catalog.possible_join_columns(catalog.catalog_of(t.spark, _lake(t)), [" C_NationKey "])
    return found.where("size(matching) > 0").select("id", "matching")


@query(f"SELECT id FROM {_CATALOG} WHERE id NOT IN ('part', 'nation')")
def unchecked_tables(t: Tables) -> DataFrame:
    checked = t.spark.createDataFrame([(i,) for i in catalog.checked_ids({"checked_tables": ["part", {"id": "nation"}]})], "id string")
    return catalog.unchecked(catalog.catalog_of(t.spark, _lake(t)), checked).select("id")


@query("SELECT event_type AS domain, event_id AS name FROM events WHERE value >= 20 QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 25")
def domain_quota(t: Tables) -> DataFrame:
    files = t.events.select(F.col("event_type").alias("domain"), F.col("event_id").alias("name"), F.col("value").alias("size"))
    return catalog.quota(files, 25, 20).select("domain", "name")


@query("SELECT user_id AS id, arg_max(event_type, event_id) AS status, max(event_id) AS at FROM events GROUP BY 1")
def latest_status(t: Tables) -> DataFrame:
    return catalog.latest_status(t.events.select(F.col("user_id").alias("id"), F.col("event_type").alias("status"), F.col("event_id").alias("at")))


# Choices and the whole pipeline
@query()
def selected_tables(t: Tables) -> DataFrame:
    task = choices.Task.of("orders", "o_custkey", "o_totalprice", place="Chicago", topic="customer nation")
    return choices.select_tables(catalog.catalog_of(t.spark, _lake(t)), task)


@query("SELECT 'orders' AS table_id, ['o_orderkey'] AS keys, ['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_orderdate', 'o_orderpriority'] AS feature_columns, ['o_orderkey', 'o_totalprice'] AS label_columns")
def split_design(t: Tables) -> DataFrame:
    d = choices.design_split(t.orders, "o_totalprice")
    return t.spark.createDataFrame([("orders", list(d.keys), list(d.feature_columns), list(d.label_columns))], "table_id string, keys array<string>, feature_columns array<string>, label_columns array<string>")


@query("SELECT c_custkey, CASE WHEN c_custkey IN (SELECT c_custkey FROM customer ORDER BY 1 LIMIT 500) THEN 'segment ' || c_custkey % 3 END AS guess FROM customer")
def generated_values(t: Tables) -> DataFrame:
    return choices.generate_values(t.customer.select("c_custkey"), "c_custkey", ["guess"], lambda column, ks: {k: f"segment {k % 3}" for k in ks})


def _query_table(t: Tables) -> DataFrame:
    return t.orders.select("o_custkey", "o_totalprice")


@query()
def augment_pipeline(t: Tables) -> DataFrame:
    """Which columns of customers explain the value of orders?"""
    task = choices.Task.of("orders", "o_custkey", "o_totalprice", topic="customer")
    result = augment.augment(_query_table(t), task, {n: getattr(t, n) for n in ("customer", "supplier", "nation")}, score=False)
    return result.correlations


@query()
def augment_report(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("n_lines"))
    lines = lines.persist(StorageLevel.DISK_ONLY)  # both tables are read by many jobs
    try:
        task = choices.Task.of("query", "l_orderkey", "quantity", topic="lines")
        lake = {"lines": lines.select(F.col("l_orderkey").alias("order_id"), "n_lines"), "region": t.region}
        result = augment.augment(lines.select("l_orderkey", "quantity"), task, lake)
    finally:
        lines.unpersist()
    row = (result.baseline.score, result.augmented.score, result.report["improvement"], result.report["is_valid"])
    return t.spark.createDataFrame([row], "baseline double, augmented double, improvement double, is_valid boolean")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queries["augment_pipeline"](spark, sf_dir)
