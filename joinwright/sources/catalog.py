"""The catalog of a lake: metadata of tables and columns, search, and its growth over sessions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from joinwright.functions.text import truncated
from joinwright.operators.profile import declared_types

#: Fields of a table's description.
METADATA = """resource struct<name: string, id: string, description: string, attribution: string,
  columns_name: array<string>, columns_field_name: array<string>, columns_datatype: array<string>,
  columns_description: array<string>, columns_format: array<string>>,
  classification struct<categories: array<string>, tags: array<string>, domain_category: string, domain_tags: array<string>>,
  metadata struct<domain: string>"""
ENTRY = """id string, name string, description string, attribution string, columns_name array<string>,
  columns_description array<string>, columns_datatype array<string>, categories array<string>, domain string"""


def read_metadata(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Catalog entries from JSON descriptions, one file each; a missing id is the folder's name."""
    raw = spark.read.schema(METADATA).json(paths, multiLine=True).withColumn("folder", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    r = "resource."
    return raw.select(
        F.coalesce(r + "id", "folder").alias("id"), F.coalesce(r + "name", "folder").alias("name"), r + "description", r + "attribution", r + "columns_name", r + "columns_description",
        r + "columns_datatype", F.col("classification.categories").alias("categories"), F.col("metadata.domain").alias("domain"),
    )


def write_catalog(entries: DataFrame, path: str) -> None:
    """Keeps entries under ``<path>/domain=.../table=...``, the table's id with characters other than letters, digits, ``_``
    and ``-`` as ``_``, and the start of its hash, as different ids may become equal. Entries kept before are replaced, all
    others stay."""
    table = F.concat_ws("-", F.regexp_replace("id", r"(?U)[^\w\-]", "_"), F.substring(F.sha2("id", 256), 1, 16))
    placed = entries.withColumn("table", table).write.partitionBy("domain", "table")
    placed.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The entries that ``write_catalog`` keeps there."""
    kept = spark.read.schema(ENTRY + ", table string").parquet(path)
    return kept.drop("table")


def field_names(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``id, field, name``: names of fields and those to display, from the same descriptions as ``read_metadata``. Fields
    that lack one of the two have no row."""
    raw = spark.read.schema(METADATA).json(paths, multiLine=True).withColumn("folder", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    pairs = F.explode(F.arrays_zip(F.col("resource.columns_field_name").alias("field"), F.col("resource.columns_name").alias("name")))
    found = raw.select(F.coalesce("resource.id", "folder").alias("id"), pairs.alias("x")).select("id", "x.field", "x.name")
    return found.where("field <> '' and name <> ''")


def with_display_names(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Fields renamed to the names to display; those without one stay, and so do those whose name another column keeps or an
    earlier one got. A field that stays may take its name from others, which then stay, too."""
    renamed = [names.get(c, c) for c in df.columns]
    while True:
        kept = {c.lower() for c, new in zip(df.columns, renamed) if new == c}
        taken, changed = set(kept), False
        for i, (c, new) in enumerate(zip(df.columns, renamed)):
            if new == c:
                continue
            if new.lower() in taken:
                renamed[i], changed = c, True
            else:
                taken.add(new.lower())
        if not changed:
            return df.toDF(*renamed)


def catalog_of(spark: SparkSession, lake: Mapping[str, DataFrame], domain: str = "local") -> DataFrame:
    """Entries for tables at hand, from their schemas alone."""
    rows = []
    for table_id, df in lake.items():
        kinds = declared_types(df)
        rows.append((table_id, table_id, f"{table_id} with {', '.join(df.columns)}", None, df.columns, ["" for _ in df.columns], [kinds[c] for c in df.columns], [], domain))
    return spark.createDataFrame(rows, ENTRY)


def columns_of(catalog: DataFrame) -> DataFrame:
    """``table_id, ordinal, column, datatype, description``; lists that are too short are padded."""
    zipped = F.posexplode(F.arrays_zip("columns_name", "columns_datatype", "columns_description")).alias("ordinal", "x")
    found = catalog.select(F.col("id").alias("table_id"), zipped).where(F.col("x.columns_name").isNotNull())
    return found.select("table_id", "ordinal", F.col("x.columns_name").alias("column"), F.coalesce("x.columns_datatype", F.lit("unknown")).alias("datatype"), F.coalesce("x.columns_description", F.lit("")).alias("description"))


def search(catalog: DataFrame, words: list[str], domains: list[str] | None = None, exclude: list[str] = (), limit: int | None = None) -> DataFrame:
    """Entries of a domain with one of the words in name or description, without those excluded; all case-insensitive.
    More words first, then names; ``limit`` is the caller's page size."""
    text = F.lower(F.concat_ws(" ", "name", "description"))
    hits = sum([text.contains(w.lower()).cast("int") for w in words], F.lit(0))
    found = catalog.withColumn("hits", hits)
    if words:
        found = found.where("hits > 0")
    if domains:
        found = found.where(F.lower("domain").isin(*[d.lower() for d in domains]))
    if exclude:
        found = found.where(~F.lower("id").isin(*[e.lower() for e in exclude]))
    found = found.orderBy(F.desc("hits"), "name", "id")
    return found.limit(limit) if limit is not None else found


def lookup(catalog: DataFrame, ids: DataFrame, max_chars: int | None = None, max_items: int | None = None) -> DataFrame:
    """Entries with one of the ids, with long fields and lists cut for a prompt where asked."""
    found = catalog.join(ids.select("id").distinct(), "id", "left_semi")
    for f in found.schema.fields:
        if max_chars and isinstance(f.dataType, T.StringType) and f.name != "id":
            found = found.withColumn(f.name, truncated(F.col(f.name), max_chars))
        if max_items and isinstance(f.dataType, T.ArrayType):
            found = found.withColumn(f.name, F.slice(f.name, 1, max_items))
    return found


def upsert(catalog: DataFrame, new: DataFrame) -> DataFrame:
    """New entries are added; known ones stay, with names that they lacked."""
    names = new.select("id", F.col("name").alias("__name")).dropDuplicates(["id"])
    known = catalog.join(names, "id", "left").withColumn("name", F.coalesce("name", "__name")).drop("__name").select(*catalog.columns)
    return known.unionByName(new.dropDuplicates(["id"]).join(catalog, "id", "left_anti"))


def unchecked(candidates: DataFrame, checked: DataFrame) -> DataFrame:
    return candidates.join(checked.select("id"), "id", "left_anti")


def checked_ids(entries: object) -> list[str]:
    """Ids from any of the stored forms: a list of ids, a list of entries, or an object with ``checked_tables``."""
    if isinstance(entries, Mapping):
        entries = entries.get("checked_tables", [])
    return [e["id"] if isinstance(e, Mapping) else str(e) for e in entries or []]


def has_columns(catalog: DataFrame, required: list[str], every: bool = False) -> DataFrame:
    """Entries with column names that contain one, or each, of the texts."""
    def has(text: str) -> Column:
        return F.exists("columns_name", lambda c: F.lower(c).contains(text.lower()))

    tests = [has(r) for r in required]
    condition: Column = tests[0]
    for t in tests[1:]:
        condition = condition & t if every else condition | t
    return catalog.where(condition)


def possible_join_columns(catalog: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``matching``: the entry's column names that equal a key after trimming and lower-casing."""
    wanted = F.array(*[F.lit(k.strip().lower()) for k in keys])
    names = F.transform("columns_name", lambda c: F.lower(F.trim(c)))
    return catalog.withColumn("matching", F.array_intersect(names, wanted))


def quota(files: DataFrame, per_domain: int = 25, least_bytes: int = 5 << 20) -> DataFrame:
    """Files of a size worth keeping, so many for each domain, by name."""
    rank = F.row_number().over(W.partitionBy("domain").orderBy("name"))
    return files.where(F.col("size") >= least_bytes).withColumn("rank", rank).where(F.col("rank") <= per_domain).drop("rank")


def latest_status(log: DataFrame) -> DataFrame:
    """The latest access status of each table."""
    return log.groupBy("id").agg(F.max_by("status", "at").alias("status"), F.max("at").alias("at"))
