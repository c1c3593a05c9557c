"""Column profiles, numeric coercion, semantic classes, and what follows from them.

A profile is one aggregation over all columns; the rules then run on its single row.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joinwright.functions.keys import parse_number

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType)
NESTED = (T.ArrayType, T.MapType, T.StructType)
CATEGORICAL_RATIO = 0.03
#: Separators that are tried in this order, and words that mark a date column.
SEPARATORS = ("|", ",")
DATE_WORDS = ("date", "time", "year", "month", "day")
DATE_FORM = r"^\s*(\d{4}[-/]\d{1,2}([-/]\d{1,2})?|\d{1,2}[-/]\d{1,2}[-/](\d{4}|\d{2})|\d{1,2}[-/ ][A-Za-z]{3,9}[-/ ](\d{4}|\d{2})|\d{8})([T ]\d.*)?\s*$"


def _col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, NUMERIC)


def profile(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """One row for each column: ``column, n_rows, n_values`` (not null), ``n_distinct, n_numbers`` (values that are
    numbers, or texts that parse as such). ``approximate`` counts distinct values with about 2 % error."""
    columns = [c for c in columns or df.columns if not isinstance(df.schema[c].dataType, NESTED)]
    distinct = (lambda c: F.approx_count_distinct(c, 0.02)) if approximate else F.count_distinct
    structs = []
    for name in columns:
        c = _col(name)
        numbers = F.count(parse_number(c)) if isinstance(df.schema[name].dataType, T.StringType) else F.count(c) if is_numeric(df, name) else F.lit(0).cast("long")
        structs.append(F.struct(F.lit(name).alias("column"), F.count(F.lit(1)).alias("n_rows"), F.count(c).alias("n_values"), distinct(c).alias("n_distinct"), numbers.alias("n_numbers")))
    return df.agg(F.array(*structs).alias("p")).select(F.inline("p"))


def convert_numeric_columns(df: DataFrame, exclude: list[str] = ()) -> DataFrame:
    """String columns of which at least half of the values, and one or more, are numbers become doubles; other
    values are null then."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in exclude]
    if not texts:
        return df
    rows = profile(df.select(*[_col(c) for c in texts])).collect()
    numeric = {r.column for r in rows if r.n_numbers >= 1 and r.n_numbers >= 0.5 * r.n_values}
    return df.select(*[parse_number(_col(c)).alias(c) if c in numeric else _col(c) for c in df.columns])


def column_class(n_rows: Column, n_distinct: Column, declared: Column) -> Column:
    """``numerical``, ``categorical``, ``text`` or ``ignore``."""
    declared = F.lower(F.coalesce(declared, F.lit("")))
    return (
        F.when(n_distinct <= 1, "ignore")
        .when(n_distinct == 2, "numerical")
        .when(n_distinct / n_rows < CATEGORICAL_RATIO, "categorical")
        .when(declared.isin("number", "checkbox"), "numerical")
        .when(declared == "text", "text")
        .otherwise("ignore")
    )


def declared_types(df: DataFrame) -> dict[str, str]:
    """What a catalog would declare: number, checkbox, text, calendar date."""
    def of(kind: T.DataType) -> str:
        if isinstance(kind, T.BooleanType):
            return "checkbox"
        if isinstance(kind, NUMERIC):
            return "number"
        return "calendar date" if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "text"

    return {f.name: of(f.dataType) for f in df.schema.fields}


def classify_columns(df: DataFrame, declared: Mapping[str, str] | None = None, approximate: bool = False) -> DataFrame:
    """``column, class``; nested columns are ``ignore``."""
    declared = declared or declared_types(df)
    kinds = F.create_map(*[F.lit(x) for pair in declared.items() for x in pair])
    classes = profile(df, approximate=approximate).select("column", column_class(F.col("n_rows"), F.col("n_distinct"), kinds[F.col("column")]).alias("class"))
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, NESTED)]
    for name in nested:
        classes = classes.union(df.sparkSession.range(1).select(F.lit(name), F.lit("ignore")))
    return classes


def column_classes(df: DataFrame, declared: Mapping[str, str] | None = None) -> dict[str, str]:
    return {r.column: r["class"] for r in classify_columns(df, declared).collect()}


def detect_types(df: DataFrame, most_numeric: int = 20, most_text: int = 100) -> DataFrame:
    """The rule by counts alone: numbers are categorical up to ``most_numeric`` distinct values, texts up to
    ``most_text``."""
    numeric = F.create_map(*[F.lit(x) for c in df.columns for x in (c, is_numeric(df, c))])[F.col("column")]
    kind = F.when(numeric, F.when(F.col("n_distinct") <= most_numeric, "categorical").otherwise("numerical"))
    return profile(df).select("column", kind.otherwise(F.when(F.col("n_distinct") <= most_text, "categorical").otherwise("text")).alias("type"))


def text_columns(df: DataFrame, declared: Mapping[str, str] | None = None, exclude: list[str] = ()) -> list[str]:
    return [c for c, kind in column_classes(convert_numeric_columns(df, exclude), declared).items() if kind == "text" and c not in exclude]


def numeric_columns(df: DataFrame, exclude: list[str] = ()) -> list[str]:
    return [c for c in df.columns if is_numeric(df, c) and not isinstance(df.schema[c].dataType, T.BooleanType) and c not in exclude]


def uniqueness(df: DataFrame) -> DataFrame:
    """``column, uniqueness``: distinct values as a percentage of the rows, two decimals."""
    return profile(df).select("column", F.round(100.0 * F.col("n_distinct") / F.greatest("n_rows", F.lit(1)), 2).alias("uniqueness"))


def primary_key(df: DataFrame) -> str | None:
    """The first column whose values are all different and not null."""
    unique = {r.column for r in profile(df).collect() if r.n_distinct == r.n_rows}
    return next((c for c in df.columns if c in unique), None)


def separator_shares(df: DataFrame, column: str, order: str | None = None, rows: int | None = None) -> DataFrame:
    """``separator, share`` of the values that it splits into several parts that aren't blank: of all, or of the first
    ``rows``."""
    values = df.where(_col(column).isNotNull())
    if rows is not None:
        values = (values.orderBy(order) if order else values).limit(rows)
    values = values.select(_col(column).cast("string").alias("v"))
    several = [F.avg((F.size(F.filter(F.split("v", f"[{s}]"), lambda x: F.trim(x) != "")) > 1).cast("double")) for s in SEPARATORS]
    table = values.agg(F.array(*[F.struct(F.lit(s).alias("separator"), a.alias("share")) for s, a in zip(SEPARATORS, several)]).alias("p"))
    return table.select(F.inline("p"))


def separator(df: DataFrame, column: str, order: str | None = None, least: float = 0.1) -> str | None:
    shares = {r.separator: r.share or 0.0 for r in separator_shares(df, column, order).collect()}
    return next((s for s in SEPARATORS if shares[s] > least), None)


def date_columns(df: DataFrame, declared: Mapping[str, str] | None = None, least: float = 0.5) -> list[str]:
    """Columns with a date word in the name, declared as dates, or texts of which more than ``least`` of all values that
    aren't blank have the form of a date; digits alone need a time."""
    declared = declared or declared_types(df)
    named = [c for c in df.columns if any(w in c.lower() for w in DATE_WORDS) or "date" in declared.get(c, "")]
    texts = [c for c in df.columns if c not in named and isinstance(df.schema[c].dataType, T.StringType)]
    if texts:
        date = lambda c: _col(c).rlike(DATE_FORM) & ~_col(c).rlike(r"^\s*\d+\s*$")
        filled = lambda c: F.trim(_col(c)) != ""
        row = df.agg(*[F.avg(F.when(filled(c), date(c).cast("int"))).alias(str(i)) for i, c in enumerate(texts)]).first()
        named += [c for c, share in zip(texts, row) if (share or 0) > least]
    return [c for c in df.columns if c in named]


def column_differences(columns: Column, described: Column) -> tuple[Column, Column]:
    """Names in a header but not in the metadata, and the reverse."""
    return F.array_except(columns, described), F.array_except(described, columns)


def roles(columns: DataFrame, target: str, keys: list[str]) -> DataFrame:
    """Adds ``role`` to a table of ``column``: 0 target, 1 join key, 2 attribute."""
    name = F.lower(F.trim("column"))
    return columns.withColumn("role", F.when(name == target.strip().lower(), 0).when(name.isin(*[k.strip().lower() for k in keys]), 1).otherwise(2))


def binary_target(df: DataFrame, column: str) -> DataFrame:
    """A text column with two values becomes 0 and 1 in their order; anything else stays as it is."""
    values = [r[0] for r in df.select(_col(column)).where(_col(column).isNotNull()).distinct().limit(3).collect()]
    if len(values) != 2 or not isinstance(df.schema[column].dataType, T.StringType):
        return df
    low, high = sorted(values)
    return df.withColumn(column, F.when(_col(column) == low, 0.0).when(_col(column) == high, 1.0))


def null_counts(df: DataFrame) -> Column:
    return reduce(lambda a, b: a + b, [_col(c).isNull().cast("int") for c in df.columns])
