"""Normal forms of join keys, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "__NA__"
#: Tried in this order; month-first before day-first, so that 01/02/2020 is 2 January.
DATE_FORMATS = ("yyyy-M-d", "yyyy-M-d'T'H:m:s", "yyyy-M-d'T'H:m:s.SSS", "yyyy-M-d'T'H:m:s.SSSSSS", "yyyy-M-d'T'H:m:s'Z'", "yyyy-M-d'T'H:m:s.SSS'Z'", "M/d/yyyy", "d/M/yyyy", "yyyy/M/d", "M-d-yyyy", "d-M-yyyy")
#: Whole numbers that are their own normal form.
_PLAIN_WHOLE = r"^(0|-?[1-9][0-9]{0,14})$"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$"


def parse_date(text: Column) -> Column:
    return F.coalesce(*[F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in DATE_FORMATS])


def parse_number(text: Column) -> Column:
    """A double, or null where the trimmed text isn't a decimal number."""
    text = F.lower(F.trim(text))
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def normalize_key(value: Column) -> Column:
    """The form under which equal keys of different spelling meet: missing and blank as ``__NA__``; dates with a
    ``t`` and separators, with two slashes, or short with two hyphens, as ``yyyy-MM-dd``; whole numbers up to 2^53
    without a fraction; other numbers as doubles print; else the trimmed lower-case text. Longer digit strings stay
    as they are, and so do infinities."""
    s = F.lower(F.trim(value.cast("string")))
    hyphens, slashes = F.length(s) - F.length(F.replace(s, F.lit("-"), F.lit(""))), F.length(s) - F.length(F.replace(s, F.lit("/"), F.lit("")))
    dated = (s.contains("t") & ((hyphens >= 1) | (slashes == 2))) | (slashes == 2) | ((hyphens >= 2) & (F.length(s) <= 12))
    number = F.when(s.rlike(_NUMBER), s.try_cast("double"))
    whole = (F.floor(number) == number) & (F.abs(number) <= float(1 << 53))
    plain = F.when(number.isNull() | (F.abs(number) == float("inf")), s).when(F.abs(number) > float(1 << 53), s)
    plain = plain.when(whole, F.when(F.abs(number) <= float(1 << 53), number).cast("long").cast("string")).otherwise(number.cast("string"))
    date = F.when(dated, F.date_format(parse_date(F.upper(s)), "yyyy-MM-dd"))
    raw = value.cast("string")  # most keys are plain whole numbers, for which none of the rest is evaluated
    return F.when(raw.rlike(_PLAIN_WHOLE), raw).when(s.isNull() | (s == ""), MISSING).otherwise(F.coalesce(date, plain))


def upper_key(value: Column) -> Column:
    """Upper case without outer spaces; missing values are ``NAN`` and so match each other."""
    return F.coalesce(F.upper(F.trim(value.cast("string"))), F.lit("NAN"))


def composite_key(*values: Column) -> Column:
    """Keys joined by ``||``, lower case, trimmed; null if any of them is."""
    return F.lower(F.trim(F.concat(*[x for i, v in enumerate(values) for x in ([F.lit("||")] if i else []) + [v.cast("string")]])))


def hash_prefix(text: Column) -> Column:
    """The first 64 bits of SHA-256 in hex. Their order and equality are those of the numbers."""
    return F.substring(F.sha2(text, 256), 1, 16)


def hash_int(text: Column) -> Column:
    return F.conv(hash_prefix(text), 16, 10).cast("decimal(20,0)")


def hash_unit(text: Column) -> Column:
    """The 64-bit hash on [0, 1]."""
    return hash_int(text).cast("double") / F.lit(float((1 << 64) - 1))
