"""Text functions: tokens of metadata, whole-word replacement, truncation, and JSON inside other text."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Distinct runs of letters and digits of two characters or more, lower case; null has none."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+")
    return F.array_distinct(F.filter(parts, lambda x: F.length(x) > 1))


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two arrays of distinct tokens; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def replace_words(text: Column, replacements: Mapping[str, str]) -> Column:
    """Whole-word, case-insensitive replacement, one after the other in the given order."""
    for word, new in replacements.items():
        text = F.regexp_replace(text, rf"(?i)\b{re.escape(word)}\b", new.replace("\\", "\\\\").replace("$", "\\$"))
    return text


def truncated(text: Column, n: int, marker: str = "...[truncated]") -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(marker))).otherwise(text)


def clean_name(name: Column) -> Column:
    """A table name for comparison: lower case, trimmed, without a number at the end."""
    return F.regexp_replace(F.lower(F.trim(name)), r"\s+\d+$", "")


def name_suffix(table_id: str) -> str:
    return "_" + table_id.replace("-", "_")


#: Characters and words of a text to which the reference cuts a vocabulary's texts.
REFERENCE_LIMIT = 200


def text_tokens(text: Column, max_chars: int | None = None, max_tokens: int | None = None, strip_punctuation: bool = True) -> Column:
    """Words for a vocabulary, lower case, numbers as ``<NUM>``: of the whole text, or of its first ``max_chars``
    characters, and of these the first ``max_tokens``."""
    text = F.coalesce(text, F.lit(""))
    text = F.lower(text if max_chars is None else F.substring(text, 1, max_chars))
    if strip_punctuation:
        text = F.regexp_replace(text, r"[^a-z0-9_\s]", " ")
    words = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    words = F.transform(words, lambda x: F.when(x.rlike("^[0-9]+$"), "<NUM>").otherwise(x))
    return words if max_tokens is None else F.slice(words, 1, max_tokens)


_WORD = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789_")
_IN_WORD, _OUTSIDE = bytes(i in _WORD for i in range(256)), bytes(set(range(256)) - _WORD)


def word_pieces(texts: pa.Array | pa.ChunkedArray, limit: int = 1 << 22) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The words of ``text_tokens`` in lower-case texts, digits as they stand, and how many each text has; for about
    ``limit`` bytes of texts at a time. Null has none."""
    for array in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        array = pc.fill_null(array.cast(pa.large_string()), "")
        ends = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
        whole, i = np.frombuffer(array.buffers()[2] or b"", np.uint8), 0
        while i < len(array):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + limit, "right")) - 1)
            data, bounds = whole[ends[i] : ends[j]].tobytes(), ends[i : j + 1] - ends[i]
            inside = np.frombuffer(data.translate(_IN_WORD), bool)
            first, last = inside.copy(), inside.copy()
            first[1:] &= ~inside[:-1]
            begins = bounds[:-1][bounds[:-1] < len(data)]  # a text's first byte never goes on with the word before
            first[begins] = inside[begins]
            last[:-1] &= ~inside[1:] | first[1:]
            starts = np.flatnonzero(first)
            lengths = np.append(0, np.flatnonzero(last) + 1 - starts)
            words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.cumsum(lengths)), pa.py_buffer(data.translate(None, _OUTSIDE)))
            yield words, np.diff(np.searchsorted(starts, bounds))
            i = j


def all_digits(words: pa.Array) -> pa.Array:
    return pc.match_substring_regex(words, r"^[0-9]+$")


def find_json(text: str | None, key: str | None = None) -> dict | None:
    """The first object in a model's answer that has ``key``: of a fenced block, of the whole text, or between
    braces anywhere; JSON or Python literals."""
    def parsed(part: str) -> dict | None:
        for read in (json.loads, ast.literal_eval):
            try:
                value = read(part)
            except (ValueError, SyntaxError, RecursionError, MemoryError):
                continue
            if isinstance(value, dict) and (key is None or key in value):
                return value
        return None

    def candidates(whole: str) -> Iterator[str]:
        yield from re.findall(r"```(?:json)?\s*(.*?)```", whole, re.S)
        yield whole.strip()
        open_: list[int] = []
        for i, c in enumerate(whole):
            if c == "{":
                open_.append(i)
            elif c == "}" and open_:
                begin = open_.pop()
                if not open_:
                    yield whole[begin : i + 1]
        for begin in open_[:1]:
            yield whole[begin + 1 :]

    for part in candidates(text or ""):
        if (value := parsed(part)) is not None:
            return value
    return None


def extract_json(text: Column, key: str | None = None) -> Column:
    """``find_json`` for columns, as canonical JSON text; null where there is none."""

    @F.pandas_udf("string")
    def extract(texts: pd.Series) -> pd.Series:
        found = (find_json(t, key) for t in texts)
        return pd.Series([None if x is None else json.dumps(x, sort_keys=True, default=str) for x in found], dtype=object)

    return extract(text)


def json_field(text: Column, key: str) -> Column:
    """A field of the first flat object between braces, without Python."""
    return F.get_json_object(F.regexp_extract(text, r"(\{[^{}]*\})", 1), f"$.{key}")
