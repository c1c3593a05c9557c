"""Short license notices in texts, found with a bounded number of edits.

A notice that may differ by k edits is cut into k + 1 pieces: k edits touch at most k of them, so every match holds one
piece unchanged (the pigeonhole principle). One automaton finds the pieces of all notices in a pass over the text; around
them the ``regex`` library's matching with bounded errors verifies the edits. Notices without edits are one piece, and
their places are all found by the automaton alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import text_batches


@dataclass(frozen=True)
class Notice:
    """Words that stand for a license, in lower case with single blanks, and the edits that a match may have."""

    words: str
    label: str
    edits: int = 0


#: Places of these are counted.
BASE = (
    Notice("gnu general public license", "gpl"),
    Notice("apache license", "apache"),
    Notice("cc by", "cc-by"),
    Notice("mit license", "mit"),
)
#: The edits allowed are about one for eight characters: short names are told from common words by nothing else.
NOTICES = BASE + (
    Notice("gnu general public license", "gpl", 3),
    Notice("gnu lesser general public license", "lgpl", 4),
    Notice("gnu affero general public license", "agpl", 4),
    Notice("apache license", "apache", 1),
    Notice("licensed under the apache license version 2 0", "apache-2.0", 5),
    Notice("mit license", "mit", 1),
    Notice("permission is hereby granted free of charge to any person obtaining a copy", "mit", 8),
    Notice("redistribution and use in source and binary forms with or without modification", "bsd", 8),
    Notice("mozilla public license", "mpl", 2),
    Notice("creative commons attribution", "cc-by", 3),
    Notice("cc by sa", "cc-by-sa"),
    Notice("cc by nc", "cc-by-nc"),
    Notice("cc by nd", "cc-by-nd"),
    Notice("released into the public domain", "public-domain", 3),
    Notice("all rights reserved", "all-rights-reserved", 2),
)

SPANS = "array<struct<label: string, notice: string, first_char: long, end_char: long, first_word: long, end_word: long, edits: int, base: boolean>>"

#: Of UTF-8 bytes: digits, letters (lower-cased) and all that are not ASCII belong to words; the others become blanks.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_PLAIN = bytes((b + 32 if 65 <= b < 91 else b) if _WORD[b] else 32 for b in range(256))


def pieces(notice: Notice) -> list[tuple[int, str]]:
    """``edits + 1`` parts of the notice and where they begin; one without edits is sought with the blanks around it."""
    if not notice.edits:
        return [(0, f" {notice.words} ")]
    cuts = [len(notice.words) * i // (notice.edits + 1) for i in range(notice.edits + 2)]
    return [(a, notice.words[a:b]) for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=8)
def _machines(notices: tuple[Notice, ...]):
    """The automaton of all pieces, each with its notices, and each notice's pattern."""
    of: dict[str, list[tuple[int, int]]] = {}
    for i, notice in enumerate(notices):
        if notice.edits >= len(notice.words):
            raise ValueError(f"a notice must have more characters than edits: {notice}")
        for at, piece in pieces(notice):
            of.setdefault(piece, []).append((i, at))
    seeds = ahocorasick.Automaton()
    for piece, uses in of.items():
        seeds.add_word(piece, (len(piece), uses))
    seeds.make_automaton()
    # Whole words: a match begins after a blank and ends before one. ENHANCEMATCH looks for fewer edits at the place found.
    patterns = [regex.compile(f"(?e)(?<= )(?:{regex.escape(n.words, literal_spaces=True)}){{e<={n.edits}}}(?= )") if n.edits else None for n in notices]
    return seeds, patterns


def plain_words(raw: bytes) -> bytes:
    """The words in lower case, with one blank between them and at both ends; without words one blank."""
    return re.sub(rb" +", b" ", b" " + raw.translate(_PLAIN) + b" ")


def find_notices(plain: str, notices: tuple[Notice, ...]) -> list[tuple[int, int, int, int]]:
    """``(notice's number, begin, end, edits)`` of the matches in words as :func:`plain_words` gives them: all places of
    notices without edits, and for the others matches that don't overlap, from left to right."""
    seeds, patterns = _machines(notices)
    found, windows = [], {}
    for last, (size, uses) in seeds.iter(plain):
        begin = last + 1 - size
        for i, at in uses:
            notice = notices[i]
            if not notice.edits:
                found.append((i, begin + 1, begin + size - 1, 0))
                continue
            # A match that holds the piece here begins and ends within so many characters of where it would without edits.
            low, high = max(0, begin - at - notice.edits - 1), begin - at + len(notice.words) + notice.edits + 1
            own = windows.setdefault(i, [])
            if own and low <= own[-1][1]:
                own[-1] = (min(low, own[-1][0]), max(high, own[-1][1]))
            else:
                own.append((low, high))
    for i, own in windows.items():
        merged: list[tuple[int, int]] = []
        for low, high in sorted(own):
            if merged and low <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
            else:
                merged.append((low, high))
        for low, high in merged:
            for m in patterns[i].finditer(plain[low:high]):
                found.append((i, low + m.start(), low + m.end(), sum(m.fuzzy_counts)))
    return found


def scan_text(raw: bytes, notices: tuple[Notice, ...]) -> tuple[int, list[dict]]:
    """The number of words and the matches, with their places in characters and words of the text."""
    plain = plain_words(raw)
    n_words = plain.count(b" ") - 1
    text = plain.decode("utf-8", "replace")
    found = find_notices(text, notices) if n_words else []
    if not found:
        return n_words, []
    blanks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 32)
    word = _WORD[np.frombuffer(raw, np.uint8)]
    edge = np.diff(np.concatenate(([False], word, [False])).astype(np.int8))
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    starts, ends = chars[np.flatnonzero(edge == 1)], chars[np.flatnonzero(edge == -1)]
    spans, seen = [], set()
    for i, begin, end, edits in sorted(found, key=lambda x: (x[1], x[2], x[0])):
        notice = notices[i]
        if (notice.label, begin, end) in seen:  # an exact match of a notice that may have edits, too
            continue
        seen.add((notice.label, begin, end))
        first, after = int(np.searchsorted(blanks, begin)) - 1, int(np.searchsorted(blanks, end))
        spans.append({"label": notice.label, "notice": notice.words, "first_char": int(starts[first]), "end_char": int(ends[after - 1]), "first_word": first, "end_word": after, "edits": edits, "base": notice in BASE})
    return n_words, spans


def scan_licenses(docs: DataFrame, id_cols: list[str], text_col: str = "text", notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """The columns ``id_cols``, ``n_words`` and ``spans``: each match with its label, the notice, its place in characters and
    in words of the text (from 0, ends excluded), its edits, and whether it is a place of one of ``BASE``.

    A null text is an empty one and has no spans; each row is a text of its own, so repeated rows are scanned each; a text
    of any length is scanned whole; other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    text_batches(spark)
    chosen = docs.select(*[F.col(c) for c in id_cols], F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("__raw"))
    kept = docs.select(*id_cols).schema
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["n_words long", f"spans {SPANS}"])
    struct = pa.struct([("label", pa.string()), ("notice", pa.string()), ("first_char", pa.int64()), ("end_char", pa.int64()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int32()), ("base", pa.bool_())])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = [scan_text(raw.as_py(), notices) for raw in batch.column(len(id_cols))]
            columns = [batch.column(i) for i in range(len(id_cols))]
            columns += [pa.array([n for n, _ in results], pa.int64()), pa.array([s for _, s in results], pa.list_(struct))]
            yield pa.RecordBatch.from_arrays(columns, names=[*id_cols, "n_words", "spans"])

    return chosen.mapInArrow(scanned, schema)


def summarise(scanned: DataFrame, id_cols: list[str]) -> DataFrame:
    """For each text the base places and labels, all labels, and as score the share of a notice's characters that the best
    match left as they are (0 without a match)."""
    base = F.filter("spans", lambda s: s["base"])
    at = F.transform(base, lambda s: s["first_word"])
    joined = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    likeness = F.transform("spans", lambda s: 1 - s["edits"] / F.char_length(s["notice"]))
    return scanned.select(
        *id_cols, "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("spans")).alias("labels"), F.coalesce(F.array_max(likeness), F.lit(0.0)).alias("score"),
    )
