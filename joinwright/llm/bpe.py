"""Byte-level BPE: whole texts to token ids and back, with a lexicon of frequent words.

Frequent words of the corpus are encoded once, on the driver, and compiled into a transducer
(:mod:`.lexicon`); words outside it are split into pieces and merged exactly. Both give the ids that the merges define, so the lexicon
changes the speed and never the result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .lexicon import Lexicon, compile_lexicon
from .storage import materialise

#: Fixed value: the pattern that splits a text into pieces before the merges.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Code points that became letters or numbers after Unicode 16, by whose tables pieces are split.
LATE = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1),
    (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686),
    (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
#: Bytes of parts of texts with their ids, and of pieces with theirs, that a worker keeps at once, what Python adds to each
#: included; and words that a partition counts before it passes them on.
PART_BYTES, PIECE_BYTES, EACH = 32 << 20, 4 << 20, 170
COUNTED = 100_000
#: Characters of texts whose new parts are encoded together.
TOGETHER = 1 << 20
_NONE, _ID = 1 << 60, (1 << 17) - 1

_pieces = regex.compile(PIECES)
_late = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in LATE) + "]")
_between = re.compile(r"(?<=\S) (?=\S)")


def split_pieces(text: str) -> list[str]:
    if text.isascii() or not _late.search(text):
        body = text.removeprefix(" ")
        if body.isalpha():
            return [text]
        if body[-1:] in (".", ",") and body[:-1].isalpha():
            return [text[:-1], text[-1]]
        return _pieces.findall(text)
    plain = _late.sub("", text)  # neither letter nor number nor space
    return [text[m.start() : m.end()] for m in _pieces.finditer(plain)]


def split_segments(text: str) -> list[str]:
    """Parts whose pieces are the text's: cut before each single space between two other characters, as a piece
    never goes on over such a space."""
    parts = _between.split(text)
    return [parts[0], *[" " + p for p in parts[1:]]] if text else []


def _cut(ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The bytes of the ids, cut into lists of these sizes."""
    held, ends = ids.tobytes(), (ids.itemsize * np.cumsum(sizes)).tolist()
    return [held[a:b] for a, b in zip([0, *ends], ends)]


class ByteBpe:
    """The vocabulary and merges of a tokenizer file; small and constant, so it may be broadcast."""

    def __init__(self, description: str):
        data = json.loads(description)
        if data["model"]["type"] != "BPE" or data["pre_tokenizer"]["type"] != "ByteLevel" or data["normalizer"]:
            raise ValueError("not a byte-level BPE tokenizer")
        # The printable form of bytes: printable ones stand for themselves, the others follow from U+0100.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*printable}))}
        vocabulary: dict[str, int] = data["model"]["vocab"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = max([*vocabulary.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(shown[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.single = [0] * 256
        for token, i in vocabulary.items():
            if len(token) == 1:
                self.single[shown[token]] = i
        #: (left << 17 | right) -> rank << 17 | merged
        self.merges: dict[int, int] = {}
        #: The merges in the order of the pairs, and the ids of bytes, as arrays; made where they are used.
        self.tables: tuple[np.ndarray, ...] | None = None
        for rank, merge in enumerate(data["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.merges.setdefault(vocabulary[a] << 17 | vocabulary[b], rank << 17 | vocabulary[a + b])

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as int32 bytes."""
        if not pieces:
            return []
        return _cut(*self.merge_joined(np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces], np.int64)))

    def merge_joined(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids (int32) of pieces whose bytes follow each other, of the given lengths, and how many ids each has. Those of
        up to 64 bytes go together, each with one merge a round: of its pairs the one of lowest rank, of equal ones the
        leftmost."""
        if self.tables is None:
            keys = np.array(sorted(self.merges), np.int64)
            self.tables = keys, np.array([self.merges[k] for k in keys.tolist()], np.int64), np.array(self.single, np.int64)
        keys, values, single = self.tables
        word, ids = np.repeat(np.arange(len(lengths)), lengths), single[data]
        done_words, done_ids = [], []
        if (long := np.flatnonzero(lengths > 64)).size:
            ends = np.cumsum(lengths)
            for i in long.tolist():
                made = self.merge(data[ends[i] - lengths[i] : ends[i]].tobytes())
                done_words.append(np.full(len(made), i))
                done_ids.append(np.array(made, np.int64))
            short = (lengths <= 64)[word]
            word, ids = word[short], ids[short]

        def pairs(at: np.ndarray) -> np.ndarray:
            """The merge of each place with the next one, ``_NONE`` without."""
            after = np.minimum(at + 1, len(ids) - 1)
            key = ids[at] << 17 | ids[after]
            found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            return np.where((keys[found] == key) & (word[after] == word[at]) & (after > at), values[found], _NONE)

        value = pairs(np.arange(len(ids)))
        while len(ids):
            begin = np.flatnonzero(np.diff(word, prepend=-1))
            least = np.repeat(np.minimum.reduceat(value, begin), np.diff(np.append(begin, len(word))))
            over = least == _NONE
            if over.any():
                done_words.append(word[over])
                done_ids.append(ids[over])
                word, ids, value, least = word[~over], ids[~over], value[~over], least[~over]
                if not len(ids):
                    break
            at = np.flatnonzero(value == least)
            at = at[np.diff(word[at], prepend=-1) != 0]  # of a piece the leftmost
            ids[at] = value[at] & _ID
            left = np.ones(len(ids), bool)
            left[at + 1] = False
            word, ids, value = word[left], ids[left], value[left]
            at = at - np.arange(len(at))
            value[at] = pairs(at)
            before = at[at > 0] - 1
            value[before] = pairs(before)
        word, ids = np.concatenate(done_words), np.concatenate(done_ids)
        order = np.argsort(word, kind="stable")
        return ids[order].astype(np.int32), np.bincount(word, minlength=len(lengths))

    def merge(self, piece: bytes) -> list[int]:
        """Exact merges, always the one of lowest rank, of equal ones the leftmost."""
        ids, find = [self.single[b] for b in piece], self.merges.get
        if len(ids) > 64:
            return self._merge_long(ids)
        found = [find(a << 17 | b, _NONE) for a, b in zip(ids, ids[1:])]
        while found and (best := min(found)) != _NONE:
            i = found.index(best)
            ids[i] = best & _ID
            del ids[i + 1], found[i]
            if i < len(found):
                found[i] = find(ids[i] << 17 | ids[i + 1], _NONE)
            if i:
                found[i - 1] = find(ids[i - 1] << 17 | ids[i], _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap: n log n in the piece's length."""
        n, find = len(ids), self.merges.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m >> 17, i, ids[i], ids[i + 1], m & _ID) for i in range(n - 1) if (m := find(ids[i] << 17 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, merged = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = merged, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (m := find(ids[x] << 17 | ids[y])) is not None:
                    heapq.heappush(heap, (m >> 17, x, ids[x], ids[y], m & _ID))
        return [i for i in ids if i >= 0]


class _Irregular(Exception):
    """A part between two spaces that is empty, or begins or ends with white space."""


class _Encoder(dict):
    """Part of a text after a single space -> the bytes of its int32 ids, the space included. Parts are kept in two
    halves of ``PART_BYTES``: when the younger one is full it takes the place of the older one. Words of the lexicon that
    were walked once stay."""

    def __init__(self, model: ByteBpe, lexicon: Lexicon):
        self.model, self.lexicon = model, lexicon
        self.older: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.held = self.pieces_held = 0

    def __missing__(self, part: str) -> bytes:
        out = self.older.get(part)
        if out is None:
            if not part or part[0].isspace() or part[-1].isspace():
                raise _Irregular
            out = self.segment(" " + part)
        if len(part) <= 64:
            self[part] = out
            self.held += len(part) + len(out) + EACH
        return out

    def prepare(self, texts: list[str]) -> None:
        """Encodes the parts of the texts that aren't held, all together."""
        if self.held >= PART_BYTES // 2:
            self.older, self.held = dict(self), 0
            self.clear()
        parts: set[str] = set()
        for text in texts:
            parts.update(text.split(" "))
        older = self.older
        new = [p for p in parts if p not in self]
        made = {p: older[p] for p in new if p in older}
        new = [p for p in new if p not in made and 0 < len(p) <= 48 and p.strip() == p]
        if not self.lexicon.empty:
            words = [b" " + p.encode() for p in new]
            unseen = []
            for part, word, known in zip(new, words, self.lexicon.accepts(words).tolist()):
                if not known:
                    unseen.append(part)
                    continue
                if (out := self.known.get(part)) is None:
                    out = self.known[part] = array("i", self.lexicon.get(word)).tobytes()
                made[part] = out
            new = unseen
        if new:
            made.update(zip(new, self.merged(" " + " ".join(new))))
        self.update(made)
        self.held += sum(map(len, made)) + sum(map(len, made.values())) + EACH * len(made)

    def merged(self, joined: str) -> list[bytes]:
        """The ids of parts that each follow a single space. No piece goes on over such a space, so the pieces are those of
        the joined text, and a part begins with the piece that begins with its space."""
        pieces = split_pieces(joined)
        data = np.frombuffer(joined.encode(), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        if len(data) > len(joined):  # from characters to bytes
            ends = np.append(np.flatnonzero(data & 0xC0 != 0x80), len(data))[ends]
        begins = np.append(0, ends[:-1])
        ids, sizes = self.model.merge_joined(data, ends - begins)
        return _cut(ids, np.add.reduceat(sizes, np.flatnonzero(data[begins] == 32)))

    def segment(self, segment: str) -> bytes:
        ids = self.lexicon.get(segment.encode())
        return array("i", ids).tobytes() if ids is not None else b"".join([self.piece(p) for p in split_pieces(segment)])

    def piece(self, piece: str) -> bytes:
        out = self.pieces.get(piece)
        if out is None:
            out = array("i", self.model.merge(piece.encode())).tobytes()
            if len(piece) <= 64:
                if self.pieces_held >= PIECE_BYTES:
                    self.pieces.clear()
                    self.pieces_held = 0
                self.pieces[piece] = out
                self.pieces_held += len(piece) + len(out) + EACH
        return out

    def text(self, text: str) -> bytes:
        if not text:
            return b""
        parts = text.split(" ")
        try:
            if parts[0] and not parts[0][-1].isspace():
                return b"".join([self.segment(parts[0]), *map(self.__getitem__, parts[1:])])
        except _Irregular:
            pass
        return b"".join([self.segment(s) for s in split_segments(text)])

    def count(self, text: str) -> int:
        """How many ids the text has."""
        parts = text.split(" ")
        try:
            if parts[0] and not parts[0][-1].isspace():
                return (len(self.segment(parts[0])) + sum(map(len, map(self.__getitem__, parts[1:])))) // 4
        except _Irregular:
            pass
        return sum([len(self.segment(s)) for s in split_segments(text)]) // 4


def _count_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def emit() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["segment", "n"])
        counts.clear()
        return made

    for batch in batches:
        for text in batch.column(0):
            if value := text.as_py():
                counts.update(value.split(" "))
            if len(counts) >= COUNTED:
                yield emit()
    if counts:
        yield emit()


def frequent_words(docs: DataFrame, text_col: str, size: int) -> list[str]:
    """At most ``size`` words, counted over all texts as they stand between spaces: those of the highest counts, as far
    as all words of a count fit. The table of how many words have a count gives the least one, so that no more rows
    than that reach the driver."""
    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(_count_segments, "segment string, n long").where(F.length("segment").between(1, 32))
    counted = materialise(counted.groupBy("segment").agg(F.sum("n").alias("n")).where("n > 1"), "word_counts")
    upto = F.sum("words").over(W.orderBy(F.desc("n")))
    fits = counted.groupBy("n").agg(F.count("*").alias("words")).withColumn("upto", upto).where(F.col("upto") <= size)
    least = fits.agg(F.min("n")).first()[0]
    return [] if least is None else sorted(row.segment for row in counted.where(F.col("n") >= least).collect())


def read_text(spark, path: str) -> str:
    """A small file's text, read by Spark, so that the path may be in any store."""
    return spark.read.text(path, wholetext=True).first()[0]


def _prepared(texts: pa.Array, encoder: _Encoder) -> Iterator[str]:
    """The texts, null as empty; the parts of some at once are prepared before."""
    begin, size = 0, 0
    for i, n in enumerate(pc.fill_null(pc.utf8_length(texts), 0).to_pylist()):
        size += n
        if size >= TOGETHER or i + 1 == len(texts):
            some = [t or "" for t in texts.slice(begin, i + 1 - begin).to_pylist()]
            encoder.prepare(some)
            yield from some
            begin, size = i + 1, 0


def _tools(model: ByteBpe, lexicon: bytes) -> tuple[_Encoder, regex.Pattern | None]:
    """The worker's encoder, which lives as long as the broadcast model, and the pattern of special tokens."""
    encoder = model.__dict__.get("encoder")
    if encoder is None or encoder.of is not lexicon:
        encoder = model.encoder = _Encoder(model, Lexicon(lexicon))
        encoder.of = lexicon
    longest = sorted(model.special, key=len, reverse=True)
    return encoder, regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None


def _placed(df: DataFrame, first: Column, keep: list[str]) -> DataFrame:
    """``first`` and then the kept columns, named by their places so that no name can clash."""
    return df.select(first.alias("given"), *[F.col(c).alias(str(i)) for i, c in enumerate(keep)])


class BpeCodec:
    """Encodes and decodes text columns. ``lexicon_size`` bounds the driver's work and what is broadcast; with 0 the corpus
    is not read for its words, and all are merged."""

    def __init__(self, docs: DataFrame, tokenizer_path: str, text_col: str = "text", lexicon_size: int = 30_000):
        spark = docs.sparkSession
        path = tokenizer_path if "://" in tokenizer_path else f"file://{tokenizer_path}"
        if path.startswith("file://"):  # installed on the driver, not necessarily on the executors
            with open(path.removeprefix("file://"), encoding="utf-8") as file:
                model = ByteBpe(file.read())
        else:
            model = ByteBpe(read_text(spark, path))
        words = [" " + w for w in frequent_words(docs, text_col, lexicon_size)] if lexicon_size else []
        self.lexicon = compile_lexicon((w.encode(), tuple(i for p in split_pieces(w) for i in model.merge(p.encode()))) for w in words)
        self._model = spark.sparkContext.broadcast(model)
        self._lexicon = spark.sparkContext.broadcast(self.lexicon)

    def encode(self, docs: DataFrame, keep: list[str], text_col: str = "text", ids_col: str = "ids") -> DataFrame:
        """The columns ``keep`` and ``ids_col array<int>``: the ids of the whole text; null text counts as empty.
        Strings of special tokens in a text become their ids. Repeated rows stay rows, an empty table gives an empty
        result, and a kept column that has the result's name gives way to it."""
        keep = [c for c in keep if c != ids_col]
        schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
        return _placed(docs, F.col(text_col).cast("string"), keep).mapInArrow(self._encoding(schema.names), schema)

    def decode(self, encoded: DataFrame, keep: list[str], ids_col: str = "ids", text_col: str = "text", digest: bool = False) -> DataFrame:
        """The columns ``keep`` and ``text_col``: the text of the ids, special tokens included. A null list has no ids,
        and null ids and those that the vocabulary lacks are left out, in the counts and digests too. With ``digest`` instead of the text: ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by commas) and
        ``decoded_sha256``. Kept columns with these names give way."""
        keep, schema = self._decoded_schema(encoded, keep, text_col, digest)
        return _placed(encoded, F.col(ids_col), keep).mapInArrow(self._decoding(schema.names, digest), schema)

    def round_trip(self, docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
        """``decode(encode(docs), digest=True)`` in one task each, without passing the ids through Spark."""
        keep, schema = self._decoded_schema(docs, keep, "", True)
        places = [str(i) for i in range(len(keep))]
        encoding, decoding = self._encoding([*places, "ids"]), self._decoding(schema.names, True)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from decoding(b.select(["ids", *places]) for b in encoding(batches))

        return _placed(docs, F.col(text_col).cast("string"), keep).mapInArrow(run, schema)

    @staticmethod
    def _decoded_schema(docs: DataFrame, keep: list[str], text_col: str, digest: bool) -> tuple[list[str], T.StructType]:
        made = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()} if digest else {text_col: T.StringType()}
        keep = [c for c in keep if c not in made]
        return keep, T.StructType([*docs.select(*keep).schema.fields, *[T.StructField(c, kind) for c, kind in made.items()]])

    def count(self, docs: DataFrame, keep: list[str], text_col: str = "text", count_col: str = "n_tokens") -> DataFrame:
        """The columns ``keep`` and ``count_col long``: how many ids the whole text has; null text has none."""
        keep = [c for c in keep if c != count_col]
        schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField(count_col, T.LongType())])
        shared_model, shared_lexicon = self._model, self._lexicon

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder, marks = _tools(shared_model.value, shared_lexicon.value)
            special = shared_model.value.special

            def n(text: str) -> int:
                if marks is None or not marks.search(text):
                    return encoder.count(text)
                return sum(1 if p in special else encoder.count(p) for p in marks.split(text))

            for batch in batches:
                counts = pa.array([n(t) for t in _prepared(batch.column(0), encoder)], pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], counts], schema.names)

        return _placed(docs, F.col(text_col).cast("string"), keep).mapInArrow(run, schema)

    def _encoding(self, names: list[str]):
        """Columns: text, then those to pass on."""
        shared_model, shared_lexicon = self._model, self._lexicon

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared_model.value
            encoder, marks = _tools(model, shared_lexicon.value)
            single = {t: np.array([i], np.int32).tobytes() for t, i in model.special.items()}

            def ids(text: str) -> bytes:
                if marks is None or not marks.search(text):
                    return encoder.text(text)
                return b"".join([single[p] if p in single else encoder.text(p) for p in marks.split(text)])

            before, made = None, b""

            for batch in batches:
                begin, held, total = 0, [], 0
                for r, text in enumerate(_prepared(batch.column(0), encoder)):
                    if text != before:  # copies that follow each other are encoded once
                        before, made = text, ids(text)
                    held.append(made)
                    total += len(held[-1])
                    if total >= 1 << 21 or r + 1 == batch.num_rows:
                        offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in held]))).astype(np.int32)
                        values = pa.Array.from_buffers(pa.int32(), total // 4, [None, pa.py_buffer(b"".join(held))])
                        lists = pa.ListArray.from_arrays(pa.array(offsets), values)
                        rest = [c.slice(begin, len(held)) for c in batch.columns[1:]]
                        yield pa.RecordBatch.from_arrays([*rest, lists], names)
                        begin, held, total = r + 1, [], 0

        return run

    def _decoding(self, names: list[str], digest: bool):
        """Columns: ids, then those to pass on."""
        shared_model = self._model

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            token = shared_model.value.bytes
            decimal = [str(i) for i in range(len(token))] if digest else []
            for batch in batches:
                offsets = batch.column(0).offsets.to_numpy()
                values = pc.fill_null(batch.column(0).values, -1).to_numpy(zero_copy_only=False)
                odd = len(values) > 0 and (values.min() < 0 or values.max() >= len(token))
                out: list[tuple] = []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    ids = values[a:b].tolist()
                    if odd:
                        ids = [i for i in ids if 0 <= i < len(token)]
                    text = b"".join([token[i] for i in ids]).decode("utf-8", "replace")
                    if digest:
                        joined = ",".join([decimal[i] for i in ids])
                        out.append((len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
                    else:
                        out.append((text,))
                made = [pa.array(x) for x in zip(*out)] if out else [pa.array([], t) for t in ((pa.int64(), pa.string(), pa.string()) if digest else (pa.string(),))]
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], names)

        return run
