"""Chat formatting by columnar byte assembly, and its inverse.

A turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts, ``<|`` cannot occur: one backslash is
added to every ``<``, backslashes, ``|`` there, which is undone by removing one. Roles also have their backslashes
and line feeds written as ``\\\\`` and ``\\n``, so that the first line feed ends the role.

Segments of all turns of whole conversations are copied into one preallocated buffer: their lengths give cumulative
offsets, and these the indices at which headers and contents are scattered. The buffer becomes the data of the Arrow
column as it is, with the conversations' ends as its offsets.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import partitions
from .words import string_buffers

START, END = "<|im_start|>", "<|im_end|>"
#: Bytes that are scattered at once, and of texts that are assembled at once (but for a longer conversation).
PIECE, CHUNK = 1 << 20, 4 << 20
_added = re.compile(r"<\\(\\*)\|")
_role = re.compile(r"\\(.)", re.S)
_turn = re.compile(rf"{re.escape(START)}([^\n]*)\n(.*?){re.escape(END)}\n", re.S)


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<(\\*)\|", r"<\1\\|")


def unescape(text: str) -> str:
    return _added.sub(r"<\1|", text) if "<\\" in text else text


def _escape_roles(roles: pa.Array) -> pa.Array:
    return escape(pc.replace_substring(pc.replace_substring(roles, "\\", "\\\\"), "\n", "\\n"))


def _unescape_role(role: str) -> str:
    return _role.sub(lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> None:
    """Copies ``data[begin : begin + length]`` to ``out[at:]``: long segments one by one, others some ``PIECE`` bytes at once."""
    for r in np.flatnonzero(lengths >= 1 << 15):
        out[at[r] : at[r] + lengths[r]] = data[begin[r] : begin[r] + lengths[r]]
    short = lengths < 1 << 15
    at, begin, lengths = at[short], begin[short], lengths[short]
    upto = np.cumsum(lengths)
    first = 0
    while first < len(at):
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + PIECE, "right")))
        some = slice(first, last)
        n = lengths[some]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(at[some], n) + within] = data[np.repeat(begin[some], n) + within]
        first = last


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the turns, each turn's end, and begin and end of each text in them."""
    parts = [string_buffers(x) for x in (pa.array([START]), _escape_roles(roles), pa.array(["\n"]), escape(texts), pa.array([END + "\n"]))] if len(roles) else []
    if not parts:
        return np.empty(0, np.uint8), np.empty(0, np.int64), np.empty((0, 2), np.int64)
    n = len(roles)
    begins = [np.broadcast_to(offsets[:1], n) if len(offsets) == 2 and i % 2 == 0 else offsets[:-1] for i, (_, offsets) in enumerate(parts)]
    lengths = [np.broadcast_to(np.diff(offsets), n) if i % 2 == 0 else np.diff(offsets) for i, (_, offsets) in enumerate(parts)]
    table = np.stack(lengths, 1)
    ends = np.cumsum(table.ravel()).reshape(n, len(parts))
    out = np.empty(int(ends[-1, -1]), np.uint8)
    for i, (data, _) in enumerate(parts):
        _scatter(out, ends[:, i] - table[:, i], data, begins[i], table[:, i])
    return out, ends[:, -1], np.stack((ends[:, 3] - table[:, 3], ends[:, 3]), 1)


def _assembled(rows: pa.Table, learned: tuple[str, ...], names: list[str]) -> pa.RecordBatch:
    """Rows (conversation, role, text) of whole conversations: one row for each conversation."""
    ids, roles, texts = (c.combine_chunks() for c in rows.columns)
    begin = np.flatnonzero(np.diff(_codes(ids), prepend=-1))
    sizes = np.diff(np.append(begin, len(ids)))
    data, ends, spans = assemble(roles, texts)
    offsets = np.concatenate(([0], ends[begin + sizes - 1]))
    formatted = pa.Array.from_buffers(pa.string(), len(begin), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
    own = np.flatnonzero(pc.is_in(roles, pa.array(learned, roles.type)).to_numpy(zero_copy_only=False))
    of = np.repeat(np.arange(len(begin)), sizes)[own]
    places = pa.StructArray.from_arrays([pa.array(spans[own, i] - offsets[of]) for i in (0, 1)], ["begin", "end"])
    loss = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(begin) + 1)).astype(np.int32)), places)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(begin)), formatted, loss], names)


def _codes(ids: pa.Array) -> np.ndarray:
    """A number for each value, null included."""
    return ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def _format(learned: tuple[str, ...], names: list[str]):
    """Rows (conversation, turn's role, text), each conversation's in order and together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[pa.Table] = []  # rows of the conversation that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0)
            fill = [pc.fill_null(c.cast(pa.large_string()), "") for c in batch.columns[1:]]
            table = pa.table([ids, *fill], ["id", "role", "text"])
            begins = np.flatnonzero(np.diff(_codes(ids), prepend=-1))
            if open_ and open_[-1].column(0)[-1].as_py() == ids[0].as_py():
                begins = begins[1:]
            sizes = np.concatenate(([0], np.cumsum(pc.binary_length(fill[1]).to_numpy(zero_copy_only=False))))
            last = 0
            for i, begin in enumerate(begins):  # a conversation begins here, so those before are whole
                enough = i + 1 == len(begins) or sizes[begins[i + 1]] - sizes[last] > CHUNK
                if enough or open_:
                    open_.append(table.slice(last, begin - last))
                    if sum(t.num_rows for t in open_):
                        yield _assembled(pa.concat_tables(open_), learned, names)
                    open_, last = [], int(begin)
            open_.append(table.slice(last))
        if open_:
            yield _assembled(pa.concat_tables(open_), learned, names)

    return run


def format_chats(turns: DataFrame, learned: tuple[str, ...] = ("assistant",), id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation: ``id_col``, ``formatted``, and ``loss``, the begins and ends in UTF-8 bytes of
    the texts of the ``learned`` roles. Null roles and texts are empty; rows without an id are one conversation.

    Turns are in the order of ``turn_col``, nulls first; equal ones in that of role and text, so repeated rows are
    repeated turns. Other columns are ignored, whatever their names, and an empty table gives an empty result. The rows
    are shuffled once by conversation and streamed; some ``CHUNK`` bytes of whole conversations are held at a time, or
    one longer conversation, which is one value of the result.
    """
    id_type = turns.schema[id_col].dataType
    turns = turns.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    turns = turns.repartition(partitions(turns.sparkSession), "id").sortWithinPartitions("id", "turn", "role", "text").select("id", "role", "text")
    schema = T.StructType().add("id", id_type).add("formatted", "string").add("loss", T.ArrayType(T.StructType().add("begin", "long").add("end", "long")))
    return turns.mapInArrow(_format(learned, schema.names), schema).withColumnRenamed("id", id_col)


def parse_chat(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn."""
    return [(_unescape_role(m[1]), unescape(m[2])) for m in _turn.finditer(formatted)]


def digest_chats(chats: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Read back from ``formatted`` and ``loss``: number and digest of the turns (role, line feed, text, line feed each),
    code points and digest of the unescaped text under the loss mask, and code points of ``formatted``."""
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = ["long", "string", "long", "string", "long"]
    schema = T.StructType().add("id", chats.schema[id_col].dataType)
    for name, kind in zip(names, kinds):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1), batch.column(2)):
                text = text.as_py()
                data = text.encode()
                turns = parse_chat(text)
                said = "".join(f"{role}\n{own}\n" for role, own in turns)
                loss = "".join(unescape(data[s["begin"] : s["end"]].decode()) for s in spans.as_py())
                rows.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            made = [pa.array(x, pa.int64() if kind == "long" else pa.string()) for x, kind in zip(zip(*rows) if rows else [[]] * 5, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["id", *names])

    return chats.select(F.col(id_col).alias("id"), "formatted", "loss").mapInArrow(run, schema).withColumnRenamed("id", id_col)
