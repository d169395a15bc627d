"""Chat formatting at token level.

A turn is ``<|turn|>`` role ``<|text|>`` text ``<|end|>``.  Role and text are
encoded each by itself, and the marks are reserved ids spliced between them, so
no text can make a mark, and no token spans a border.  Control strings inside
texts (the marks and those of common other templates) get a backslash after
their first character, and backslashes are doubled, so that the formatted text
can be read back as well.  The loss mask covers the assistant's texts; its
places are prefix sums of the segments' lengths over the conversation.

A conversation may hold a large part of all turns, so its tokens are never put
into one row: turns are encoded before the shuffle, and the sorted stream is
assembled turn by turn with only the running sums in memory.

Defined results: a null text or role is empty; turns are ordered by turn
(null first), ties by role, then tokens; conversation ids may be of any type
that has an order, and a null one is one conversation; repeated rows are turns of their own; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffle_partitions, slices
from .tokens import ByteBpe

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of this template and of other public ones.
CONTROL = (TURN, TEXT, END, "<s>", "</s>", "<unk>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")
FIRST_RESERVED = 50257
RESERVED = {TURN: FIRST_RESERVED, TEXT: FIRST_RESERVED + 1, END: FIRST_RESERVED + 2}
_AT_CONTROL = re.compile("(?=" + "|".join(map(re.escape, CONTROL)) + ")(.)", re.S)
_ESCAPED = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    """``text`` without any control string; ``unescape`` gives it back."""
    if "\\" in text:
        text = text.replace("\\", "\\\\")
    return _AT_CONTROL.sub(r"\1\\", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


_ENCODED = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("text_at", T.LongType()), T.StructField("text_n", T.LongType())])
#: A row per turn: its tokens, where they start in the conversation, and the loss span there (empty if start = end).
FORMATTED = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("nth", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), *(T.StructField(n, T.LongType()) for n in ("start", "loss_start", "loss_end"))])
DIGESTS = T.StructType([T.StructField(n, T.LongType()) for n in ("conv_id", "n_turns")] + [T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])
_INTS = pa.list_(pa.int32())


def _of(schema: T.StructType, kind: T.DataType) -> T.StructType:
    """The schema with the conversation's id of that type."""
    return T.StructType([T.StructField("conv_id", kind), *schema.fields[1:]])



def _encode(batches: Iterator[pa.RecordBatch], paths: tuple) -> Iterator[pa.RecordBatch]:
    bpe = ByteBpe(*paths)
    for batch in slices(batches):
        ids, at, n, roles = [], [], [], []
        for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            r, t = bpe.encode(escape(role or "")), bpe.encode(escape(text or ""))
            lengths = np.cumsum([1, len(r), 1, len(t), 1])
            ids.append(np.concatenate([[RESERVED[TURN]], r, [RESERVED[TEXT]], t, [RESERVED[END]]]).astype(np.int32))
            at.append(lengths[2])
            n.append(len(t))
            roles.append(role or "")
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(roles, pa.string()), pa.array(ids, _INTS), pa.array(at, pa.int64()), pa.array(n, pa.int64())], names=_ENCODED.names)


def _assemble(batches: Iterator[pa.RecordBatch], learns: str) -> Iterator[pa.RecordBatch]:
    now, nth, place = ..., 0, 0
    for batch in batches:
        get = [batch.column(batch.schema.get_field_index(n)) for n in _ENCODED.names]
        lengths = np.diff(get[3].offsets.to_numpy())
        out = []
        for conv, role, size, at, n in zip(get[0].to_pylist(), get[2].to_pylist(), lengths.tolist(), get[4].to_pylist(), get[5].to_pylist()):
            if now is ... or conv != now:
                now, nth, place = conv, 0, 0
            first = place + at
            out.append((nth, place, first, first + n if role == learns else first))
            nth, place = nth + 1, place + size
        columns = [pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 4)]
        yield pa.RecordBatch.from_arrays([get[0], columns[0], get[3], *columns[1:]], names=FORMATTED.names)


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learns: str = "assistant", tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """Formatted turns, in order within their conversations, each conversation in one partition."""
    kind = df.schema[conv].dataType
    slim = df.select(F.col(f"`{conv}`"), F.col(f"`{turn}`").cast("long"), F.col(f"`{role}`").cast("string"), F.col(f"`{text}`").cast("string"))
    encoded = slim.mapInArrow(lambda it: _encode(it, (tokenizer, ranks)), _of(_ENCODED, kind))
    dealt = encoded.repartition(shuffle_partitions(df.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "ids")
    return dealt.mapInArrow(lambda it: _assemble(it, learns), _of(FORMATTED, kind))


class Reader:
    """Digests of one conversation, read from its formatted turns one by one."""

    def __init__(self, bpe: ByteBpe):
        self.bpe, self.turns, self.loss = bpe, hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, ids: np.ndarray, start: int, loss_start: int, loss_end: int) -> tuple[str, str]:
        """Role and text of a turn, read back from its tokens."""
        marks = np.flatnonzero(ids >= FIRST_RESERVED)
        if ids[marks].tolist() != [RESERVED[m] for m in (TURN, TEXT, END)]:
            raise ValueError("marks are missing or misplaced")
        role, text = (self.bpe.decode_bytes(ids[a + 1 : b].tolist()).decode("utf-8", "surrogatepass") for a, b in zip(marks, marks[1:]))
        self.n += 1
        self.chars += len(TURN) + len(role) + len(TEXT) + len(text) + len(END)
        under = unescape(self.bpe.decode_bytes(ids[loss_start - start : loss_end - start].tolist()).decode("utf-8", "surrogatepass"))
        self.loss_chars += len(under)
        self.loss.update(under.encode("utf-8", "surrogatepass"))
        role, text = unescape(role), unescape(text)
        self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        return role, text

    def row(self, conv) -> tuple:
        return conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _read(batches: Iterator[pa.RecordBatch], paths: tuple) -> Iterator[pa.RecordBatch]:
    bpe, now, reader, kind = ByteBpe(*paths), ..., None, None

    def made(rows: list[tuple]) -> pa.RecordBatch:
        types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, types)], names=DIGESTS.names)

    for batch in batches:
        get = [batch.column(batch.schema.get_field_index(n)) for n in FORMATTED.names]
        kind = get[0].type
        offsets, values = get[2].offsets.to_numpy(), get[2].values.to_numpy(zero_copy_only=False)
        rows = []
        for k, (conv, start, a, b) in enumerate(zip(*(get[i].to_pylist() for i in (0, 3, 4, 5)))):
            if reader is None or conv != now:
                if reader:
                    rows.append(reader.row(now))
                now, reader = conv, Reader(bpe)
            reader.add(values[offsets[k] : offsets[k + 1]], start, a, b)
        yield made(rows)
    if reader:
        yield made([reader.row(now)])


def digests(formatted: DataFrame, tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """What formatted conversations hold, read back from tokens and masks; the turns must come as they were formatted."""
    return formatted.mapInArrow(lambda it: _read(it, (tokenizer, ranks)), _of(DIGESTS, formatted.schema["conv_id"].dataType))


def oracle(table: str) -> str:
    """The digests of a table of turns as SQL for DuckDB."""

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def added(c: str) -> str:
        strings = " + ".join(f"(length({c}) - length(replace({c}, {quoted(s)}, ''))) // {len(s)}" for s in CONTROL)
        return f"(length({c}) - length(replace({c}, chr(92), '')) + {strings})"

    marks = len(TURN) + len(TEXT) + len(END)
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM {table})
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
  CAST(sum(CASE WHEN r = 'assistant' THEN length(t) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN r = 'assistant' THEN t ELSE '' END, '' ORDER BY turn, r, t)) AS loss_sha256,
  CAST(sum({marks} + length(r) + length(t) + {added('r')} + {added('t')}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""
