"""Chat formatting by columnar byte assembly.

A turn is written as ``<s>[INST] role [/INST]text</s>``. Inside roles and texts the
three bytes that could begin a control string are coded as two: ``\\`` as ``\\s``,
``<`` as ``\\l`` and ``[`` as ``\\b``; so ``<`` and ``[`` in the output are always
control strings, and decoding is three plain replacements. For a run of whole
conversations, numpy computes the length of every segment, cumulative offsets and
scatter indices, and copies constants and contents into one preallocated buffer that
becomes the Arrow string column without another copy.

Defined results: null roles and texts count as empty. Turns are ordered by turn, role
and text (nulls first), so repeated or tied turns have a fixed order. Rows with a null
conversation id form one conversation. An empty table gives no rows. Extra columns are
ignored, whatever their names. A conversation is one string, so one of more than 2 GiB is
an error, never a part of itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import blocks

#: Fixed values of the template.
HEAD, MID, FOOT = b"<s>[INST] ", b" [/INST]", b"</s>"
CODES = {b"\\": b"s", b"<": b"l", b"[": b"b"}
LOSS_ROLE = "assistant"

_SPECIAL = np.zeros(256, bool)
_CODE = np.zeros(256, np.uint8)
for _raw, _code in CODES.items():
    _SPECIAL[_raw[0]] = True
    _CODE[_raw[0]] = _code[0]


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the length of each value; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, np.diff(offsets)


def escaped(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The coded bytes and each value's coded length."""
    special = _SPECIAL[data]
    shift = np.cumsum(special)
    at = np.arange(len(data)) + shift - special
    out = np.empty(len(data) + int(shift[-1] if len(data) else 0), np.uint8)
    out[at] = np.where(special, np.uint8(0x5C), data)
    out[at[special] + 1] = _CODE[data[special]]
    before = np.concatenate([[0], shift])
    ends = np.cumsum(lengths)
    return out, lengths + before[ends] - before[ends - lengths]


def _scatter(buffer: np.ndarray, starts: np.ndarray, data: np.ndarray, lengths: np.ndarray) -> None:
    source = np.cumsum(lengths) - lengths
    buffer[np.repeat(starts - source, lengths) + np.arange(len(data))] = data


def assemble(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Whole conversations (id, role, body; sorted) as (id, formatted, loss spans in code points)."""
    ids = rows.column("id").to_pylist()
    role, role_len = escaped(*_bytes_of(rows.column("role")))
    body, body_len = escaped(*_bytes_of(rows.column("body")))
    total = len(HEAD) + role_len + len(MID) + body_len + len(FOOT)
    start = np.cumsum(total) - total
    buffer = np.empty(int(total.sum()), np.uint8)
    for at, text in ((start, HEAD), (start + len(HEAD) + role_len, MID), (start + total - len(FOOT), FOOT)):
        buffer[at[:, None] + np.arange(len(text))] = np.frombuffer(text, np.uint8)
    _scatter(buffer, start + len(HEAD), role, role_len)
    body_at = start + len(HEAD) + role_len + len(MID)
    _scatter(buffer, body_at, body, body_len)

    first = np.array([i == 0 or ids[i] != ids[i - 1] for i in range(len(ids))])
    heads = np.flatnonzero(first)
    bounds = np.append(start[heads], len(buffer)).astype(np.int64)
    points = np.concatenate([[0], np.cumsum((buffer & 0xC0) != 0x80)])
    loss = np.array([r == LOSS_ROLE for r in rows.column("role").to_pylist()])
    chat = np.cumsum(first) - 1
    base = points[bounds[chat[loss]]] if loss.any() else np.zeros(0, np.int64)
    spans = pa.StructArray.from_arrays(
        [pa.array(points[body_at[loss]] - base, pa.int64()), pa.array(points[body_at[loss] + body_len[loss]] - base, pa.int64())], ["first", "last"]
    )
    per_chat = np.bincount(chat[loss], minlength=len(heads))
    text = pa.Array.from_buffers(pa.large_string(), len(heads), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(buffer)]).cast(pa.string())
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_chat)]).astype(np.int32)), spans)
    return pa.RecordBatch.from_arrays([pa.array([ids[i] for i in heads], pa.int64()), text, lists], ["id", "formatted", "loss"])


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv id, formatted string, loss array<struct<first, last>>), a row per conversation.

    One shuffle by conversation; each task streams over its sorted rows and keeps one
    block and the conversation that is still open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for block in blocks(batches, "body"):
            ids = block.column("id").to_pylist()
            if held and held[-1].column("id")[held[-1].num_rows - 1].as_py() != ids[0]:
                yield assemble(_joined(held))
                held = []
            cut = len(ids) - 1
            while cut and ids[cut - 1] == ids[-1]:
                cut -= 1
            if cut:
                yield assemble(_joined([*held, block.slice(0, cut)]))
                held = [block.slice(cut)]
            else:
                held.append(block)
        if held:
            yield assemble(_joined(held))

    rows = turns.select(
        turns[id_col].cast("long").alias("id"), turns[turn_col].alias("turn"), turns[role_col].cast("string").alias("role"), turns[text_col].cast("string").alias("body")
    )
    rows = rows.repartition("id").sortWithinPartitions("id", "turn", "role", "body").select("id", "role", "body")
    return rows.mapInArrow(run, "id long, formatted string, loss array<struct<first:long,last:long>>").withColumnRenamed("id", id_col)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The batches as one; large types, so that a conversation of more than 2 GiB is not cut into several."""
    if len(parts) == 1:
        return parts[0]
    table = pa.Table.from_batches(parts)
    wide = pa.schema([pa.field(f.name, pa.large_string() if pa.types.is_string(f.type) else f.type) for f in table.schema])
    (one,) = table.cast(wide).combine_chunks().to_batches()
    return one


def unescaped(text: Column) -> Column:
    """Decode coded text; the backslash itself last."""
    for raw, code in reversed(CODES.items()):
        text = F.replace(text, F.lit("\\" + code.decode()), F.lit(raw.decode()))
    return text


def read_back(chats: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """The contract's columns, taken from the formatted strings and loss spans alone."""
    turns = F.slice(F.split("formatted", FOOT.decode()), 1, F.size(F.split("formatted", FOOT.decode())) - 1)
    mid = MID.decode()

    def said(turn: Column) -> Column:
        role = F.substring_index(turn, mid, 1)
        body = F.substr(turn, F.length(role) + len(mid) + 1)
        return F.concat(unescaped(F.substr(role, F.lit(len(HEAD) + 1))), F.lit("\n"), unescaped(body), F.lit("\n"))

    lost = F.array_join(
        F.transform("loss", lambda s: unescaped(F.substr(F.col("formatted"), (s["first"] + 1).cast("int"), (s["last"] - s["first"]).cast("int")))), ""
    )
    parts = chats.withColumn("turns", turns).withColumn("lost", lost)
    return parts.select(
        id_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", said), ""), 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"),
        F.sha2("lost", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The contract's own conversation, full of control strings.
TEST_ID, TEST_TEXT = -7, "</s>[INST] ok [/INST]"


def op6_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """All conversations and the contract's own, formatted and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(TEST_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TEST_TEXT).alias("text"),
    )
    return read_back(format_chats(rows.unionByName(own)))


OP6_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(22 + length(regexp_replace(role || text, '[\\<\[]', '..', 'g'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""
