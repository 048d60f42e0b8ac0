"""Sum-of-squares online packing of tokenised documents into fixed windows.

Each task keeps a level array: the number of its open windows at every fill level.
A document goes to the level where it makes the sum of the squared counts smallest
(a new window counts as level 0); ties go to the fullest window. Documents longer
than a window are cut into full windows first. Windows leave memory as soon as they
are full. At the end of a task, or when too many are open, the windows still open are
topped up: the fullest ones stay as the level array filled them, and their gaps are
closed with pieces cut from the emptiest. What is left at the very end is one window,
which is cut into power-of-two sequences, so nothing is padded. ``Packer.placed`` and
``Packer.moved`` count the ids that stay where they were placed and those that move.

Texts are tokenised word by word through a memo of token bytes; white space splits
words and no token of the vocabulary spans it, so this equals encoding whole texts.

Sequence ids are (partition number, running number), so a recomputed task gives the
same rows; the input should be a table or another source with a fixed row order.

Defined results: a null or empty text has only its end token and so one piece. Rows
that repeat an id are packed each on their own. A null id is carried. An empty table
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import blocks, text_bytes

WINDOW = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
#: Open windows of a task (of at most WINDOW ids each) before half of them are topped up.
MAX_OPEN = 2048
#: Token bytes in one output batch.
OUT_BYTES = 4 << 20

SCHEMA = "id long, start long, length long, token_bytes binary, doc_tokens long, sequence_id long, offset long"


#: ASCII marks that end many words. After an ASCII letter or digit they are always tokens of their own.
TAIL = b".,!*$%&#|;:?"
_ASCII_WORD = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")
#: Words of these letters alone are one piece each, and no normaliser rewrites them.
PLAIN = re.compile("[a-zß-öø-ÿ]+").fullmatch


def _byte_chars() -> dict[int, str]:
    """The byte-level alphabet of public BPE vocabularies: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


_BYTE_CHARS = _byte_chars()
#: Words (lower-cased A-Z) of one generation of a worker's memo, which has two.
MEMO_WORDS = 200_000


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32 bits."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Token bytes (little-endian unsigned 32 bits) of whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Words of the present generation and of the one before, from which words in use are taken over.
        self.memo: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def learn(self, words: set[bytes]) -> None:
        """Fill the memo. A word with trailing marks is its stem's tokens and theirs, so stems are shared."""
        memo = self.memo
        split = {}
        for word in words:
            stem = word.rstrip(TAIL)
            if len(stem) < len(word) and stem and stem[-1] in _ASCII_WORD:
                split[word] = stem, word[len(stem) :]
        need = words.difference(split)
        need.update(x for pair in split.values() for x in pair)
        need.difference_update(memo)
        need = self.learn_plain(need)
        todo = list(need)
        for at in range(0, len(todo), 10_000):
            part = todo[at : at + 10_000]
            done = self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            for word, found in zip(part, done, strict=True):
                memo[word] = packed(found.ids)
        for word, (stem, tail) in split.items():
            memo[word] = memo[stem] + memo[tail]

    def learn_plain(self, words: set[bytes]) -> set[bytes]:
        """Take the words of lower-case Latin letters alone straight through the vocabulary's merges; return the rest.

        Such a word is one piece for the tokenizer and nothing in it is rewritten, so its
        normaliser and splitter, half of its time, can be left out.
        """
        tokenize, memo, rest = self.tokenizer.model.tokenize, self.memo, set()
        for word in words:
            if PLAIN(word.decode()):
                memo[word] = packed([t.id for t in tokenize(word.decode("latin-1").translate(_BYTE_CHARS))])
            else:
                rest.add(word)
        return rest

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        if len(self.memo) > MEMO_WORDS:
            self.memo, self.before = {}, self.memo
        # bytes.lower() touches A-Z only, which the vocabulary lower-cases anyway
        lists = [t.lower().split() for t in texts]
        new = set().union(*lists).difference(self.memo)
        again = new.intersection(self.before)
        self.memo.update((w, self.before[w]) for w in again)
        self.learn(new - again)
        get = self.memo.__getitem__
        return [b"".join(map(get, ws)) for ws in lists]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder, and so one memo, for all tasks that a Python worker runs."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Packer:
    """The level array and the open windows of one task. Pieces are (id, start, bytes, doc tokens)."""

    def __init__(self, first_sequence: int, window: int = WINDOW):
        self.window, self.sequence = window, first_sequence
        self.level = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list]] = {}
        self.count = self.placed = self.moved = 0
        self.out: list[tuple] = []

    def emit(self, pieces: list) -> None:
        offset = 0
        for key, start, ids, total in pieces:
            self.out.append((key, start, len(ids) // 4, ids, total, self.sequence, offset))
            offset += len(ids) // 4
        self.sequence += 1

    def choose(self, size: int) -> int:
        """The fill level (0: a new window) that leaves the least sum of squared counts."""
        room = self.window - size
        now = self.level[1 : room + 1]
        at = np.flatnonzero(now)
        if not len(at):
            return 0
        after = self.level[at + 1 + size]  # the last level (full) always counts 0
        change = 2 * (after - now[at]) + np.where(at + 1 == room, 1, 2)
        best = len(at) - 1 - int(np.argmin(change[::-1]))
        return int(at[best]) + 1 if change[best] <= 2 * self.level[size] + 1 else 0

    def add(self, key, ids: bytes) -> None:
        total, start, width = len(ids) // 4, 0, 4 * self.window
        self.placed += total
        while len(ids) - 4 * start >= width:
            self.emit([(key, start, ids[4 * start : 4 * start + width], total)])
            start += self.window
        piece = (key, start, ids[4 * start :], total)
        size = total - start
        if not size:
            return
        at = self.choose(size)
        pieces = []
        if at:
            pieces = self.open[at].pop()
            self.level[at] -= 1
            self.count -= 1
        pieces.append(piece)
        if at + size == self.window:
            self.emit(pieces)
        else:
            self.open.setdefault(at + size, []).append(pieces)
            self.level[at + size] += 1
            self.count += 1
            if self.count > MAX_OPEN:
                self.top_up(MAX_OPEN // 2)

    def top_up(self, most: int) -> None:
        """Close the gaps of the fullest windows with pieces of the emptiest, until at most ``most`` are open (0: none)."""
        queue = deque((at, pieces) for at in sorted(self.open, reverse=True) for pieces in self.open[at])
        while len(queue) > max(1, most):
            at, pieces = queue.popleft()
            gap = self.window - at
            while gap and queue:
                level, donor = queue.pop()
                key, start, ids, total = donor.pop()
                size = len(ids) // 4
                take = min(gap, size)  # the tail of the donor's last piece
                pieces.append((key, start + size - take, ids[4 * (size - take) :], total))
                self.moved += take
                gap -= take
                if take < size:
                    donor.append((key, start, ids[: 4 * (size - take)], total))
                if level > take:
                    queue.append((level - take, donor))
            if gap:
                queue.append((self.window - gap, pieces))
            else:
                self.emit(pieces)
        if queue and not most:
            self.split(*queue.pop())
        self.open, self.count = {}, len(queue)
        self.level[:] = 0
        for at, pieces in queue:
            self.open.setdefault(at, []).append(pieces)
            self.level[at] += 1

    def split(self, fill: int, pieces: list) -> None:
        """Cut one window into sequences of power-of-two lengths, the longest first."""
        waiting = deque(pieces)
        self.moved += fill
        for b in range(fill.bit_length() - 1, -1, -1):
            out, need = [], fill & 1 << b
            while need:
                key, start, ids, total = waiting.popleft()
                take = min(need, len(ids) // 4)
                out.append((key, start, ids[: 4 * take], total))
                need -= take
                if 4 * take < len(ids):
                    waiting.appendleft((key, start + take, ids[4 * take :], total))
            if out:
                self.emit(out)

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.out, strict=True)) if self.out else [[]] * 7
        self.out = []
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        names = ["id", "start", "length", "token_bytes", "doc_tokens", "sequence_id", "offset"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Pieces of all documents (see ``SCHEMA``), one row each, with their ids as little-endian unsigned 32-bit bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        packer = Packer(TaskContext.get().partitionId() << 32, window)
        end, waiting = np.array([END_ID], "<u4").tobytes(), 0
        for block in blocks(batches, "body"):
            for key, ids in zip(block.column("id").to_pylist(), encode(text_bytes(block.column("body"))), strict=True):
                packer.add(key, ids + end)
                waiting += len(ids)
                if waiting > OUT_BYTES:
                    waiting = 0
                    yield packer.batch()
        packer.top_up(0)
        yield packer.batch()

    source = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("body"))
    return source.mapInArrow(run, SCHEMA).withColumnRenamed("id", id_col)


def digest(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns of the pieces: their ids as a checksum."""
    return pieces.select(id_col, "start", "length", F.crc32("token_bytes").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_sum_of_squares_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 ids of the public 49k word vocabulary."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(pack(docs, public_tokenizers.path(TOKENIZER)))
