"""Quality rules by suffix arrays: maximal repeated substrings of each text.

Each block of texts becomes one array of word numbers; a suffix array is built
over it by prefix doubling, restricted after every round to suffixes whose
prefix still occurs twice in the same text. Longest-common-prefix (LCP) values
of neighbouring suffixes give the LCP intervals, whose spans are the maximal
repeated substrings; their union gives the covered fraction, and the largest
value the longest repeat.

Defined results: a null or empty text has no words and fails the base rule.
Repeated rows each give their own row. Ties cannot occur (a verdict uses counts
only). A null id is carried through. Extra input columns are ignored unless
asked for with ``carry``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import blocks, segment_ids, text_bytes

#: Base rules.
MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
#: The method's limits: share of words inside repeats of LONG_REPEAT words or more, and the longest repeat.
LONG_REPEAT = 16
MAX_LONG_FRACTION = 0.20
MAX_REPEAT_WORDS = 200
SYMBOLS = b"#*$%&|<>"

_NOT_CONTINUATION = np.array([(b & 0xC0) != 0x80 for b in range(256)])
_SPACE = np.array([b == 0x20 or 0x09 <= b <= 0x0D for b in range(256)])
_SYMBOL = np.array([b in SYMBOLS for b in range(256)])

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, longest_repeat long, n_repeats long, covered_fraction double, "
    "spans array<struct<first:int,last:int>>"
)


def suffix_repeats(words: np.ndarray, texts: np.ndarray, window: int = WINDOW):
    """(repeated, order, lcp) of all positions whose ``window`` words occur twice in their text.

    ``words``: word numbers, with one number of its own after each text; ``texts``:
    the text of each position. ``order``: those positions in suffix order, by text;
    ``lcp[i]``: words that ``order[i]`` and ``order[i - 1]`` have in common (0 for less
    than ``window``). ``window`` must be a power of two.
    """
    n = len(words)
    key = texts.astype(np.int64) * (int(words.max()) + 1 if n else 1) + words
    active = np.argsort(key, kind="stable")
    rank = np.zeros(n, np.int64)
    width, old = 1, np.zeros(n, np.int64)
    second = key[active]
    repeated = np.zeros(n, bool)
    while len(active):
        # rank: first place of the group in suffix order; a group of one keeps its rank for good
        first = np.ones(len(active), bool)
        first[1:] = (second[1:] != second[:-1]) | (old[1:] != old[:-1])
        outer = np.ones(len(active), bool)
        outer[1:] = old[1:] != old[:-1]
        places = np.arange(len(active))
        starts = np.maximum.accumulate(np.where(first, places, 0))
        rank[active] = old + starts - np.maximum.accumulate(np.where(outer, places, 0))
        lasts = np.ones(len(active), bool)
        lasts[:-1] = first[1:]
        active = active[~(first & lasts)]
        if width == window:
            repeated[active] = True
        if not len(active):
            break
        ahead = active + width  # a repeated prefix never reaches past its text's own end mark
        old, second = rank[active], rank[ahead]
        by = np.lexsort((second, old))
        active, old, second = active[by], old[by], second[by]
        width *= 2
    held = np.flatnonzero(repeated)
    order = held[np.argsort(rank[held], kind="stable")]
    return repeated, order, _lcp(words, order, window)


def _lcp(words: np.ndarray, order: np.ndarray, window: int) -> np.ndarray:
    """Common words of neighbours in suffix order; text order makes the work linear."""
    if not len(order):
        return np.zeros(0, np.int64)
    before = np.full(len(words) + 1, -1, np.int64)
    before[order[1:]] = order[:-1]
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(order))
    lcp = np.zeros(len(order), np.int64)
    word, common, last = words.tolist(), 0, -2
    for at in np.sort(order).tolist():
        common = max(common - 1, 0) if at == last + 1 else 0
        last, other = at, before[at]
        if other < 0:
            common = 0
            continue
        other = int(other)
        while word[at + common] == word[other + common] and at != other:
            common += 1
        lcp[place[at]] = common
    lcp[lcp < window] = 0
    return lcp


def interval_count(lcp: np.ndarray) -> int:
    """Number of LCP intervals, that is of maximal repeated substrings up to their left extension."""
    found, open_at = 0, []
    for value in lcp.tolist():
        while open_at and open_at[-1] > value:
            open_at.pop()
        if value and (not open_at or open_at[-1] < value):
            open_at.append(value)
            found += 1
    return found


def measure(raw: list[bytes]) -> dict[str, np.ndarray | list]:
    """The counts of each text of a block."""
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw), np.uint8)
    row = segment_ids(size)
    count = lambda mask: np.bincount(row[mask], minlength=len(raw))
    word_chars = count(_NOT_CONTINUATION[data] & ~_SPACE[data])
    n_symbols = count(_SYMBOL[data])

    numbers: dict[bytes, int] = {}
    parts, n_words, n_dup_lines = [], np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
    for i, text in enumerate(raw):
        words = text.split()
        n_words[i] = len(words)
        for w in words:
            if w not in numbers:
                numbers[w] = len(numbers)
        part = np.empty(len(words) + 1, np.int64)
        part[:-1] = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        part[-1] = -1 - i
        parts.append(part)
        if b"\n" in text:
            lines = [x for x in text.split(b"\n") if x.strip()]
            n_dup_lines[i] = len(lines) - len(set(lines))
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    flat = np.where(flat < 0, len(numbers) - 1 - flat, flat)
    text_of = segment_ids(n_words + 1)
    repeated, order, lcp = suffix_repeats(flat, text_of)

    best = np.zeros(len(flat) + 1, np.int64)  # longest repeat that starts at each position
    best[order] = np.maximum(lcp, np.append(lcp[1:], 0)) if len(order) else 0
    begin = np.concatenate([[0], np.cumsum(n_words + 1)])
    n_repeat, covered, longest, repeats, spans = (np.zeros(len(raw), np.int64) for _ in range(4)), None, None, None, []
    n_repeat_words, covered, longest, repeats = n_repeat
    n_repeat_words += _covered(repeated, np.where(repeated, WINDOW, 0), begin)[0]
    covered_words, all_spans = _covered(best[:-1] >= LONG_REPEAT, best[:-1], begin)
    covered += covered_words
    if len(order):
        np.maximum.at(longest, text_of[order], lcp)
        cut = np.flatnonzero(np.diff(text_of[order])) + 1
        for piece, at in zip(np.split(lcp, cut), text_of[order][np.concatenate([[0], cut])], strict=True):
            repeats[at] = interval_count(piece)
    spans = all_spans
    fraction = np.divide(covered, n_words, out=np.zeros(len(raw)), where=n_words > 0)
    failed = (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)
    kept = ~failed & (fraction <= MAX_LONG_FRACTION) & (longest <= MAX_REPEAT_WORDS)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat_words, "base_failed": failed, "kept": kept, "longest_repeat": longest,
        "n_repeats": repeats, "covered_fraction": fraction, "spans": spans,
    }


def _covered(starts: np.ndarray, lengths: np.ndarray, begin: np.ndarray):
    """Words of each text in the union of spans, and the merged spans themselves (word numbers, end exclusive)."""
    texts = len(begin) - 1
    at = np.flatnonzero(starts)
    change = np.zeros(len(starts) + 1, np.int64)
    change[at] += 1
    np.add.at(change, at + lengths[at], -1)
    inside = np.cumsum(change[:-1]) > 0
    total = np.add.reduceat(np.append(inside, False).astype(np.int64), begin[:-1]) if texts else np.zeros(0, np.int64)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    spans: list[list[tuple[int, int]]] = [[] for _ in range(texts)]
    for first, last in edge.reshape(-1, 2).tolist():
        i = int(np.searchsorted(begin, first, side="right")) - 1
        spans[i].append((first - int(begin[i]), last - int(begin[i])))
    return total, spans


def _measured(docs: DataFrame, text_col: str, carried: list[str]) -> tuple[DataFrame, list[str]]:
    """The carried columns as c0, c1, ... and the columns of ``SCHEMA``; the text goes to the tasks once."""
    names = [f"c{i}" for i in range(len(carried))]
    frame = docs.select(*[docs[c].alias(n) for c, n in zip(carried, names, strict=True)], *([] if text_col in carried else [docs[text_col].cast("string").alias("body")]))
    body = names[carried.index(text_col)] if text_col in carried else "body"
    fields = ", ".join(f"{n} {frame.schema[n].dataType.simpleString()}" for n in names)
    span_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, body):
            found = measure(text_bytes(block.column(body)))
            spans = pa.array([[{"first": a, "last": b} for a, b in x] for x in found.pop("spans")], span_type)
            yield pa.RecordBatch.from_arrays(
                [block.column(n) for n in names] + [pa.array(v) for v in found.values()] + [spans],
                [*names, *found, "spans"],
            )

    return frame.mapInArrow(run, f"{fields}, {SCHEMA}" if fields else SCHEMA), names


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per document: the carried columns (default: its id) and the counts and verdict of ``SCHEMA``.

    Runs as one Arrow map over the scan: no shuffle, memory bounded by a block of text.
    """
    carried = [id_col] if carry is None else carry
    out, names = _measured(docs, text_col, carried)
    return out.withColumnsRenamed(dict(zip(names, carried, strict=True)))


def kept_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that the rules keep, with the columns they had."""
    out, names = _measured(docs, text_col, docs.columns)
    return out.where("kept").select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The contract's counts and verdict of every whole document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs).drop("spans")
