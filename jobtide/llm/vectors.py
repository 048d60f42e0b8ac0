"""Vector code compression: each part of a vector becomes the number of its nearest codebook entry.

Vectors of integers (floors of SCALE times each component) are cut into PARTS equal
parts; each part position has a codebook of at most 64 entries, begun with the parts of
the first vectors and moved to the (floored) means of what is assigned to them, twice.

The nearest entry is found by slice-and-intersect bitmasks. For every dimension of a part
the entries are sorted by their coordinate, and each place in that order carries the mask
(one bit an entry, uint64) of all entries before it. A part asks for the slice of entries
within a radius in each dimension: two binary searches give two places, whose masks differ
by the slice. The slices of all dimensions ANDed are the entries in the box around the
part. The first radius is the distance to the best of the entries that are nearest in one
dimension, so the box holds that entry and all that are as near: the candidates are exact,
and only they are measured.

One Arrow map over the vectors per round; tasks sum what they assign, so a round shuffles
at most one row per task and codebook component, and the driver holds one codebook.

Defined results: rows whose vector is null or holds a null or non-finite component are
left out. Repeated rows and ids each give a row; where codebooks begin, equal ids go by
their vectors. A null id counts as larger than all. Fewer than 64 vectors begin as many
entries. Empty vectors have empty parts (entry 0, error 0). The first vector sets the length;
a vector of another length, or where it is no multiple of PARTS every vector, keeps its row
with a null code and error. Components beyond 2**20 raise an error, as their squares would
not fit. Null labels count as one label. Very long vectors are worked on in smaller blocks.
Extra columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import scratch, spread_join, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Largest absolute component; squares of differences then fit 64 bits.
LARGEST = 1 << 20
#: Components that a task works on at one time.
BLOCK = 1 << 20


def integers(values: np.ndarray) -> np.ndarray:
    """Floors of SCALE times each component."""
    if len(values) and np.abs(values).max() > LARGEST:
        raise ValueError(f"vector components beyond {LARGEST} are not supported")
    return np.floor(values.astype(np.float64) * SCALE).astype(np.int64)


class Slices:
    """Exact nearest entries of one codebook (entries, dimensions) by prefix masks of its sorted coordinates."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        order = np.argsort(entries, axis=0, kind="stable")
        self.order = order.T
        self.sorted = [np.ascontiguousarray(entries[o, j]) for j, o in enumerate(self.order)]
        bits = np.uint64(1) << order.T.astype(np.uint64)
        self.masks = [np.concatenate([np.zeros(1, np.uint64), np.bitwise_or.accumulate(b)]) for b in bits]

    def _squares(self, parts: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ((parts - self.entries[at]) ** 2).sum(axis=1)

    def candidates(self, parts: np.ndarray) -> np.ndarray:
        """The mask of entries in the box around each part, whose radius is an upper bound of the nearest distance."""
        bound = self._squares(parts, np.zeros(len(parts), np.int64))
        for j, values in enumerate(self.sorted):
            place = np.searchsorted(values, parts[:, j])
            for near in (np.maximum(place - 1, 0), np.minimum(place, len(values) - 1)):
                bound = np.minimum(bound, self._squares(parts, self.order[j][near]))
        radius = np.ceil(np.sqrt(bound.astype(np.float64))).astype(np.int64) + 1  # rounding can only widen the box
        mask = np.full(len(parts), (1 << len(self.entries)) - 1, np.uint64)
        for j, (values, before) in enumerate(zip(self.sorted, self.masks, strict=True)):
            first = np.searchsorted(values, parts[:, j] - radius, side="left")
            last = np.searchsorted(values, parts[:, j] + radius, side="right")
            mask &= before[last] ^ before[first]
        return mask

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each part; ties go to the lower entry."""
        left = self.candidates(parts)
        best, least = np.zeros(len(parts), np.int64), np.full(len(parts), np.iinfo(np.int64).max)
        rows = np.arange(len(parts))
        while len(rows):
            lowest = left & (~left + np.uint64(1))
            entry = np.frexp(lowest.astype(np.float64))[1] - 1
            squares = self._squares(parts[rows], entry)
            better = squares < least[rows]
            best[rows[better]], least[rows[better]] = entry[better], squares[better]
            left = left ^ lowest
            rows, left = rows[left > 0], left[left > 0]
        return best, least


def assign(vectors: np.ndarray, books: list[Slices]) -> tuple[np.ndarray, np.ndarray]:
    """(entries, squared distances), both (vectors, parts)."""
    width = vectors.shape[1] // len(books)
    found = [book.nearest(vectors[:, i * width : (i + 1) * width]) for i, book in enumerate(books)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _matrices(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Blocks of a batch with their integer vectors."""
    step = max(1, BLOCK // max(1, length))
    for batch in batches:
        for first in range(0, batch.num_rows, step):
            part = batch.slice(first, step)
            yield part, integers(part.column("vector").flatten().to_numpy(zero_copy_only=False)).reshape(part.num_rows, length)


def kept_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, vector) without null vectors and vectors with null or non-finite components."""
    rows = df.select(df[id_col].cast("long").alias("id"), df[label_col].alias("label"), df[vector_col].alias("vector"))
    finite = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.where(F.col("vector").isNotNull() & finite)


def train(rows: DataFrame, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (PARTS, entries, dimensions) of ``rows(id, vector)``; None where there is no vector that can be cut."""
    first = [r["vector"] for r in rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(ENTRIES).collect()]  # at most ENTRIES
    if not first or len(first[0]) % PARTS:
        return None
    length, width = len(first[0]), len(first[0]) // PARTS
    rows = rows.where(F.size("vector") == length).select("vector")
    start = [v for v in first if len(v) == length]
    books = integers(np.array(start, np.float64).reshape(-1)).reshape(len(start), PARTS, width).transpose(1, 0, 2)
    for _ in range(rounds if width else 0):
        books = _moved(rows, books)
    return books


def _moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks with every used entry at the floored mean of its parts."""
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(b) for b in books]
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for _, vectors in _matrices(batches, parts * width):
            cell = (assign(vectors, slices)[0] + np.arange(parts) * entries).reshape(-1)
            count += np.bincount(cell, minlength=len(count))
            np.add.at(total, cell, vectors.reshape(-1, width))
        used = np.flatnonzero(count)
        at = (used[:, None] * width + np.arange(width)).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[used].reshape(-1)), pa.array(np.repeat(count[used], width))], ["at", "total", "n"])

    moved = rows.mapInArrow(sums, "at long, total long, n long").groupBy("at").agg(F.sum("total"), F.sum("n")).collect()  # one codebook
    after = books.reshape(-1).copy()
    for at, total, n in moved:
        after[at] = total // n
    return after.reshape(books.shape)


def books_digest(books: np.ndarray | None) -> str:
    """SHA-256 of all components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, [] if books is None else books.reshape(-1).tolist())).encode()).hexdigest()


def encode(rows: DataFrame, books: np.ndarray | None) -> DataFrame:
    """(id, label, code, error) of ``rows(id, label, vector)``: two hex digits a part, and the squared distances summed."""
    if books is None:
        return rows.select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    length = books.shape[0] * books.shape[2]
    digits = np.array([f"{i:02x}" for i in range(ENTRIES)], object)
    kind = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(b) for b in books]
        for part, vectors in _matrices(batches, length):
            entry, error = assign(vectors, slices)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), pa.array(digits[entry].sum(axis=1), pa.string()), pa.array(error.sum(axis=1))], ["id", "label", "code", "error"])

    fits = F.size("vector") == length
    coded = rows.where(fits).mapInArrow(run, f"id long, label {kind}, code string, error long")
    return coded.unionByName(encode(rows.where(~fits), None))


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256), a row for each kept vector; label_error is the error of all vectors of its label."""
    rows = kept_vectors(df, id_col, vector_col, label_col)
    with scratch(df.sparkSession) as kept:
        books = train(rows)
        # null labels meet as well: a label is told by whether it is there and by its text
        named = encode(rows, books).select("id", "code", "error", F.col("label").isNull().alias("absent"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("name"))
        coded = written(named, "codes")
        sums = written(coded.groupBy("absent", "name").agg(F.sum("error").alias("label_error"), F.count("*").alias("m")), "sums")
        kept += [coded, sums]
    out = spread_join(coded, sums, ["absent", "name"], coded.count())
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def op12_bitmask_product_codes(spark, sf_dir: str) -> DataFrame:
    """Codes of all embeddings: 16 parts, 64 entries, two rounds."""
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


_ASSIGN = """
a@I@ AS MATERIALIZED (
  SELECT p.vec_id, p.part, any_value(p.x) AS x,
    min(list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - c.x[i]) * (p.x[i] - c.x[i]))) * 64 + c.entry) AS best
  FROM parts p JOIN c@I@ c ON p.part = c.part GROUP BY p.vec_id, p.part
)"""
_MOVE = """
m@I@ AS (
  SELECT part, best % 64 AS entry, i, (sum(x[i]) - ((sum(x[i]) % count(*) + count(*)) % count(*))) // count(*) AS x
  FROM (SELECT part, best, x, unnest(range(1, len(x) + 1)) AS i FROM a@I@) GROUP BY ALL
), c@J@ AS MATERIALIZED (
  SELECT c.part, c.entry, coalesce(n.x, c.x) AS x
  FROM c@I@ c LEFT JOIN (SELECT part, entry, list(x::BIGINT ORDER BY i) AS x FROM m@I@ GROUP BY part, entry) n ON c.part = n.part AND c.entry = n.entry
)"""


def _sql() -> str:
    moves = [_ASSIGN.replace("@I@", str(i)) + "," + _MOVE.replace("@I@", str(i)).replace("@J@", str(i + 1)) for i in range(ROUNDS)]
    steps = [*moves, _ASSIGN.replace("@I@", str(ROUNDS))]
    return """
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, part, v[part * (len(v) // 16) + 1 : (part + 1) * (len(v) // 16)] AS x
  FROM (SELECT vec_id, v, unnest(range(16)) AS part FROM kept)
), c0 AS MATERIALIZED (
  SELECT p.part, s.entry, p.x
  FROM parts p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < 64) s ON p.vec_id = s.vec_id
), @STEPS@, coded AS (
  SELECT vec_id, string_agg(printf('%02x', best % 64), '' ORDER BY part) AS code, sum(best // 64)::BIGINT AS error FROM a@LAST@ GROUP BY vec_id
), books AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c@LAST@
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), books
""".replace("@STEPS@", ", ".join(steps)).replace("@LAST@", str(ROUNDS))


OP12_SQL = _sql()
