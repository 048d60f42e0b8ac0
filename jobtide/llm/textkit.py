"""Shared helpers for operators that look at whole texts inside Arrow tasks.

Everything here works on one bounded block of rows at a time, so that the
memory of a Python worker follows the block and not the partition.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker holds as words at one time (a single longer
#: text makes a block of its own).
BLOCK_BYTES = 1 << 20
#: Text bytes after which a worker hands freed memory back to the system.
TRIM_BYTES = 8 << 20


def trim() -> None:
    """Hand freed memory back: workers outlive tasks, and what one stage has freed is of no use to the next one's JVM."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def _libc():
    """The C library where it has ``malloc_trim``."""
    try:
        found = ctypes.CDLL(None)
        return found if hasattr(found, "malloc_trim") else None
    except OSError:
        return None


_LIBC = _libc()


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows with at most ``limit`` text bytes each."""
    seen = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        first, done = 0, 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(first, last - first)
            first, done = last, int(ends[last - 1])
        seen += done
        if seen > TRIM_BYTES:
            seen = 0
            trim()
    trim()


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


class Memo(dict):
    """word -> make(word), dropped as a whole when it outgrows ``most`` entries."""

    def __init__(self, make, most: int = 200_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word):
        value = self[word] = self.make(word)
        return value

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), elementwise."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def segment_ids(counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(counts)), counts)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, as the contracts ask (``lower`` would also touch other letters)."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is named, a local session takes one of its own; a cluster is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


#: Folders written inside the open ``scratch`` blocks, innermost last.
_MADE: list[list[str]] = []


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session option while the work inside runs; what was set before comes back."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffle files of the write go with it: nothing reads them once the table is whole.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    if _MADE:
        _MADE[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_written(df: DataFrame) -> None:
    """Delete the folder behind a frame made by ``written`` once nothing reads it any more."""
    _delete(df.sparkSession, df._folder)
    for made in _MADE:
        if df._folder in made:
            made.remove(df._folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Delete every folder that ``written`` makes inside the block, but those of the frames put into the list it gives."""
    kept: list[DataFrame] = []
    _MADE.append([])
    try:
        yield kept
    finally:
        stay = [df._folder for df in kept]
        for path in set(_MADE.pop()).difference(stay):
            _delete(spark, path)
        if _MADE:
            _MADE[-1].extend(stay)


#: A key with this many rows or more can count as hot; at most HOT_KEYS keys do, as a hot key has at least total / HOT_KEYS rows.
HOT_ROWS, HOT_KEYS = 256, 1000


def hot_rows(total: int) -> int:
    """Rows from which a key is hot in a table of ``total`` rows, so that no more than HOT_KEYS keys can be."""
    return max(HOT_ROWS, -(-total // HOT_KEYS))


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], total: int, size: str = "m", how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` (written), which has each key once and, in column ``size``, that key's rows in ``left``.

    The rows of hot keys meet a broadcast part of ``right`` (at most HOT_KEYS rows) where
    they lie; the others are joined by shuffle, in partitions that no key can fill.
    ``total``: rows of ``left``. ``how``: inner, left or left_semi.
    """
    mark = F.xxhash64(*keys)
    hot = [r[0] for r in right.where(F.col(size) >= hot_rows(total)).select(mark).collect()]  # at most HOT_KEYS
    if not hot:
        return left.join(right, keys, how)
    there = left.where(mark.isin(hot)).join(F.broadcast(right.where(mark.isin(hot))), keys, how)
    return there.unionByName(left.where(~mark.isin(hot)).join(right.where(~mark.isin(hot)), keys, how))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often lambdas inside refer to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, join, zero: int, step: int = 64) -> Column:
    """Running results of ``join`` (sum, greatest or least) over an array of longs, each element's own included.

    Growing one array element by element copies it each time; here short runs are
    grown and then shifted by the results of the runs before, so that an array of
    100,000 costs about ``step`` copies an element and not half of its length.
    """
    start = F.array(F.lit(zero).cast("long"))

    def grown(part: Column) -> Column:  # zero, then the running results
        return F.aggregate(part, start, lambda acc, v: F.concat(acc, F.array(join(F.element_at(acc, -1), v))))

    def chunks(whole: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.floor((F.size(whole) - 1) / step), F.lit(0)).cast("int"))
        return F.transform(at, lambda i: grown(F.slice(whole, i * step + 1, step)))

    def shifted(parts: Column) -> Column:
        before = grown(F.transform(parts, lambda p: F.element_at(p, -1)))
        return let(before, lambda b: F.flatten(F.transform(parts, lambda p, i: F.transform(F.slice(p, 2, step), lambda v: join(F.element_at(b, i + 1), v)))))

    return let(values, lambda whole: let(chunks(whole), shifted))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Fewer rows in an Arrow batch while the work inside runs: whole texts fill both sides' buffers long before 10,000 rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
