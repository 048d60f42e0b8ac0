"""Importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k.

Word unigrams and bigrams are hashed into BUCKETS. Their counts over all documents give
the raw model, and over the target documents the target model. A document's log weight
is the sum over its n-grams of log p_target - log p_raw; adding Gumbel noise to it and
keeping the k largest samples k documents without replacement in proportion to their
weights. The noise is a hash of the id, so a rerun or a lost executor changes nothing.

The k-th largest key is found by counting, not by sorting: each round counts the keys
in a histogram of the interval that holds it, until the interval is small.

Defined results: texts without words have weight 0. Rows with equal keys (repeated rows
of one id and text) are kept or dropped together. The noise of a row without an id is a
hash of its text. An empty table gives no rows; an empty target gives every text weight
0. Very long texts count whole. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import Memo, blocks, mix, segment_ids, text_bytes, written

BUCKETS = 1 << 15
#: Share of the documents to keep.
KEEP = 0.85
SEED = 20240101
#: Up to this many target ids are broadcast (8 bytes each); more are joined by shuffle.
BROADCAST_IDS = 2_000_000
#: Each round narrows the interval by up to HISTOGRAM, so MAX_ROUNDS is a stop against a fault.
HISTOGRAM, SMALL, MAX_ROUNDS = 1024, 4096, 200


def _memo() -> Memo:
    return Memo(lambda w: xxhash.xxh3_64_intdigest(w.lower()))


def ngram_buckets(texts: list[bytes], memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text number) of every word and every pair of neighbouring words."""
    lists = [t.split() for t in texts]
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((h for ws in lists for h in map(memo.__getitem__, ws)), np.uint64, int(counts.sum()))
    memo.trim()
    row = segment_ids(counts)
    inside = row[1:] == row[:-1]
    pairs = mix(flat[:-1] * np.uint64(0x9E3779B97F4A7C15) + flat[1:])[inside]
    low = np.uint64(BUCKETS - 1)
    return (np.concatenate([flat, pairs]) & low).astype(np.int64), np.concatenate([row, row[1:][inside]])


def log_ratios(docs: DataFrame) -> np.ndarray:
    """docs(body, is_target) -> log p_target - log p_raw by bucket; each task sends one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, raw, target = _memo(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for block in blocks(batches, "body"):
            bucket, row = ngram_buckets(text_bytes(block.column("body")), memo)
            wanted = np.array(block.column("is_target").to_pylist(), bool)
            raw += np.bincount(bucket, minlength=BUCKETS)
            target += np.bincount(bucket[wanted[row]], minlength=BUCKETS)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], ["bucket", "raw", "target"])

    sums = docs.mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    table = sums.toArrow()  # at most BUCKETS rows
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    at = table.column("bucket").to_numpy()
    raw[at] += table.column("raw").to_numpy()
    target[at] += table.column("target").to_numpy()
    if target.sum() == BUCKETS:
        return np.zeros(BUCKETS)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The k-th largest value of a double column, by rounds of counting."""
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if k >= n:
        return low
    above = 0
    for _ in range(MAX_ROUNDS):
        width = (high - low) / HISTOGRAM
        inside = df.where(F.col(column).between(low, high))
        if width <= 0 or low + width == low:
            return low
        cell = F.least(F.floor((F.col(column) - low) / width), F.lit(HISTOGRAM - 1)).alias("cell")
        # bounds of a cell are the values in it, so that rounding loses none
        cells = inside.groupBy(cell).agg(F.count("*").alias("n"), F.min(column).alias("a"), F.max(column).alias("b")).orderBy(F.desc("cell")).collect()
        for c in cells:
            if above + c["n"] >= k:
                low, high, n = c["a"], c["b"], c["n"]
                break
            above += c["n"]
        if n <= SMALL:
            rest = df.where(F.col(column).between(low, high)).orderBy(F.desc(column)).limit(k - above).agg(F.min(column))
            return rest.first()[0]
    raise RuntimeError(f"the k-th key is not found after {MAX_ROUNDS} rounds")


def resample(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP, seed: int = SEED) -> DataFrame:
    """(id, log_weight, gumbel_key, kept), a row for each input row; ``target_ids`` has the ids of the target documents."""
    source = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("body"))
    ids = target_ids.select(target_ids[id_col].cast("long").alias("id")).where("id is not null").distinct().withColumn("is_target", F.lit(True))
    marked = source.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left")
    ratios = log_ratios(marked.select("body", F.coalesce("is_target", F.lit(False)).alias("is_target")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo()
        for block in blocks(batches, "body"):
            texts = text_bytes(block.column("body"))
            bucket, row = ngram_buckets(texts, memo)
            weights = pa.array(np.bincount(row, weights=ratios[bucket], minlength=len(texts)))
            yield pa.RecordBatch.from_arrays([block.column("id"), weights, block.column("draw")], ["id", "log_weight", "draw"])

    draw = F.when(F.col("id").isNull(), F.xxhash64(F.lit(seed), F.lit("text"), "body")).otherwise(F.xxhash64(F.lit(seed), "id"))
    scored = source.withColumn("draw", draw).mapInArrow(run, "id long, log_weight double, draw long")
    uniform = (F.shiftrightunsigned("draw", 11).cast("double") + 0.5) / float(1 << 53)
    scored = written(scored.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform))), "weights")
    k = int(np.ceil(keep * scored.count()))
    cut = kth_largest(scored, "gumbel_key", k) if k else None
    kept = F.lit(False) if cut is None else F.col("gumbel_key") >= F.lit(cut)
    return scored.select(F.col("id").alias(id_col), "log_weight", "gumbel_key", kept.alias("kept"))


def op1_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """All documents, resampled towards those labelled as good."""
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), good)
