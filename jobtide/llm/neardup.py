"""MinHash near-duplicate detection with one-permutation hashing and star-shaped candidates.

1. One Arrow map over the texts gives each document's shingle count, a 128-bit key of
   its shingle set and its band keys (see ``minhash``). Documents with equal sets are
   one class; only its smallest id goes on.
2. Every bucket of a band links its members to one centre (a star), so the number of
   candidate pairs is bounded by the number of band rows, however large a bucket is.
3. Candidates whose sizes allow the threshold are confirmed on the full shingle sets.
   Components follow from confirmed links.
4. A star can miss a link between two members of which one failed against the centre.
   Buckets that still hold several components are searched again: small ones pair the
   members of different components; in large ones the members outside the bucket's
   largest component (its strays) are compared, set against set in blocks of bounded size,
   first with its members and then, as far as they are still apart, with each other. Left
   out of the latter are strays of which fewer shingles occur in another stray component
   than the threshold needs: no link of theirs is possible. Links found are added to the
   components that there are.

What is moved in step 4 grows with the members times the blocks of strays that are left
(one block for up to BLOCK strays), not with pairs of members; only strays that are not
taken in and share most of their shingles with others are quadratic, in blocks. Joins on hot keys (exact
copies, buckets, centres, components) broadcast the part that belongs to hot keys, whose
number is bounded, or salt it.

Defined results: texts without words (or null) have an empty set and link with nothing;
texts of fewer words than a shingle have one shingle, the whole sequence. Equal sets link.
Rows that repeat an id count as one node with the links of all of them. A null id links
with nothing and has a null component (its row counts as kept). Very long texts are whole
sets. Extra columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, extended
from .minhash import BANDS, SHINGLE, band_keys, shingle_sets, signatures, word_memo
from .textkit import blocks, hot_rows, scratch, small_batches, spread_join, text_bytes, written

#: Similarity in percent.
THRESHOLD = 80
#: Up to this many ids, the list of documents to confirm is broadcast (8 bytes each); beyond, it is joined by shuffle.
BROADCAST_IDS = 2_000_000
#: Members of a bucket up to which its remaining pairs are listed; larger buckets go to blocks of BLOCK sets or BLOCK_ITEMS shingles.
SMALL_BUCKET, BLOCK, BLOCK_ITEMS = 48, 512, 1 << 18
#: Blocks of strays of one pool from which strays are sifted by shingle counts before they meet each other. The sifting moves every
#: shingle of a stray twice as a row, which costs about as much as this many copies of its set. Such pools number at most a
#: 4096th of the strays.
FILTER_BLOCKS = 8
#: Blocks that one copy of a stray is joined with.
RUN = 256


def shingle_table(docs: DataFrame, width: int, bands: bool) -> DataFrame:
    """docs(id, body) -> (id, n, hi, lo, bands) or, with ``bands`` false, (id, n, hi, lo, hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_memo()
        for block in blocks(batches, "body"):
            hashes, sizes = shingle_sets(text_bytes(block.column("body")), memo, width)
            ends = np.cumsum(sizes)
            digests = [xxhash.xxh3_128_intdigest(hashes[e - s : e].tobytes()) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
            low = np.array([d & (2**64 - 1) for d in digests], np.uint64).view(np.int64)
            high = np.array([d >> 64 for d in digests], np.uint64).view(np.int64)
            if bands:
                keys = band_keys(signatures(hashes, sizes))
                counts = np.where(sizes > 0, keys.shape[1], 0)
                values = keys[sizes > 0].reshape(-1)
            else:
                counts, values = sizes, hashes.view(np.int64)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [block.column("id"), pa.array(sizes), pa.array(high), pa.array(low), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                ["id", "n", "hi", "lo", "items"],
            )

    return docs.mapInArrow(run, "id long, n long, hi long, lo long, items array<long>")


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose id is in ``ids`` (distinct): by broadcast where the list is short, else by shuffle."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b; written) whose full sets reach the threshold. The set of a ``b`` with many pairs is copied, so that they spread."""
    least = max(BLOCK, hot_rows(pairs.count()))
    hot = pairs.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("copies"), F.count("*").alias("m")).where(F.col("m") >= least).drop("m")
    hot = F.broadcast(written(hot, "hot"))
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("y")).join(hot, "b", "left")
    right = right.select("b", "y", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("salt"))
    dealt = pairs.join(hot, "b", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("a"), F.col("copies")), F.lit(0)).cast("int").alias("salt"))
    shared = F.size(F.array_intersect("x", "y"))
    return (
        dealt.join(left, "a").join(right, ["b", "salt"]).withColumn("shared", shared)
        .where(100 * F.col("shared") >= threshold * (F.size("x") + F.size("y") - F.col("shared")))
        .select("a", "b")
    )


def _sizes_allow(n: str, m: str, threshold: int):
    return 100 * F.least(n, m) >= threshold * F.greatest(n, m)


def _linkable(members: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """(id) of those ``members(id, component)`` of whose shingles enough occur in another of their components for any link between them."""
    own = written(members.join(sets.select("id", "n", "items"), "id"), "own")
    tokens = own.select("id", "n", "component", F.explode("items").alias("token"))
    common = tokens.groupBy("token").agg(F.min("component").alias("p"), F.max("component").alias("q"), F.count("*").alias("m")).where("p < q").select("token", "m")
    total = own.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    able = spread_join(tokens, written(common, "common"), ["token"], total).groupBy("id", "n").count()
    return able.where(100 * F.col("count") >= threshold * F.col("n")).select("id").distinct()


def _pools(rows: DataFrame, sets: DataFrame, threshold: int, total: int) -> DataFrame:
    """(pool, id, component, n, items, class, stray) of the members of large buckets, ``rows(bucket, id, component)``.

    Buckets of one largest component form a pool, so that most pairs are compared once and
    not once a band. A pool's strays are its members outside that component.
    """
    sizes = rows.groupBy("bucket", "component").agg(F.count("*").alias("often"))
    main = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("often", -F.col("component"))).alias("pool"), F.sum("often").alias("rows_here"))
    pools = spread_join(rows.select("bucket", "id", "component"), written(main, "main"), ["bucket"], total, "rows_here").select("pool", "id", "component").distinct()
    step = float(np.log(100 / threshold))
    pools = pools.join(sets.select("id", "n", "items"), "id").withColumn("class", F.floor(F.log(F.col("n")) / step).cast("int"))
    return written(pools.withColumn("stray", F.col("component") != F.col("pool")), "pools")


def _stray_work(pools: DataFrame, sets: DataFrame, threshold: int, among: bool) -> DataFrame:
    """The rows of the set comparisons inside pools.

    The strays of a pool, in blocks, meet the members of its largest component, in blocks
    (kind 0). With ``among``, strays meet each other as well (kind 1); where they are many,
    those that cannot have a link with another are left out first. Sizes more than one class (a factor of 1 / threshold) apart rule a
    link out.
    """
    strays = pools.where("stray")
    kind = lambda df, k: df.drop("stray").withColumn("kind", F.lit(k))
    every, ones = kind(pools.where("not stray"), 0), kind(strays, 0)
    if among:
        crowded = F.broadcast(strays.groupBy("pool").count().where(F.col("count") > FILTER_BLOCKS * BLOCK).select("pool"))
        many = strays.join(crowded, "pool", "left_semi")
        able = written(_linkable(many.select("id", "component").distinct(), sets, threshold), "able")
        meeting = kind(strays.join(crowded, "pool", "left_anti").unionByName(many.join(able, "id", "left_semi")), 1)
        every, ones = every.unionByName(meeting), ones.unionByName(meeting)

    def counted(df: DataFrame, alias: str) -> DataFrame:
        full = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_ITEMS)).cast("int")
        return written(df.groupBy("kind", "pool", "class").agg(full.alias(alias)), "counts")

    k, j = counted(every, "k"), counted(ones, "j")
    number = lambda column, alias: F.explode(F.sequence(F.lit(0), F.col(column) - 1)).alias(alias)
    tasks = k.select("kind", "pool", F.col("class").alias("other"), number("k", "block")).join(j.select("kind", "pool", "class", number("j", "part")), ["kind", "pool"])
    tasks = written(tasks.where("abs(other - class) <= 1").withColumn("run", F.floor(F.col("block") / RUN).cast("int")), "tasks")

    deal = lambda most: F.pmod(F.xxhash64("id"), F.col(most)).cast("int")
    cols = ["kind", "pool", "class", "part", "other", "block", "side", "id", "component", "items"]
    every = every.join(k, ["kind", "pool", "class"]).withColumn("block", deal("k")).withColumnRenamed("class", "other")
    every = every.join(tasks, ["kind", "pool", "other", "block"]).withColumn("side", F.lit(0))
    runs = tasks.groupBy("kind", "pool", "class", "part").agg((F.max("run") + 1).alias("runs"))
    ones = ones.join(j, ["kind", "pool", "class"]).withColumn("part", deal("j")).join(runs, ["kind", "pool", "class", "part"])
    ones = ones.withColumn("run", F.explode(F.sequence(F.lit(0), F.col("runs") - 1))).join(tasks, ["kind", "pool", "class", "part", "run"]).withColumn("side", F.lit(1))
    return every.select(cols).union(ones.select(cols))


def _pool_links(pools: DataFrame, sets: DataFrame, threshold: int, among: bool) -> DataFrame:
    """Links between components inside pools, found set against set."""

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        ids, component, side = group["id"].to_numpy(), group["component"].to_numpy(), group["side"].to_numpy()
        sizes = np.array([len(x) for x in group["items"]])
        vocabulary, number = np.unique(np.concatenate(list(group["items"])), return_inverse=True)
        begin = np.cumsum(sizes) - sizes
        mark, found = np.zeros(len(vocabulary), np.int32), []
        for i in np.flatnonzero(side == 1).tolist():
            own = number[begin[i] : begin[i] + sizes[i]]
            mark[own] = 1
            shared = np.add.reduceat(mark[number], begin)
            mark[own] = 0
            ok = (100 * shared >= threshold * (sizes + sizes[i] - shared)) & (component != component[i]) & (side == 0)
            # one link to each component is enough
            hits = np.flatnonzero(ok)
            found += [(ids[i], j) for j in ids[hits[np.unique(component[hits], return_index=True)[1]]]]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    work = _stray_work(pools, sets, threshold, among)
    return work.groupBy("kind", "pool", "class", "part", "other", "block").applyInPandas(compare, "a long, b long")


def _of(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """``rows`` with the component of their id (its own, where it has no link)."""
    found = rows.join(parts.withColumnRenamed("node", "id"), "id", "left")
    return found.withColumn("component", F.coalesce("component", "id"))


def _split(rows: DataFrame, total: int) -> DataFrame:
    """The rows of buckets that have several components."""
    several = rows.groupBy("bucket").agg(F.min("component").alias("p"), F.max("component").alias("q"), F.count("*").alias("rows_here")).where("p < q")
    several = written(several.select("bucket", "rows_here"), "several")
    return written(spread_join(rows, several, ["bucket"], total, "rows_here", "left_semi"), "split")


def _with_missed_links(spread: DataFrame, pairs: DataFrame, parts: DataFrame, sets: DataFrame, threshold: int, total: int) -> DataFrame:
    """``parts`` with the links between members of one bucket (spread) that are still in different components."""
    left = _split(written(_of(spread.select("bucket", "id", "n", "m"), parts), "member"), total)
    small = left.where(F.col("m") <= SMALL_BUCKET)
    other = small.select("bucket", F.col("id").alias("b"), F.col("n").alias("k"), F.col("component").alias("q"))
    again = (
        small.join(other, "bucket").where("id < b and component <> q").where(_sizes_allow("n", "k", threshold))
        .select(F.col("id").alias("a"), "b").distinct().join(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
    )
    more = _confirmed(written(again, "again"), sets, threshold)
    large = left.where(F.col("m") > SMALL_BUCKET)
    if large.isEmpty():
        return extended(parts, written(more, "more"))
    # first the strays meet the largest component of their pool, which takes most of them in; then those that are left, each other
    pools = _pools(large, sets, threshold, total)
    parts = extended(parts, written(more.union(_pool_links(pools, sets, threshold, among=False)), "more"))
    rest = written(_of(pools.where("stray").select(F.col("pool").alias("bucket"), "id"), parts), "rest")
    rest = _split(rest, rest.count())
    if rest.isEmpty():
        return parts
    pools = _pools(rest, sets, threshold, rest.count())
    return extended(parts, written(_pool_links(pools, sets, threshold, among=True), "more"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """(id, n_shingles, component_id, kept), a row for each input row."""
    spark = docs.sparkSession
    source = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("body"))
    with scratch(spark) as kept:
        with small_batches(spark):
            marks = written(shingle_table(source, width, bands=True), "marks")
        named = marks.where("n > 0 and id is not null")
        total = named.count()
        classes = written(named.groupBy("hi", "lo").agg(F.min("id").alias("head"), F.count("*").alias("m")), "classes")
        heads = spread_join(named, classes, ["hi", "lo"], total).where("id = head").select("id", "n", "items", "hi", "lo").dropDuplicates(["id", "hi", "lo"])
        heads = written(heads, "heads")
        rows = heads.select("id", "n", F.explode("items").alias("bucket"))
        in_bands = BANDS * heads.count()
        # stars: the centre of a bucket is its smallest id; buckets of one member give nothing
        stars = rows.groupBy("bucket").agg(F.min("id").alias("b"), F.min_by("n", "id").alias("k"), F.count("*").alias("m")).where("m > 1")
        spread = written(spread_join(rows, written(stars, "stars"), ["bucket"], in_bands), "spread")
        pairs = written(spread.where("id <> b").where(_sizes_allow("n", "k", threshold)).select(F.col("id").alias("a"), "b").distinct(), "pairs")
        wanted = written(spread.select("id").distinct(), "wanted")
        with small_batches(spark):
            sets = written(shingle_table(_only(source, wanted), width, bands=False).dropDuplicates(["id", "hi", "lo"]), "sets")
        parts = components(written(_confirmed(pairs, sets, threshold), "found"))
        parts = _with_missed_links(spread, pairs, parts, sets, threshold, in_bands)
        # equal ids with different texts tie their classes together
        key = F.struct("hi", "lo")
        repeated = written(named.groupBy("id").agg(F.min(key).alias("x"), F.max(key).alias("y")).where("x <> y").select("id"), "repeated")
        if not repeated.isEmpty():
            ties = spread_join(named.join(repeated, "id", "left_semi"), classes, ["hi", "lo"], total)
            parts = extended(parts, ties.select(F.col("id").alias("a"), F.col("head").alias("b")).distinct())
        final = classes.join(parts.withColumnRenamed("node", "head"), "head", "left").select("hi", "lo", "m", F.coalesce("component", "head").alias("component"))
        final = written(final, "final")
        kept += [marks, final]
    linked = spread_join(named.select("id", "n", "hi", "lo"), final, ["hi", "lo"], total).select("id", "n", "component")
    alone = marks.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component"))
    out = linked.union(alone)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def op7_minhash_neardup(spark, sf_dir: str) -> DataFrame:
    """The contract's classes: 4-word shingles, similarity of 80 percent or more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4, threshold=80)
