"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import drop_written, spread_join, written

#: Rounds needed grow with the logarithm of the longest path; reaching this is an error, never a partial result.
MAX_ROUNDS = 100


def _least(edges: DataFrame, total: int) -> DataFrame:
    """(u, v, m): each directed edge with the least of u and its neighbours; edges of hot nodes stay where they lie."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")).select("u", F.least("u", "m").alias("m"), "degree")
    return spread_join(edges, written(least, "least"), ["u"], total, "degree")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is the smallest node reachable.

    Self-links, repeated links and an empty table are fine; null ends are left out.
    The rounds end when the edge set stays the same; each is written to the shared
    folder, so lineage stays short and a lost executor costs one round at most.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and u > v").distinct()
    now, mark = written(now, "links"), None
    total = now.count()
    if not total:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(MAX_ROUNDS):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both, 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = written(large, "stars")
        small = _least(large, total)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        after = written(small.where("u > v").distinct(), "links")
        state = after.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
        drop_written(now)
        drop_written(large)
        now, total = after, state[0]
        if state == mark:
            break
        mark = state
    else:
        raise RuntimeError(f"components are not complete after {MAX_ROUNDS} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def extended(parts: DataFrame, links: DataFrame) -> DataFrame:
    """``parts(node, component)`` with ``links(a, b)`` (written) added: only the components that the links touch are worked on again."""
    if links.isEmpty():
        return parts
    for end in ("a", "b"):
        of = parts.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
        links = links.join(of, end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    merged = components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    sizes = parts.groupBy("component").agg(F.count("*").alias("m"))
    moved = sizes.join(merged.select(F.col("node").alias("component"), F.col("component").alias("to")), "component")
    moved = written(moved, "moved")
    total = parts.count()
    out = spread_join(parts, moved, ["component"], total, how="left").select("node", F.coalesce("to", "component").alias("component"))
    fresh = merged.join(parts.select("node"), "node", "left_anti")
    return written(out.union(fresh), "parts")
