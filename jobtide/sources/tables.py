"""Sinks and their readers: exports, baselines, raw archives, run reports, audits, snapshots.

Every write makes new files; a snapshot becomes current by its success marker, so an
interrupted run leaves the last one in place.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators.state import rewrite_ids
from ..operators.views import order_backlog
from ..schemas import POSTING
from . import files

RAW_BODY_LIMIT = 2000


#: Hexadecimal digits of an id that name its part of an export.
PART_DIGITS = 2


def part_digests(lines: DataFrame) -> DataFrame:
    """lines(part, value) -> (part, n, digest), whatever the order of the lines."""
    return lines.groupBy("part").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("value")).alias("digest"))


def _parts(postings: DataFrame, digits: int) -> DataFrame:
    fields = [c.split()[0] for c in POSTING.split(", ")]
    return postings.select(F.substr("id", F.lit(1), F.lit(digits)).alias("part"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def changed_parts(postings: DataFrame, path: str, digits: int = PART_DIGITS) -> DataFrame:
    """(part, change) of the parts that differ from the export at ``path``: ``new``, ``changed`` or ``gone``. Only digests meet."""
    spark = postings.sparkSession
    after = part_digests(_parts(postings, digits)).select("part", F.struct("n", "digest").alias("after"))
    names = [n.split("=", 1)[1] for n in files.names(spark, path) if n.startswith("part=")]  # 16^digits at most
    before = spark.read.schema("value string, part string").option("basePath", path).text(*[[f"{path}/part={n}" for n in names]]) if names else spark.createDataFrame([], "value string, part string")
    both = after.join(part_digests(before).select("part", F.struct("n", "digest").alias("before")), "part", "full_outer").where("not (after <=> before)")
    return both.select("part", F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "gone").otherwise("changed").alias("change"))


def export_postings(postings: DataFrame, path: str, digits: int = PART_DIGITS) -> list[str]:
    """Bring the export at ``path`` up to date, part by part: the parts that changed; none where the export is the same.

    A part has the lines of a range of ids, sorted. Parts that are equal keep their files.
    """
    spark = postings.sparkSession
    changes = {r["part"]: r["change"] for r in changed_parts(postings, path, digits).collect()}  # 16^digits at most
    kept = [p for p, change in changes.items() if change != "gone"]
    if kept:
        lines = _parts(postings.where(F.substr("id", F.lit(1), F.lit(digits)).isin(kept)), digits)
        dealt = lines.repartition("part").sortWithinPartitions("part", "value")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").text(path)
    for part in (p for p, change in changes.items() if change == "gone"):
        files.delete(spark, f"{path}/part={part}")
    return sorted(changes)


def restore_postings(spark: SparkSession, path: str, state: DataFrame | None = None) -> DataFrame:
    """An export as postings, defaults filled; ids that the state has already are ignored."""
    lines = spark.read.text(path).where("trim(value) <> ''").select("value")
    rows = lines.select(F.from_json("value", POSTING).alias("p"), F.array_contains(F.json_object_keys("value"), "posted_precision").alias("has")).select("p.*", "has")
    derived = D.posted_precision("source", "posted_at")
    precision = F.when((F.col("source") == "listings") | ~F.col("has"), derived).otherwise(F.coalesce(F.nullif("posted_precision", F.lit("")), F.lit("unknown")))
    defaults = {
        "remote": F.coalesce("remote", F.lit(False)), "disqualifiers": F.coalesce("disqualifiers", F.array().cast("array<string>")),
        "link_status": F.coalesce(F.nullif("link_status", F.lit("")), F.lit("unchecked")), "tier_source": F.coalesce(F.nullif("tier_source", F.lit("")), F.lit("heuristic")),
        "posted_precision": precision,
    }
    rows = rows.withColumns(defaults).drop("has")
    return rows if state is None else state.unionByName(rows.join(state.select("id"), "id", "left_anti"))


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Ids, one a line."""
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''").distinct()


def write_baseline(ids: DataFrame, path: str) -> None:
    ids.select("id").distinct().orderBy("id").withColumnRenamed("id", "value").write.mode("overwrite").text(path)


def archive_raw(raw: DataFrame, path: str, run_id: str, created_at: Column) -> None:
    """Gated raw rows by run and source, bodies cut; a repeated run replaces its own partitions only."""
    rows = raw.withColumn("description", F.substr("description", F.lit(1), F.lit(RAW_BODY_LIMIT))).withColumn("run_id", F.lit(run_id)).withColumn("created_at", created_at)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "source").parquet(path)


def replay_raw(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """One run's rows; only its partitions are read."""
    return spark.read.parquet(path).where(F.col("run_id") == run_id)


def prune_partitions(spark: SparkSession, path: str, column: str, gone: Callable[[str], bool]) -> list[str]:
    """Delete whole partitions ``column=value`` whose value is ``gone``: the values that went. Their files are never read."""
    values = [name.split("=", 1)[1] for name in files.names(spark, path) if name.startswith(f"{column}=")]
    went = [value for value in values if gone(value)]
    for value in went:
        files.delete(spark, f"{path}/{column}={value}")
    return went


def prune_raw(spark: SparkSession, path: str, keep: int = 3) -> list[str]:
    """Only the newest ``keep`` runs (by their latest row) stay: the runs that went."""
    runs = spark.read.parquet(path).groupBy("run_id").agg(F.max("created_at").alias("at"))
    stay = {r["run_id"] for r in runs.orderBy(F.desc("at"), "run_id").limit(keep).collect()}
    return prune_partitions(spark, path, "run_id", lambda run: run not in stay)


def write_report(report: DataFrame, path: str) -> None:
    """One nested report per run; a repeated run replaces its own."""
    report.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def read_reports(spark: SparkSession, path: str, since: Column) -> DataFrame:
    return spark.read.parquet(path).where(F.col("started_at") >= since).orderBy("started_at")


def exploded_sources(reports: DataFrame) -> DataFrame:
    """Run history: one row per run and source."""
    return reports.select("run_id", "started_at", "duration_s", F.explode("sources").alias("s")).select("run_id", "started_at", "duration_s", "s.*")


def append_audit(record: DataFrame, path: str) -> None:
    """JSON by UTC day."""
    record.withColumn("day", F.date_format("at", "yyyy-MM-dd")).write.mode("append").partitionBy("day").json(path)


def read_audit(spark: SparkSession, path: str, today: str, days: int = 30) -> DataFrame:
    """The days that are kept; older partitions are not read."""
    return spark.read.json(path).where(F.col("day") >= F.date_format(F.date_sub(F.lit(today).cast("date"), days), "yyyy-MM-dd"))


def prune_audit(spark: SparkSession, path: str, today: str, days: int = 30) -> list[str]:
    """Days before the window go, files and all: the days that went."""
    first = (date.fromisoformat(today) - timedelta(days=days)).isoformat()
    return prune_partitions(spark, path, "day", lambda day: day < first)


def rewrite_tables(tables: dict[str, tuple[DataFrame, str]], mapping: DataFrame, path: str, version: str) -> bool:
    """One mapping(old, new, collides) of ids for all tables(name: (rows, id column)), as one new version.

    Nothing is written where any new id would have two old ones. The version counts from
    its commit on, which is made when all tables are written, so readers see all or none.
    """
    spark = mapping.sparkSession
    if not mapping.where("collides").isEmpty():
        return False
    for name, (rows, column) in tables.items():
        rewrite_ids(rows, mapping, column).write.mode("overwrite").parquet(f"{path}/{version}/{name}")
    return files.make(spark, f"{path}/{version}/_COMMITTED")


def read_version(spark: SparkSession, path: str, version: str, name: str) -> DataFrame:
    """A table of a committed version; an error where it is not committed."""
    if "_COMMITTED" not in files.names(spark, f"{path}/{version}"):
        raise FileNotFoundError(f"{path}/{version} is not committed")
    return spark.read.parquet(f"{path}/{version}/{name}")


REVIEW = ["id", "company", "title", "term", "tier", "score", "location", "posted_at", "apply_url", "disqualifiers", "score_rationale"]


def review_rows(postings: DataFrame) -> DataFrame:
    """Eleven columns, by term rank, score, company."""
    rows = postings.select(*REVIEW).withColumn("disqualifiers", F.array_join("disqualifiers", "|"))
    return order_backlog(rows.withColumn("_score", F.col("score")).withColumn("score", F.col("score").cast("string"))).orderBy("term_rank", F.desc("points"), F.lower("company"), "id").select(*REVIEW)


def write_review(postings: DataFrame, path: str) -> None:
    review_rows(postings).write.mode("overwrite").option("header", True).csv(path)


def write_snapshot(table: DataFrame, path: str, version: str, partitions: int = 64) -> None:
    """A new version of a state table, hash-partitioned by id for the next merge."""
    table.repartition(partitions, "id").write.mode("overwrite").parquet(f"{path}/v={version}")


def read_snapshot(spark: SparkSession, path: str, version: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/v={version}")


