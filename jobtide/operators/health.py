"""Trailing-median health checks over the run history, one row per source and run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TRAILING, MIN_RUNS, DROP, STALE_DAYS, MIN_DATED, DRIFT = 20, 3, 0.5, 7, 30, 0.25
#: Days before a run that count as its history: a feed that was silent for longer has none, and is not flagged.
HISTORY_DAYS = STALE_DAYS + 1


def _median(values: Column) -> Column:
    """Median of a short array without nulls."""
    ordered = F.array_sort(values)
    at = lambda n: F.get(ordered, n.cast("int")).cast("double")
    return (at((F.size(values) - 1) / 2) + at(F.size(values) / 2)) / 2


def source_health(history: DataFrame, days: int = HISTORY_DAYS) -> DataFrame:
    """history(source, started_at, raw_fetched, responding, not_modified, dated, midnight) with verdicts.

    Every run is judged by the runs of its source before it that are at most ``days``
    days older: of these by the last TRAILING rows (a frame of rows, filtered by time), and
    for the last data by all (a frame of time). Partitions are the sources, whose histories are short.
    """
    span = days * 86_400_000_000
    by_row = Window.partitionBy("source").orderBy("started_at").rowsBetween(-TRAILING, -1)
    by_time = Window.partitionBy("source").orderBy(F.unix_micros("started_at")).rangeBetween(-span, -1)
    boards = F.col("responding").isNotNull()
    measured = F.coalesce("responding", "raw_fetched")
    rows = history.withColumn("measured", measured)
    valid = lambda c: F.when(~F.col("not_modified") & (F.col(c) > 0), F.col(c)).cast("double")
    share = F.when((F.col("dated") > 0) & F.col("midnight").isNotNull(), F.col("midnight") / F.col("dated"))
    entry = F.struct(F.unix_micros("started_at").alias("at"), valid("responding").alias("board"), valid("raw_fetched").alias("raw"), share.alias("share"))
    rows = rows.withColumn("before", F.filter(F.collect_list(entry).over(by_row), lambda x: x["at"] >= F.unix_micros("started_at") - span))
    for name in ("board", "raw", "share"):
        values = F.filter(F.transform("before", lambda x: x[name]), lambda v: v.isNotNull())  # noqa: B023
        rows = rows.withColumns({f"{name}_median": _median(values), f"{name}_n": F.size(values)})
    rows = rows.withColumn("last_data_at", F.last(F.when(~F.col("not_modified") & (F.col("raw_fetched") > 0), F.col("started_at")), ignorenulls=True).over(by_time)).drop("before")
    enough = F.when(boards, F.col("board_n")).otherwise(F.col("raw_n")) >= MIN_RUNS
    median = F.when(~F.col("not_modified") & enough, F.when(boards, F.col("board_median")).otherwise(F.col("raw_median")))
    rows = rows.withColumn("median", median).withColumn("ratio", F.col("measured") / F.col("median"))
    rows = rows.withColumn("volume_drop", F.coalesce(F.col("median").isNotNull() & ((F.col("measured") == 0) | (F.col("ratio") < DROP)), F.lit(False)))
    since = (F.unix_micros("started_at") - F.unix_micros("last_data_at")) / F.lit(86_400_000_000.0)
    rows = rows.withColumn("days_since_data", F.when(F.col("not_modified"), since))
    rows = rows.withColumn("stale_304", F.coalesce(F.col("days_since_data") >= STALE_DAYS, F.lit(False)))
    rows = rows.withColumn("midnight_share", F.when(F.col("dated") >= MIN_DATED, F.col("midnight") / F.col("dated")))
    rows = rows.withColumn("midnight_median", F.when(F.col("midnight_share").isNotNull() & (F.col("share_n") >= MIN_RUNS), F.col("share_median")))
    rows = rows.withColumn("precision_drift", F.coalesce(F.abs(F.col("midnight_share") - F.col("midnight_median")) >= DRIFT, F.lit(False)))
    rows = rows.withColumn("ok", ~(F.col("volume_drop") | F.col("stale_304") | F.col("precision_drift")))
    unit = F.when(boards, "boards responding").otherwise("raw postings")
    whole = lambda c: F.bround(c, 0).cast("long")  # noqa: E731  halves to even
    percent = lambda c: whole(F.col(c) * 100)
    # The published wording
    message = (
        F.when(F.col("volume_drop") & (F.col("measured") == 0), F.format_string("%s: 0 %s (trailing median %d) - source may be broken", "source", unit, whole("median")))
        .when(F.col("volume_drop"), F.format_string("%s: %d %s, %d%% of trailing median %d", "source", "measured", unit, percent("ratio"), whole("median")))
        .when(F.col("stale_304"), F.format_string("%s: only 304s for %d days - upstream frozen or an ETag is pinned", "source", whole("days_since_data")))
        .when(
            F.col("precision_drift"),
            F.format_string(
                "%s: %d%% of timestamps are midnight UTC, against a trailing median of %d%% - the feed's timestamp format may have changed, "
                "which would silently reclassify posted_at precision", "source", percent("midnight_share"), percent("midnight_median"),
            ),
        )
    )
    return rows.withColumn("message", message).drop("board_median", "board_n", "raw_median", "raw_n", "share_median", "share_n")
