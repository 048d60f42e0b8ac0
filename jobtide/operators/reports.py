"""Counters of a run, rollups over the run history, samples for audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D


def exclusion_counts(excluded: DataFrame) -> DataFrame:
    """A3: reason, n, share of all."""
    counts = excluded.groupBy("filter_reason").agg(F.count("*").alias("n"))
    total = excluded.agg(F.count("*").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("filter_reason", "n", (F.col("n") / F.col("total")).alias("share"))


def suppression_collapse(suppressions: DataFrame) -> DataFrame:
    """A5: per baseline id: distinct titles, hits, the titles, and a flag for more than one."""
    titles = suppressions.groupBy("baseline_id", "title").agg(F.sum("times_seen").alias("hits"))
    out = titles.groupBy("baseline_id").agg(F.count("*").alias("n_titles"), F.sum("hits").alias("hits"), F.array_join(F.array_sort(F.collect_list("title")), " | ").alias("titles"))
    return out.withColumn("collapsed", F.col("n_titles") > 1)


def source_run_counters(rows: DataFrame) -> DataFrame:
    """rows(source, keep, is_new, suppressed, posted_at, term) of one run, by source."""
    midnight = F.unix_micros("posted_at") % D.DAY_MICROS == 0
    kept = F.col("keep")
    out = rows.groupBy("source").agg(
        F.count("*").alias("raw_fetched"), F.count_if(kept).alias("fetched"), F.count_if(~kept).alias("filtered_out"), F.count_if("is_new").alias("new"),
        F.count_if("suppressed").alias("baselined"), F.count_if(kept & F.col("posted_at").isNotNull()).alias("dated"), F.count_if(kept & midnight).alias("midnight"),
        F.count_if(kept & (F.col("term") == "unknown")).alias("term_unknown"),
    )
    out = out.withColumn("midnight_share", F.try_divide("midnight", "dated")).withColumn("term_unknown_rate", F.try_divide("term_unknown", "fetched"))
    return out.withColumn("term_warning", F.coalesce(F.col("term_unknown_rate") > 0.10, F.lit(False)))


def run_totals(counters: DataFrame, accepted: DataFrame, merged: DataFrame) -> DataFrame:
    """Sums over the sources; what was accepted but not new is a duplicate."""
    sums = counters.agg(F.sum("raw_fetched").alias("raw_fetched"), F.sum("filtered_out").alias("filtered_out"), F.sum("baselined").alias("suppressed_by_baseline"))
    taken = accepted.agg(F.count("*").alias("accepted"))
    new = merged.agg(F.count_if("is_new").alias("new"), F.coalesce(F.sum("url_upgrades"), F.lit(0)).alias("url_upgrades"))
    return sums.crossJoin(taken).crossJoin(new).withColumn("deduped_out", F.col("accepted") - F.col("new"))


def _counted(rows: DataFrame, key: str, name: str) -> DataFrame:
    """One row: a map from key to the number of rows, in the order of the keys."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("k")).agg(F.count("*").alias("n"))
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name))


def links_by_source(postings: DataFrame) -> DataFrame:
    """One row: links (map by status) and links_by_source (map of such maps), from one count of the postings."""
    counts = postings.groupBy("source", "link_status").agg(F.count("*").alias("n"))
    entries = lambda k, v: F.map_from_entries(F.collect_list(F.struct(k, v)))
    own = counts.groupBy("source").agg(entries("link_status", "n").alias("m")).agg(entries("source", "m").alias("links_by_source"))
    return own.crossJoin(counts.groupBy("link_status").agg(F.sum("n").alias("n")).agg(entries("link_status", "n").alias("links")))


def run_report(run: DataFrame, counters: DataFrame, accepted: DataFrame, merged: DataFrame, postings: DataFrame, decided: DataFrame, baseline: DataFrame, gone: DataFrame, scored: DataFrame, now: Column) -> DataFrame:
    """The nested report of a run, one row.

    ``run(run_id, duration_s)`` has one row; ``counters`` are those of its sources (``source_run_counters``);
    ``gone(id, why)`` are the postings that expired or were retired; ``decided`` are the rows
    that notification looked at. All parts are aggregates of one row each.
    """
    sources = counters.agg(F.array_sort(F.collect_list(F.struct("source", "raw_fetched", "fetched", "filtered_out", "new", "baselined", "dated", "midnight", "term_unknown"))).alias("sources"))
    warned = counters.where("term_warning").select(F.format_string("%s: term unknown for %d%% of postings (>10%%)", "source", F.bround(F.col("term_unknown_rate") * 100, 0).cast("long")).alias("w"))
    why, how = F.col("decision_reason"), F.col("decision")
    notified = decided.agg(
        F.create_map(
            F.lit("sent"), F.count_if(how == "interrupt"), F.lit("suppressed_rate_cap"), F.count_if(why.startswith("rate cap")),
            F.lit("suppressed_quiet_hours"), F.count_if(why.startswith("quiet hours")), F.lit("suppressed_backpressure"), F.count_if(why.contains("backpressure")),
        ).alias("notifications")
    )
    counts = postings.agg(F.count_if((F.col("status") == "notified") & F.col("tier").isin(1, 2)).alias("backlog_unapplied"))
    went = gone.agg(F.count_if(F.col("why") == "expired").alias("expired"), F.count_if(F.col("why") == "retired").alias("retired"))
    parts = [
        sources, warned.agg(F.array_sort(F.collect_list("w")).alias("warnings")), run_totals(counters, accepted, merged), _counted(scored, "tier", "tiers"), _counted(scored, "tier_source", "scorer"),
        notified, counts, baseline.agg(F.count("*").alias("baseline_size")), went, links_by_source(postings),
    ]
    return reduce(DataFrame.crossJoin, parts, run.withColumn("started_at", now))  # one row each


def latest_report(reports: DataFrame) -> DataFrame:
    """The report of the latest run."""
    return reports.agg(F.max_by(F.struct(*reports.columns), F.struct("started_at", "run_id")).alias("r")).select("r.*")


def report_counts(report: DataFrame) -> DataFrame:
    """A report's counts as rows (field, source, name, n)."""
    plain = ["raw_fetched", "filtered_out", "suppressed_by_baseline", "accepted", "new", "url_upgrades", "deduped_out", "backlog_unapplied", "baseline_size", "expired", "retired"]
    row = lambda field, source, name, n: F.struct(F.lit(field).alias("field"), source.cast("string").alias("source"), name.cast("string").alias("name"), n.cast("long").alias("n"))
    none = F.lit(None)
    single = F.array(*[row(c, none, none, F.col(c)) for c in plain])
    of_map = lambda c: F.transform(F.map_entries(c), lambda e: row(c, none, e["key"], e["value"]))
    maps = [of_map(c) for c in ("tiers", "scorer", "notifications", "links")]
    nested = F.flatten(F.transform(F.map_entries("links_by_source"), lambda s: F.transform(F.map_entries(s["value"]), lambda e: row("links_by_source", s["key"], e["key"], e["value"]))))
    return report.select(F.inline(F.concat(single, *maps, nested)))


def link_status_counts(postings: DataFrame) -> DataFrame:
    """By source and status, and by status alone (source null), in one pass."""
    return postings.rollup("link_status", "source").agg(F.count("*").alias("n"), F.grouping("link_status").alias("g")).where("g = 0").drop("g")


def store_stats(postings: DataFrame, ledger: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """One row; ``runs`` has one row a run."""
    facts = postings.agg(
        F.count("*").alias("total"), *[F.count_if(F.col("tier") == t).alias(f"tier{t}") for t in (1, 2, 3)],
        *[F.count_if(F.col("status") == s).alias(s) for s in ("new", "notified", "applied", "skipped", "expired")],
        F.count_if((F.col("status") == "notified") & F.col("tier").isin(1, 2)).alias("backlog"), F.max("first_seen_at").alias("last_new"),
    )
    pushes = ledger.where(F.unix_micros("sent_at") >= F.unix_micros(now) - 3_600_000_000).agg(F.count("*").alias("pushes_last_hour"))
    return facts.crossJoin(pushes).crossJoin(runs.agg(F.count("*").alias("runs")))  # one row each


def backlog_unapplied(postings: DataFrame) -> DataFrame:
    """A10: (n)."""
    return postings.agg(F.count_if((F.col("status") == "notified") & F.col("tier").isin(1, 2)).alias("n"))


def daily_new_by_source(history: DataFrame) -> DataFrame:
    """Day x source sums of ``new``, zero where a source did not run, in long form with the day's total."""
    sums = history.groupBy(F.to_date("started_at").alias("day"), "source").agg(F.sum("new").alias("new"))
    days, sources = sums.select("day").distinct(), sums.select("source").distinct()  # few of both
    filled = days.crossJoin(F.broadcast(sources)).join(sums, ["day", "source"], "left").withColumn("new", F.coalesce("new", F.lit(0)))
    totals = sums.groupBy("day").agg(F.sum("new").alias("total"))
    return filled.join(totals, "day")


def median_daily_new(history: DataFrame, today: Column) -> DataFrame:
    """The median of complete days and its verdict."""
    totals = history.groupBy(F.to_date("started_at").alias("day")).agg(F.sum("new").alias("total")).where(F.col("day") < today)
    out = totals.agg(F.percentile("total", F.lit(0.5)).alias("median"), F.count("*").alias("days"))
    return out.withColumn("verdict", F.when(F.col("median") < 10, "below range").when(F.col("median") > 40, "above range").otherwise("in range"))


def tier1_precision(postings: DataFrame) -> DataFrame:
    """A13."""
    top = F.col("tier") == 1
    out = postings.agg(F.count_if(top & (F.col("status") == "applied")).alias("applied"), F.count_if(top & F.col("status").isin("applied", "skipped")).alias("resolved"))
    out = out.withColumn("precision", F.try_divide("applied", "resolved"))
    return out.withColumn("low", F.coalesce(F.col("precision") < 0.30, F.lit(False)))


def tier_volume_per_day(history: DataFrame) -> DataFrame:
    """history(started_at, tiers map) -> day, tier, n."""
    return history.select(F.to_date("started_at").alias("day"), F.explode("tiers").alias("tier", "v")).groupBy("day", "tier").agg(F.sum("v").alias("n"))


def notification_totals(history: DataFrame) -> DataFrame:
    """history(notifications map) -> kind, n."""
    return history.select(F.explode("notifications").alias("kind", "v")).groupBy("kind").agg(F.sum("v").alias("n"))


def source_rollup(history: DataFrame) -> DataFrame:
    """A17."""
    return history.groupBy("source").agg(
        F.count("*").alias("runs"), F.count_if("not_modified").alias("not_modified_runs"),
        F.coalesce(F.percentile(F.when(~F.col("not_modified"), F.col("raw_fetched")), F.lit(0.5)), F.lit(0.0)).alias("median_raw"), F.sum("new").alias("new"),
    )


def run_time_projection(runs: DataFrame) -> DataFrame:
    """Minutes a month at 48 runs a day."""
    out = runs.agg(F.avg("duration_s").alias("mean_s")).withColumn("minutes_month", F.col("mean_s") * 48 * 30 / 60)
    return out.withColumn("over_budget", F.col("minutes_month") > 1200)


def posting_hours(postings: DataFrame, sources: list[str], weekdays_only: bool = False) -> DataFrame:
    """24 bins of local posting hours (whole-second midnights left out), with each bin's share and the dropped count."""
    rows = postings.where(F.col("source").isin(sources) & F.col("posted_at").isNotNull())
    midnight = F.unix_micros("posted_at") % D.DAY_MICROS == 0
    when = D.local("posted_at")
    used = ~midnight & (F.weekday(when) < 5 if weekdays_only else F.lit(True))
    bins = rows.where(used).groupBy(F.hour(when).alias("hour")).agg(F.count("*").alias("n"))
    totals = rows.agg(F.count_if(used).alias("total"), F.count_if(midnight).alias("dropped"))
    hours = postings.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    out = hours.join(F.broadcast(bins), "hour", "left").withColumn("n", F.coalesce("n", F.lit(0))).crossJoin(F.broadcast(totals))
    return out.select("hour", "n", F.try_divide("n", "total").alias("share"), "dropped")


def best_posting_windows(bins: DataFrame, width: int, top: int = 5) -> DataFrame:
    """The best circular runs of ``width`` hours among the 24 bins(hour, n)."""
    ahead = reduce(DataFrame.unionByName, [bins.select(((F.col("hour") - k + 24) % 24).alias("start"), "n") for k in range(width)])
    return ahead.groupBy("start").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("start")).limit(top)


def board_tally(log: DataFrame) -> DataFrame:
    """log(board, http_status, rows) -> board, outcome, responding."""
    status = F.col("http_status")
    outcome = F.when(status == 304, "unchanged").when(status.isin(403, 404, 410), "dead").when((status == 200) & (F.col("rows") > 0), "live").when(status == 200, "empty").otherwise("other")
    return log.select("board", outcome.alias("outcome"), ((status == 304) | (status == 200)).alias("responding"))


def board_counts(tally: DataFrame) -> DataFrame:
    return tally.groupBy("outcome").agg(F.count("*").alias("n"), F.count_if("responding").alias("responding"))


def surviving_roster(roster: DataFrame, tally: DataFrame) -> DataFrame:
    """A21, second half: boards that are not dead; those that answered are verified."""
    dead = tally.where("outcome = 'dead'").select("board")
    live = tally.where("responding").select("board", F.lit(True).alias("_ok")).distinct()
    return roster.join(dead, "board", "left_anti").join(live, "board", "left").withColumn("verified", F.coalesce("_ok", "verified")).drop("_ok")


def stable_sample(rows: DataFrame, n: int, id_col: str = "id") -> DataFrame:
    """The same rows for the same data, others when any id changes: a top-k by a hash of id and data digest."""
    name = F.col(id_col).cast("string")
    number = F.conv(F.substr(F.md5(name.cast("binary")), F.lit(1), F.lit(15)), 16, 10).cast("long")
    digest = rows.agg(F.concat(F.count("*"), F.lit(":"), F.coalesce(F.bit_xor(number), F.lit(0))).alias("_digest"))
    place = F.md5(F.concat("_digest", F.lit(":"), name).cast("binary"))
    chosen = rows.crossJoin(F.broadcast(digest)).orderBy(place, id_col).limit(n)  # the digest is one row
    return chosen.drop("_digest").orderBy(id_col)


def sample_exclusions(excluded: DataFrame, n: int, reason: str | None = None, seed: int = 0, id_col: str = "id") -> DataFrame:
    """A top-k by a hash of seed and id, so that one seed gives one sample on every layout."""
    rows = excluded if reason is None else excluded.where(F.col("filter_reason") == reason)
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary")), id_col).limit(n)


def recent_suppressions(suppressions: DataFrame, since: Column, n: int) -> DataFrame:
    """T9."""
    return suppressions.where(F.col("last_at") >= since).orderBy(F.desc("last_at"), "baseline_id", "title", "source").limit(n)


def audit_record(excluded: DataFrame, suppressions: DataFrame, run_id: str, now: Column, sample: int = 20) -> DataFrame:
    """One nested record: complete counts, a stable sample, the five worst collapses."""
    reasons = exclusion_counts(excluded).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("filter_reason", "n")))).alias("by_reason"), F.sum("n").alias("total"))
    taken = stable_sample(excluded, sample).agg(F.array_sort(F.collect_list(F.struct("id", "company", "title", "filter_reason"))).alias("sample"))
    worst = suppression_collapse(suppressions).where("collapsed").orderBy(F.desc("n_titles"), F.desc("hits"), "baseline_id").limit(5)
    worst = worst.agg(F.collect_list(F.struct("baseline_id", "n_titles", "hits", "titles")).alias("worst_collapse"))
    hidden = suppressions.agg(F.count("*").alias("suppressed"))
    one = reasons.crossJoin(taken).crossJoin(worst).crossJoin(hidden)  # one row each
    return one.select(
        F.lit(run_id).alias("run_id"), now.alias("at"), F.struct("total", "by_reason", "sample").alias("exclusions"), F.struct(F.col("suppressed").alias("total"), "worst_collapse").alias("suppressions")
    )

