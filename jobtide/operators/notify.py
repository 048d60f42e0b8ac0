"""Notification decisions: precedence, quiet hours, the hourly cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import rules as R
from ..functions import dates as D


def decide_notifications(postings: DataFrame, baseline: DataFrame, now: Column, sent_last_hour: DataFrame, backlog: DataFrame) -> DataFrame:
    """Add decision, decision_reason and priority.

    ``sent_last_hour(n)`` and ``backlog(n)`` have one row each. The clock is the same for
    a batch, so cap slots are a rank: only tier-1 rows outside quiet hours that nothing
    else stops take one, in order of (score desc, seq). The rank needs one partition, so
    it is taken over the best ``INTERRUPTS_PER_HOUR`` such rows, chosen by a top-k that
    each task does on its own first.
    """
    known = postings.join(baseline.select("id", F.lit(True).alias("_base")).distinct(), "id", "left")
    known = known.crossJoin(F.broadcast(sent_last_hour.select(F.col("n").alias("_sent")))).crossJoin(F.broadcast(backlog.select(F.col("n").alias("_backlog"))))
    done = F.col("status").isin("notified", "applied", "skipped", "expired")
    low = (F.size("disqualifiers") > 0) | (F.col("tier") == 3)
    open_ = F.col("_base").isNull() & ~done & ~low & (F.col("tier") == 1) & ~D.is_quiet(now)
    best = known.where(open_).orderBy(F.desc("score"), "seq", "id").limit(R.INTERRUPTS_PER_HOUR).select("id", "score", "seq", "_sent")
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "seq", "id"))  # at most INTERRUPTS_PER_HOUR rows
    slots = best.withColumn("_rank", rank).where(F.col("_rank") <= F.greatest(F.lit(0), F.lit(R.INTERRUPTS_PER_HOUR) - F.col("_sent"))).select("id", F.lit(True).alias("_slot"))
    rows = known.join(F.broadcast(slots), "id", "left")
    pressed = F.col("_backlog") > R.BACKLOG_LIMIT
    tier2 = F.when(pressed, F.format_string("tier 2 digest-only; backpressure (%d unapplied > " + str(R.BACKLOG_LIMIT) + ")", "_backlog")).otherwise("tier 2 digest-only")
    reason = (
        F.when(F.col("_base"), "baseline: seen before cutover").when(done, F.concat(F.lit("already "), "status")).when(low, "tier 3")
        .when(F.col("tier") == 2, tier2).when(D.is_quiet(now), "quiet hours: tier 1 downgraded")
        .when(F.col("_slot"), "tier 1").otherwise(f"rate cap: {R.INTERRUPTS_PER_HOUR}/hour already sent")
    )
    decision = (
        F.when(F.col("_base") | done, "skip").when(low | (F.col("tier") == 2), "digest").when(D.is_quiet(now), "silent").when(F.col("_slot"), "interrupt").otherwise("digest")
    )
    out = rows.withColumn("decision", decision).withColumn("decision_reason", reason)
    out = out.withColumn("priority", F.when(F.col("decision") == "interrupt", 5).when(F.col("decision") == "silent", 2).otherwise(3))
    return out.drop("_base", "_sent", "_backlog", "_slot")


def suppression_counts(decided: DataFrame) -> DataFrame:
    """How many rows each kind of suppression held back."""
    why = F.col("decision_reason")
    return decided.agg(
        F.count_if(why.startswith("rate cap")).alias("rate_cap"), F.count_if(why.startswith("quiet hours")).alias("quiet_hours"), F.count_if(why.contains("backpressure")).alias("backpressure")
    )


def record_notifications(ledger: DataFrame, decided: DataFrame, now: Column) -> DataFrame:
    """Append what was sent; the caller sets these ids to ``notified``."""
    sent = decided.where(F.col("decision").isin("interrupt", "silent")).select(F.col("id").alias("posting_id"), "tier", now.alias("sent_at"))
    return ledger.unionByName(sent)


def notifications_since(ledger: DataFrame, since: Column, tier: int | None = None) -> DataFrame:
    """(n)."""
    rows = ledger.where(F.col("sent_at") >= since)
    return (rows if tier is None else rows.where(F.col("tier") == tier)).agg(F.count("*").alias("n"))


def payloads(decided: DataFrame, now: Column) -> DataFrame:
    """What a push would carry; header text in ASCII."""
    tags = F.create_map(*[F.lit(x) for pair in R.TERM_TAGS.items() for x in pair])
    plain = lambda c: F.regexp_replace(F.translate(c, "–—‘’“”", "--''\"\""), r"[^\x00-\x7F]", "?")
    age = D.age_text("posted_at", "first_seen_at", "posted_precision", now)
    body = F.concat_ws(" · ", "term", "location", age)
    return decided.where(F.col("decision").isin("interrupt", "silent")).select(
        "id", plain(F.concat_ws(" - ", "company", "title")).alias("title"), F.concat_ws("\n", body, F.when(F.coalesce("score_rationale", F.lit("")) != "", F.col("score_rationale"))).alias("body"),
        "priority", F.try_element_at(tags, F.col("term")).alias("tag"), F.col("apply_url").alias("action_url"),
    )
