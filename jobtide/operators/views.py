"""Ranked views of live postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from .. import rules as R
from ..functions import dates as D
from ..functions import links as L
from ..functions import text as T
from .reports import latest_report


def term_rank(term: Column | str = "term") -> Column:
    table = T.mapping({t: i for i, t in enumerate(R.TERM_ORDER)})
    return F.coalesce(F.try_element_at(table, F.col(term) if isinstance(term, str) else term), F.lit(9))


def live(postings: DataFrame) -> DataFrame:
    """F9."""
    return postings.where(~F.col("status").isin("expired", "skipped"))


def recent(postings: DataFrame, since: Column | None = None, status: str | None = None, tier: int | None = None, limit: int | None = None) -> DataFrame:
    """Newest first; the limit is a top-k, not a sort of all rows."""
    out = postings if since is None else postings.where(F.col("first_seen_at") >= since)
    out = out if status is None else out.where(F.col("status") == status)
    out = out if tier is None else out.where(F.col("tier") == tier)
    out = out.orderBy(F.desc("first_seen_at"), "id")
    return out if limit is None else out.limit(limit)


def ranking(mode: str) -> list[Column]:
    """Sort keys within a term."""
    day = D.posted_day("posted_at", "first_seen_at", "posted_precision")
    if mode == "date":
        return [F.desc(day), F.asc("tier"), F.desc("score"), F.desc("id")]
    return [F.desc("score"), F.desc(day), F.asc("tier"), F.desc("id")]


def numbered_within(df: DataFrame, group: Column, levels: list[list[tuple[Column, bool]]], last: Column, name: str) -> DataFrame:
    """Running numbers from 1 within a group, in the order of all levels' (key, descending), then of ``last``.

    Counts of ever smaller parts of a group tell how many rows come before a part; only the
    rows of one smallest part are numbered in one task.
    """
    df = df.withColumn("_g", F.struct(group))
    for i, level in enumerate(levels):
        df = df.withColumn(f"_k{i}", F.struct(*[c.alias(f"f{j}") for j, (c, _) in enumerate(level)]))  # structs join where a field is null
    keys = ["_g", *[f"_k{i}" for i in range(len(levels))]]
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    base = counts.select("_g").distinct().withColumn("_b", F.lit(0).cast("long"))
    for i, level in enumerate(levels):
        upper, here = keys[: i + 1], keys[: i + 2]
        order = [F.col(f"_k{i}.f{j}").desc() if down else F.col(f"_k{i}.f{j}").asc() for j, (_, down) in enumerate(level)]
        before = F.coalesce(F.sum("_n").over(Window.partitionBy(*upper).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        parts = counts.groupBy(*here).agg(F.sum("_n").alias("_n")).withColumn("_in", before)
        base = parts.join(base, upper).select(*here, (F.col("_b") + F.col("_in")).alias("_b"))
    rows = df.join(base, keys)
    return rows.withColumn(name, F.col("_b") + F.row_number().over(Window.partitionBy(*keys).orderBy(last))).drop(*keys, "_b")


def rank_postings(postings: DataFrame, mode: str = "date", top: int | None = None) -> DataFrame:
    """term_rank and place of all rows. With ``top`` only the best of each term stay, by a limit that each task applies first."""
    ranked = postings.withColumn("term_rank", term_rank())
    if top is None:
        day = (D.posted_day("posted_at", "first_seen_at", "posted_precision"), True)
        tier, score, prefix = (F.col("tier"), False), (F.col("score"), True), [(F.substr("id", F.lit(1), F.lit(2)), True)]
        levels = [[day], [tier, score], prefix] if mode == "date" else [[score], [day, tier], prefix]
        return numbered_within(ranked, F.col("term_rank"), levels, F.desc("id"), "place")
    place = F.row_number().over(Window.partitionBy("term_rank").orderBy(*ranking(mode)))
    return ranked.withColumn("place", place).where(F.col("place") <= top)


def in_order(postings: DataFrame, mode: str = "date") -> DataFrame:
    """All rows by term, then rank: one range sort, no window."""
    return postings.orderBy(term_rank(), *ranking(mode))


def live_by_term(postings: DataFrame, term: str | None = None, tier: int | None = None, mode: str = "date") -> DataFrame:
    out = live(postings)
    out = out if term is None else out.where(F.col("term") == term)
    return in_order(out if tier is None else out.where(F.col("tier") == tier), mode)


def fresh(postings: DataFrame, now: Column) -> DataFrame:
    """Fresh live rows; ``approximate`` marks those whose posting time is not an instant."""
    rows = live(postings).where(D.is_fresh("posted_at", "posted_precision", now))
    return rows.withColumn("approximate", F.col("posted_precision") != "instant")


def index_rows(postings: DataFrame, now: Column) -> DataFrame:
    """T4: the display fields of live rows, with each term's count."""
    rows = live(postings)
    counts = rows.groupBy("term").agg(F.count("*").alias("in_term"))
    day = D.posted_day("posted_at", "first_seen_at", "posted_precision")
    clean = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))
    badge = F.when(F.col("link_status").isin("dead", "redirected_to_index"), "dead").when(F.col("link_status") == "unreachable", "unverified").otherwise("")
    return rows.join(F.broadcast(counts), "term").select(
        "id", "term", "in_term", clean("company").alias("company"), clean("title").alias("title"),
        F.concat(clean("location"), F.when(F.col("remote"), " (remote)").otherwise("")).alias("place"),
        F.when(F.col("posted_at").isNotNull(), F.date_format(day, "yyyy-MM-dd")).otherwise("-").alias("posted"),
        D.age_text("posted_at", "first_seen_at", "posted_precision", now).alias("age"), badge.alias("badge"), "tier", "score",
    )


def mirror_rows(postings: DataFrame) -> DataFrame:
    """Eight escaped columns."""
    day = F.date_format(D.posted_day("posted_at", "first_seen_at", "posted_precision"), "yyyy-MM-dd")
    place = F.concat("location", F.when(F.col("remote"), " / remote").otherwise(""))
    values = {
        "id": F.col("id"), "company": F.col("company"), "title": F.col("title"), "term": F.col("term"), "tier": F.col("tier").cast("string"), "location": place,
        "posted_date": F.when(F.col("posted_at").isNotNull(), day), "apply_url": F.col("apply_url"),
    }
    return postings.select(*[L.neutralize_formula(v).alias(k) for k, v in values.items()])


def digest(postings: DataFrame, now: Column, top: int = 12) -> DataFrame:
    """T5: the best of each tier among live rows of the last 24 hours, with how many more there were."""
    rows = live(postings).where(F.unix_micros("first_seen_at") >= F.unix_micros(now) - D.DAY_MICROS)
    counts = rows.groupBy("tier").agg(F.count("*").alias("in_tier"))
    place = F.row_number().over(Window.partitionBy("tier").orderBy(F.desc("score"), F.desc("first_seen_at"), "id"))
    best = rows.withColumn("place", place).where(F.col("place") <= top)
    return best.join(F.broadcast(counts), "tier").withColumn("overflow", F.greatest(F.lit(0), F.col("in_tier") - top)).select("tier", "place", "id", "score", "overflow")


def digest_totals(postings: DataFrame, reports: DataFrame, now: Column) -> DataFrame:
    """T5, the lines around the tiers: one row with the backlog, the new rows of 24 hours, their dead links, and what the latest run of that time held back."""
    recent = F.unix_micros("first_seen_at") >= F.unix_micros(now) - D.DAY_MICROS
    shown = recent & ~F.col("status").isin("expired", "skipped")
    facts = postings.agg(
        F.count_if((F.col("status") == "notified") & F.col("tier").isin(1, 2)).alias("backlog"), F.count_if(shown).alias("new"),
        F.count_if(shown & F.col("link_status").isin("dead", "redirected_to_index")).alias("dead_links"),
    )
    held = latest_report(reports.where(F.unix_micros("started_at") >= F.unix_micros(now) - D.DAY_MICROS)).select("notifications")
    kinds = ("rate_cap", "quiet_hours", "backpressure")
    return facts.crossJoin(held).select("backlog", "new", "dead_links", *[F.coalesce(F.try_element_at("notifications", F.lit(f"suppressed_{k}")), F.lit(0)).alias(f"suppressed_{k}") for k in kinds])


def order_backlog(rows: DataFrame) -> DataFrame:
    """rows(term, score as text): sort keys; a score that is no number counts 0."""
    return rows.withColumn("term_rank", term_rank(F.trim(F.coalesce("term", F.lit("unknown"))))).withColumn("points", F.coalesce(F.col("score").try_cast("int"), F.lit(0))).orderBy("term_rank", F.desc("points"))


def off_cycle(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.trim("term").isin(R.TERM_ORDER[:3])).alias("off_cycle"))


def search_exclusions(excluded: DataFrame, pattern: str) -> DataFrame:
    """F7."""
    return excluded.where(F.lower("title").contains(pattern.lower())).orderBy("company", "id")


def needing_link_check(postings: DataFrame, limit: int | None = None) -> DataFrame:
    """F13."""
    return recent(postings.where(F.col("link_status") == "unchecked"), limit=limit)


def host_waves(links: DataFrame, per_wave: int = 3) -> DataFrame:
    """links(id, url) -> (id, host_key, wave): at most ``per_wave`` of a domain in one wave."""
    rows = links.withColumn("host_key", L.host_key("url"))
    text = isinstance(links.schema["id"].dataType, StringType)
    parts = [F.substr("id", F.lit(1), F.lit(n)) for n in (2, 4)] if text else [F.shiftright(F.col("id").cast("long"), n) for n in (24, 12)]
    rows = numbered_within(rows, F.col("host_key"), [[(c, False)] for c in parts], F.asc("id"), "_number")
    return rows.withColumn("wave", F.ceil(F.col("_number") / per_wave).cast("int")).select("id", "host_key", "wave")


def decision_stats(postings: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """Totals over live postings and the user's decisions(id, status, applied_on)."""
    rows = postings.join(decisions.select("id", F.col("status").alias("_to"), "applied_on"), "id", "left")
    applied = F.col("_to") == "applied"
    week = F.date_sub(F.to_date(D.local(now)), 7)
    return rows.agg(
        F.count_if(F.col("_to").isNull() & ~F.col("status").isin("expired", "skipped")).alias("undecided"), F.count_if(applied).alias("applied"),
        F.count_if(applied & (F.col("applied_on") >= week)).alias("applied_week"), F.count_if(applied & F.col("applied_on").isNull()).alias("applied_undated"),
        F.count_if(~F.col("status").isin("expired", "skipped")).alias("live"),
    )


def applied_by(postings: DataFrame, decisions: DataFrame, column: str) -> DataFrame:
    """Applied postings by term or tier."""
    ids = decisions.where(F.col("status") == "applied").select("id")
    return postings.join(ids, "id", "left_semi").groupBy(column).agg(F.count("*").alias("n"))
