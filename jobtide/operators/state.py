"""Keyed state: pure functions from (state, batch) to the next state.

A batch row's place in its batch is (source_order, seq). Every merge is one shuffle by
id on each side; nothing is ordered beyond one id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import rules as R
from ..functions import text as T
from ..functions.links import is_expiry_signal
from .location import with_places

ORDER = ["source_order", "seq"]


def normalize_postings(raw: DataFrame, now: Column, also: tuple[str, ...] = (), strings: DataFrame | None = None) -> DataFrame:
    """Raw postings to postings; columns ``also`` are carried.

    Titles, companies and places are normalised once per distinct string. Those are read
    from ``strings``: raw postings that have at least the strings of ``raw``, such as the
    rows before costly gates, which then run once. Without it they are read from ``raw``.
    """
    strings = raw if strings is None else strings
    titles = strings.select(F.col("title").alias("_title")).distinct().withColumn("title_norm", T.normalize_title("_title")).withColumn("_term", T.named_term("_title"))
    companies = strings.select(F.col("company").alias("_company")).distinct().withColumn("company_norm", T.normalize_company("_company"))
    rows = with_places(raw, strings).join(titles, F.expr("title <=> _title"), "left").join(companies, F.expr("company <=> _company"), "left").drop("_title", "_company")
    rows = rows.withColumn("term", T.infer_term("title", "description", "term_default", F.col("_term")))
    rows = rows.withColumn("dedupe_key", T.dedupe_key("company_norm", "title_norm", "location_norm", "term")).withColumn("id", T.posting_id("dedupe_key"))
    trimmed = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return rows.select(
        "id", "dedupe_key", trimmed("company").alias("company"), trimmed("title").alias("title"), "term",
        F.when(trimmed("location") == "", "Unknown").otherwise(trimmed("location")).alias("location"),
        "remote", trimmed("apply_url").alias("apply_url"),
        F.when(trimmed("apply_url") != "", trimmed("apply_url")).alias("source_url"), "source", now.alias("first_seen_at"), now.alias("last_seen_at"),
        "posted_at", "posted_precision", "company_norm", "title_norm", "location_norm", "source_id", *ORDER, *also,
    )


def cutover_flags(batch: DataFrame, baseline: DataFrame, cutover: Column) -> DataFrame:
    """The batch with ``known`` (its id is baselined) and ``accepted``.

    A baselined id is promoted by its first row posted after the cutover; that row and
    all later ones of the id are accepted, earlier ones stay suppressed. The promoting
    row of an id is a minimum, combined before the shuffle, so no task orders an id's rows;
    the batch is read twice, so write it first where it is costly.
    """
    known = baseline.select("id").distinct()
    first = batch.where(F.col("posted_at") > cutover).groupBy("id").agg(F.min(F.struct(*ORDER)).alias("_from"))
    first = known.join(first, "id", "left").select("id", F.lit(True).alias("known"), "_from")
    rows = batch.join(first, "id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    return rows.withColumn("accepted", ~F.col("known") | F.coalesce(F.struct(*ORDER) >= F.col("_from"), F.lit(False))).drop("_from")


def apply_cutover(batch: DataFrame, baseline: DataFrame, cutover: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted, suppressed, next baseline) by ``cutover_flags``."""
    flagged = cutover_flags(batch, baseline, cutover)
    promoted = flagged.where("known and accepted").select("id").distinct()
    accepted, suppressed = (flagged.where(keep).drop("known", "accepted") for keep in ("accepted", "not accepted"))
    return accepted, suppressed, baseline.join(promoted, "id", "left_anti")


def source_rank(source: Column) -> Column:
    table = T.mapping(R.SOURCE_RANK)
    return F.coalesce(F.try_element_at(table, source), F.lit(R.OTHER_RANK))


LEVELS = sorted({*R.SOURCE_RANK.values(), R.OTHER_RANK})
PIECE_BITS = 12


KEPT = ["company", "title", "term", "dedupe_key", "first_seen_at", "posted_precision", "company_norm", "title_norm", "location_norm"]
LATEST = ["last_seen_at", "location", "remote"]
FOUND = {"source_id": F.max, "source_url": F.min, "posted_at": F.min}


def fold_batch(batch: DataFrame) -> DataFrame:
    """One row an id: first and last row (n_head, n_tail), given values (n_<column>), and for W1 the given links.

    Links come as one entry (source, first_url, last_url, changes) a source (n_sources), and the entry
    that takes each rank first (n_first_<rank>); a link counts up to the first one of a higher-ranked
    source. Rows are folded in pieces of 2^12 places of the batch, then pieces by source, so no task
    or array has all rows of an id.
    """
    piece, url = ["id", "source_order", "_piece"], F.col("apply_url").alias("url")
    given, rank = F.coalesce("apply_url", F.lit("")) != "", source_rank(F.col("source"))
    spot, at = F.struct("seq", url), F.struct("source_order", "_piece")
    before = Window.partitionBy(*piece).orderBy("seq", "apply_url", "source").rowsBetween(Window.unboundedPreceding, -1)
    rows = batch.withColumn("_piece", F.shiftright("seq", PIECE_BITS)).withColumn("_top", F.max(F.when(given, rank)).over(before))
    rows = rows.withColumn("_live", given & (F.col("_top").isNull() | (rank >= F.col("_top"))))
    rows = rows.withColumn("_moved", F.col("_live") & (F.col("apply_url") != F.lag("apply_url").over(Window.partitionBy(*piece, "source", "_live").orderBy("seq", "apply_url"))))
    ends = {"n_head": F.min, "n_tail": F.max, **{f"n_{c}": pick for c, pick in FOUND.items()}}
    parts = rows.groupBy(*piece, "source").agg(
        F.min(F.struct(*ORDER, url, "source", *KEPT)).alias("n_head"), F.max(F.struct(*ORDER, url, "source", *LATEST)).alias("n_tail"),
        *[pick(F.when(F.col(c).isNotNull(), F.struct(*ORDER, c))).alias(f"n_{c}") for c, pick in FOUND.items()],
        F.min(F.when(F.col("_live"), spot)).alias("_first"), F.max(F.when(F.col("_live"), spot)).alias("_last"), F.count_if("_moved").alias("_moves"),
    )
    taker = F.when(F.col("_first").isNotNull(), rank)
    outranked = F.coalesce(*[F.when(taker == n, F.min(F.when(taker > n, at)).over(Window.partitionBy("id"))) for n in LEVELS])
    parts = parts.withColumn("_until", outranked).withColumn("_live", F.col("_first").isNotNull() & (F.col("_until").isNull() | (at <= F.col("_until"))))
    last = F.lag("_last.url").over(Window.partitionBy("id", "source", "_live").orderBy("source_order", "_piece"))
    parts = parts.withColumn("_moved", F.col("_live") & (F.col("_first.url") != last))
    sources = parts.groupBy("id", "source").agg(
        *[pick(c).alias(c) for c, pick in ends.items()], F.min(F.when(F.col("_live"), F.struct("source_order", "_first"))).alias("_first"),
        F.max(F.when(F.col("_live"), F.struct("source_order", "_last"))).alias("_last"), (F.sum(F.when(F.col("_live"), F.col("_moves")).otherwise(0)) + F.count_if("_moved")).cast("int").alias("_moves"),
    )
    named = F.col("source").isNotNull()  # no source is never the same source
    entry = F.when(F.col("_first").isNotNull(), F.struct(
        "source", F.col("_first._first.url").alias("first_url"), F.when(named, F.col("_last._last.url")).otherwise(F.col("_first._first.url")).alias("last_url"),
        F.when(named, F.col("_moves")).otherwise(0).alias("changes"),
    ))
    firsts = [F.min_by(entry, F.when(F.col("_first").isNotNull() & (rank == n), F.struct("_first", "source"))).alias(f"n_first_{n}") for n in LEVELS]
    return sources.groupBy("id").agg(*[pick(c).alias(c) for c, pick in ends.items()], F.collect_list(entry).alias("n_sources"), *firsts)


def prefer_url(seed: Column, held: Column) -> Column:
    """Fold the columns of ``fold_batch`` into the seed (url, source, steps): which link a posting keeps.

    The same source replaces its link; another source only if it ranks higher; an empty
    link never replaces one, so a seed that is ``held`` bars lower ranks. ``steps`` counts changes.
    """
    rank = source_rank(seed["source"])
    own = F.get(F.filter("n_sources", lambda e: e["source"] == seed["source"]), F.lit(0))
    entries = [F.when(held & (rank == n), own).when(~(held & (rank > n)), F.col(f"n_first_{n}")) for n in LEVELS]

    def step(acc: Column, e: Column) -> Column:
        changed = e["first_url"] != F.coalesce(acc["url"], F.lit(""))
        return F.struct(e["last_url"].alias("url"), e["source"].alias("source"), (acc["steps"] + e["changes"] + changed.cast("int")).alias("steps"))

    return F.aggregate(F.filter(F.array(*entries), lambda e: e.isNotNull()), seed, step)


def upsert(state: DataFrame, batch: DataFrame) -> DataFrame:
    """The next state, with ``is_new`` and ``url_upgrades`` for each id of the batch.

    A first sighting sets every column. Later ones refresh the sighting time, place and
    remoteness (latest), the source's id (latest given), link and source (see
    ``prefer_url``), and fill an unknown posting time and source link; everything else
    stays, also the precision of a posting time filled later.
    """
    both = state.join(fold_batch(batch), "id", "full_outer")
    touched, new = F.col("n_head").isNotNull(), F.col("status").isNull()
    held = ~new & (F.coalesce("apply_url", F.lit("")) != "")
    start = lambda c, n: F.when(held, F.col(c)).when(F.size("n_sources") == 0, F.col(f"n_tail.{n}")).when(new, F.col(f"n_head.{n}")).otherwise(F.col(c)).alias(n)
    seed = F.struct(start("apply_url", "url"), start("source", "source"), F.lit(0).alias("steps"))
    both = both.withColumn("_link", F.when(touched, prefer_url(seed, held)))
    fill = lambda c, n: F.coalesce(c, f"{n}.{c}").alias(c)
    refresh = lambda c, n: F.coalesce(f"{n}.{c}", c).alias(c)
    values = {c: fill(c, "n_head") for c in KEPT} | {c: fill(c, f"n_{c}") for c in ("posted_at", "source_url")}
    values |= {c: refresh(c, "n_tail") for c in LATEST} | {"source_id": refresh("source_id", "n_source_id")}
    values["apply_url"] = F.when(touched, F.col("_link.url")).otherwise(F.col("apply_url")).alias("apply_url")
    values["source"] = F.when(touched, F.col("_link.source")).otherwise(F.col("source")).alias("source")
    values["status"] = F.coalesce("status", F.lit("new")).alias("status")
    values["link_status"] = F.when(new | (F.col("_link.steps") > 0), "unchecked").otherwise(F.col("link_status")).alias("link_status")
    columns = [values.get(c, F.col(c)) for c in state.columns]
    return both.select(*columns, (touched & new).alias("is_new"), F.coalesce(F.col("_link.steps"), F.lit(0)).alias("url_upgrades"))


def seen(batch: DataFrame, state: DataFrame) -> DataFrame:
    """Batch rows whose id or dedupe key is in the state; two semi joins by keys, so no row pairs with many."""
    by_id = batch.join(state.select("id", F.lit(True).alias("_id")).distinct(), "id", "left")
    keys = state.where("dedupe_key is not null").select("dedupe_key", F.lit(True).alias("_key")).distinct()
    return by_id.join(keys, "dedupe_key", "left").where("_id or _key").select(*batch.columns)


def healthy_sources(reports: DataFrame) -> DataFrame:
    """Sources that answered with data: (source)."""
    return reports.where("ok and not not_modified and fetched > 0").select("source").distinct()


def mark_seen(sightings: DataFrame, ids: DataFrame, run_id: str) -> DataFrame:
    """Ids seen in a healthy source start afresh."""
    now = ids.select("id").distinct().withColumn("_seen", F.lit(True))
    both = sightings.join(now, "id", "full_outer")
    return both.select(
        "id",
        F.when(F.col("_seen"), F.lit(run_id)).otherwise(F.col("last_seen_run")).alias("last_seen_run"),
        F.when(F.col("_seen"), 0).otherwise(F.col("missed_runs")).alias("missed_runs"),
        F.when(F.col("_seen").isNull(), F.col("first_missed_at")).alias("first_missed_at"),
    )


def mark_missed(sightings: DataFrame, postings: DataFrame, healthy: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Live postings of a healthy source that no healthy source showed: one more miss."""
    missing = postings.where(~F.col("status").isin("applied", "expired")).join(F.broadcast(healthy), "source", "left_semi")
    missing = missing.join(ids.select("id").distinct(), "id", "left_anti").select("id", F.lit(True).alias("_missed"))
    both = sightings.join(missing, "id", "full_outer")
    return both.select(
        "id", "last_seen_run",
        (F.coalesce("missed_runs", F.lit(0)) + F.coalesce(F.col("_missed").cast("int"), F.lit(0))).alias("missed_runs"),
        F.when(F.col("_missed"), F.coalesce("first_missed_at", now)).otherwise(F.col("first_missed_at")).alias("first_missed_at"),
    )


def expire_stale(postings: DataFrame, sightings: DataFrame, now: Column, hours: int = 48) -> DataFrame:
    """Postings with ``status`` expired where they were missing for ``hours``; ``just_expired`` marks the change."""
    gone = sightings.where(F.unix_micros("first_missed_at") <= F.unix_micros(now) - hours * 3_600_000_000).select("id", F.lit(True).alias("_gone"))
    both = postings.join(gone, "id", "left")
    change = F.coalesce("_gone", F.lit(False)) & ~F.col("status").isin("applied", "expired")
    return both.withColumn("just_expired", change).withColumn("status", F.when(change, "expired").otherwise(F.col("status"))).drop("_gone")


def demote(ids: DataFrame, postings: DataFrame, sightings: DataFrame, baseline: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Move ids out of the postings into the baseline: (postings, sightings, baseline)."""
    return postings.join(ids, "id", "left_anti"), sightings.join(ids, "id", "left_anti"), seed_baseline(baseline, ids, now)


def retire_expired(postings: DataFrame, sightings: DataFrame, baseline: DataFrame, now: Column, days: int = 90) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Long-expired postings move to the baseline."""
    old = postings.where((F.col("status") == "expired") & (F.unix_micros("last_seen_at") < F.unix_micros(now) - days * 86_400_000_000)).select("id")
    return demote(old, postings, sightings, baseline, now)


def seed_baseline(baseline: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Insert or ignore."""
    fresh = ids.select("id").distinct().join(baseline.select("id"), "id", "left_anti")
    return baseline.unionByName(fresh.withColumn("seeded_at", now))


def promote(baseline: DataFrame, ids: DataFrame) -> DataFrame:
    return baseline.join(ids.select("id").distinct(), "id", "left_anti")


def collapse_to_baseline(postings: DataFrame, baseline: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(empty postings, baseline with all their ids)."""
    return postings.limit(0), seed_baseline(baseline, postings.select("id"), now)


def first_raw_by_id(batch: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns of the first row of each id in batch order."""
    return batch.groupBy("id").agg(*[F.min_by(c, F.struct(*ORDER)).alias(c) for c in columns])


def apply_updates(postings: DataFrame, updates: DataFrame) -> DataFrame:
    """Overwrite the columns that ``updates(id, ...)`` has, for its ids."""
    names = [c for c in updates.columns if c != "id"]
    marked = updates.select("id", *[F.col(c).alias(f"u_{c}") for c in names], F.lit(True).alias("_hit"))
    both = postings.join(marked, "id", "left")
    return both.select(*[F.when(F.col("_hit"), F.col(f"u_{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in postings.columns])


def apply_link_results(postings: DataFrame, results: DataFrame) -> DataFrame:
    """results(id, link_status, final_url, link_checked_at); proof that a posting is gone expires it."""
    out = apply_updates(postings, results.select("id", "link_status", "final_url", "link_checked_at"))
    hit = results.select("id", is_expiry_signal("link_status").alias("_gone"))
    return out.join(hit, "id", "left").withColumn("status", F.when(F.col("_gone"), "expired").otherwise(F.col("status"))).drop("_gone")


DECISIONS = {"applied": "applied", "interviewing": "applied", "skipped": "skipped", "rejected": "skipped"}


def parse_decisions(rows: DataFrame) -> DataFrame:
    """J14, first half: rows(row_no, id, status, applied_on) -> (id, status, applied_on), the last known word of each id."""
    word = F.lower(F.trim("status"))
    table = T.mapping(DECISIONS)
    known = rows.where((F.trim("id") != "") & (word != "")).select(F.trim("id").alias("id"), F.try_element_at(table, word).alias("status"), "applied_on", "row_no")
    return known.where("status is not null").groupBy("id").agg(F.max_by("status", "row_no").alias("status"), F.max_by("applied_on", "row_no").alias("applied_on"))


def unknown_decisions(rows: DataFrame) -> DataFrame:
    """J14, words that are no decision: (row_no, id, word), to be reported."""
    word = F.trim("status")
    known = F.lower(word).isin(list(DECISIONS))
    return rows.where((F.trim("id") != "") & (word != "") & ~known).select("row_no", F.trim("id").alias("id"), word.alias("word"))


def set_status(postings: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """changes(id, status); equal statuses are not touched, ``applied`` stamps its time."""
    both = postings.join(changes.select("id", F.col("status").alias("_to")), "id", "left")
    moved = F.col("_to").isNotNull() & (F.col("_to") != F.col("status"))
    return (
        both.withColumn("applied_at", F.when(moved & (F.col("_to") == "applied"), now).otherwise(F.col("applied_at")))
        .withColumn("status", F.when(moved, F.col("_to")).otherwise(F.col("status"))).drop("_to")
    )


def mirror_plan(postings: DataFrame, mirrored: DataFrame) -> DataFrame:
    """(id, op, position): rows already mirrored(id, position) are updated, new live ones appended after them.

    Positions of appended rows come from counts of partitions of the id order, so no
    task sees all rows.
    """
    first = mirrored.where(F.trim("id") != "").groupBy("id").agg(F.min("position").alias("position"))
    known = postings.join(first, "id", "left")
    updates = known.where("position is not null").select("id", F.lit("update").alias("op"), F.col("position").cast("long").alias("position"))
    used = mirrored.agg(F.coalesce(F.max("position"), F.lit(0)).cast("long").alias("used"))
    fresh = known.where("position is null").where(~F.col("status").isin("expired", "skipped")).select("id")
    return updates.unionByName(numbered(fresh, "id").crossJoin(F.broadcast(used)).select("id", F.lit("append").alias("op"), (F.col("used") + F.col("n")).alias("position")))


def numbered(df: DataFrame, column: str, shift: int = 2) -> DataFrame:
    """(column, n): running numbers from 1 in the order of a text column, by counts of its hexadecimal prefixes."""
    part = F.substr(column, F.lit(1), F.lit(shift))
    counts = df.groupBy(part.alias("_p")).agg(F.count("*").alias("_c"))  # at most 16^shift rows for hexadecimal ids
    before = counts.withColumn("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = df.withColumn("_p", part).join(F.broadcast(before.drop("_c")), "_p")
    return rows.withColumn("n", F.col("_b") + F.row_number().over(Window.partitionBy("_p").orderBy(column))).select(column, "n")


def rekey(postings: DataFrame) -> DataFrame:
    """J17, first half: (old, new, collides) of ids recomputed under the present rules, where they change."""
    key = T.dedupe_key(T.normalize_company("company"), T.normalize_title("title"), F.col("location_norm"), F.col("term"))
    moved = postings.select(F.col("id").alias("old"), T.posting_id(key).alias("new")).where("old <> new")
    many = moved.groupBy("new").agg((F.count("*") > 1).alias("collides"))
    return moved.join(many, "new").select("old", "new", "collides")


def rewrite_ids(table: DataFrame, mapping: DataFrame, column: str = "id") -> DataFrame:
    """J17, second half: replace old ids; the caller stops if any mapping collides."""
    return table.join(mapping.select(F.col("old").alias(column), F.col("new").alias("_new")), column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new").select(*table.columns)


def union_ids(parts: list[DataFrame], minus: DataFrame | None = None) -> DataFrame:
    """Distinct ids of all parts, without those of ``minus``."""
    ids = reduce(DataFrame.unionByName, [p.select("id") for p in parts]).distinct()
    return ids if minus is None else ids.join(minus.select("id").distinct(), "id", "left_anti")


def record_exclusions(excluded: DataFrame, dropped: DataFrame, version: str, now: Column) -> DataFrame:
    """A2: keyed by (id, filter_version); the first reason stays, seen_at follows."""
    names = ["company", "title", "apply_url", "term", "source", "filter_reason"]
    rows = dropped.groupBy("id").agg(*[F.min_by(c, F.struct(*ORDER)).alias(f"n_{c}") for c in names]).withColumn("filter_version", F.lit(version)).withColumn("_hit", F.lit(True))
    both = excluded.join(rows, ["id", "filter_version"], "full_outer")
    values = {c: F.when(F.col("seen_at").isNull(), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in names}
    values["seen_at"] = F.when(F.col("_hit"), now).otherwise(F.col("seen_at")).alias("seen_at")
    return both.select(*[values.get(c, F.col(c)) for c in excluded.columns])


def record_suppressions(table: DataFrame, suppressed: DataFrame, now: Column) -> DataFrame:
    """A4: keyed by (baseline_id, title, source); counts add up, first facts stay."""
    keys = ["baseline_id", "title", "source"]
    rows = suppressed.withColumn("baseline_id", F.col("id")).groupBy(*keys).agg(
        *[F.min_by(c, F.struct(*ORDER)).alias(f"n_{c}") for c in ("company", "posted_at", "title_norm")], F.count("*").alias("_n")
    )
    both = table.join(rows, keys, "full_outer")
    old = F.col("first_at").isNotNull()
    values = {c: F.when(old, F.col(c)).otherwise(F.col(f"n_{c}")).alias(c) for c in ("company", "posted_at", "title_norm")}
    values["first_at"] = F.coalesce("first_at", now).alias("first_at")
    values["last_at"] = F.when(F.col("_n").isNotNull(), now).otherwise(F.col("last_at")).alias("last_at")
    values["times_seen"] = (F.coalesce("times_seen", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("times_seen")
    return both.select(*[values.get(c, F.col(c)) for c in table.columns])


def prune(table: DataFrame, column: str, now: Column, days: int) -> DataFrame:
    """Rows not older than ``days``."""
    return table.where(F.unix_micros(column) >= F.unix_micros(now) - days * 86_400_000_000)


def keep_recent_runs(runs: DataFrame, n: int) -> DataFrame:
    """The payload rows of the n latest runs (by their latest row); run ids are few."""
    latest = runs.groupBy("run_id").agg(F.max("created_at").alias("_at")).orderBy(F.desc("_at"), "run_id").limit(n).select("run_id")
    return runs.join(F.broadcast(latest), "run_id", "left_semi")


def empty(spark, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
