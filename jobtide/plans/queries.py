"""The registered queries: library operators over the bound tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import links as L
from ..functions import text as T
from ..operators import gates as G
from ..operators import health as H
from ..operators import notify as N
from ..operators import reports as R
from ..operators import scoring as C
from ..operators import state as S
from ..operators import views as V
from ..operators.location import normalize_locations
from ..schemas import BASELINE, EXCLUDED, SIGHTING, SUPPRESSION
from ..sources.feeds import strip_html
from ..sources.folders import written
from . import bindings as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

PROFILE = G.Profile(needs_sponsorship=True, us_person=False, holds_clearance=False, wanted_terms={"summer-2027": False, "fall-2026": True}, configured=True)


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def now():
    return B.stamp(B.NOW)


# --- text ---------------------------------------------------------------------


@query
def n01_basic_text(spark, sf):
    docs = B.read(spark, sf, "documents")
    return docs.select("doc_id", F.md5(T.basic_text("text").cast("binary")).alias("basic_md5"))


@query
def n02_normalize_company(spark, sf):
    raw = B.raw_postings(spark, sf)
    return raw.groupBy("company").agg(F.count("*").alias("n")).select("company", T.normalize_company("company").alias("company_norm"), "n")


@query
def n04_normalize_title(spark, sf):
    raw = B.raw_postings(spark, sf)
    return raw.groupBy("title").agg(F.count("*").alias("n")).select("title", T.normalize_title("title").alias("title_norm"), "n")


@query
def n09_normalize_location(spark, sf):
    raw = normalize_locations(B.raw_postings(spark, sf))
    return raw.groupBy("location", "remote_hint", "location_norm").agg(F.count("*").alias("n"))


@query
def n10_infer_term(spark, sf):
    return B.raw_postings(spark, sf).select("seq", T.infer_term("title", "description", "term_default").alias("term"))


@query
def n12_normalize_postings(spark, sf):
    rows = S.normalize_postings(B.raw_postings(spark, sf), now())
    return rows.select("seq", "id", "dedupe_key", "term", "location", "remote", "source_url")


@query
def n13_n14_head_and_years(spark, sf):
    raw = B.raw_postings(spark, sf)
    return raw.select("seq", T.role_head("title").alias("head"), T.min_years("description").alias("years"))


@query
def n15_n16_day_and_age(spark, sf):
    p = B.postings(spark, sf)
    args = ("posted_at", "first_seen_at", "posted_precision")
    return p.select("seq", "posted_precision", D.posted_day(*args).alias("day"), D.age_text(*args, now()).alias("age"), D.is_fresh("posted_at", "posted_precision", now()).alias("fresh"))


@query
def s08_s09_timestamps(spark, sf):
    e = B.read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    text = F.when(F.col("event_id") % 4 == 0, F.unix_timestamp("ts").cast("string")).when(F.col("event_id") % 4 == 1, F.unix_millis("ts").cast("string")).when(
        F.col("event_id") % 4 == 2, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    ).otherwise("soon")
    age = F.concat((F.col("event_id") % 40).cast("string"), B.pick(["h", "d", "w", "mo", "yr", "x"], F.col("event_id")))
    return e.select("event_id", D.parse_timestamp(text).alias("parsed"), D.age_to_posted_at(age, now()).alias("posted_at"))


@query
def s10_strip_html(spark, sf):
    return B.read(spark, sf, "pages").select("page_id", strip_html("html").alias("body"))


@query
def n17_n21_links(spark, sf):
    l = B.links(spark, sf)
    return l.select(
        "id", L.has_job_id("final_url").alias("has_id"), L.looks_like_index("final_url").alias("is_index"), L.is_known_blocked("final_url").alias("blocked_host"),
        L.classify_link("url", "final_url", "http_status").alias("verdict"), L.link_note("url", "final_url", "http_status").alias("note"), L.host_key("final_url").alias("host_key"),
    )


@query
def n22_n23_mirror_rows(spark, sf):
    return V.mirror_rows(B.postings(spark, sf))


@query
def n24_redact_secrets(spark, sf):
    return B.read(spark, sf, "conversations").select("conv_id", "turn", F.md5(L.redact_secrets("text", ["the stan", "therhean is the is", "and therhean is the is esndha"]).cast("binary")).alias("clean_md5"))


@query
def n26_parse_applied_on(spark, sf):
    o = B.read(spark, sf, "orders")
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    text = F.when(k % 5 == 0, F.date_format(d, "yyyy-MM-dd")).when(k % 5 == 1, F.date_format(d, "MM/dd/yyyy")).when(k % 5 == 2, F.date_format(d, "yyyy/MM/dd")).when(k % 5 == 3, "soon").when(F.dayofmonth(d) > 12, F.date_format(d, "dd/MM/yyyy"))
    return o.select(k.alias("seq"), D.parse_applied_on(text).alias("applied_on"))


@query
def n28_parse_model_reply(spark, sf):
    e = B.read(spark, sf, "events")
    reply = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('Sure:\n{"score": '), F.col("value").cast("string"), F.lit(', "rationale": "fits", "concerns": ["a", "b", "c"]}'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("no "), F.col("props"))).otherwise("none")
    return e.select("event_id", C.parse_reply(reply).alias("r")).select("event_id", F.col("r.score").alias("score"), F.col("r.rationale").alias("rationale"))


# --- gates --------------------------------------------------------------------


@query
def f01_f04_gates(spark, sf):
    return G.with_gates(B.raw_postings(spark, sf)).select("seq", "level_reason", "field_reason", "keep", "reason")


@query
def a01_gate_reason_counts(spark, sf):
    return G.gate_reason_counts(G.with_gates(B.raw_postings(spark, sf)))


@query
def f05_clearance_finding(spark, sf):
    must, may = G.clearance(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("description", F.lit(""))))
    return B.raw_postings(spark, sf).select("seq", must.alias("must_hold"), may.alias("may_obtain"))


@query
def f06_disqualifiers(spark, sf):
    raw = B.raw_postings(spark, sf).withColumn("term", T.infer_term("title", "description", "term_default"))
    return G.disqualifiers(raw, PROFILE).select("seq", F.array_join("disqualifiers", ",").alias("disqualifiers"))


# --- state --------------------------------------------------------------------


def _normalized(spark, sf):
    """The gated and normalised batch, written once: several frames of one query read it."""
    raw = B.raw_postings(spark, sf)
    return written(S.normalize_postings(G.with_gates(raw).where("keep"), now(), strings=raw), "batch")


def _baseline(batch):
    """Every third id of the first half of the batch."""
    rows = batch.where(F.col("posted_at") < B.stamp(B.CUTOVER))
    return rows.where(F.substr("id", F.lit(1), F.lit(1)).isin(*"01234")).select("id", now().alias("seeded_at")).distinct()


def _suppressed(spark, sf):
    """What the cutover holds back, written once."""
    batch = _normalized(spark, sf)
    return written(S.apply_cutover(batch, _baseline(batch), B.stamp(B.CUTOVER))[1], "suppressed")


@query
def j01_apply_cutover(spark, sf):
    batch = _normalized(spark, sf)
    return S.cutover_flags(batch, _baseline(batch), B.stamp(B.CUTOVER)).select("seq", "accepted")


def _state_columns(spark):
    from ..schemas import POSTING

    return S.empty(spark, POSTING)


@query
def j02_upsert_postings(spark, sf):
    batch = _normalized(spark, sf)
    half = F.col("seq") % 2 == 0
    state = written(S.upsert(_state_columns(spark), batch.where(half)).drop("is_new", "url_upgrades"), "state")
    merged = S.upsert(state, batch.where(~half))
    return merged.select("id", "company", "title", "term", "location", "remote", "apply_url", "source", "source_id", "source_url", "posted_at", "posted_precision", "status", "link_status", "is_new", "url_upgrades")


@query
def j03_u02_seen_ids(spark, sf):
    p = B.postings(spark, sf)
    return S.union_ids([p.where("source = 'ats'"), p.where("tier = 1")], p.where("status = 'expired'"))


@query
def j03_seen(spark, sf):
    """By id for tier 1; by dedupe key alone for the applied ones of it, whose ids stand under an older key."""
    p = B.postings(spark, sf).withColumn("dedupe_key", F.concat_ws("|", "company_norm", "title_norm", "term"))
    top = p.where("tier = 1").select("id", F.lit(None).cast("string").alias("dedupe_key"))
    older = p.where("tier = 1 and status = 'applied' and company_norm <> 'meta'").select(F.concat(F.lit("old"), "id").alias("id"), "dedupe_key")
    return S.seen(p.select("seq", "id", "dedupe_key"), top.unionByName(older))


@query
def j09_collapse_to_baseline(spark, sf):
    return S.collapse_to_baseline(B.postings(spark, sf), S.empty(spark, BASELINE), now())[1].select("id", "seeded_at")


@query
def j04_j05_sightings(spark, sf):
    p = B.postings(spark, sf)
    before = p.where(F.col("seq") % 4 != 0).select("id", F.lit("r0").alias("last_seen_run"), (F.col("seq") % 3).cast("int").alias("missed_runs"), F.when(F.col("seq") % 3 > 0, F.col("last_seen_at")).alias("first_missed_at"))
    healthy = p.where(F.col("source").isin("ats", "listings")).select("source").distinct()
    seen = p.where((F.col("seq") % 5 < 2) & F.col("source").isin("ats", "listings")).select("id")
    out = S.mark_missed(S.mark_seen(before, seen, "r1"), p, healthy, seen, now())
    return out.select("id", "last_seen_run", "missed_runs", "first_missed_at")


@query
def j06_expire_stale(spark, sf):
    p = B.postings(spark, sf)
    s = p.where(F.col("seq") % 3 > 0).select("id", F.col("last_seen_at").alias("first_missed_at"))
    return S.expire_stale(p, s, now()).select("id", "status", "just_expired")


@query
def j07_retire_expired(spark, sf):
    p = B.postings(spark, sf)
    kept, _, baseline = S.retire_expired(p, S.empty(spark, SIGHTING), S.empty(spark, BASELINE), now())
    return kept.select("id", F.lit("postings").alias("held_in")).union(baseline.select("id", F.lit("baseline")))


@query
def j08_seed_baseline(spark, sf):
    p = B.postings(spark, sf)
    first = S.seed_baseline(S.empty(spark, BASELINE), p.where("tier = 1"), now())
    return S.promote(S.seed_baseline(first, p.where("status = 'applied'"), now()), p.where("term = 'new-grad'")).select("id")


@query
def j11_first_raw_by_id(spark, sf):
    return S.first_raw_by_id(_normalized(spark, sf), ["title", "source", "posted_at"]).select("id", F.col("title"), F.col("source"), "posted_at")


@query
def j12_apply_triage(spark, sf):
    p = B.postings(spark, sf)
    updates = p.where("status = 'new'").select("id", (100 - F.col("score")).alias("score"), F.lit(2).alias("tier"))
    return S.apply_updates(p, updates).select("id", "score", "tier")


@query
def j13_apply_link_results(spark, sf):
    p = B.postings(spark, sf).withColumn("final_url", F.lit(None).cast("string")).withColumn("link_checked_at", F.lit(None).cast("timestamp"))
    verdict = B.pick(["ok", "dead", "blocked", "redirected_to_index"], F.col("seq"))
    results = p.where(F.col("seq") % 2 == 0).select("id", verdict.alias("link_status"), F.col("apply_url").alias("final_url"), now().alias("link_checked_at"))
    return S.apply_link_results(p, results).select("id", "link_status", "final_url", "status")


def _decision_rows(spark, sf):
    p = B.postings(spark, sf)
    words = B.pick(["Applied", "skipped ", "", "maybe", "Interviewing", "rejected"], F.floor(F.col("seq") / 4) + 2 * F.col("o"))
    rows = p.select("id", "seq", F.explode(F.array(F.lit(0), F.lit(1))).alias("o")).where(F.col("seq") % 4 == 0)
    return rows.select((F.col("seq") * 2 + F.col("o")).alias("row_no"), "id", words.alias("status"), F.lit("2001-07-30").cast("date").alias("applied_on"))


def _decisions(spark, sf):
    return S.parse_decisions(_decision_rows(spark, sf))


@query
def j14_unknown_words(spark, sf):
    return S.unknown_decisions(_decision_rows(spark, sf))


@query
def j14_j15_decisions(spark, sf):
    return S.set_status(B.postings(spark, sf).withColumn("applied_at", F.lit(None).cast("timestamp")), _decisions(spark, sf), now()).select("id", "status", "applied_at")


@query
def j16_mirror_plan(spark, sf):
    p = B.postings(spark, sf)
    return S.mirror_plan(p, p.where(F.col("seq") % 10 == 0).select("id", (F.col("seq") / 10 + 2).cast("int").alias("position")))


@query
def j17_rekey(spark, sf):
    p = _normalized(spark, sf).dropDuplicates(["id"]).withColumn("location_norm", F.when(F.col("location_norm").isin("nyc", "sf-bay"), "new-york").otherwise(F.col("location_norm")))
    return S.rekey(p)


@query
def a02_a03_exclusions(spark, sf):
    raw = B.raw_postings(spark, sf)
    rows = G.with_gates(raw).where("not keep").withColumn("filter_reason", F.col("reason"))
    dropped = S.normalize_postings(rows, now(), also=("filter_reason",), strings=raw)
    table = S.record_exclusions(S.empty(spark, EXCLUDED), dropped, "v1", now())
    return R.exclusion_counts(table).select("filter_reason", "n", F.round("share", 9).alias("share"))


@query
def a04_a05_suppressions(spark, sf):
    suppressed = _suppressed(spark, sf)
    once = S.record_suppressions(S.empty(spark, SUPPRESSION), suppressed, now())
    return R.suppression_collapse(S.record_suppressions(once, suppressed.where("source = 'ats'"), now()))


@query
def r01_prune(spark, sf):
    p = B.postings(spark, sf)
    return S.prune(p, "first_seen_at", now(), 14).select("id").union(S.prune(p.where("tier = 2"), "last_seen_at", now(), 30).select("id"))


@query
def w10_keep_recent_runs(spark, sf):
    h = B.run_history(spark, sf)
    runs = h.select(F.date_format("started_at", "yyyyMMdd").alias("run_id"), F.col("started_at").alias("created_at"), "source")
    return S.keep_recent_runs(runs, 3).groupBy("run_id", "source").agg(F.count("*").alias("n"))


# --- scoring and notification -------------------------------------------------


def _targets(spark, sf):
    return B.postings(spark, sf).where(F.col("company_norm").isin(B.TARGETS)).select("company_norm").distinct()


def _scored(spark, sf):
    p = C.with_target(B.postings(spark, sf).drop("tier", "score"), _targets(spark, sf))
    return C.with_signals(p, PROFILE, now())


@query
def c01_signals(spark, sf):
    return _scored(spark, sf).select("id", F.explode("signals").alias("s")).select("id", F.col("s.signal").alias("signal"), F.col("s.points").alias("points"))


@query
def c02_c03_score_and_tier(spark, sf):
    rows = _scored(spark, sf)
    return rows.select("id", "heuristic_score", "heuristic_trace", C.assign_tier(F.col("heuristic_score")).alias("tier"))


@query
def c04_score_postings(spark, sf):
    p = B.postings(spark, sf)
    cache = p.where(F.col("seq") % 5 == 0).select(F.col("id").alias("posting_id"), "score", F.lit("seen before").alias("rationale"))
    reply = F.when(F.col("seq") % 2 == 0, F.concat(F.lit('{"score": '), F.col("score").cast("string"), F.lit(', "rationale": "ok"}'))).otherwise("busy")
    replies = p.where(F.col("seq") % 3 == 0).select("id", reply.alias("reply"))
    return C.score_postings(_scored(spark, sf), cache, replies, True).select("id", "score", "tier", "tier_source", "score_rationale")


def _sourced(spark, sf):
    return B.postings(spark, sf).withColumn("tier_source", B.pick(["llm", "cached", "heuristic", "llm"], F.col("seq"))).withColumn("score_rationale", F.concat(F.lit("because "), F.col("seq").cast("string")))


@query
def j10_cache_scores(spark, sf):
    """The first score of a model stays: what was cached, and what is new."""
    rows = _sourced(spark, sf)
    cache = rows.where(F.col("seq") % 5 == 0).select(F.col("id").alias("posting_id"), F.lit(1).alias("score"), F.lit("old").alias("rationale"), "tier_source", now().alias("scored_at"), F.lit("m1").alias("model"))
    return C.cache_scores(cache, rows, "m2", now() + F.expr("interval 1 hour"))


@query
def c04_scorer_counts(spark, sf):
    return C.scorer_counts(_sourced(spark, sf))


@query
def f12_model_candidates(spark, sf):
    cache = B.postings(spark, sf).where(F.col("seq") % 5 == 0).select(F.col("id").alias("posting_id"))
    return C.model_candidates(_scored(spark, sf), cache).select("id", "heuristic_score")


@query
def n27_build_prompts(spark, sf):
    rows = C.build_prompts(_scored(spark, sf).withColumn("description", F.col("title_norm")), "R:{resume}|T:{targets}|P:{posting}|H:{heuristic}", "me", "all")
    return rows.select("id", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


def decided_postings(spark, sf, at: str):
    p = B.postings(spark, sf)
    base = p.where(F.col("seq") % 50 == 0).select("id")
    sent_at = F.timestamp_micros(F.unix_micros(F.lit(at).cast("timestamp")) - F.col("seq") * 180_000_000)
    ledger = p.where("status = 'notified'").select(F.col("id").alias("posting_id"), "tier", sent_at.alias("sent_at"))
    sent = N.notifications_since(ledger, F.lit(at).cast("timestamp") - F.expr("interval 1 hour"), 1)
    return N.decide_notifications(p, base, F.lit(at).cast("timestamp"), sent, R.backlog_unapplied(p))


@query
def c05_w08_decide_notifications(spark, sf):
    return decided_postings(spark, sf, "2001-08-03 20:00:00").select("id", "decision", "decision_reason", "priority")


@query
def c05_quiet_hours(spark, sf):
    return decided_postings(spark, sf, "2001-08-03 08:00:00").groupBy("decision", "decision_reason", "priority").agg(F.count("*").alias("n"))


@query
def c05_suppression_counts(spark, sf):
    return N.suppression_counts(decided_postings(spark, sf, "2001-08-03 20:00:00"))


def _ledger(spark, sf):
    return B.postings(spark, sf).where("status = 'notified'").select(F.col("id").alias("posting_id"), "tier", F.col("last_seen_at").alias("sent_at"))


@query
def c06_record_notifications(spark, sf):
    at = "2001-08-03 08:00:00"
    return N.record_notifications(_ledger(spark, sf), decided_postings(spark, sf, at), B.stamp(at))


@query
def c07_notifications_since(spark, sf):
    since = now() - F.expr("interval 400 days")
    every = N.notifications_since(_ledger(spark, sf), since).select(F.lit("all").alias("tier"), "n")
    return every.union(N.notifications_since(_ledger(spark, sf), since, 1).select(F.lit("1"), "n"))


@query
def n25_payloads(spark, sf):
    return N.payloads(decided_postings(spark, sf, "2001-08-03 08:00:00").withColumn("score_rationale", F.lit("ok")), now()).select("id", "title", "body", "priority", "tag", "action_url")


@query
def f11_c08_quiet_and_digest(spark, sf):
    e = B.read(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    last = F.timestamp_micros(F.unix_micros("ts") - (F.col("event_id") % 30) * 3_600_000_000)
    return e.select("event_id", D.is_quiet("ts").alias("quiet"), D.digest_due("ts", last).alias("due"), D.next_digest("ts").alias("next_digest"))


# --- views --------------------------------------------------------------------


@query
def w07_rank_by_date(spark, sf):
    """A report of the ten best of each term; w07_rank_all_by_date ranks all."""
    return V.rank_postings(V.live(B.postings(spark, sf)), "date", 10).select("term", "place", "id")


@query
def w07_rank_by_score(spark, sf):
    """A report of the ten best of each term; w07_rank_all_by_score ranks all."""
    return V.rank_postings(V.live(B.postings(spark, sf)), "score", 10).select("term", "place", "id")


@query
def w07_rank_all_by_date(spark, sf):
    return V.rank_postings(V.live(B.postings(spark, sf)), "date").select("term", "place", "id")


@query
def w07_rank_all_by_score(spark, sf):
    return V.rank_postings(V.live(B.postings(spark, sf)), "score").select("term", "place", "id")


@query
def t01_recent(spark, sf):
    return V.recent(B.postings(spark, sf), status="new", tier=2, limit=50).select("id", "first_seen_at")


@query
def t02_live_by_term(spark, sf):
    return V.live_by_term(B.postings(spark, sf), term="new-grad").select("id", "term", "tier", "score")


@query
def t03_fresh(spark, sf):
    return V.fresh(B.postings(spark, sf), B.stamp("2001-07-20 12:00:00")).select("id", "approximate")


@query
def t04_index_rows(spark, sf):
    return V.index_rows(B.postings(spark, sf), now())


@query
def t05_digest(spark, sf):
    return V.digest(B.postings(spark, sf), B.stamp("2001-07-20 12:00:00"))


@query
def t06_order_backlog(spark, sf):
    p = B.postings(spark, sf).select("id", "term", F.when(F.col("seq") % 9 == 0, "n/a").otherwise(F.col("score").cast("string")).alias("score"))
    return V.order_backlog(p).select("id", "term_rank", "points")


@query
def t06_off_cycle(spark, sf):
    return V.off_cycle(B.postings(spark, sf))


@query
def f07_search_exclusions(spark, sf):
    return V.search_exclusions(B.postings(spark, sf), "engineer").select("id", "company", "title")


@query
def f13_needing_link_check(spark, sf):
    return V.needing_link_check(B.postings(spark, sf), 100).select("id")


@query
def w11_host_waves(spark, sf):
    return V.host_waves(B.links(spark, sf).select("id", F.col("final_url").alias("url")))


@query
def a20_decision_stats(spark, sf):
    return V.decision_stats(B.postings(spark, sf), _decisions(spark, sf), now())


@query
def a20_applied_by_term(spark, sf):
    return V.applied_by(B.postings(spark, sf), _decisions(spark, sf), "term")


# --- health and reports -------------------------------------------------------


@query
def w02_w05_source_health(spark, sf):
    h = H.source_health(B.run_history(spark, sf))
    return h.select("source", "started_at", "measured", "median", F.round("ratio", 9).alias("ratio"), "volume_drop", "stale_304", F.round("midnight_median", 9).alias("midnight_median"), "precision_drift", "ok")


@query
def w05_quiet_feeds(spark, sf):
    """Feeds that answer on a few days of a month only: most runs have no history within eight days, or a short one."""
    some = (F.dayofmonth("started_at") % 12 < 2) | (F.dayofmonth("started_at") % 7 == 3)
    h = H.source_health(B.run_history(spark, sf).where(some))
    return h.select("source", "started_at", "measured", "median", F.round("ratio", 9).alias("ratio"), "volume_drop", "stale_304", F.round("midnight_median", 9).alias("midnight_median"), "precision_drift", "ok")


@query
def w05_messages(spark, sf):
    return H.source_health(B.run_history(spark, sf)).where("not ok").select("source", "started_at", "message")


@query
def a06_source_counters(spark, sf):
    g = G.with_gates(B.raw_postings(spark, sf)).withColumn("term", T.infer_term("title", "description", "term_default"))
    rows = g.withColumn("is_new", F.col("keep") & (F.col("seq") % 10 == 0)).withColumn("suppressed", F.col("keep") & (F.col("seq") % 10 == 1))
    return R.source_run_counters(rows).withColumns({c: F.round(c, 9) for c in ("midnight_share", "term_unknown_rate")})


@query
def a07_run_totals(spark, sf):
    g = G.with_gates(B.raw_postings(spark, sf)).withColumn("term", F.lit("unknown")).withColumn("is_new", F.lit(False)).withColumn("suppressed", F.lit(False))
    accepted = _normalized(spark, sf)
    return R.run_totals(R.source_run_counters(g), accepted, S.upsert(_state_columns(spark), accepted))


@query
def a08_link_status_counts(spark, sf):
    return R.link_status_counts(B.postings(spark, sf))


@query
def a09_store_stats(spark, sf):
    p = B.postings(spark, sf)
    ledger = p.where("status = 'notified'").select(F.col("id").alias("posting_id"), "tier", F.col("first_seen_at").alias("sent_at"))
    runs = B.read(spark, sf, "events").select(F.date_trunc("hour", "ts").alias("started_at")).distinct()
    return R.store_stats(p, ledger, runs, now())


@query
def a11_daily_new(spark, sf):
    return R.daily_new_by_source(B.run_history(spark, sf))


@query
def a12_median_daily_new(spark, sf):
    return R.median_daily_new(B.run_history(spark, sf), F.lit("2024-01-20").cast("date"))


@query
def a13_tier1_precision(spark, sf):
    return R.tier1_precision(B.postings(spark, sf)).withColumn("precision", F.round("precision", 9))


@query
def a14_a16_tier_volume(spark, sf):
    h = B.run_history(spark, sf).withColumn("tiers", F.create_map(F.lit("1"), F.col("new"), F.lit("2"), F.col("raw_fetched")))
    return R.tier_volume_per_day(h)


@query
def a16_notification_totals(spark, sf):
    h = B.run_history(spark, sf).withColumn("notifications", F.create_map(F.lit("sent"), F.col("new"), F.lit("digest"), F.col("dated")))
    return R.notification_totals(h)


@query
def a15_signal_attribution(spark, sf):
    rows = _scored(spark, sf).withColumn("tier", C.assign_tier(F.col("heuristic_score")))
    return C.signal_attribution(rows).withColumns({c: F.round(c, 9) for c in ("share", "mean_points")})


@query
def a17_source_rollup(spark, sf):
    return R.source_rollup(B.run_history(spark, sf))


@query
def a18_run_time_projection(spark, sf):
    return R.run_time_projection(B.run_history(spark, sf)).withColumns({c: F.round(c, 6) for c in ("mean_s", "minutes_month")})


@query
def a19_posting_hours(spark, sf):
    return R.posting_hours(B.postings(spark, sf), ["ats", "listings"], weekdays_only=True).withColumn("share", F.round("share", 9))


@query
def w06_best_windows(spark, sf):
    return R.best_posting_windows(R.posting_hours(B.postings(spark, sf), ["ats", "listings"]), 3)


@query
def a21_board_tally(spark, sf):
    log = B.links(spark, sf).select(F.col("id").alias("board"), F.when(F.col("id") % 6 == 5, 304).otherwise(F.col("http_status")).alias("http_status"), (F.col("id") % 3).alias("rows"))
    tally = R.board_tally(log)
    roster = log.select("board", (F.col("board") % 2 == 0).alias("verified"))
    left = R.surviving_roster(roster, tally).groupBy("verified").agg(F.count("*").alias("n")).select(F.concat(F.lit("roster-"), F.col("verified").cast("string")).alias("outcome"), "n", F.lit(0).cast("long").alias("responding"))
    return R.board_counts(tally).union(left)


@query
def a22_audit_record(spark, sf):
    g = G.with_gates(B.raw_postings(spark, sf)).where("not keep").select(F.col("seq").cast("string").alias("id"), "company", "title", F.col("reason").alias("filter_reason"))
    suppressed = _suppressed(spark, sf)
    one = R.audit_record(g, S.record_suppressions(S.empty(spark, SUPPRESSION), suppressed, now()), "r1", now())
    return one.select("run_id", "at", F.to_json("exclusions").alias("exclusions"), F.to_json("suppressions").alias("suppressions"))


@query
def t07_stable_sample(spark, sf):
    return R.stable_sample(B.postings(spark, sf), 20).select("id", "title")


@query
def t08_sample_exclusions(spark, sf):
    g = G.with_gates(B.raw_postings(spark, sf)).where("not keep").select("seq", F.col("reason").alias("filter_reason"))
    return R.sample_exclusions(g, 20, "senior-level", id_col="seq")


@query
def t09_recent_suppressions(spark, sf):
    suppressed = _suppressed(spark, sf)
    table = S.record_suppressions(S.empty(spark, SUPPRESSION), suppressed, now())
    return R.recent_suppressions(table, B.stamp("2001-01-01 00:00:00"), 25).select("baseline_id", "title", "source", "times_seen")


@query
def ranked_postings(spark, sf):
    """The flagship: gated, normalised, deduplicated, scored, ranked postings."""
    raw = B.raw_postings(spark, sf)
    gated = G.disqualifiers(G.with_gates(raw).where("keep").withColumn("term", T.infer_term("title", "description", "term_default")), PROFILE)
    batch = written(S.normalize_postings(gated, now(), also=("disqualifiers",), strings=raw), "batch")
    merged = S.upsert(_state_columns(spark), batch).drop("disqualifiers", "tier", "score")
    body = S.first_raw_by_id(batch, ["disqualifiers"])
    scored = C.with_signals(C.with_target(merged.join(body, "id", "left"), _targets(spark, sf)), PROFILE, now())
    scored = scored.withColumn("score", F.col("heuristic_score")).withColumn("tier", C.assign_tier(F.col("heuristic_score")))
    return V.rank_postings(scored, "date", 20).select("term", "place", "id", "company", "title", "location_norm", "tier", "score", "heuristic_trace")
