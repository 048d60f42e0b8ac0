"""Scores, tiers and what they are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import text as T
from .gates import Profile


def _points(name: str, parts: list[tuple[Column, Column, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(ok, F.struct(label.alias("signal"), points.cast("int").alias("points"))) for ok, label, points in parts])).alias(name)


def _parts(profile: Profile, now: Column) -> list[tuple[Column, Column, Column, Column]]:
    """(applies, signal, points, words in the trace) of each signal, in order."""
    lit = F.lit
    term = F.coalesce(F.try_element_at(T.mapping(R.TERM_POINTS), F.col("term")), lit(10))
    title = F.when(F.coalesce("title_norm", lit("")) != "", F.col("title_norm")).otherwise(F.lower("title"))
    place, label = lit(0), lit(None).cast("string")
    for pattern, n, name in reversed(R.DISCIPLINES):
        place, label = F.when(title.rlike(pattern), n).otherwise(place), F.when(title.rlike(pattern), name).otherwise(label)
    metro = F.try_element_at(T.mapping(R.METRO_POINTS), F.col("location_norm"))
    days = F.floor((F.unix_micros(now) - F.unix_micros("posted_at")) / lit(86_400_000_000))
    unwanted = F.col("term").isin([t for t, w in profile.wanted_terms.items() if not w])
    plus = lambda name, n: F.concat(name, lit(" "), F.when(n >= 0, lit("+")).otherwise(lit("")), n.cast("string"))
    return [
        (lit(True), F.concat(lit("term:"), F.col("term")), term, plus(F.concat(lit("term "), F.col("term")), term)),
        (label.isNotNull(), F.concat(lit("discipline:"), label), place, plus(label, place)),
        (F.col("is_target"), lit("target-company"), lit(R.TARGET_POINTS), lit(f"target company +{R.TARGET_POINTS}")),
        (metro.isNotNull(), F.concat(lit("metro:"), F.col("location_norm")), metro, plus(F.col("location_norm"), metro)),
        (F.col("remote"), lit("remote"), lit(R.REMOTE_POINTS), lit(f"remote +{R.REMOTE_POINTS}")),
        (days <= 2, lit("recency:<2d"), lit(8), lit("posted <2d +8")),
        ((days > 2) & (days <= 7), lit("recency:<1w"), lit(4), lit("posted <1w +4")),
        (days > 45, lit("recency:stale"), lit(-8), lit("posted >45d -8")),
        (unwanted, lit("term-not-wanted"), lit(R.UNWANTED_POINTS), F.concat(F.col("term"), lit(f" not wanted {R.UNWANTED_POINTS}"))),
    ]


def with_target(postings: DataFrame, targets: DataFrame) -> DataFrame:
    """Add ``is_target``; targets(company_norm) is the roster's, a small list."""
    marked = targets.select("company_norm").distinct().withColumn("is_target", F.lit(True))
    return postings.join(F.broadcast(marked), "company_norm", "left").withColumn("is_target", F.coalesce("is_target", F.lit(False)))


def with_signals(postings: DataFrame, profile: Profile, now: Column) -> DataFrame:
    """Add signals (array of signal and points), heuristic_score and heuristic_trace."""
    parts = _parts(profile, now)
    out = postings.withColumn("signals", _points("signals", [p[:3] for p in parts]))
    total = F.aggregate("signals", F.lit(0), lambda a, s: a + s["points"])
    trace = F.array_join(F.array_compact(F.array(*[F.when(ok, words) for ok, _, _, words in parts])), "; ")
    return out.withColumn("heuristic_score", F.greatest(F.lit(0), F.least(F.lit(100), total))).withColumn("heuristic_trace", trace)


def assign_tier(score: Column) -> Column:
    """C3, over is_target, term and disqualifiers."""
    return (
        F.when(F.size("disqualifiers") > 0, 3).when((score >= R.TIER1) & F.col("is_target"), 1)
        .when((F.col("term") == "new-grad") & F.col("is_target") & (score >= R.TIER1_NEW_GRAD), 1).when(score >= R.TIER2, 2).otherwise(3)
    )


def model_candidates(scored: DataFrame, cache: DataFrame) -> DataFrame:
    """without disqualifier, not cached, at or above the floor."""
    return scored.where((F.size("disqualifiers") == 0) & (F.col("heuristic_score") >= R.MODEL_FLOOR)).join(cache.select(F.col("posting_id").alias("id")), "id", "left_anti")


def build_prompts(candidates: DataFrame, template: str, resume: str, targets: str) -> DataFrame:
    """(id, prompt) for an offline scorer; bodies are cut at 2,500 characters."""
    block = F.concat_ws("\n", F.concat(F.lit("Company: "), "company"), F.concat(F.lit("Title: "), "title"), F.concat(F.lit("Location: "), "location"), F.substr(F.coalesce("description", F.lit("")), F.lit(1), F.lit(2500)))
    prompt = F.lit(template)
    for name, value in (("{resume}", F.lit(resume)), ("{targets}", F.lit(targets)), ("{posting}", block), ("{heuristic}", F.col("heuristic_trace"))):
        prompt = F.replace(prompt, F.lit(name), value)
    return candidates.select("id", prompt.alias("prompt"))


def parse_reply(reply: Column) -> Column:
    """struct(score, rationale) of a model's answer, or null: the JSON between the outer braces, with a numeric score."""
    parsed = F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), "score string, rationale string, concerns array<string>", {"mode": "PERMISSIVE"})
    score = parsed["score"].try_cast("double")
    concerns = F.array_join(F.slice(F.coalesce(parsed["concerns"], F.array().cast("array<string>")), 1, 2), "; ")
    text = F.concat(F.coalesce(parsed["rationale"], F.lit("")), F.when(concerns != "", F.concat(F.lit(" ("), concerns, F.lit(")"))).otherwise(""))
    return F.when(score.isNotNull(), F.struct(F.greatest(F.lit(0), F.least(F.lit(100), score.cast("int"))).alias("score"), F.substr(F.trim(text), F.lit(1), F.lit(300)).alias("rationale")))


def score_postings(scored: DataFrame, cache: DataFrame, replies: DataFrame, model_configured: bool) -> DataFrame:
    """Add score, tier, score_rationale, tier_source. cache(posting_id, score, rationale); replies(id, reply)."""
    rows = scored.join(cache.select(F.col("posting_id").alias("id"), F.col("score").alias("c_score"), F.col("rationale").alias("c_why")), "id", "left")
    rows = rows.join(replies.select("id", parse_reply(F.col("reply")).alias("r")), "id", "left")
    barred, cached = F.size("disqualifiers") > 0, F.col("c_score").isNotNull()
    below = F.col("heuristic_score") < R.MODEL_FLOOR
    plain = below | F.lit(not model_configured)
    rows = rows.withColumn("tier_source", F.when(barred, "disqualified").when(cached, "cached").when(plain, "heuristic").when(F.col("r").isNotNull(), "llm").otherwise("heuristic-fallback"))
    source = F.col("tier_source")
    rows = rows.withColumn("score", F.when(source == "disqualified", 0).when(source == "cached", F.col("c_score")).when(source == "llm", F.col("r.score")).otherwise(F.col("heuristic_score")))
    note = F.lit(" (below LLM floor)") if model_configured else F.lit("")
    why = (
        F.when(source == "disqualified", F.concat(F.lit("disqualified: "), F.array_join("disqualifiers", ", "))).when(source == "cached", F.col("c_why"))
        .when(source == "llm", F.col("r.rationale")).when(source == "heuristic", F.concat("heuristic_trace", note)).otherwise(F.concat("heuristic_trace", F.lit(" [scorer unavailable]")))
    )
    return rows.withColumn("score_rationale", why).withColumn("tier", assign_tier(F.col("score"))).drop("c_score", "c_why", "r")


def cache_scores(cache: DataFrame, scored: DataFrame, model: str, now: Column) -> DataFrame:
    """J10, second half: only a model's own scores are cached, the first one stays."""
    fresh = scored.where("tier_source = 'llm'").select(F.col("id").alias("posting_id"), "score", F.col("score_rationale").alias("rationale"), "tier_source", now.alias("scored_at"), F.lit(model).alias("model"))
    return cache.unionByName(fresh.join(cache.select("posting_id"), "posting_id", "left_anti").select(*cache.columns))


def scorer_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("tier_source").agg(F.count("*").alias("n"))


def signal_attribution(scored: DataFrame) -> DataFrame:
    """Of tier-1 postings, how often each signal occurs, its share, and its mean points."""
    top = scored.where("tier = 1")
    total = top.agg(F.count("*").alias("total"))
    return (
        top.select(F.explode("signals").alias("s")).groupBy(F.col("s.signal").alias("signal")).agg(F.count("*").alias("n"), F.avg("s.points").alias("mean_points"))
        .crossJoin(F.broadcast(total)).select("signal", "n", (F.col("n") / F.col("total")).alias("share"), "mean_points")
    )
