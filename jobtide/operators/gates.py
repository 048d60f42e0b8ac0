"""Rule gates: level, field and eligibility, as columns added to raw postings."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import text as T


def title_level(title: Column) -> Column:
    """F1 and F2, first half: the reason that a canonical title gives, or null where the body decides."""
    has = lambda phrases: title.rlike(T.words_pattern(phrases))
    early, engineering = has(R.EARLY), has(R.ENGINEERING)
    rest = F.regexp_replace(title, T.words_pattern(R.ALLOWED_TITLES), " ")
    return (
        F.when(title == "", "empty-title")
        .when(has(R.NON_ENGINEERING) & ~(early & engineering), "non-engineering-function")
        .when(early, "early-career")
        .when(has(R.ALLOWED_TITLES), F.when(rest.rlike(T.words_pattern(R.PLAINLY_SENIOR)), "senior-level").otherwise("allowlist-title"))
        .when(has(R.SENIOR), "senior-level")
        .when(~engineering, "not-engineering")
    )


def body_level(body: Column, strict: Column) -> Column:
    """F1 and F2, second half: the reason of an engineering title without a level; ``strict`` marks board sources."""
    early_body = reduce(lambda a, b: a | b, [F.lower(body).contains(p) for p in R.EARLY_BODY])
    return (
        F.when(T.min_years(body) >= R.MAX_YEARS, "experience-required")
        .when(~strict, "engineering-unleveled")
        .when(F.coalesce(early_body, F.lit(False)), "early-career-body")
        .otherwise("unleveled-no-early-signal")
    )


KEPT_BY_LEVEL = ["early-career", "allowlist-title", "engineering-unleveled", "early-career-body"]


def field_reason(title: Column, head: Column) -> Column:
    """the reason of the field gate; both texts are canonical."""
    technical = T.words_pattern(R.TECHNICAL)
    out = F.when(title == "", "discipline-empty-title").when(title.rlike(T.words_pattern(R.AUDIENCE)), "discipline-audience-facing")
    out = out.when(head.rlike(technical), "discipline-technical")
    for text in (head, title):
        for group, phrases in R.NON_TECHNICAL.items():
            out = out.when(text.rlike(T.words_pattern(phrases)), f"discipline-{group}")
        if text is head:
            out = out.when(title.rlike(technical), "discipline-technical")
    return out.when(title.rlike(T.words_pattern(R.WEAK)), "discipline-weak-signal").otherwise("discipline-not-technical")


KEPT_BY_FIELD = ["discipline-technical", "discipline-weak-signal"]


def with_gates(raw: DataFrame) -> DataFrame:
    """raw(title, description, source, ...) with level_reason, field_reason (null if the level gate rejects), keep and reason.

    The title rules run once per distinct title; body rules need the row itself and run where the title leaves the reason open.
    """
    titles = raw.select("title").distinct()
    titles = titles.withColumn("title_basic", T.basic_text("title")).withColumn("_head", T.basic_text(T.role_head("title")))
    titles = titles.withColumn("_head", F.when(F.col("_head") == "", F.col("title_basic")).otherwise(F.col("_head")))
    titles = titles.select(F.col("title").alias("_title"), title_level(F.col("title_basic")).alias("_level"), field_reason(F.col("title_basic"), F.col("_head")).alias("_field"))
    rows = raw.join(titles, F.expr("title <=> _title"), "left").drop("_title")
    rows = rows.withColumn("level_reason", F.coalesce("_level", body_level(F.coalesce("description", F.lit("")), F.col("source") == "ats")))
    passed = F.col("level_reason").isin(KEPT_BY_LEVEL)
    rows = rows.withColumn("field_reason", F.when(passed, F.col("_field"))).drop("_field", "_level")
    rows = rows.withColumn("keep", passed & F.col("field_reason").isin(KEPT_BY_FIELD))
    return rows.withColumn("reason", F.when(passed, F.col("field_reason")).otherwise(F.col("level_reason")))


def gate_reason_counts(gated: DataFrame) -> DataFrame:
    """A1: (gate, source, reason, n): each gate over every row it saw."""
    level = gated.groupBy("source", F.col("level_reason").alias("reason")).agg(F.count("*").alias("n")).withColumn("gate", F.lit("level"))
    of_field = gated.where("field_reason is not null").groupBy("source", F.col("field_reason").alias("reason")).agg(F.count("*").alias("n"))
    return level.unionByName(of_field.withColumn("gate", F.lit("field"))).select("gate", "source", "reason", "n")


@dataclass(frozen=True)
class Profile:
    """The candidate's facts; work-authorization rules rest while it is not configured."""

    needs_sponsorship: bool = False
    us_person: bool = False
    holds_clearance: bool = False
    wanted_terms: dict[str, bool] = field(default_factory=dict)
    configured: bool = False


def clearance(text: Column) -> tuple[Column, Column]:
    """(must hold one, may obtain one), each mention read within its surroundings.

    Surroundings may overlap. The text is cut at the mentions, long pieces between them
    are cut to what can surround one, and each mention is joined with the pieces and
    mentions before and after it that ``CONTEXT_CHARS`` characters can reach, so the work
    is linear in the text and in the mentions.
    """
    flags, near = "(?iU)", R.CONTEXT_CHARS
    mention = flags + R.CLEARANCE
    reach = 2 * (near // (R.SHORTEST_MENTION + 1) + 1)  # pieces and mentions; between two mentions is a character at least
    nearest = lambda p: F.when(F.length(p) > 2 * near, F.concat(F.left(p, F.lit(near)), F.right(p, F.lit(near)))).otherwise(p)
    pieces, hits = F.transform(F.split(text, mention), nearest), F.regexp_extract_all(text, F.lit(mention), F.lit(0))
    # piece, mention, piece, mention, ..., piece
    chain = F.flatten(F.transform(F.arrays_zip(pieces.alias("p"), hits.alias("h")), lambda x: F.array(x["p"], F.coalesce(x["h"], F.lit("")))))

    def window(chain: Column, i: Column) -> Column:
        at = 2 * i + 2  # the mention's place, from 1
        first = F.greatest(at - reach, F.lit(1))
        before = F.right(F.array_join(F.slice(chain, first, at - first), ""), F.lit(near))
        return F.concat(before, F.element_at(chain, at), F.left(F.array_join(F.slice(chain, at + 1, F.lit(reach)), ""), F.lit(near)))

    windows = T.let(chain, lambda c: F.transform(F.sequence(F.lit(0), (F.size(c) / 2).cast("int") - 2), lambda i: window(c, i)))
    found = F.when(text.rlike(mention), windows).otherwise(F.array().cast("array<string>"))
    # one pass over the windows: 2 where one may be obtained, 1 where one is held
    judged = F.transform(found, lambda w: F.when(w.rlike(flags + R.OBTAINABLE), 2).when(w.rlike(flags + R.ALREADY_HELD), 1).otherwise(0))
    verdict = F.coalesce(F.array_max(judged), F.lit(0))
    return verdict == 1, verdict == 2


def disqualifiers(df: DataFrame, profile: Profile) -> DataFrame:
    """add ``disqualifiers`` to df(title, description, sponsorship, degrees, term, ...)."""
    df = df.withColumn("_text", F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("description", F.lit(""))))
    text, degrees = F.col("_text"), F.coalesce("degrees", F.array().cast("array<string>"))
    says = lambda pattern: text.rlike("(?iU)" + pattern)
    must, _ = clearance(text)
    sponsorship = F.trim(F.coalesce("sponsorship", F.lit("")))
    listed = F.size(degrees) > 0
    by_degree = F.when(
        listed,
        F.when(F.array_distinct(degrees) == F.array(F.lit("PhD")), "phd-required").when(
            ~F.array_contains(degrees, "Bachelor's") & ~F.array_contains(degrees, "Associate's"), "masters-required"
        ),
    ).otherwise(F.when(says(R.PHD), "phd-required").when(says(R.MASTERS) & ~says(R.BACHELORS), "masters-required"))
    unwanted = [t for t, w in profile.wanted_terms.items() if not w]
    found = [
        F.when(must, "clearance") if not profile.holds_clearance else None,
        F.when(says(R.US_PERSON) | (sponsorship == "U.S. Citizenship is Required"), "citizenship") if profile.configured and not profile.us_person else None,
        F.when(says(R.NO_SPONSORSHIP) | (sponsorship == "Does Not Offer Sponsorship"), "no-sponsorship") if profile.configured and profile.needs_sponsorship else None,
        by_degree,
        F.when(F.col("term").isin(unwanted), F.when(F.col("term") == "summer-2027", "summer-only").otherwise("grad-date-mismatch")) if unwanted else None,
    ]
    return df.withColumn("disqualifiers", F.array_compact(F.array(*[f for f in found if f is not None]))).drop("_text")
