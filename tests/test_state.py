"""Keyed merges: preservation rules, idempotence, batch splits, cutover, sightings, suppressions."""

from __future__ import annotations

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from jobtide.operators import notify as N
from jobtide.operators import scoring as C
from jobtide.operators import state as S
from jobtide.operators import views as V
from jobtide.operators.gates import Profile, clearance, disqualifiers, with_gates
from jobtide.schemas import BASELINE, POSTING, RAW_POSTING, SUPPRESSION

T0 = datetime(2026, 7, 1)
def now():
    return F.lit("2026-07-10 20:00:00").cast("timestamp")

BATCH = (
    "id string, dedupe_key string, company string, title string, term string, location string, remote boolean, apply_url string, source_url string, source string, first_seen_at timestamp, "
    "last_seen_at timestamp, posted_at timestamp, posted_precision string, company_norm string, title_norm string, location_norm string, source_id string, source_order int, seq long"
)


def row(key, seq, source="listings", url="u1", posted=None, source_id=None, location="A", order=0):
    at = T0 + timedelta(hours=seq)
    return (key, key, "C", f"T{seq}", "unknown", location, False, url, url or None, source, at, at, posted, "unknown", "c", "t", "l", source_id, order, seq)


def merged(spark, *batches):
    state = S.empty(spark, POSTING)
    for rows in batches:
        state = S.upsert(state, spark.createDataFrame(rows, BATCH)).drop("is_new", "url_upgrades")
    return {r.id: r for r in state.collect()}


def test_upsert_keeps_and_refreshes(spark):
    got = merged(spark, [row("a", 1, posted=None, location="A")], [row("a", 2, url="u2", posted=T0, source_id="s", location="B")])["a"]
    assert (got.title, got.location, got.apply_url, got.posted_at, got.source_id, got.source_url, got.status) == ("T1", "B", "u2", T0, "s", "u1", "new")
    assert got.first_seen_at == T0 + timedelta(hours=1) and got.last_seen_at == T0 + timedelta(hours=2)
    again = merged(spark, [row("a", 1, posted=T0)], [row("a", 2, posted=T0 + timedelta(days=9))])["a"]
    assert again.posted_at == T0


@pytest.mark.parametrize(
    ("rows", "url", "source"),
    [
        ([("listings", "l"), ("ats", "a"), ("swe", "s")], "a", "ats"), ([("listings", "l"), ("swe", "s")], "l", "listings"), ([("listings", "l"), ("listings", "m")], "m", "listings"),
        ([("ats", ""), ("swe", "s")], "s", "swe"), ([("ats", "a"), ("ats", "")], "a", "ats"), ([("new", "n"), ("swe", "s"), ("new", "o")], "s", "swe"),
    ],
)
def test_links_by_precedence(spark, rows, url, source):
    batch = [row("a", i, source=s, url=u) for i, (s, u) in enumerate(rows)]
    assert (merged(spark, batch)["a"].apply_url, merged(spark, batch)["a"].source) == (url, source)
    split = merged(spark, *[[b] for b in batch])["a"]
    assert (split.apply_url, split.source) == (url, source)


def test_batch_split_invariance(spark):
    rows = [row(f"k{i % 7}", i, source=["ats", "listings", "swe"][i % 3], url=["", "x", "y", "z"][i % 4], posted=T0 if i % 5 == 0 else None, source_id=str(i) if i % 2 else None, location=str(i)) for i in range(60)]
    whole, parts = merged(spark, rows), merged(spark, rows[:20], rows[20:41], rows[41:])
    assert whole == parts


def test_upsert_repeats_are_quiet(spark):
    rows = [row("a", 1), row("b", 2)]
    state = S.upsert(S.empty(spark, POSTING), spark.createDataFrame(rows, BATCH))
    assert {r.id for r in state.where("is_new").collect()} == {"a", "b"}
    again = S.upsert(state.drop("is_new", "url_upgrades"), spark.createDataFrame(rows, BATCH))
    assert again.where("is_new or url_upgrades > 0").count() == 0


def folded(rows, start=None):
    """The link rule, row by row: (url, source, steps)."""
    rank = lambda s: {"ats": 100, "listings": 50, "swe": 50, "ai": 50}.get(s, 10)
    rows = sorted((order, seq, url, source) for url, source, order, seq in rows)
    url, source = start or rows.pop(0)[2:]
    steps = 0
    for _, _, u, s in rows:
        if not url or (u and (s == source or rank(s) > rank(source))):
            steps += bool(u) and u != url
            url, source = u, s
    return url, source, steps


def test_link_fold_equals_row_by_row(spark):
    draw = random.Random(7)
    rows = [row(f"k{draw.choice([0, 0, 0, draw.randrange(60)])}", seq, source=draw.choice(["ats", "listings", "swe", "ai", "x", "y"][draw.choice([0, 1, 4]) :]), url=draw.choice(["", "", "u", "v", "w"]), order=draw.randrange(2))
            for seq in draw.sample(range(40_000), 1500)]
    early, late = rows[:700], rows[700:]
    pick = lambda part, key: [(r[7], r[9], r[18], r[19]) for r in part if r[0] == key]
    state = S.upsert(S.empty(spark, POSTING), spark.createDataFrame(early, BATCH))
    first = {r.id: (r.apply_url, r.source, r.url_upgrades) for r in state.collect()}
    assert first == {k: folded(pick(early, k)) for k in {r[0] for r in early}}
    second = S.upsert(state.drop("is_new", "url_upgrades"), spark.createDataFrame(late, BATCH))
    got = {r.id: (r.apply_url, r.source, r.url_upgrades) for r in second.collect()}
    want = {k: folded(pick(late, k), first[k][:2] if k in first else None) if pick(late, k) else (*first[k][:2], 0) for k in {r[0] for r in rows}}
    assert got == want


def test_upsert_makes_no_array_of_rows(spark):
    batch = spark.createDataFrame([row("a", i, source=["ats", "swe"][i % 2], url=f"u{i}") for i in range(3000)], BATCH)
    plan = S.upsert(S.empty(spark, POSTING), batch)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"collect_(list|set)\([^)]*seq", plan)
    assert [len(r.n_sources) for r in S.fold_batch(batch).collect()] == [1]


def test_cutover_promotes_from_the_first_late_row_on(spark):
    old, new = T0, T0 + timedelta(days=30)
    batch = spark.createDataFrame([row("a", 1, posted=old), row("a", 2, posted=new), row("a", 3, posted=None), row("b", 4, posted=old), row("c", 5)], BATCH)
    base = spark.createDataFrame([("a", T0), ("b", T0)], BASELINE)
    accepted, suppressed, rest = S.apply_cutover(batch, base, F.lit(str(T0 + timedelta(days=1))).cast("timestamp"))
    assert sorted(r.seq for r in accepted.collect()) == [2, 3, 5] and sorted(r.seq for r in suppressed.collect()) == [1, 4]
    assert [r.id for r in rest.collect()] == ["b"]
    table = S.record_suppressions(S.empty(spark, SUPPRESSION), suppressed, now())
    twice = S.record_suppressions(table, suppressed, now())
    assert {r.baseline_id: r.times_seen for r in twice.collect()} == {"a": 2, "b": 2}


def test_sightings_expire_only_while_the_source_is_healthy(spark):
    postings = spark.createDataFrame([("a", "ats", "new"), ("b", "swe", "new"), ("c", "ats", "applied")], "id string, source string, status string")
    healthy = spark.createDataFrame([("ats",)], "source string")
    none = spark.createDataFrame([], "id string")
    sightings = S.mark_missed(S.empty(spark, "id string, last_seen_run string, missed_runs int, first_missed_at timestamp"), postings, healthy, none, F.lit(str(T0)).cast("timestamp"))
    assert [(r.id, r.missed_runs) for r in sightings.collect()] == [("a", 1)]
    late = F.lit(str(T0 + timedelta(hours=48))).cast("timestamp")
    assert {r.id: r.status for r in S.expire_stale(postings, sightings, late).collect()} == {"a": "expired", "b": "new", "c": "applied"}
    back = S.mark_seen(sightings, spark.createDataFrame([("a",)], "id string"), "r2")
    assert [(r.missed_runs, r.first_missed_at, r.last_seen_run) for r in back.collect()] == [(0, None, "r2")]


@pytest.mark.parametrize("mode", ["date", "score"])
def test_every_live_posting_has_a_place(spark, mode):
    rows = [(f"{i * 37 % 400:04x}", "new-grad" if i % 3 else "unknown", T0 + timedelta(days=i % 5), None, "unknown", None if i % 11 == 0 else 1 + i % 2, i % 4) for i in range(400)]
    df = spark.createDataFrame(rows, "id string, term string, first_seen_at timestamp, posted_at timestamp, posted_precision string, tier int, score int")
    out = V.rank_postings(df, mode)
    assert not re.search(r"windowspecdefinition\(term_rank", out._jdf.queryExecution().optimizedPlan().toString())
    day, tier = lambda r: -r[2].toordinal(), lambda r: r[5] or 0
    key = {"date": lambda r: (day(r), tier(r), -r[6]), "score": lambda r: (-r[6], day(r), tier(r))}[mode]
    best = sorted(sorted(rows, key=lambda r: r[0], reverse=True), key=key)
    want = {r[0]: place for term in ("new-grad", "unknown") for place, r in enumerate([r for r in best if r[1] == term], 1)}
    assert {r.id: r.place for r in out.collect()} == want


@pytest.mark.parametrize("kind", ["long", "string"])
def test_waves_of_a_hot_host_are_split(spark, kind):
    links = spark.range(0, 30_000, 100).select(F.col("id") if kind == "long" else F.lpad(F.hex("id"), 6, "0").alias("id"), F.lit("https://a.example.org/x").alias("url"))
    out = V.host_waves(links)
    assert not re.search(r"row_number\(\) windowspecdefinition\(host_key", out._jdf.queryExecution().optimizedPlan().toString())
    assert [r.wave for r in out.orderBy("id").collect()] == [i // 3 + 1 for i in range(300)]


def raw(spark, rows):
    base = {"source": "listings", "source_order": 0, "company": "C", "title": "Engineer", "location": "", "apply_url": "", "posted_precision": "unknown"}
    names = [c.split()[0] for c in RAW_POSTING.split(", ")]
    return spark.createDataFrame([tuple(({**base, "seq": i} | r).get(n) for n in names) for i, r in enumerate(rows)], RAW_POSTING)


def test_gates(spark):
    cases = [
        ({"title": ""}, "empty-title"), ({"title": "Sales Engineer"}, "non-engineering-function"), ({"title": "Senior Software Engineer"}, "senior-level"), ({"title": "Barista"}, "not-engineering"),
        ({"title": "Software Engineer"}, "discipline-technical"), ({"title": "Software Engineer", "source": "ats"}, "unleveled-no-early-signal"), ({"title": "Software Engineer", "source": "ats", "description": "recent graduate"}, "discipline-technical"),
        ({"title": "Software Engineer", "description": "5 years of experience"}, "experience-required"), ({"title": "Member of Technical Staff"}, "discipline-technical"), ({"title": "Legal Intern"}, "non-engineering-function"),
        ({"title": "Public Policy and AI Innovation Intern"}, "discipline-policy"), ({"title": "Machine Learning Engineer Graduate - Brand Ads"}, "discipline-technical"), ({"title": "Research Intern"}, "discipline-weak-signal"),
    ]
    got = {r.seq: r.reason for r in with_gates(raw(spark, [c for c, _ in cases])).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]


def test_eligibility(spark):
    cases = [
        ({"description": "Active security clearance required"}, ["clearance"]), ({"description": "must be able to obtain an active security clearance"}, []),
        ({"description": "clearance " + "x" * 200 + " active top secret " + "y" * 200 + " able to obtain polygraph"}, []), ({"description": "PhD required", "degrees": ["Bachelor's", "PhD"]}, []),
        ({"degrees": ["PhD"]}, ["phd-required"]), ({"description": "Master's degree required"}, ["masters-required"]), ({"description": "Bachelor's or Master's required"}, []), ({"description": "no visa sponsorship"}, ["no-sponsorship"]),
        ({"sponsorship": "U.S. Citizenship is Required"}, ["citizenship"]), ({"description": "You currently hold a top secret clearance"}, ["clearance"]),
    ]
    profile = Profile(needs_sponsorship=True, configured=True)
    got = {r.seq: r.disqualifiers for r in disqualifiers(raw(spark, [c for c, _ in cases]).withColumn("term", F.lit("unknown")), profile).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]
    must, may = clearance(F.lit("secret clearance; " + "z" * 300 + " holding public trust"))
    assert tuple(spark.range(1).select(must, may).first()) == (True, False)


def test_score_and_tier(spark):
    rows = [("a", "fall-2026", "machine learning engineer", "stripe", "sf-bay", True, T0), ("b", "new-grad", "software engineer", "stripe", "nyc", False, None), ("c", "unknown", "nurse", "x", "y", False, None)]
    df = spark.createDataFrame([(*r, "", []) for r in rows], "id string, term string, title_norm string, company_norm string, location_norm string, remote boolean, posted_at timestamp, title string, disqualifiers array<string>")
    targets = spark.createDataFrame([("stripe",)], "company_norm string")
    out = C.with_signals(C.with_target(df, targets), Profile(), F.lit(str(T0 + timedelta(days=3))).cast("timestamp"))
    got = {r.id: (r.heuristic_score, r.tier) for r in out.select("id", "heuristic_score", C.assign_tier(F.col("heuristic_score")).alias("tier")).collect()}
    assert got == {"a": (100, 1), "b": (70, 1), "c": (12, 3)}


@pytest.mark.parametrize(("sent", "hour", "want"), [(0, 20, 3), (2, 20, 1), (5, 20, 0), (0, 8, 0)])
def test_rate_cap(spark, sent, hour, want):
    rows = [(f"p{i}", 1, 90 - i, "new", [], i) for i in range(6)] + [("d", 1, 99, "new", ["clearance"], 9), ("n", 1, 99, "notified", [], 10), ("t", 2, 99, "new", [], 11)]
    df = spark.createDataFrame(rows, "id string, tier int, score int, status string, disqualifiers array<string>, seq long")
    one = lambda n: spark.createDataFrame([(n,)], "n long")
    out = N.decide_notifications(df, spark.createDataFrame([], "id string"), F.lit(f"2026-07-10 {hour:02}:00:00").cast("timestamp"), one(sent), one(0))
    got = {r.id: r.decision for r in out.collect()}
    assert sorted(k for k, v in got.items() if v == "interrupt") == [f"p{i}" for i in range(want)]
    assert sum(v == "silent" for v in got.values()) == (6 if hour == 8 else 0) and got["d"] == got["t"] == "digest" and got["n"] == "skip"


def test_clearance_windows_equal_a_loop_and_are_linear(spark):
    import random
    import re
    import time

    from jobtide import rules as R

    draw = random.Random(2)
    parts = ["clearance", "poly", "top secret", "active ", "able to obtain ", "holding ", "x" * 50, " ", ". ", "word ", "security clearance ", "y" * 150 + " ", "é " * 20, "y" * 400]
    rows = [(i, " ".join(draw.choice(parts) for _ in range(draw.randint(0, 25)))) for i in range(300)]
    mention, obtain, held = (re.compile(p, re.I) for p in (R.CLEARANCE, R.OBTAINABLE, R.ALREADY_HELD))

    def brute(text):
        windows = [text[max(0, m.start() - R.CONTEXT_CHARS) : m.end() + R.CONTEXT_CHARS] for m in mention.finditer(text)]
        may = any(obtain.search(w) for w in windows)
        return any(not obtain.search(w) and held.search(w) for w in windows) and not may, may

    must, may = clearance(F.col("t"))
    got = {r.i: (r.must, r.may) for r in spark.createDataFrame(rows, "i int, t string").select("i", must.alias("must"), may.alias("may")).collect()}
    assert [i for i, t in rows if got[i] != brute(t)] == []
    begin = time.time()
    many = spark.range(1).select(F.repeat(F.lit("secret clearance word "), 100_000).alias("t")).select(must.alias("must"), may.alias("may")).first()
    assert tuple(many) == (False, False) and time.time() - begin < 60
