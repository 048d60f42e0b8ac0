"""Readers on small landed files, round trips of the sinks, and the streams."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from jobtide.operators import health as H
from jobtide.operators import reports as R
from jobtide.operators import state as S
from jobtide.schemas import POSTING
from jobtide.sources import feeds as S1
from jobtide.sources import tables as S2
from jobtide.streaming import streams as X
from jobtide.streaming.snapshots import Chain

T0 = datetime(2026, 7, 1)


def test_listings(spark, tmp_path):
    records = [
        {"id": "1", "company_name": "A", "title": "Eng", "active": True, "is_visible": True, "category": "Software", "locations": ["NYC", "SF"], "url": "u", "date_posted": 1700000000, "degrees": ["PhD"]},
        {"id": "2", "active": False, "title": "x"}, {"id": "3", "active": True, "category": "Hardware", "title": "x"}, {"id": "4", "active": True, "is_visible": False, "title": "x"},
        {"id": "5", "active": True, "title": "No category", "company_name": "B", "url": "v"},
    ]
    (tmp_path / "l.json").write_text(json.dumps(records))
    rows = {r.source_id: r for r in S1.read_listings(spark, str(tmp_path / "l.json")).collect()}
    assert set(rows) == {"1", "5"} and rows["1"].location == "NYC" and rows["1"].term_default == "new-grad" and rows["5"].posted_precision == "unknown"
    quality = S1.listings_quality(spark, str(tmp_path / "l.json")).first()
    assert (quality.records, quality.inactive, quality.off_category, quality.kept, quality.warning) == (5, 2, 1, 2, None)


def test_boards(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"jobs": [{"id": 7, "title": "Eng", "absolute_url": "u", "location": {"name": "NYC"}, "first_published": "2026-07-01T10:00:00-04:00", "content": "&lt;p&gt;A &amp;amp; B&lt;/p&gt;&lt;br/&gt;C"}, {"id": 8, "title": "", "absolute_url": "u"}]}))
    a = S1.read_board_a(spark, str(tmp_path / "a.json"), "Acme").collect()
    assert [(r.company, r.source_id, r.description, r.posted_at, r.posted_precision) for r in a] == [("Acme", "7", "A & B\nC", datetime(2026, 7, 1, 14), "instant")]
    (tmp_path / "b.json").write_text(json.dumps([{"id": "x", "text": "Eng", "hostedUrl": "", "applyUrl": "u", "createdAt": 1700000000000, "workplaceType": "remote", "categories": {"location": "SF"}}, {"text": "no link"}, {"id": "", "text": "T", "hostedUrl": "h", "workplaceType": ""}]))
    b = {r.title: r for r in S1.read_board_b(spark, str(tmp_path / "b.json"), "Acme").collect()}
    assert set(b) == {"Eng", "T"} and b["Eng"].remote_hint is True and b["T"].remote_hint is None and b["T"].source_id is None
    (tmp_path / "c.json").write_text(json.dumps({"jobs": [{"id": "1", "title": "E", "jobUrl": "u", "isListed": False}, {"id": "2", "title": "F", "jobUrl": "u", "isRemote": True, "descriptionHtml": "<b>x</b>"}]}))
    c = S1.read_board_c(spark, str(tmp_path / "c.json"), "Acme").collect()
    assert [(r.title, r.remote_hint, r.description) for r in c] == [("F", True, "x")]


def test_pipe_tables(spark, tmp_path):
    text = """# t
| Company | Position | Location | Salary | Posting | Age |
| --- | --- | --- | --- | --- | --- |
| <a href="c"><strong>A &amp; B</strong></a> | Eng | NYC +10 | $1 | <a href="https://x/1">go</a> | 3d |
| C | | NYC | $1 | <a href="https://x/2">go</a> | 3d |
| short | row |

| Company | Position | Location | Posting | Age |
|---|---|---|---|---|
| D | Dev | | <a href="https://x/3">go</a> | soon |
| E | Dev | SF | none | 1d |
| Other | table | without | header |

| Name | Value |
|---|---|
| a | b |
"""
    (tmp_path / "NEW_GRAD_USA.md").write_text(text)
    now = F.lit(str(T0)).cast("timestamp")
    got = {r.company: r for r in S1.read_pipe_tables(spark, str(tmp_path), "swe", now).collect()}
    assert set(got) == {"A & B", "D"} and got["A & B"].location == "NYC" and got["A & B"].posted_at == T0 - timedelta(days=3)
    assert got["D"].posted_at is None and got["D"].term_default == "new-grad" and got["A & B"].posted_precision == "age_derived"


def test_roster_and_union(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"companies": [{"name": "Acme, Inc.", "ats": "x", "token": "a", "target": True, "tags": ["t"], "verified": True}, {"name": "B", "target": False}]}))
    roster = S1.load_roster(spark, str(tmp_path / "r.json"))
    assert [r.company_norm for r in S1.target_companies(roster).collect()] == ["acme"]
    one = S1._raw(spark.range(2).withColumnRenamed("id", "seq"), "ats", title=F.lit("x"))
    both = S1.union_sources({"ats": one, "listings": one})
    assert [r.source_order for r in both.orderBy("source_order").collect()] == [0, 0, 3, 3] and S1.union_sources({"ats": one, "listings": one}, ["ats"]).count() == 2


def test_union_has_the_boards_of_all_kinds(spark):
    """Before, the boards were those of one kind, whose unlisted rows no other feed brought."""
    from jobtide.plans import bindings as B
    from jobtide.plans import landed as L

    sf = "/root/testdata/sf0.001"
    got = {r.source: (r.n, r.places) for r in L.QUERIES["s13_u01_union_sources"](spark, sf).collect()}
    linked = B.raw_postings(spark, sf).where("title <> '' and apply_url <> ''")
    n = 3 * linked.count() - linked.where("seq % 8 = 0").count()
    assert got["ats"] == (n, n)


def posting_rows(spark, n=5):
    names = [c.split()[0] for c in POSTING.split(", ")]
    base = {"company": "Ünï", "title": 't"\\', "term": "unknown", "source": "ats", "remote": True, "posted_precision": "instant", "disqualifiers": ["a"], "link_status": "ok", "tier_source": "llm", "score": 3, "tier": 1, "first_seen_at": T0, "last_seen_at": T0, "posted_at": T0, "status": "new"}
    return spark.createDataFrame([tuple({**base, "id": f"{i:02}"}.get(c) for c in names) for i in range(n)], POSTING)


def test_export_round_trip(spark, tmp_path):
    rows, path = posting_rows(spark), str(tmp_path / "a")
    assert S2.export_postings(rows, path, 1) == ["0"] and not S2.export_postings(rows.repartition(3), path, 1)
    back = S2.restore_postings(spark, path)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    (tmp_path / "old").write_text('{"id": "zz", "source": "swe", "posted_at": "2026-07-01T00:00:00.000Z"}\n{"id": "00"}\n')
    old = {r.id: r for r in S2.restore_postings(spark, str(tmp_path / "old"), rows).collect()}
    assert len(old) == 6 and (old["zz"].posted_precision, old["zz"].link_status, old["zz"].tier_source, old["zz"].disqualifiers) == ("age_derived", "unchecked", "heuristic", [])


def test_export_writes_changed_parts_only(spark, tmp_path):
    rows, path = posting_rows(spark, 40), str(tmp_path / "e")
    assert S2.export_postings(rows, path, 1) == ["0", "1", "2", "3"]
    held = {f: f.stat().st_mtime_ns for f in (tmp_path / "e").rglob("part-*")}
    later = rows.withColumn("score", F.when(F.col("id") == "17", 9).otherwise(F.col("score"))).where("id < '30'")
    assert {r.part: r.change for r in S2.changed_parts(later, path, 1).collect()} == {"1": "changed", "3": "gone"}
    assert S2.export_postings(later, path, 1) == ["1", "3"] and not S2.export_postings(later, path, 1)
    same = [f for f in held if "part=0" in str(f) or "part=2" in str(f)]
    assert same and all(f.exists() and f.stat().st_mtime_ns == held[f] for f in same) and not (tmp_path / "e" / "part=3").exists()
    assert S2.restore_postings(spark, path).where("score = 9").count() == 1
    assert S2.changed_parts(rows.limit(0), str(tmp_path / "none"), 1).count() == 0


def test_partitions_are_pruned_with_their_files(spark, tmp_path):
    for i in range(4):
        raw = spark.createDataFrame([("ats", f"d{i}")], "source string, description string")
        S2.archive_raw(raw, str(tmp_path / "raw"), f"r{i}", F.lit(str(T0 + timedelta(hours=i))).cast("timestamp"))
        S2.append_audit(spark.createDataFrame([(T0 + timedelta(days=i), i)], "at timestamp, n int"), str(tmp_path / "audit"))
    assert S2.prune_raw(spark, str(tmp_path / "raw"), 2) == ["r0", "r1"] and S2.prune_raw(spark, str(tmp_path / "raw"), 2) == []
    assert sorted(f.name for f in (tmp_path / "raw").glob("run_id=*")) == ["run_id=r2", "run_id=r3"] and S2.replay_raw(spark, str(tmp_path / "raw"), "r2").count() == 1
    assert S2.prune_audit(spark, str(tmp_path / "audit"), "2026-07-04", 1) == ["2026-07-01", "2026-07-02"]
    assert sorted(f.name for f in (tmp_path / "audit").glob("day=*")) == ["day=2026-07-03", "day=2026-07-04"]


def test_ids_are_rewritten_in_all_tables_or_none(spark, tmp_path):
    mapping = spark.createDataFrame([("a", "x", False), ("b", "y", False)], "old string, new string, collides boolean")
    tables = {"postings": (spark.createDataFrame([("a", 1), ("c", 2)], "id string, n int"), "id"), "ledger": (spark.createDataFrame([("b",), ("b",)], "posting_id string"), "posting_id")}
    clash = mapping.withColumn("collides", F.lit(True))
    assert not S2.rewrite_tables(tables, clash, str(tmp_path), "v2") and not (tmp_path / "v2").exists()
    assert S2.rewrite_tables(tables, mapping, str(tmp_path), "v2")
    assert sorted(map(tuple, S2.read_version(spark, str(tmp_path), "v2", "postings").collect())) == [("c", 2), ("x", 1)]
    assert [r.posting_id for r in S2.read_version(spark, str(tmp_path), "v2", "ledger").collect()] == ["y", "y"]
    (tmp_path / "v2" / "_COMMITTED").unlink()
    with pytest.raises(FileNotFoundError):
        S2.read_version(spark, str(tmp_path), "v2", "ledger")


def test_places_do_not_depend_on_the_layout(spark, tmp_path):
    """The order of the feeds, and what the merges decide by it, for other partition counts and with adaptive execution on and off."""
    titles = ["Software Engineer Intern", "SWE Co-op", "Platform Engineer, New Grad"]
    for n in range(7):
        jobs = [{"id": str(100 * n + i), "title": titles[(n + i) % 3], "jobUrl": f"https://x/{n}-{i}", "location": "Austin, TX", "publishedAt": f"2026-0{1 + (n + i) % 7}-01T00:00:00Z"} for i in range(20)]
        (tmp_path / f"board {n}.json").write_text(json.dumps({"jobs": jobs}))
        records = [{"id": str(i), "company_name": "Acme", "title": titles[i % 3], "active": True, "url": f"https://y/{n}-{i}", "locations": ["Austin, TX"], "date_posted": 1780000000 + 86400 * ((n * i) % 50)} for i in range(15)]
        (tmp_path / f"list{n}.json").write_text(json.dumps(records))
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")
    before, found = [spark.conf.get(n) for n in names], []
    now, cut = F.lit(str(T0)).cast("timestamp"), F.lit("2026-04-15").cast("timestamp")
    try:
        for setting in (("1", "true"), ("4", "false"), ("32", "true")):
            for name, value in zip(names, setting, strict=True):
                spark.conf.set(name, value)
            board = S1.read_board_c(spark, str(tmp_path / "board *.json"), "Acme")
            rows = S1.union_sources({"ats": [board, board], "listings": S1.read_listings(spark, str(tmp_path / "list*.json"))})
            batch = S.normalize_postings(rows, now)
            merged = S.upsert(S.empty(spark, POSTING), batch).select("id", "apply_url", "source", "source_id", "posted_at", "url_upgrades")
            flags = S.cutover_flags(batch, batch.select("id"), cut).select("source_order", "seq", "accepted")
            firsts = S.first_raw_by_id(batch, ["apply_url", "seq"])
            found.append([sorted(map(tuple, df.collect()), key=str) for df in (rows.select("source_order", "seq", "apply_url"), merged, flags, firsts)])
    finally:
        for name, value in zip(names, before, strict=True):
            spark.conf.set(name, value)
    assert found[0] == found[1] == found[2]
    order = [r[2] for r in sorted(found[0][0])]
    assert order[:105] == [f"https://y/{n}-{i}" for n in range(7) for i in range(15)] and order[105:245] == [f"https://x/{n}-{i}" for n in range(7) for i in range(20)]


def test_small_sinks(spark, tmp_path):
    ids = spark.createDataFrame([("b",), ("a",), ("b",)], "id string")
    S2.write_baseline(ids, str(tmp_path / "base"))
    assert sorted(r.id for r in S2.read_baseline(spark, str(tmp_path / "base")).collect()) == ["a", "b"]
    raw = spark.createDataFrame([("ats", "d" * 3000)], "source string, description string")
    for run in ("r1", "r2", "r2"):
        S2.archive_raw(raw, str(tmp_path / "raw"), run, F.lit(str(T0)).cast("timestamp"))
    assert [len(r.description) for r in S2.replay_raw(spark, str(tmp_path / "raw"), "r2").collect()] == [2000]
    S2.write_review(posting_rows(spark), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == S2.REVIEW
    S2.write_snapshot(posting_rows(spark), str(tmp_path / "state"), "1", 2)
    assert S2.read_snapshot(spark, str(tmp_path / "state"), "1", POSTING).count() == 5
    record = R.audit_record(spark.createDataFrame([("1", "c", "t", "senior-level")], "id string, company string, title string, filter_reason string"), spark.createDataFrame([("b", "t", 2), ("b", "u", 1)], "baseline_id string, title string, times_seen long"), "r1", F.lit(str(T0)).cast("timestamp"))
    S2.append_audit(record, str(tmp_path / "audit"))
    kept = S2.read_audit(spark, str(tmp_path / "audit"), "2026-07-20").first()
    assert kept.exclusions.total == 1 and kept.suppressions.worst_collapse[0].n_titles == 2 and S2.read_audit(spark, str(tmp_path / "audit"), "2026-09-20").count() == 0


def test_health_rules(spark):
    rows = [("s", T0 + timedelta(hours=i), 100, None, False, 100, 10) for i in range(5)]
    rows += [("s", T0 + timedelta(hours=6), 40, None, False, 100, 90), ("s", T0 + timedelta(hours=7), 0, None, True, 0, 0), *[("s", T0 + timedelta(days=d), 0, None, True, 0, 0) for d in (7.5, 9, 30)]]
    rows += [("b", T0 + timedelta(hours=i), 100, None, False, 0, None) for i in range(3)] + [("b", T0 + timedelta(hours=4), 1, 9, False, 0, None)]
    df = spark.createDataFrame(rows, "source string, started_at timestamp, raw_fetched long, responding long, not_modified boolean, dated long, midnight long")
    got = {(r.source, r.started_at): r for r in H.source_health(df).collect()}
    assert got["s", T0 + timedelta(hours=6)].volume_drop and got["s", T0 + timedelta(hours=6)].precision_drift and "40% of trailing median 100" in got["s", T0 + timedelta(hours=6)].message
    assert got["s", T0 + timedelta(hours=7)].ok and got["s", T0 + timedelta(days=7.5)].stale_304 and got["b", T0 + timedelta(hours=4)].ok


    # data older than eight days is no history: a feed that was silent for longer is not flagged again
    assert all(got["s", T0 + timedelta(days=d)].ok and got["s", T0 + timedelta(days=d)].last_data_at is None for d in (9, 30))


def test_stable_sample(spark):
    df = spark.createDataFrame([(str(i),) for i in range(100)], "id string")
    first = [r.id for r in R.stable_sample(df, 10).collect()]
    assert first == [r.id for r in R.stable_sample(df.repartition(7), 10).collect()] and first != [r.id for r in R.stable_sample(df.limit(99), 10).collect()]


def collected(stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name).collect()


def landed(spark, path, rows, schema):
    """Rows, a file each, in the order in which they land."""
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(path), mode="append")


def test_first_seen_for_ever_and_within(spark, tmp_path):
    schema = "id string, seen_at timestamp"
    landed(spark, tmp_path / "in", [[("a", T0 + timedelta(days=i)), (f"n{i}", T0 + timedelta(days=i))] for i in range(5)], schema)
    stream = X.landing(spark, str(tmp_path / "in"), schema, 1)
    assert sorted(r.id for r in collected(X.stream_first_seen(stream), "first_seen")) == ["a", "n0", "n1", "n2", "n3", "n4"]
    within = [r.id for r in collected(X.stream_first_seen_within(stream, "1 hour"), "seen_within")]
    assert within.count("a") > 1


def test_snapshot_chain_over_five_batches(spark, tmp_path):
    schema = "id string, n long"
    landed(spark, tmp_path / "in", [[("a", 1), (f"n{i}", i)] for i in range(5)], schema)
    chain = Chain(str(tmp_path / "state"), schema, keep=2, partitions=2)
    merge = lambda state, batch: state.unionByName(batch).groupBy("id").agg(F.sum("n").alias("n"))
    X.stream_ingest(X.landing(spark, str(tmp_path / "in"), schema, 1), chain, merge, str(tmp_path / "cp")).awaitTermination(120)
    assert {r.id: r.n for r in chain.read(spark).collect()} == {"a": 5} | {f"n{i}": i for i in range(5)}
    assert list(chain.commits(spark)) == [3, 4] and {r.id: r.n for r in chain.read(spark, 4).collect()}["a"] == 4
    assert len(list((tmp_path / "state" / "data").iterdir())) == 2


def test_merge_that_dies_before_its_commit_is_replayed(spark, tmp_path):
    schema = "id string, n long"
    landed(spark, tmp_path / "in", [[("a", 1)], [("a", 10)], [("a", 100)]], schema)
    merge = lambda state, batch: state.unionByName(batch).groupBy("id").agg(F.sum("n").alias("n"))

    class Dying(Chain):
        deaths = {1: "before the commit", 2: "after the commit"}

        def commit(self, spark, batch, folder):
            if self.deaths.get(batch) == "before the commit":
                del self.deaths[batch]
                raise RuntimeError("killed between write and commit")
            super().commit(spark, batch, folder)
            if self.deaths.pop(batch, None):
                raise RuntimeError("killed after the commit")

    chain = Dying(str(tmp_path / "state"), schema, keep=1, partitions=1)
    start = lambda: X.stream_ingest(X.landing(spark, str(tmp_path / "in"), schema, 1), chain, merge, str(tmp_path / "cp"))
    with pytest.raises(Exception, match="killed between"):
        start().awaitTermination(120)
    assert [tuple(r) for r in chain.read(spark).collect()] == [("a", 1)] and len(list((tmp_path / "state" / "data").iterdir())) == 2
    with pytest.raises(Exception, match="killed after"):
        start().awaitTermination(120)
    start().awaitTermination(120)
    assert [tuple(r) for r in chain.read(spark).collect()] == [("a", 111)] and len(list((tmp_path / "state" / "data").iterdir())) == 1
    other = chain.write(chain.read(spark), 2)
    assert not chain.commit(spark, 2, other) and chain.clean(spark) == [other]


def test_rate_cap_over_batches(spark, tmp_path):
    schema = "channel string, id string, ts timestamp, score int"
    pushes = [("c", f"p{i}", T0 + timedelta(minutes=10 * i), 50) for i in range(9)]
    landed(spark, tmp_path / "p", [pushes[:2], pushes[2:5], pushes[5:], [("d", "q", T0, 1)]], schema)
    chain = Chain(str(tmp_path / "sent"), X.SENT, partitions=1, key="channel")
    X.stream_rate_cap(X.landing(spark, str(tmp_path / "p"), schema, 1), chain, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = X.read_decisions(spark, str(tmp_path / "out")).collect()
    assert sorted(r.id for r in got if r.decision == "interrupt") == ["p0", "p1", "p2", "p6", "p7", "p8", "q"] and len(got) == 10


def test_silent_ids_expire_by_healthy_runs(spark, tmp_path):
    """Heartbeats go to all ids of a source; an unhealthy source expires nothing; an id that comes back in time stays."""
    schema = "source string, run_at timestamp, healthy boolean, id string"
    at = lambda hours: T0 + timedelta(hours=hours)
    runs = [("s", at(h), h != 30, None) for h in range(0, 132, 6)] + [("u", at(h), h < 6, None) for h in range(0, 132, 6)]
    seen = [("s", at(0), True, "gone"), ("s", at(0), True, "back"), ("s", at(48), True, "back"), ("s", at(30), False, "gone"), ("u", at(0), True, "quiet"), *[("s", at(h), True, "live") for h in range(0, 132, 6)]]
    rows = sorted(runs + seen, key=lambda r: r[1])
    landed(spark, tmp_path / "e", [rows[20 * i : 20 * i + 20] for i in range(-(-len(rows) // 20))], schema)
    held = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", X.ROCKSDB)
    try:
        got = collected(X.stream_expiry(X.landing(spark, str(tmp_path / "e"), schema, 1), 2), "expired")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", held)
    # missed from the run at 6 h on, so 54 h is the first healthy run 48 h later; ``back`` was seen at 48 h and expires at 102 h
    assert sorted((r.id, r.expired_at) for r in got) == [("back", at(102)), ("gone", at(54))]


def test_state_helpers(spark):
    decisions = spark.createDataFrame([(1, "a", "Applied", None), (2, "a", "skipped", None), (3, "", "applied", None), (4, "b", "hm", None), (5, "c", " interviewing ", None)], "row_no long, id string, status string, applied_on date")
    assert {r.id: r.status for r in S.parse_decisions(decisions).collect()} == {"a": "skipped", "c": "applied"}
    numbered = S.numbered(spark.createDataFrame([(f"{i:03x}",) for i in range(300)], "id string"), "id")
    assert [r.n for r in numbered.orderBy("id").collect()] == list(range(1, 301))
