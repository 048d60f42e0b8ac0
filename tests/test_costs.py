"""Costly steps run once, and what skips them changes no result."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from jobtide import rules as R
from jobtide.functions import text as T
from jobtide.operators import gates as G
from jobtide.operators import state as S
from jobtide.plans import bindings as B

SF = "/root/testdata/sf0.001"


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_gates_run_once_under_normalized_postings(spark):
    raw = B.raw_postings(spark, SF)
    gated = G.with_gates(raw).where("keep")
    once = S.normalize_postings(gated, B.stamp(B.NOW), strings=raw)
    filters = [line for line in optimized(once).splitlines() if "Filter" in line and "unleveled-no-early-signal" in line]
    assert len(filters) == 1
    assert once.exceptAll(S.normalize_postings(gated, B.stamp(B.NOW))).count() == 0 and once.count() == gated.count()


def test_title_rules_are_not_in_the_pass_over_the_rows(spark):
    """The level rules on titles stand below the aggregate of distinct titles' join, once for a title."""
    plan = optimized(G.with_gates(B.raw_postings(spark, SF)).select("level_reason"))
    above = plan.split("Join", 1)[0]
    assert "non-engineering-function" not in above and "experience-required" in above


def test_texts_without_a_sign_name_no_term(spark):
    texts = [f"{a}{m}{b}" for m in R.NEW_GRAD_MARKERS for a, b in (("", ""), ("A ", " role"))]
    texts += [m.replace(" ", "-").upper() for m in R.NEW_GRAD_MARKERS] + [f"x {s} 2027" for s in R.SEASONS] + [f"2027 {s.title()}" for s in R.SEASONS]
    texts += ["Class of 2027", "CLASS-OF '27", "Graduate Trader", "Sümmer 2027", "\U0001d400 \U0001d5e6ummer 2027", "Ｎｅｗ Ｇｒａｄ", "plain", "", None, "Engineer & co 2027"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.named_term("t").alias("got"), T.let(T.basic_text("t"), T._term_in).alias("want")).collect()
    assert [r.t for r in rows if r.got != r.want] == [] and sum(r.got is not None for r in rows) > 40


def test_years_in_any_case(spark):
    df = spark.createDataFrame([("5 YEARS of Experience",), ("2 Year EXPERIENCE",), ("4 yrs experience",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(T.min_years("x")).collect()] == [5, 2, None, None, None]


def test_remoteness_by_place(spark):
    places = [("Remote - US", None), ("Hybrid - Remote", None), ("Paris", True), ("Remote", False), (None, None), ("", None)]
    raw = B.raw_postings(spark, SF).limit(1).drop("location", "remote_hint").crossJoin(spark.createDataFrame(places, "location string, remote_hint boolean"))
    got = S.normalize_postings(raw, B.stamp(B.NOW)).select(F.col("location"), "remote")
    assert sorted(map(tuple, got.collect())) == sorted([("Remote - US", True), ("Hybrid - Remote", False), ("Paris", True), ("Remote", False), ("Unknown", False), ("Unknown", False)])


def test_folders_are_listed_by_few_tasks(spark, tmp_path):
    """Before, each folder of a feed was a task of its own."""
    from jobtide.sources import feeds

    spark.range(100).selectExpr("cast(id as string) as value", "id as chunk").repartition(1).write.partitionBy("chunk").text(f"{tmp_path}/in")
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before, sc = spark.conf.get(name), spark.sparkContext
    sc.setJobGroup("listing", "listing")
    try:
        found = feeds.whole_files(spark, f"{tmp_path}/in")
        jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup("listing")]
        tasks = sum(sc.statusTracker().getStageInfo(i).numTasks for j in jobs for i in j.stageIds)
    finally:
        sc._jsc.clearJobGroup()
    assert 0 < tasks <= feeds.LISTERS * sc.defaultParallelism < 100 and spark.conf.get(name) == before
    assert sorted((r.place, r.value.strip()) for r in found.collect()) == sorted(enumerate(sorted(map(str, range(100)), key=lambda c: f"chunk={c}/")))


def test_short_rows_of_tables_under_any_filter(spark):
    """A filter of the caller may run before the one on the number of cells."""
    from jobtide.sources import feeds

    text = "x\n| Company | Position | Posting |\n|---|---|---|\n| A | B | C |\n| only |\n|| D | E | F | more ||\n\n| G | H | I |\n"
    files = spark.createDataFrame([("f", 0, text), ("g", 1, text.replace("Company", "Firm"))], "file string, place long, value string")
    rows = feeds.pipe_tables(files).where("row['company'] <> ''").where("length(row['posting']) > 0")
    assert sorted((r.file, r.n, r.row["company"], r.row["posting"]) for r in rows.collect()) == [("f", 3, "A", "C"), ("f", 5, "D", "F")]


def test_expiry_reads_an_id_once_and_writes_changes_only():
    """Two round trips to the state an id at most; before, there were three, also where nothing changed."""
    import pandas as pd

    from jobtide.streaming.streams import Expiry

    class Held(dict):
        calls = 0

        def getValue(self, key):  # noqa: N802
            self.calls += 1
            return self.get(key)

        def updateValue(self, key, value):  # noqa: N802
            self.calls += 1
            self[key] = value

        def containsKey(self, key):  # noqa: N802
            self.calls += 1
            return key in self

    class Nothing:
        exists = staticmethod(lambda: False)

    expiry, oldest = Expiry(), []
    expiry.seen, expiry.runs, expiry.oldest = Held({("b",): ([5, 7],), ("gone",): ([],)}), Nothing(), Nothing()
    expiry._wait = lambda runs, first: oldest.append((runs, first))
    frame = pd.DataFrame({"id": ["a", "b", "a", "gone", None, "sick"], "at": [9, 7, 8, 9, 10, 11], "healthy": [True] * 5 + [False]})
    assert list(expiry.handleInputRows(("s", 0), iter([frame]), None)) == []
    assert dict(expiry.seen) == {("a",): ([8, 9],), ("b",): ([5, 7],), ("gone",): ([],)} and oldest == [([7, 8, 9, 10], 5)]
    assert expiry.seen.calls == 4


def test_landing_shuffles_columns_and_writes_small_files(spark):
    """Before, a feed's whole rows were shuffled, their texts written as they are, and the shuffle files stayed."""
    from jobtide.plans import landed as L

    texts = L._raw_by_file(spark, SF).groupBy(F.floor(F.col("seq") / L.FILE_ROWS).alias("chunk")).agg(L.array_of("title", "description").alias("value"))
    plan = texts._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    at = [i for i, line in enumerate(lines) if "Exchange" in line]
    assert len(at) == 1 and "experience" in plan and not any("experience" in line for line in lines[at[0] :])
    assert L.by_file(spark.range(100_000), "id").rdd.getNumPartitions() == 5 and L.by_file(spark.range(0), "id").count() == 0
    path = L.board_a_files(spark, SF)
    read = spark.read.text(path, wholetext=True).select(F.sum(F.length("value")), F.count("*")).first()
    held = [f.stat().st_size for f in Path(path).rglob("part-*")]
    assert len(held) == read[1] == 3 and sum(held) * 4 < read[0]


def test_files_of_a_source_go_when_it_is_counted(spark, monkeypatch):
    """Before, the files of five landings stayed, of which one was read by nothing."""
    from jobtide.plans import landed as L

    made, new = [], L.new_folder
    monkeypatch.setattr(L, "new_folder", lambda *given: made.append(new(*given)) or made[-1])
    rows = L.QUERIES["s13_u01_union_sources"](spark, SF).collect()
    assert sorted(r.source for r in rows) == ["ats", "listings", "swe"] and made and not any(Path(p).exists() for p in made)


def test_tables_are_dealt_by_the_number_of_files(spark, tmp_path, monkeypatch):
    """Before, packed texts made few tasks, each with the sorted lines of many files."""
    from jobtide.sources import feeds

    text = "| Company | Position | Posting |\n|---|---|---|\n| A | B | <a href=\"u\">go</a> |\n"
    for i in range(40):
        (tmp_path / f"{i:02}.md").write_text(text)
    monkeypatch.setattr(feeds, "TABLE_FILES", 2)
    rows = feeds.read_pipe_tables(spark, str(tmp_path), "swe", B.stamp(B.NOW))
    assert rows.rdd.getNumPartitions() == 20 and sorted(r.seq for r in rows.collect()) == [(i << feeds.POSITION_BITS) + 2 for i in range(40)]
