"""Registered queries over landed files: feeds, sinks and streams.

Feeds arrive as many files of bounded size. Here they are written from the driver's tables
into the shared folder, FILE_ROWS records a file, and read back by the library's readers,
so that the number of files grows with the tables. Sinks are written and read back; streams
read what has landed, once, and write files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import gates as G
from ..operators import reports as R
from ..operators import state as S
from ..operators import views as V
from ..schemas import POSTING, RAW_POSTING
from ..sources import feeds, files, tables
from ..sources.folders import new_folder, shuffles_dropped, written
from ..streaming import streams as X
from ..streaming.snapshots import Chain
from . import bindings as B
from .queries import decided_postings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

FILE_ROWS = 500
#: Files that a task writes, about.
TASK_FILES = 40
CATEGORIES = ["Software", "Hardware", "", "AI/ML/Data", "Quant", "Product"]
SINCE, TODAY, AUDIT_DAYS = "2024-01-15 00:00:00", "2024-01-31", 10


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def by_file(rows: DataFrame, key: str) -> DataFrame:
    """A table's rows, those of one file in one task; tasks do not grow with the table."""
    tasks = max(1, -(-rows.count() // (FILE_ROWS * TASK_FILES)))
    return rows.repartition(tasks, F.floor(F.col(key) / FILE_ROWS))


def land(rows: DataFrame, key: str, value: Column, label: str) -> str:
    """Write one compressed text file per FILE_ROWS keys; ``value`` aggregates a file's rows to its text.

    Rows that come from ``by_file`` are not shuffled again.
    """
    path = new_folder(rows.sparkSession, label)
    texts = rows.groupBy(F.floor(F.col(key) / FILE_ROWS).alias("chunk")).agg(value.alias("value"))
    with shuffles_dropped(rows.sparkSession):
        texts.write.partitionBy("chunk").option("compression", "gzip").text(path)
    return path


def _in_order(fields: tuple[Column, ...], key: str) -> Column:
    """A file's records, by key: what collect_list gathers has no order of its own."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.struct(*fields).alias("record")))), lambda x: x["record"])


def array_of(*fields: Column, key: str = "seq") -> Column:
    return F.to_json(_in_order(fields, key))


def named(name: str, *fields: Column, key: str = "seq") -> Column:
    return F.to_json(F.struct(_in_order(fields, key).alias(name)))


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    return B.raw_postings(spark, sf)


def _raw_by_file(spark: SparkSession, sf: str) -> DataFrame:
    """Raw postings to land: the orders are dealt out, of which a few columns are read, and not the texts made from them."""
    return B.raw_postings(spark, sf, by_file(B.read(spark, sf, "orders"), "o_orderkey"))


def listings_files(spark: SparkSession, sf: str) -> str:
    k = F.col("seq")
    category = F.when(k % 9 != 0, B.pick(CATEGORIES, F.floor(k / 7)))
    fields = [
        k.cast("string").alias("id"), category.alias("category"), F.col("company").alias("company_name"), "title", (k % 4 != 1).alias("active"),
        F.when(k % 10 != 0, k % 10 != 3).alias("is_visible"), F.unix_timestamp("posted_at").alias("date_posted"), F.col("apply_url").alias("url"),
        F.array("location", F.lit("Elsewhere")).alias("locations"), "sponsorship", "degrees",
    ]
    return land(_raw_by_file(spark, sf), "seq", array_of(*fields), "listings")


def board_a_files(spark: SparkSession, sf: str) -> str:
    k = F.col("seq")
    body = F.concat(F.lit("&lt;p&gt;"), "description", F.lit(" &amp;amp; more&lt;/p&gt;&lt;br/&gt;End"))
    fields = [
        k.alias("id"), "title", F.when(k % 3 != 0, F.col("company")).alias("company_name"), F.col("apply_url").alias("absolute_url"), F.struct(F.col("location").alias("name")).alias("location"),
        F.concat(F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-04:00")).alias("first_published"), body.alias("content"),
    ]
    return land(_raw_by_file(spark, sf), "seq", named("jobs", *fields), "board-a")


def board_b_files(spark: SparkSession, sf: str) -> str:
    k = F.col("seq")
    fields = [
        F.when(k % 5 != 0, F.concat(F.lit("b"), k.cast("string"))).otherwise("").alias("id"), F.col("title").alias("text"), B.pick(["remote", "hybrid", ""], k).alias("workplaceType"),
        F.unix_millis("posted_at").alias("createdAt"), F.when(k % 2 == 0, F.col("apply_url")).otherwise("").alias("hostedUrl"), F.col("apply_url").alias("applyUrl"),
        F.when(k % 3 != 0, F.col("description")).alias("descriptionPlain"), F.concat(F.lit("<b>"), "description", F.lit("</b>")).alias("description"),
        F.struct("location").alias("categories"),
    ]
    return land(_raw_by_file(spark, sf), "seq", array_of(*fields), "board-b")


def board_c_files(spark: SparkSession, sf: str) -> str:
    k = F.col("seq")
    fields = [
        F.concat(F.lit("c"), k.cast("string")).alias("id"), "title", "location", F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"),
        F.when(k % 8 != 1, k % 8 != 0).alias("isListed"), F.col("remote_hint").alias("isRemote"), F.col("apply_url").alias("jobUrl"),
        F.concat(F.lit("<p>"), "description", F.lit("</p>")).alias("descriptionHtml"),
    ]
    return land(_raw_by_file(spark, sf), "seq", named("jobs", *fields), "board-c")


def table_files(spark: SparkSession, sf: str) -> str:
    """Markdown files; the header of every third one names no company."""
    k = F.col("seq")
    line = F.concat(
        F.lit('| <a href="c"><strong>'), F.replace("company", F.lit("&"), F.lit("&amp;")), F.lit("</strong></a> | "), F.replace("title", F.lit("|"), F.lit("/")), F.lit(" | "), "location",
        F.when(k % 4 == 0, " +2").otherwise(""), F.lit(' | <a href="'), "apply_url", F.lit('">go</a> | '), F.when(k % 11 == 0, "soon").otherwise(F.concat((k % 30).cast("string"), F.lit("d"))), F.lit(" |"),
    )
    head = F.when(F.floor(F.min("seq") / FILE_ROWS) % 3 == 1, "| Firm").otherwise("| Company")
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"]), "\n")
    text = F.concat(F.lit("# Jobs\n\n"), head, F.lit(" | Position | Location | Posting | Age |\n|---|---|---|---|---|\n"), rows, F.lit("\n\nend"))
    return land(_raw_by_file(spark, sf), "seq", text, "tables")


def _columns(df: DataFrame) -> DataFrame:
    return df.withColumn("degrees", F.array_join("degrees", ",")).drop("seq")


@query
def s01_read_listings(spark, sf):
    return _columns(feeds.read_listings(spark, listings_files(spark, sf)))


@query
def s02_read_board_a(spark, sf):
    return _columns(feeds.read_board_a(spark, board_a_files(spark, sf), "Acme"))


@query
def s03_read_board_b(spark, sf):
    return _columns(feeds.read_board_b(spark, board_b_files(spark, sf), "Acme"))


@query
def s04_read_board_c(spark, sf):
    return _columns(feeds.read_board_c(spark, board_c_files(spark, sf), "Acme"))


@query
def s05_s06_read_pipe_tables(spark, sf):
    return _columns(feeds.read_pipe_tables(spark, table_files(spark, sf), "swe", B.stamp(B.NOW)))


@query
def s07_target_companies(spark, sf):
    k = F.col("s_suppkey")
    fields = [F.col("s_name").alias("name"), F.lit("ats").alias("ats"), k.cast("string").alias("token"), F.when(k % 5 != 0, k % 2 == 0).alias("target"), F.array(F.lit("t")).alias("tags"), (k % 3 == 0).alias("verified")]
    path = land(B.read(spark, sf, "supplier"), "s_suppkey", named("companies", *fields, key="s_suppkey"), "roster")
    return feeds.target_companies(feeds.load_roster(spark, path))


def _chunk() -> Column:
    return F.regexp_extract("file", r"chunk=(\d+)", 1).cast("long").alias("chunk")


@query
def s12_listings_quality(spark, sf):
    found = feeds.listings_quality(spark, listings_files(spark, sf))
    return found.select(_chunk(), "records", "inactive", "off_category", "kept", F.col("warning").isNotNull().alias("warned"))


@query
def s12_tables_quality(spark, sf):
    found = feeds.pipe_tables_quality(spark, table_files(spark, sf))
    return found.select(_chunk(), "kept", F.col("warning").isNotNull().alias("warned"))


def _feeds(spark: SparkSession, sf: str) -> dict:
    """Three sources from landed files; the boards are two feeds of one."""
    boards = [feeds.read_board_c(spark, board_c_files(spark, sf), "Acme"), feeds.read_board_b(spark, board_b_files(spark, sf), "Acme")]
    return {"listings": feeds.read_listings(spark, listings_files(spark, sf)), "swe": feeds.read_pipe_tables(spark, table_files(spark, sf), "swe", B.stamp(B.NOW)), "ats": boards}


def _held(spark: SparkSession, sf: str, landed: Callable[[SparkSession, str], str], read: Callable[[SparkSession, str], DataFrame], drop: Callable[[str], None]) -> DataFrame:
    """(source, seq) of a feed's rows; its files are dropped when they are read, so that the disk does not hold those of all feeds."""
    path = landed(spark, sf)
    with shuffles_dropped(spark):
        rows = written(read(spark, path).select("source", "seq"), "held")
    drop(path)
    return rows


@query
def s13_u01_union_sources(spark, sf):
    """Rows and places of each source; the boards of all three kinds are feeds of one."""
    table = lambda spark, path: feeds.read_pipe_tables(spark, path, "swe", B.stamp(B.NOW))
    board = lambda read: lambda spark, path: read(spark, path, "Acme")
    sources = {
        "listings": [(listings_files, feeds.read_listings)], "swe": [(table_files, table)],
        "ats": [(board_a_files, board(feeds.read_board_a)), (board_b_files, board(feeds.read_board_b)), (board_c_files, board(feeds.read_board_c))],
    }
    gone = []
    with ThreadPoolExecutor(1) as aside:  # a feed's files are deleted while the next ones land
        drop = lambda path: gone.append(aside.submit(files.delete, spark, path))
        parts = {name: [_held(spark, sf, *feed, drop) for feed in own] for name, own in sources.items()}
        counts = feeds.union_sources(parts).groupBy("source_order", "source").agg(F.count("*").alias("n"), F.count_distinct("seq").alias("places"))
        counts = written(counts, "counts")
    for deletion in gone:
        deletion.result()  # an error of one is not hidden
    return counts


@query
def s13_u01_places(spark, sf):
    """Each row's place: source, feed, file in the order of paths, position in the file."""
    rows, seq = feeds.union_sources(_feeds(spark, sf)), F.col("seq")
    part = lambda shift, bits: F.shiftright(seq, shift).bitwiseAND((1 << bits) - 1)
    return rows.select(
        "source_order", part(feeds.POSITION_BITS + feeds.FILE_BITS, 15).alias("feed"), part(feeds.POSITION_BITS, feeds.FILE_BITS).alias("file"), part(0, feeds.POSITION_BITS).alias("position"), "title", "apply_url"
    )


def stored(spark: SparkSession, sf: str) -> DataFrame:
    """Stored postings with every column of the schema."""
    rows = B.postings(spark, sf)
    fields = [c.split(" ", 1) for c in POSTING.split(", ")]
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in fields])


@query
def s14_s15_export_restore(spark, sf):
    path = new_folder(spark, "export")
    tables.export_postings(stored(spark, sf), path)
    back = tables.restore_postings(spark, path)
    names = ["id", "company", "title", "term", "location", "remote", "apply_url", "source", "first_seen_at", "posted_at", "posted_precision", "tier", "score", "status", "link_status", "tier_source"]
    return back.select(*names, F.array_join("disqualifiers", ",").alias("disqualifiers"))


@query
def s14_changed_parts(spark, sf):
    """Parts of an export that differ after some rows changed, and some went."""
    path, rows = new_folder(spark, "export"), stored(spark, sf)
    tables.export_postings(rows.where("not startswith(id, 'a0')"), path)
    later = rows.withColumn("status", F.when((F.col("id") < "8") & (F.col("score") == 7), "applied").otherwise(F.col("status"))).where("not startswith(id, 'ff')")
    return tables.changed_parts(later, path)


@query
def s16_baseline(spark, sf):
    path = new_folder(spark, "baseline")
    tables.write_baseline(B.postings(spark, sf).where("tier = 1").select("id"), path)
    return tables.read_baseline(spark, path)


@query
def s17_archive_replay(spark, sf):
    """Two runs, the second written twice; its rows are read back."""
    path, raw = new_folder(spark, "archive"), _raw(spark, sf).withColumn("description", F.repeat("description", F.lit(40)))
    for run, odd in (("r1", 0), ("r2", 0), ("r2", 1)):
        tables.archive_raw(raw.where(F.col("seq") % 2 == odd), path, run, B.stamp(B.NOW))
    return tables.replay_raw(spark, path, "r2").select("seq", "source", F.length("description").alias("chars"))


@query
def s17_r04_prune_raw(spark, sf):
    """Five runs are archived, three stay: what each has before and after."""
    path, raw = new_folder(spark, "archive"), _raw(spark, sf)
    for i in range(5):
        tables.archive_raw(raw.where(F.col("seq") % 5 == i), path, f"r{(i * 3) % 5}", B.stamp(B.NOW) + F.expr(f"interval {i} hours"))
    count = lambda when: spark.read.parquet(path).groupBy("run_id").agg(F.count("*").alias("n")).select(F.lit(when).alias("at"), "run_id", "n")
    before = spark.createDataFrame(count("before").collect(), "at string, run_id string, n long")  # a row a run
    tables.prune_raw(spark, path, 3)
    return before.union(count("after"))


@query
def s18_reports(spark, sf):
    path = new_folder(spark, "reports")
    runs = B.run_history(spark, sf).groupBy("started_at").agg(F.max("duration_s").alias("duration_s"), F.collect_list(F.struct("source", "raw_fetched", "new")).alias("sources"))
    tables.write_report(runs.withColumn("run_id", F.concat(F.lit("r"), F.unix_timestamp("started_at").cast("string"))), path)
    return tables.exploded_sources(tables.read_reports(spark, path, B.stamp(SINCE)))


@query
def s19_r03_audit(spark, sf):
    path = new_folder(spark, "audit")
    runs = B.run_history(spark, sf).groupBy(F.col("started_at").alias("at")).agg(F.sum("new").alias("n"))
    tables.append_audit(runs.withColumn("run_id", F.concat(F.lit("r"), F.unix_timestamp("at").cast("string"))), path)
    return tables.read_audit(spark, path, TODAY, AUDIT_DAYS).select("run_id", "n")


@query
def s19_r03_prune_audit(spark, sf):
    """Day partitions before the window go: the days and their records that are left."""
    path = new_folder(spark, "audit")
    runs = B.run_history(spark, sf).groupBy(F.col("started_at").alias("at")).agg(F.sum("new").alias("n"))
    tables.append_audit(runs.withColumn("run_id", F.concat(F.lit("r"), F.unix_timestamp("at").cast("string"))), path)
    went = tables.prune_audit(spark, path, TODAY, AUDIT_DAYS)
    gone = spark.createDataFrame([(day,) for day in went], "day string").select(F.lit("gone").alias("state"), "day", F.lit(None).cast("long").alias("records"))
    left = spark.read.json(path).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("records"))
    return gone.union(left.select(F.lit("left"), "day", "records"))


@query
def j17_rewrite_ids(spark, sf):
    """Ids of one metro change under its new name, in postings, sightings, baseline, ledger and cache at once."""
    raw = _raw(spark, sf)
    p = S.normalize_postings(G.with_gates(raw).where("keep"), B.stamp(B.NOW), strings=raw).dropDuplicates(["id"])
    p = p.select("id", "company", "title", "term", F.when(F.col("location_norm") == "nyc", "new-york").otherwise(F.col("location_norm")).alias("location_norm"))
    p = written(p, "postings")
    held = {"postings": "id", "sightings": "id", "baseline": "id", "ledger": "posting_id", "cache": "posting_id"}
    named = {
        name: (p.where(F.substr("id", F.lit(16), F.lit(1)) >= F.lit("0123"[i % 4])).select(F.col("id").alias(column)), column) for i, (name, column) in enumerate(held.items())
    }
    path = new_folder(spark, "migrated")
    done = tables.rewrite_tables(named, S.rekey(p), path, "v2")
    parts = [tables.read_version(spark, path, "v2", name).select(F.lit(name).alias("held_in"), F.col(column).alias("id")) for name, column in held.items()] if done else []
    return reduce(DataFrame.union, parts)


def _report(spark: SparkSession, sf: str) -> DataFrame:
    """The report of one run over the bound tables."""
    raw = _raw(spark, sf)
    g = G.with_gates(raw).withColumn("term", F.lit("unknown")).withColumn("is_new", F.lit(False)).withColumn("suppressed", F.col("seq") % 10 == 1)
    accepted = written(S.normalize_postings(G.with_gates(raw).where("keep"), B.stamp(B.NOW), strings=raw), "batch")
    merged, p = S.upsert(S.empty(spark, POSTING), accepted), B.postings(spark, sf)
    gone = p.where("status = 'expired'").select("id", F.when(F.col("seq") % 50 < 10, "retired").otherwise("expired").alias("why"))
    scored = p.withColumn("tier_source", F.when(F.col("seq") % 5 == 0, "llm").when(F.col("seq") % 5 == 1, "cached").otherwise("heuristic"))
    run = spark.range(1).select(F.lit("r2").alias("run_id"), F.lit(12.5).alias("duration_s"))
    decided = decided_postings(spark, sf, "2001-08-03 20:00:00")
    return R.run_report(run, R.source_run_counters(g), accepted, merged, p, decided, p.where("tier = 1").select("id"), gone, scored, B.stamp(B.NOW))


@query
def a07_run_report(spark, sf):
    """The nested report, written beside an older one and read back as the latest."""
    path, report = new_folder(spark, "reports"), _report(spark, sf)
    tables.write_report(report, path)
    older = tables.read_reports(spark, path, B.stamp("1970-01-01 00:00:00")).withColumn("run_id", F.lit("r1")).withColumn("started_at", F.col("started_at") - F.expr("interval 1 hour"))
    both = older.withColumn("expired", F.lit(-1).cast("long")).unionByName(tables.read_reports(spark, path, B.stamp("1970-01-01 00:00:00")))
    return R.report_counts(R.latest_report(both))


@query
def a07_report_sources(spark, sf):
    """The same report's sources and warnings."""
    path = new_folder(spark, "reports")
    tables.write_report(_report(spark, sf), path)
    report = R.latest_report(tables.read_reports(spark, path, B.stamp("1970-01-01 00:00:00")))
    return report.select(F.explode("sources").alias("s"), F.size("warnings").alias("warnings")).select("s.source", "s.raw_fetched", "s.fetched", "s.filtered_out", "s.baselined", "s.term_unknown", "warnings")


@query
def t05_digest_totals(spark, sf):
    path = new_folder(spark, "reports")
    tables.write_report(_report(spark, sf), path)
    return V.digest_totals(B.postings(spark, sf).withColumn("first_seen_at", F.col("first_seen_at") + F.expr("interval 1 day")), tables.read_reports(spark, path, B.stamp("1970-01-01 00:00:00")), B.stamp(B.NOW))


@query
def s20_review(spark, sf):
    path = new_folder(spark, "review")
    tables.write_review(stored(spark, sf), path)
    back = spark.read.option("header", True).csv(path).fillna("")  # an empty cell is read as null
    return back.select("id", "company", "title", "term", F.col("tier").cast("int").alias("tier"), F.col("score").cast("int").alias("score"), "location", "apply_url", "disqualifiers")


# --- streams ------------------------------------------------------------------

#: Landings, each of which a stream takes up from its checkpoint in a run of its own.
TURNS = 5


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, X.ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def in_turns(rows: DataFrame, turn: Column, run: Callable[[str], StreamingQuery], label: str) -> str:
    """Land the rows of one turn after the other, and let the stream that ``run(folder)`` starts take up each."""
    path = new_folder(rows.sparkSession, label)
    for i in range(TURNS):
        rows.where(turn == i).write.mode("append").parquet(f"{path}/in")
        running = run(path)
        running.awaitTermination()
        if running.exception() is not None:
            raise running.exception()
    return path


def finished(rows: DataFrame, turn: Column, make: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    """The rows, landed in turns, through a stream into files, and those read."""
    spark, schema = rows.sparkSession, []

    def run(path: str) -> StreamingQuery:
        stream = make(X.landing(spark, f"{path}/in", rows.schema))
        schema[:] = [stream.schema]
        return stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").outputMode("append").trigger(availableNow=True).start()

    with _rocksdb(spark):
        path = in_turns(rows, turn, run, label)
    return spark.read.schema(schema[0]).parquet(f"{path}/out")


def _by_time(spark: SparkSession, sf: str) -> tuple[DataFrame, Column]:
    """The events with ``ts``, and the turn of each: fifths of the time they cover."""
    rows = B.read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    first, last = rows.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    return rows, F.floor((F.unix_micros("ts") - (first or 0)) * TURNS / ((last or 0) - (first or 0) + 1)).cast("int")


@query
def x01_x05_stream_ingest(spark, sf):
    """Landed raw postings through the batch functions, a snapshot for each of five micro-batches; later ones bring late rows."""
    rows = _raw(spark, sf)
    chains = {}

    def merge(state: DataFrame, batch: DataFrame) -> DataFrame:
        new = S.normalize_postings(G.with_gates(batch).where("keep"), B.stamp(B.NOW), strings=batch)
        return S.upsert(state, new).drop("is_new", "url_upgrades")

    def run(path: str) -> StreamingQuery:
        chain = chains.setdefault(path, Chain(f"{path}/state", POSTING, partitions=8))
        return X.stream_ingest(X.landing(spark, f"{path}/in", RAW_POSTING), chain, merge, f"{path}/log")

    path = in_turns(rows, F.col("seq") % TURNS, run, "ingest")
    after = chains[path].read(spark)
    return after.select("id", "company", "title", "term", "location", "remote", "apply_url", "source", "source_id", "source_url", "posted_at", "posted_precision", "status", "link_status")


@query
def x02_stream_first_seen(spark, sf):
    """Each user once, over five landings."""
    events, turn = _by_time(spark, sf)
    rows = events.select(F.col("user_id").cast("string").alias("id"), F.col("ts").alias("seen_at"), turn.alias("turn"))
    return finished(rows, F.col("turn"), X.stream_first_seen, "first-seen").select("id")


@query
def x02_first_seen_within(spark, sf):
    """Each user at most once in 48 hours of bounded memory; each landing has a user's last event of its time only."""
    events, turn = _by_time(spark, sf)
    rows = events.groupBy(F.col("user_id").cast("string").alias("id"), turn.alias("turn")).agg(F.max("ts").alias("seen_at"))
    return finished(rows, F.col("turn"), X.stream_first_seen_within, "seen-within").select("id", "seen_at")


@query
def x03_stream_rate_cap(spark, sf):
    """Pushes of each user as a channel; the cap is sequential, so a brute-force test takes the place of SQL."""
    events, turn = _by_time(spark, sf)
    rows = events.select(F.col("user_id").cast("string").alias("channel"), F.col("event_id").cast("string").alias("id"), "ts", F.col("value").cast("int").alias("score"), turn.alias("turn"))

    def run(path: str) -> StreamingQuery:
        chain = Chain(f"{path}/sent", X.SENT, partitions=8, key="channel")
        return X.stream_rate_cap(X.landing(spark, f"{path}/in", rows.schema), chain, f"{path}/out", f"{path}/log")

    return X.read_decisions(spark, f"{in_turns(rows, F.col('turn'), run, 'capped')}/out").select("id", "ts", "score", "decision")


@query
def x03_push_counts(spark, sf):
    events, turn = _by_time(spark, sf)
    found = finished(events.select("ts", turn.alias("turn")), F.col("turn"), X.stream_push_counts, "pushes")
    return found.select(F.col("window.start").alias("window_start"), "n")


@query
def x04_stream_expiry(spark, sf):
    """Runs of each source every six hours, and the users that each showed."""
    events, turn = _by_time(spark, sf)
    run_at = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / 21600) * 21600)
    runs = B.run_history(spark, sf).select("source", F.col("started_at").alias("run_at"), (~F.col("not_modified")).alias("healthy"))
    shown = events.select(F.col("event_type").alias("source"), run_at.alias("run_at"), F.col("user_id").cast("string").alias("id")).distinct().join(runs, ["source", "run_at"])
    rows = shown.select("source", "run_at", "healthy", "id").unionByName(runs.withColumn("id", F.lit(None).cast("string")))
    first, last = rows.agg(F.unix_timestamp(F.min("run_at")), F.unix_timestamp(F.max("run_at"))).first()
    rows = rows.withColumn("turn", F.floor((F.unix_timestamp("run_at") - (first or 0)) * TURNS / ((last or 0) - (first or 0) + 1)).cast("int"))
    return finished(rows, F.col("turn"), lambda stream: X.stream_expiry(stream, 8), "expired")
