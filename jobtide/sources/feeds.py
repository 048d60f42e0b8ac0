"""Readers: each turns landed files of one feed into raw postings.

Every row carries ``seq``, its place in the feed: the place of its file in the order of
paths and its position in the file. Both come from the scan, so the order is the same on
every layout and at every reading. A feed file is read whole, by one task; feeds land as
many files of bounded size.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType
from pyspark.sql.window import Window

from .. import rules as R
from ..functions import dates as D
from ..functions import text as T

BODY_LIMIT = 6000
#: Bits of ``seq`` for the position in a file and for the file's place; above them stands the feed's number in its source.
POSITION_BITS, FILE_BITS = 24, 24
#: Up to this many files, their places are broadcast (a path and a number each, about 150 bytes).
BROADCAST_FILES = 500_000
#: Files of tables that a task cuts into lines and sorts, about.
TABLE_FILES = 150
#: Tasks a core that list folders; by itself Spark takes one for each folder.
LISTERS = 4


@F.pandas_udf(StringType())
def unescape_twice(raw: pd.Series) -> pd.Series:
    """HTML entities resolved twice: feeds escape their bodies once more than needed."""
    return raw.map(lambda x: html.unescape(html.unescape(x)) if x else x)


def strip_html(raw: Column | str, limit: int = BODY_LIMIT) -> Column:
    """Plain text of an HTML body. Only the entities need Python, in Arrow batches; null is empty."""
    text = F.coalesce(F.when(T.col(raw).contains("&"), unescape_twice(T.col(raw))).otherwise(T.col(raw)), F.lit(""))
    text = F.regexp_replace(text, r"(?i)<(br|/p|/div|/li|/h[1-6])[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    text = F.regexp_replace(text, r"[ \t\r\f\x0B]+", " ")
    text = F.regexp_replace(text, r"\n\s*\n+", "\n")
    return F.substr(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit(1), F.lit(limit))


LISTING = (
    "id string, source string, category string, company_name string, title string, active boolean, is_visible boolean, date_posted long, date_updated long, "
    "url string, company_url string, locations array<string>, sponsorship string, degrees array<string>"
)
JOBS_A = "jobs array<struct<id:long,requisition_id:string,title:string,company_name:string,absolute_url:string,location:struct<name:string>,first_published:string,updated_at:string,content:string>>"
JOBS_B = (
    "id string, text string, country string, workplaceType string, createdAt long, hostedUrl string, applyUrl string, descriptionPlain string, description string, "
    "categories struct<commitment:string,location:string,team:string,allLocations:array<string>>"
)
JOBS_C = "jobs array<struct<id:string,title:string,department:string,team:string,location:string,publishedAt:string,isListed:boolean,isRemote:boolean,workplaceType:string,jobUrl:string,applyUrl:string,descriptionPlain:string,descriptionHtml:string>>"
ROSTER = "companies array<struct<name:string,ats:string,token:string,target:boolean,tags:array<string>,verified:boolean,note:string>>"


@contextmanager
def _few_listers(spark: SparkSession) -> Iterator[None]:
    """While files are listed: folders are shared out among some tasks, as one for each takes longer than the listing."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), LISTERS * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _counted_files(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """((file, place, value), the number of files): every file's whole text and its place in the order of paths.

    The driver has the listing of any scan of files; the places are taken from it.
    """
    # the listing and the rows write the slashes after a scheme differently
    name = F.regexp_replace("_metadata.file_path", "^([a-z0-9]+):/+", "$1:/")
    with _few_listers(spark):
        files = spark.read.text(path, wholetext=True).select("value", name.alias("file"))
    places = [(name, i) for i, name in enumerate(sorted(re.sub("^([a-z0-9]+):/+", r"\1:/", f) for f in files.inputFiles()))]
    table = spark.createDataFrame(places, "file string, place long")
    return files.join(F.broadcast(table) if len(places) <= BROADCAST_FILES else table, "file"), len(places)


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, value): every file's whole text and its place in the order of paths."""
    return _counted_files(spark, path)[0]


def seq(place: str, position: str) -> Column:
    return F.shiftleft(F.col(place).cast("long"), POSITION_BITS) + F.col(position)


def _records(spark: SparkSession, path: str, schema: str, field: str | None = None) -> DataFrame:
    """(file, seq, the record's columns) of JSON files: an array of records, or an object with one in ``field``. A file without records gives one row of nulls."""
    kind = StructType.fromDDL(schema)
    parsed = F.from_json("value", ArrayType(kind)) if field is None else F.from_json("value", kind)[field]
    rows = whole_files(spark, path).select("file", "place", F.posexplode_outer(parsed).alias("position", "record"))
    return rows.select("file", seq("place", "position").alias("seq"), "record.*")


def _raw(df: DataFrame, source: str, **given: Column) -> DataFrame:
    """All columns of a raw posting, and its place; those not given are null."""
    none = lambda kind: F.lit(None).cast(kind)
    values = {
        "source": F.lit(source), "company": none("string"), "title": none("string"), "location": none("string"), "apply_url": none("string"),
        "description": none("string"), "term_default": none("string"), "posted_at": none("timestamp"), "remote_hint": none("boolean"), "source_id": none("string"),
        "sponsorship": none("string"), "degrees": none("array<string>"),
    } | given
    out = df.select(*[v.alias(k) for k, v in values.items()], "seq")
    return out.withColumn("posted_precision", D.posted_precision("source", "posted_at"))


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    """An array of records; active and visible ones of a relevant or no category."""
    rows = _records(spark, path, LISTING)
    fits = F.coalesce("category", F.lit("")).isin("", *R.RELEVANT_CATEGORIES)
    rows = rows.where(F.coalesce("active", F.lit(False)) & F.coalesce("is_visible", F.lit(True)) & fits)
    return _raw(
        rows, "listings", company=F.col("company_name"), title=F.col("title"), location=F.get("locations", F.lit(0)), apply_url=F.col("url"), term_default=F.lit("new-grad"),
        posted_at=F.timestamp_seconds("date_posted"), source_id=F.col("id"), sponsorship=F.col("sponsorship"), degrees=F.col("degrees"),
    )


def listings_quality(spark: SparkSession, path: str) -> DataFrame:
    """By file: records, inactive, off-category, kept, and a warning when nothing is left."""
    on = F.coalesce("active", F.lit(False)) & F.coalesce("is_visible", F.lit(True))
    fits = F.coalesce("category", F.lit("")).isin("", *R.RELEVANT_CATEGORIES)
    rows = _records(spark, path, LISTING)
    out = rows.groupBy("file").agg(F.count("seq").alias("records"), F.count_if(~on & F.col("seq").isNotNull()).alias("inactive"), F.count_if(on & ~fits).alias("off_category"), F.count_if(on & fits).alias("kept"))
    return out.withColumn("warning", F.when(F.col("kept") == 0, F.format_string("parsed 0 from %d", "records")))


def read_board_a(spark: SparkSession, path: str, company: str | None = None) -> DataFrame:
    """``{"jobs": [...]}`` with first_published and escaped HTML bodies; title and link required."""
    rows = _records(spark, path, JOBS_A, "jobs").where("title <> '' and absolute_url <> ''")
    return _raw(
        rows, "ats", company=F.coalesce(F.nullif("company_name", F.lit("")), F.lit(company)), title=F.col("title"), location=F.col("location.name"), apply_url=F.col("absolute_url"),
        description=strip_html("content"), posted_at=D.parse_timestamp("first_published"), source_id=F.col("id").cast("string"),
    )


def read_board_b(spark: SparkSession, path: str, company: str | None = None) -> DataFrame:
    """S3: a bare array with epoch milliseconds and a workplace type."""
    link = F.coalesce(F.nullif("hostedUrl", F.lit("")), F.nullif("applyUrl", F.lit("")))
    rows = _records(spark, path, JOBS_B).withColumn("_link", link).where("text <> '' and _link is not null")
    place = F.lower(F.coalesce("workplaceType", F.lit("")))
    body = F.coalesce(F.nullif("descriptionPlain", F.lit("")), strip_html("description"))
    return _raw(
        rows, "ats", company=F.lit(company), title=F.col("text"), location=F.col("categories.location"), apply_url=F.col("_link"), description=body,
        posted_at=D.parse_timestamp(F.col("createdAt").cast("string")), remote_hint=F.when(place == "remote", True).when(place != "", False), source_id=F.nullif("id", F.lit("")),
    )


def read_board_c(spark: SparkSession, path: str, company: str | None = None) -> DataFrame:
    """``{"jobs": [...]}``; rows that say they are not listed are left out."""
    rows = _records(spark, path, JOBS_C, "jobs")
    rows = rows.withColumn("_link", F.coalesce(F.nullif("jobUrl", F.lit("")), F.nullif("applyUrl", F.lit(""))))
    rows = rows.where("title <> '' and _link is not null and not (isListed <=> false)")
    body = F.coalesce(F.nullif("descriptionPlain", F.lit("")), strip_html("descriptionHtml"))
    return _raw(
        rows, "ats", company=F.lit(company), title=F.col("title"), location=F.col("location"), apply_url=F.col("_link"), description=body,
        posted_at=D.parse_timestamp("publishedAt"), remote_hint=F.col("isRemote"), source_id=F.nullif("id", F.lit("")),
    )


def cell_text(cell: Column) -> Column:
    """What is in <strong>, else the cell, without tags."""
    strong = F.regexp_extract(cell, r"(?is)<strong>(.*?)</strong>", 1)
    bare = F.when(cell.contains("<"), F.regexp_replace(F.when(strong != "", strong).otherwise(cell), "<[^>]+>", "")).otherwise(cell)
    return F.trim(F.replace(bare, F.lit("&amp;"), F.lit("&")))


def cell_url(cell: Column) -> Column:
    return F.trim(F.regexp_extract(cell, 'href="([^"]+)"', 1))


def pipe_tables(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """S5, first half: files(file, place, value whole text) -> (file, place, line, row map by header name) of every table with company and position.

    Lines of one file form islands: a line that is no table line ends one, and a header
    followed by a dash line begins one. The work is by file, so many files run at once.
    ``tasks``: how many share them; by itself Spark takes few, as packed texts are small, and their sorted lines are not.
    """
    dealt = files.repartition("place") if tasks is None else files.repartition(tasks, "place")
    lines = dealt.select("file", "place", F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    lines = lines.withColumn("is_row", F.col("line").startswith("|"))
    cells = lambda: F.transform(F.split(F.btrim(F.trim("line"), F.lit("|")), r"\|"), lambda c: F.trim(c))
    by_file = Window.partitionBy("place").orderBy("n")
    dashes = F.lead("line").over(by_file).rlike(r"^[|\s:-]*$")
    named = F.lower("line").contains("company") & F.lower("line").contains("position")
    low = F.when(F.col("is_row") & named, F.transform(cells(), F.lower))
    header = F.col("is_row") & F.coalesce(F.array_contains("low", "company") & F.array_contains("low", "position") & dashes, F.lit(False))
    lines = lines.withColumn("low", low).withColumn("is_header", header)
    # rows right after a header's dash line belong to it, up to the first line that is no row
    earlier = by_file.rowsBetween(Window.unboundedPreceding, -1)
    head = F.last(F.when(F.col("is_header"), F.struct("n", "low")), ignorenulls=True).over(earlier)
    end = F.last(F.when(~F.col("is_row"), F.col("n")), ignorenulls=True).over(earlier)
    rows = lines.withColumn("last", head).withColumn("end", end).where(~F.col("is_header") & F.col("is_row") & (F.col("n") > F.col("last.n") + 1) & (F.col("last.n") > F.coalesce("end", F.lit(-1))))
    rows = rows.select("file", "place", "n", F.col("last.low").alias("head"), cells().alias("cells"))
    rows = rows.where(F.size("cells") >= F.size("head"))
    # filters of callers may be moved below this one, so the map asks for itself
    fits = F.size("cells") >= F.size("head")
    return rows.select("file", "place", "n", F.when(fits, F.map_from_arrays("head", F.slice("cells", 1, F.size("head")))).alias("row"))


def _table_rows(spark: SparkSession, path: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(files, complete rows of their tables); a file is known by its whole path, as names repeat between folders."""
    files, n = _counted_files(spark, path)
    at = lambda name: F.try_element_at("row", F.lit(name))
    rows = pipe_tables(files, max(spark.sparkContext.defaultParallelism, -(-n // TABLE_FILES))).select(
        "file", seq("place", "n").alias("seq"), cell_text(at("company")).alias("company"), cell_text(at("position")).alias("title"), cell_url(F.coalesce(at("posting"), F.lit(""))).alias("url"),
        F.nullif(F.regexp_replace(cell_text(at("location")), r"\s*\+\d+\s*$", ""), F.lit("")).alias("location"), D.age_to_posted_at(at("age"), now).alias("posted_at"),
    ).where("company <> '' and title <> '' and url <> ''")
    return files, rows


def read_pipe_tables(spark: SparkSession, path: str, source: str, now: Column) -> DataFrame:
    """Postings of Markdown tables; the new-grad file sets its term."""
    rows = _table_rows(spark, path, now)[1]
    name = F.lower(F.regexp_extract("file", "([^/]+)$", 1))
    return _raw(
        rows, source, company=F.col("company"), title=F.col("title"), location=F.col("location"), apply_url=F.col("url"),
        term_default=F.when(name.contains("new_grad"), "new-grad"), posted_at=F.col("posted_at"),
    )


def pipe_tables_quality(spark: SparkSession, path: str) -> DataFrame:
    """By file: the rows kept, and a warning when there are none."""
    files, rows = _table_rows(spark, path, F.current_timestamp())
    kept = files.select("file").join(rows.groupBy("file").agg(F.count("*").alias("kept")), "file", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    return kept.withColumn("warning", F.when(F.col("kept") == 0, F.concat(F.lit("parsed 0 rows in "), F.regexp_extract("file", "([^/]+)$", 1))))


def load_roster(spark: SparkSession, path: str) -> DataFrame:
    """One row per board."""
    return _records(spark, path, ROSTER, "companies").where("seq is not null").drop("file", "seq").withColumn("company_norm", T.normalize_company("name"))


def target_companies(roster: DataFrame) -> DataFrame:
    return roster.where("target").select("company_norm").distinct()


def union_sources(feeds: dict[str, DataFrame | list[DataFrame]], only: list[str] | None = None) -> DataFrame:
    """All feeds with (source_order, seq), the order that later merges follow.

    A source of several feeds (boards) comes as a list; its feeds follow each other.
    """
    parts = []
    for name, order in R.SOURCE_ORDER.items():
        if name in feeds and (only is None or name in only):
            own = feeds[name] if isinstance(feeds[name], list) else [feeds[name]]
            shift = lambda i: F.lit(i << (POSITION_BITS + FILE_BITS))
            parts += [feed.withColumn("source_order", F.lit(order)).withColumn("seq", F.col("seq") + shift(i)) for i, feed in enumerate(own)]
    return reduce(DataFrame.unionByName, parts)
