"""How the driver's tables become the library's inputs, alike in Spark and in DuckDB.

Rows come from ``orders``, ``events`` and ``pages``; text columns are picked from short
lists by the row's key, so that the tricky cases of every rule occur at every scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions.text import strings

NOW, CUTOVER = "2001-08-03 12:00:00", "1999-01-01 00:00:00"

TITLES = [
    "Software Engineer Intern (Fall 2026)", "SWE Co-op [Backend] - Req #48213", "Software Development Engineer II", "Senior Software Engineer",
    "Engineer II L4", "Développeur Café & Web", "Machine Learning Engineer, New Grad 2027", "Member of Technical Staff", "Senior Member of Technical Staff",
    "Software Engineering Engineer", "Graduate Software Engineer (Class of 2027)", "Product Manager", "Sales Engineer", "Data Scientist - Summer 2027",
    "Research Intern", "Account Executive, Mid-Market", "Public Policy and AI Innovation Intern", "Frontend Developer (Remote, US)", "Platform Engineer 3",
    "Technical Program Manager", "Machine Learning Engineer Graduate - Brand Ads", "", "Quantitative Analyst", "2027 Winter Internship | Embedded Systems",
]
COMPANIES = ["The Stripe, Inc.", "Alphabet Inc", "Facebook", "JPMorgan Chase", "Amazon.com", "Cohere", "Scale AI LLC", "Amazon Web Services, Inc.", "Ünïcode GmbH", "Block Co", "NVIDIA Corporation", ""]
PLACES = [
    "San Francisco, CA", "Brooklyn, OH", "Cambridge, UK", "Cambridge, MA", "New York, NY; Remote", "Remote - US", "United States", "Santa Clara, California",
    "Portland, ME", "Seattle, Washington", "Springfield, IL", "Flexible - Any Acme Site", "Lyon, France", "South San Francisco", "Multiple Locations", "",
    "Washington, DC", "Hybrid - Austin", "São Paulo, Brazil", "Paris or London", "Anywhere", "Irvine, CA / Remote", "Ontario",
]
BODIES = [
    "", "We want 3-5 years of relevant experience in systems.", "Open to a recent graduate. 0-2 years of experience.", "Must hold an active security clearance.",
    "You will be able to obtain an active security clearance.", "A PhD is required for this role.", "Master's degree required. 10+ years of experience.",
    "Bachelor's or Master's degree required.", "We do not sponsor visas. U.S. citizenship needed.", "Join us for the Spring 2027 season.",
    "Public trust. Currently pursuing a bachelor degree, 1 year of experience.",
]
TERMS = ["fall-2026", "winter-2027", "spring-2027", "summer-2027", "new-grad", "unknown"]
STATUSES = ["new", "new", "notified", "applied", "skipped", "expired", "notified"]
METROS = ["sf-bay", "nyc", "us-il", "remote", "seattle", "unknown"]
COMPANY_NORMS = ["stripe", "google", "meta", "cohere"]
TARGETS = ["stripe", "google", "meta"]
LINK_STATUSES = ["unchecked", "ok", "dead", "redirected_to_index", "unreachable", "blocked"]
TITLE_NORMS = ["software engineer intern", "machine learning engineer", "data scientist", "frontend engineer", "platform engineer l2", "analyst"]


def pick(values: list[str], key: Column) -> Column:
    return F.element_at(strings(values), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stamp(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def raw_postings(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """One raw posting per order; ``orders``: the table's rows as the caller has dealt them out."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    number = F.substr("o_orderpriority", F.lit(1), F.lit(1))
    source = F.when(number == "1", "listings").when(number == "2", "swe").when(number == "3", "ai").otherwise("ats")
    order = F.when(number == "1", 0).when(number == "2", 1).when(number == "3", 2).otherwise(3)
    posted = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.when(k % 3 == 0, 0).otherwise(k % 86400) * 1_000_000)
    rows = (read(spark, sf_dir, "orders") if orders is None else orders).select(
        source.alias("source"), order.alias("source_order"), k.alias("seq"), pick(COMPANIES, c).alias("company"), pick(TITLES, k).alias("title"),
        pick(PLACES, k + c).alias("location"), F.when(k % 13 == 0, "").otherwise(F.concat(F.lit("https://boards.example.com/jobs/"), (k % 701).cast("string"))).alias("apply_url"),
        pick(BODIES, F.floor(k / 24) + c).alias("description"), F.when(number == "1", "new-grad").alias("term_default"),
        F.when(k % 11 != 0, posted).alias("posted_at"), F.when(k % 7 == 0, True).when(k % 7 == 1, False).alias("remote_hint"),
        F.when(k % 5 != 0, F.concat(F.lit("r"), (k % 997).cast("string"))).alias("source_id"),
        F.when(k % 17 == 0, "U.S. Citizenship is Required").when(k % 17 == 1, "Does Not Offer Sponsorship").alias("sponsorship"),
        F.when(k % 19 == 0, F.array(F.lit("PhD"))).when(k % 19 == 1, F.array(F.lit("Master's"), F.lit("PhD"))).when(k % 19 == 2, F.array(F.lit("Bachelor's"))).alias("degrees"),
    )
    return rows.withColumn("posted_precision", D.posted_precision("source", "posted_at"))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored posting per order, for the views and reports."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    number = F.substr("o_orderpriority", F.lit(1), F.lit(1))
    posted = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.when(k % 3 == 0, 0).otherwise(k % 86400) * 1_000_000)
    seen = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + (86_400 + k % 7200) * 1_000_000)
    rows = read(spark, sf_dir, "orders").select(
        F.substr(F.sha2(k.cast("string"), 256), F.lit(1), F.lit(16)).alias("id"), k.alias("seq"), pick(COMPANIES, c).alias("company"), pick(COMPANY_NORMS, c).alias("company_norm"),
        pick(TITLES, k).alias("title"), pick(TITLE_NORMS, k).alias("title_norm"), pick(TERMS, k).alias("term"), pick(PLACES, k + c).alias("location"),
        pick(METROS, c).alias("location_norm"), (k % 7 == 0).alias("remote"), F.concat(F.lit("https://boards.example.com/jobs/"), (k % 701).cast("string")).alias("apply_url"),
        F.when(number == "1", "listings").when(number == "2", "swe").when(number == "3", "ai").otherwise("ats").alias("source"),
        F.when(k % 11 != 0, posted).alias("posted_at"), seen.alias("first_seen_at"), seen.alias("last_seen_at"), (1 + k % 3).cast("int").alias("tier"), (k % 101).cast("int").alias("score"),
        pick(STATUSES, k).alias("status"), pick(LINK_STATUSES, k).alias("link_status"),
        F.when(k % 29 == 0, F.array(F.lit("clearance"))).otherwise(F.array().cast("array<string>")).alias("disqualifiers"),
    )
    return rows.withColumn("posted_precision", D.posted_precision("source", "posted_at"))


def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run of each source (event type) per six hours of events."""
    slot = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / 21600) * 21600)
    rows = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source"), slot.alias("started_at")).agg(
        F.count("*").alias("raw_fetched"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("value") > 50).alias("midnight"), F.max("event_id").alias("last_id")
    )
    idle = F.col("last_id") % 6 == 0
    return rows.select(
        "source", "started_at", F.when(idle, 0).otherwise(F.col("raw_fetched") - F.when(F.col("last_id") % 5 == 0, F.col("raw_fetched")).otherwise(0)).alias("raw_fetched"),
        F.when(F.col("source") == "click", F.col("users")).alias("responding"), idle.alias("not_modified"), F.col("raw_fetched").alias("dated"),
        F.when(F.col("last_id") % 7 != 0, F.col("midnight")).alias("midnight"), (F.col("raw_fetched") % 13).alias("new"), (F.col("last_id") % 90).cast("double").alias("duration_s"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved links: page urls, some of them turned into job links."""
    k = F.col("page_id")
    final = (
        F.when(k % 25 == 7, F.concat(F.lit("https://careers.roblox.com/jobs/"), k.cast("string"))).when(k % 25 == 12, "https://eu.amazon.jobs/en/")
        .when(k % 5 == 0, F.concat(F.lit("https://boards.greenhouse.io/acme"), F.when(k % 2 == 0, F.concat(F.lit("/jobs/"), k.cast("string"))).otherwise("")))
        .when(k % 5 == 1, F.concat(F.lit("https://jobs.lever.co/acme/"), k.cast("string"), F.lit("?gh_jid="), k.cast("string")))
        .when(k % 5 == 2, "https://www.example.org/careers/").otherwise(F.col("url"))
    )
    status = F.element_at(F.array(*[F.lit(x) for x in (200, 200, 404, 403, 500, 200, 410, 429, 301)]), (k % 9 + 1).cast("int"))
    return read(spark, sf_dir, "pages").select(k.alias("id"), "url", final.alias("final_url"), status.alias("http_status"))


# --- the same in DuckDB -------------------------------------------------------


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values: list[str], key: str) -> str:
    return f"[{', '.join(map(text, values))}][CAST(({key}) % {len(values)} AS BIGINT) + 1]"


_SOURCE = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'listings' WHEN '2' THEN 'swe' WHEN '3' THEN 'ai' ELSE 'ats' END"
_POSTED = "CAST(o_orderdate AS TIMESTAMP) + to_seconds(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 86400 END)"
_PRECISION = (
    "CASE WHEN posted_at IS NULL THEN 'unknown' WHEN source = 'listings' THEN CASE WHEN epoch_us(posted_at) % 86400000000 = 0 THEN 'date' ELSE 'instant' END "
    "WHEN source = 'ats' THEN 'instant' WHEN source IN ('swe', 'ai') THEN 'age_derived' ELSE 'unknown' END"
)

RAW_SQL = f"""
raw0 AS (
  SELECT {_SOURCE} AS source, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 0 WHEN '2' THEN 1 WHEN '3' THEN 2 ELSE 3 END AS source_order, o_orderkey AS seq,
    {listed(COMPANIES, "o_custkey")} AS company, {listed(TITLES, "o_orderkey")} AS title, {listed(PLACES, "o_orderkey + o_custkey")} AS location,
    CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'https://boards.example.com/jobs/' || (o_orderkey % 701) END AS apply_url,
    {listed(BODIES, "o_orderkey // 24 + o_custkey")} AS description, CASE WHEN substr(o_orderpriority, 1, 1) = '1' THEN 'new-grad' END AS term_default,
    CASE WHEN o_orderkey % 11 <> 0 THEN {_POSTED} END AS posted_at, CASE o_orderkey % 7 WHEN 0 THEN true WHEN 1 THEN false END AS remote_hint,
    CASE WHEN o_orderkey % 5 <> 0 THEN 'r' || (o_orderkey % 997) END AS source_id,
    CASE o_orderkey % 17 WHEN 0 THEN 'U.S. Citizenship is Required' WHEN 1 THEN 'Does Not Offer Sponsorship' END AS sponsorship,
    CASE o_orderkey % 19 WHEN 0 THEN ['PhD'] WHEN 1 THEN ['Master''s', 'PhD'] WHEN 2 THEN ['Bachelor''s'] END AS degrees
  FROM orders
), raw AS (SELECT *, {_PRECISION} AS posted_precision FROM raw0)"""

POSTINGS_SQL = f"""
p0 AS (
  SELECT sha256(CAST(o_orderkey AS VARCHAR))[1:16] AS id, o_orderkey AS seq, {listed(COMPANIES, "o_custkey")} AS company, {listed(COMPANY_NORMS, "o_custkey")} AS company_norm,
    {listed(TITLES, "o_orderkey")} AS title, {listed(TITLE_NORMS, "o_orderkey")} AS title_norm, {listed(TERMS, "o_orderkey")} AS term,
    {listed(PLACES, "o_orderkey + o_custkey")} AS location, {listed(METROS, "o_custkey")} AS location_norm, o_orderkey % 7 = 0 AS remote,
    'https://boards.example.com/jobs/' || (o_orderkey % 701) AS apply_url, {_SOURCE} AS source, CASE WHEN o_orderkey % 11 <> 0 THEN {_POSTED} END AS posted_at,
    CAST(o_orderdate AS TIMESTAMP) + to_seconds(86400 + o_orderkey % 7200) AS first_seen_at, CAST(o_orderdate AS TIMESTAMP) + to_seconds(86400 + o_orderkey % 7200) AS last_seen_at,
    CAST(1 + o_orderkey % 3 AS INT) AS tier, CAST(o_orderkey % 101 AS INT) AS score, {listed(STATUSES, "o_orderkey")} AS status, {listed(LINK_STATUSES, "o_orderkey")} AS link_status,
    CASE WHEN o_orderkey % 29 = 0 THEN ['clearance'] ELSE [] END AS disqualifiers
  FROM orders
), p AS (SELECT *, {_PRECISION} AS posted_precision FROM p0)"""

HISTORY_SQL = """
h0 AS (
  SELECT event_type AS source, to_timestamp(floor(epoch(ts) / 21600) * 21600)::TIMESTAMP AS started_at, count(*) AS n, count(DISTINCT user_id) AS users,
    count(*) FILTER (value > 50) AS m, max(event_id) AS last_id FROM events GROUP BY ALL
), h AS (
  SELECT source, started_at, CASE WHEN last_id % 6 = 0 THEN 0 ELSE n - CASE WHEN last_id % 5 = 0 THEN n ELSE 0 END END AS raw_fetched,
    CASE WHEN source = 'click' THEN users END AS responding, last_id % 6 = 0 AS not_modified, n AS dated, CASE WHEN last_id % 7 <> 0 THEN m END AS midnight,
    n % 13 AS new, CAST(last_id % 90 AS DOUBLE) AS duration_s FROM h0
)"""

LINKS_SQL = """
links AS (
  SELECT page_id AS id, url, CASE WHEN page_id % 25 = 7 THEN 'https://careers.roblox.com/jobs/' || page_id WHEN page_id % 25 = 12 THEN 'https://eu.amazon.jobs/en/' ELSE CASE page_id % 5 WHEN 0 THEN 'https://boards.greenhouse.io/acme' || CASE WHEN page_id % 2 = 0 THEN '/jobs/' || page_id ELSE '' END
      WHEN 1 THEN 'https://jobs.lever.co/acme/' || page_id || '?gh_jid=' || page_id WHEN 2 THEN 'https://www.example.org/careers/' ELSE url END END AS final_url,
    [200, 200, 404, 403, 500, 200, 410, 429, 301][CAST(page_id % 9 AS BIGINT) + 1] AS http_status FROM pages
)"""
