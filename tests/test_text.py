"""Canonical text: cases in the manner of the published rule tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from jobtide.functions import dates as D
from jobtide.functions import links as L
from jobtide.functions import text as T
from jobtide.operators.location import normalize_locations


def one(spark, values, column, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").orderBy("i").select(column).collect()]


def test_pinned_id(spark):
    key = T.dedupe_key(F.lit("stripe"), F.lit("software engineer intern"), F.lit("sf-bay"), F.lit("fall-2026"))
    assert spark.range(1).select(T.posting_id(key)).first()[0] == "d93ecfbbf9230857"


def test_basic_text(spark):
    got = one(spark, ["Café  &  Bar", None, "", "ﬁne ½ Ⅳ ＆ Ａ１", "a—b", "İstanbul", "日本 x"], T.basic_text("x"))
    assert got == ["cafe and bar", "", "", "fine 1 2 iv and a1", "a b", "istanbul", "x"]


@pytest.mark.parametrize(
    "same",
    [
        ["SWE Intern, Fall 2026", "Software Engineer Co-op (Fall 2026)", "Software Engineering Internship"],
        ["Software Engineer 1", "Software Engineer I", "Software Engineer", "Software Engineer, Level 0"],
        ["Software Engineer L4", "Software Engineer Level 4", "Software Engineer IV"],
        ["SDE II - Req #12345", "Software Developer 2"],
        ["Data Scientist (Remote, US)", "Data Scientist"],
    ],
)
def test_titles_that_collapse(spark, same):
    assert len(set(one(spark, same, T.normalize_title("x")))) == 1


def test_titles_that_stay_apart(spark):
    titles = ["Software Engineer (Backend)", "Software Engineer (Computer Vision)", "Software Engineer 2", "Software Engineer 3", "Hardware Engineer"]
    assert len(set(one(spark, titles, T.normalize_title("x")))) == len(titles)


def test_companies(spark):
    got = one(spark, ["The Stripe, Inc.", "Facebook", "Scale AI", "Amazon Web Services, Inc.", "Co", None], T.normalize_company("x"))
    assert got == ["stripe", "meta", "scale ai", "amazon", "", ""]


def test_locations(spark):
    want = {
        "San Francisco, CA": "sf-bay", "South San Francisco": "sf-bay", "Brooklyn, NY": "nyc", "Brooklyn, OH": "us-oh", "Brooklyn, OH, USA": "us-oh", "Cambridge, UK": "london",
        "Cambridge, MA": "boston", "Portland, ME": "us-me", "Portland, OR": "portland", "Seattle, Washington": "seattle", "Washington, DC": "dc-metro", "Remote": "remote",
        "New York, NY; Austin, TX": "nyc", "Connecticut, USA": "us-ct", "United States": "us", "TBD": "unknown", "In-Office": "unknown", "Lyon, France": "lyon-france", None: "unknown",
    }
    df = spark.createDataFrame([(k, None) for k in want], "location string, remote_hint boolean")
    assert {r.location: r.location_norm for r in normalize_locations(df).collect()} == want


def test_terms(spark):
    rows = [
        ("Intern, Fall 2026", None, None, "fall-2026"), ("2027 Summer Intern", None, None, "summer-2027"), ("Engineer", "for Spring '27", None, "spring-2027"), ("New Grad Engineer", None, None, "new-grad"),
        ("Graduate Trader", None, None, "new-grad"), ("Graduate Research Intern", None, None, "unknown"), ("Engineer", None, " NEW-GRAD ", "new-grad"), ("Engineer", None, "someday", "unknown"),
        ("Intern Fall 2031", "Winter 2027", None, "winter-2027"), (None, None, None, "unknown"),
    ]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, t string, b string, d string")
    assert [r[0] for r in df.orderBy("i").select(T.infer_term("t", "b", "d")).collect()] == [r[3] for r in rows]


def test_years_and_heads(spark):
    assert one(spark, ["3-5 years of experience", "10+ years experience. 2 years of experience", "0 years experience", None, "5 years of fun. experience"], T.min_years("x")) == [3, 2, None, None, None]
    assert one(spark, ["ML Engineer - Ads", "Engineer, Infra", "Engineer (x)", "A–B", None], T.role_head("x")) == ["ML Engineer", "Engineer", "Engineer", "A–B", ""]


def test_links(spark):
    urls = ["https://boards.greenhouse.io/acme", "https://boards.greenhouse.io/acme/jobs/42", "https://x.org/careers/", "https://x.org/a?gh_jid=7", "https://www.jobs.apple.com:443/x", "not a url", "", None]
    assert one(spark, urls, L.looks_like_index("x")) == [True, False, True, False, False, False, False, False]
    assert one(spark, urls, L.has_job_id("x")) == [False, True, False, True, False, False, False, False]
    assert one(spark, urls, L.is_known_blocked("x"))[4] is True
    assert one(spark, ["https://u:p@a.b.example.com:80/x", "https://localhost/x"], L.host_key("x")) == ["example.com", "localhost"]
    assert one(spark, ["=1+1", "-x", "ok", None], L.neutralize_formula("x")) == ["'=1+1", "'-x", "ok", ""]
    assert one(spark, ["a secret-secret-secret b"], L.redact_secrets("x", ["secret-secret-secret", "short", "secret-secret"])) == ["a [redacted] b"]


def test_dates(spark):
    got = one(spark, ["1700000000", "1700000000000", "2026-01-02T03:04:05Z", "2026-01-02T03:04:05", "soon", "", None], F.unix_seconds(D.parse_timestamp("x")))
    assert got == [1700000000, 1700000000, 1767323045, 1767323045, None, None, None]
    now = F.lit("2026-07-01 12:00:00").cast("timestamp")
    assert one(spark, ["3h", "<b>2d</b>", "1mo", "x", None], (F.unix_seconds(now) - F.unix_seconds(D.age_to_posted_at("x", now)))) == [10800, 172800, 2592000, None, None]
    quiet = one(spark, ["2026-07-01 05:00:00", "2026-07-01 12:59:00", "2026-07-01 13:00:00", "2026-01-01 13:30:00"], D.is_quiet(F.col("x").cast("timestamp")))
    assert quiet == [True, True, False, True]
    assert [str(x) for x in one(spark, ["2026-03-04", "03/04/2026", "31/12/2026", "2026/3/4", "x"], D.parse_applied_on("x"))] == ["2026-03-04", "2026-03-04", "2026-12-31", "2026-03-04", "None"]


def test_basic_text_of_every_code_point(spark):
    """Each character, inside a word and beside one, as the published rule folds it."""
    import re
    import unicodedata

    def rule(text):
        plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
        return re.sub("[^a-z0-9]+", " ", plain.replace("&", " and ")).strip()

    points = [p for p in range(1, 0x110000) if not 0xD800 <= p < 0xE000]
    texts = ["x ".join(f"a{chr(p)}b" for p in points[i : i + 256]) for i in range(0, len(points), 256)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(8)
    got = {r.i: r.g for r in df.select("i", T.basic_text("t").alias("g")).collect()}
    assert [i for i, t in enumerate(texts) if got[i] != rule(t)] == []
    styled = "".join(chr(0x1D5D4 + ord(c) - 65) if c.isupper() else chr(0x1D5EE + ord(c) - 97) if c.islower() else c for c in "Software Engineer")
    assert spark.createDataFrame([(styled,)], "t string").select(T.basic_text("t")).first()[0] == "software engineer"


def test_strip_html_equals_a_loop_over_all_pages(spark):
    import html
    import re

    from jobtide.sources.feeds import BODY_LIMIT, strip_html

    def loop(raw):
        text = html.unescape(html.unescape(raw or ""))
        text = re.sub(r"(?i)<(br|/p|/div|/li|/h[1-6])[^>]*>", "\n", text)
        text = re.sub(r"[ \t\r\f\x0b]+", " ", re.sub(r"<[^>]+>", " ", text))
        return re.sub(r"\n\s*\n+", "\n", text, flags=re.ASCII).strip(" \t\n\r\f\x0b")[:BODY_LIMIT]

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html")
    more = spark.createDataFrame([("&amp;lt;b&amp;gt;A &amp;amp; B&lt;/p&gt;x",), (None,), ("",), ("a &notin; b &copy; " * 900,), ("<ul><li>1</li>\n \n<LI>2</Li></ul>",)], "html string")
    rows = pages.union(more).select("html", strip_html("html").alias("got")).collect()
    assert len(rows) > 50 and [r.html for r in rows if r.got != loop(r.html)] == []
