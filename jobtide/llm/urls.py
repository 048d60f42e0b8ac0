"""URL filters: host-suffix and path-prefix expressions joined with rules on short hash prefixes.

Every URL becomes the expressions ``host suffix`` + ``path prefix`` (suffixes at label
bounds, prefixes up to each slash); every rule is one such expression. Suffixes of more
labels, or prefixes of more segments, than any rule has cannot match and are not made, so
the work for a URL is linear in its length. Both sides are hashed (SHA-256); the join is
on the first PREFIX hex digits and the full digests are compared after it. Among the
rules that fit, the longest wins; of entries with one expression, the rule, then the
greater verdict.

Rules are broadcast while there are at most BROADCAST_RULES of them. A larger list is
first reduced to the rules that occur at all, by a join with the distinct prefixes of
all expressions (so a hot host or suffix counts once per task), and then broadcast or,
if still large, joined by shuffle with adaptive splitting. URLs are judged once each;
the rows of a URL that many pages have meet its verdict where they lie.

Defined results: a null URL or one without ``://`` has an empty host and path and fits
no rule; repeated rows each give a row; a null id is carried; extra columns are ignored,
whatever their names; an empty table gives no rows; with no rules all is allowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import ascii_lower, let, spread_join, written

PREFIX = 8
BROADCAST_RULES = 200_000

#: The contract's rules (expression, verdict).
RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]
#: The method's own list, for URLs that no rule fits: the junk host families that the pages table shows (by reading it), under
#: each ending. A caller passes any other list as rows of kind ``list``.
FAMILIES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
LISTED = [f"{family}.example.{ending}/" for family in FAMILIES for ending in ("com", "net", "org")]


def url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Add host and path."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(F.col(url), F.instr(url, "://") + 3))
    df = df.withColumn("_rest", F.coalesce(rest, F.lit("")))
    df = df.withColumn("_host", F.regexp_extract("_rest", r"^[^/?#]*", 0))
    path = F.regexp_extract(F.substr(F.col("_rest"), F.length("_host") + 1), r"^[^?#]*", 0)
    return df.withColumn("path", path).withColumn("host", ascii_lower(F.col("_host"))).drop("_rest", "_host")


def expressions(labels: int, segments: int, host: str = "host", path: str = "path"):
    """The host-suffix and path-prefix expressions of a URL of at most so many labels and path segments, as an array column."""
    names, parts = F.split(host, r"\."), F.split(path, "/", segments + 2)

    def joined(n, p):
        suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(n), F.lit(labels))), lambda i: F.array_join(F.slice(n, -i, i), "."))
        depth = F.least(F.size(p) - 1, F.lit(segments + 1))
        prefixes = F.when(
            depth > 0, F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(p, 1, i), "/"), F.lit("/")))
        ).otherwise(F.array().cast("array<string>"))
        return let(prefixes, lambda q: F.flatten(F.transform(suffixes, lambda s: F.transform(q, lambda x: F.concat(s, x)))))

    return let(names, lambda n: let(parts, lambda p: joined(n, p)))


def rule_table(spark, rules: list[tuple[str, str]], kind: str) -> DataFrame:
    """A short list of (expression, verdict) as rules; long lists come as tables of their own."""
    rows = [F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict"), F.lit(kind).alias("kind")) for r, v in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict): the longest fitting rule of kind ``rule``, else a fitting one of kind ``list``, else allow.

    ``rules(rule, verdict, kind)``; a rule is a host, then a path that ends in ``/``.
    """
    source = url_parts(pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url")))
    urls = source.groupBy("host", "path").agg(F.count("*").alias("m"))
    rule_host, rule_path = F.substring_index("rule", "/", 1), F.expr("substr(rule, instr(rule, '/'))")
    most = rules.agg(F.max(F.size(F.split(rule_host, r"\."))), F.max(F.size(F.split(rule_path, "/")) - 2), F.count("*")).first()
    exprs = urls.select("host", "path", F.explode(expressions(most[0] or 1, most[1] or 0)).alias("expr"))
    exprs = exprs.withColumn("digest", F.sha2("expr", 256)).withColumn("short", F.substring("digest", 1, PREFIX)).drop("expr")
    listed = rules.withColumn("digest", F.sha2("rule", 256)).withColumn("short", F.substring("digest", 1, PREFIX))
    small = most[2] <= BROADCAST_RULES
    if not small:
        listed = written(listed.join(exprs.select("short").distinct(), "short", "left_semi"), "rules")
        small = listed.count() <= BROADCAST_RULES
    listed = listed.withColumnRenamed("digest", "full")
    hits = exprs.join(F.broadcast(listed) if small else listed, "short").where("digest = full")
    best = hits.groupBy("host", "path").agg(
        F.max(F.struct(F.col("kind") == "rule", F.length("rule"), "rule", "verdict")).alias("best")
    )
    best = best.select("host", "path", F.when(F.col("best.col1"), F.col("best.rule")).alias("rule"), F.col("best.verdict").alias("verdict"))
    judged = written(urls.join(best, ["host", "path"], "left"), "judged")
    total = judged.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    return spread_join(source, judged, ["host", "path"], total).select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    """The contract's rules, then the listed hosts, over all pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rules = rule_table(spark, RULES, "rule").union(rule_table(spark, [(h, "block") for h in LISTED], "list"))
    return judge(pages, rules)


OP10_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw_host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM parts
), urls AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM split
), rules(rule_host, rule_path, verdict, kind) AS (VALUES
  ('com', '/', 'allow', 1), ('example.com', '/en/', 'block', 1), ('www.example.com', '/en/', 'allow', 1),
  ('net', '/es/', 'block', 1), ('net', '/fr/', 'block', 1),
  @LISTED@
), best AS (
  SELECT u.page_id, u.host, u.path, r.rule_host || r.rule_path AS rule, r.verdict, r.kind,
    row_number() OVER (PARTITION BY u.page_id, u.host, u.path ORDER BY r.kind DESC NULLS LAST, length(r.rule_host || r.rule_path) DESC) AS rn
  FROM urls u LEFT JOIN rules r
    ON (u.host = r.rule_host OR ends_with(u.host, '.' || r.rule_host)) AND starts_with(u.path, r.rule_path)
)
SELECT page_id, host, path, CASE WHEN kind = 1 THEN rule END AS rule, coalesce(verdict, 'allow') AS verdict
FROM best WHERE rn = 1
""".replace("@LISTED@", ", ".join(f"('{x[:-1]}', '/', 'block', 0)" for x in LISTED))
