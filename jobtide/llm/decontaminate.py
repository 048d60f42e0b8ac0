"""Benchmark decontamination by winnowing, with DataFrame functions only.

Every run of GRAM words is hashed; in each sliding window of SPAN hashes the smallest
is kept as a fingerprint. Two texts that share GRAM + SPAN - 1 words in a row (here
exactly the contract's window of 10) share a fingerprint, so joining the fingerprints
of documents with those of benchmark items finds every document that can hold a
window. Hits are then extended to whole windows: in the documents found, every
window is looked up by 128 bits of hash over its 64-bit word hashes, and the words
inside matched windows are counted. Items shorter than a window have no such guarantee and
are looked up by their whole length in every document.

All item widths below a window share one pass over the documents. The benchmark side is
broadcast while it has at most BROADCAST_ROWS fingerprints or windows (8 to 20 bytes
each, and the item's id); beyond, the joins shuffle.

Defined results: null and empty texts have no words and no hits; an item without words
has no window. Rows that repeat an id and a text share their result; rows that repeat
an id with other texts are kept apart. A null id is carried. With an empty benchmark
nothing is contaminated. Repeated item ids count once; a null item id is the empty
string. Very long texts are read whole: a document's places are one row each, and only its
spans and items (as many as the answer itself names) come together. Extra columns are
ignored, or carried whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import ascii_lower, written

WINDOW, GRAM = 10, 5
SPAN = WINDOW - GRAM + 1
BROADCAST_ROWS = 1_000_000

_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
EMPTY_DIGEST = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def words(text: str | Column) -> Column:
    """A-Z lower-cased runs of digits, a-z and characters beyond ASCII."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _SEPARATOR), "")


def gram_hashes(hashes: str, width: int) -> Column:
    """Hash of the ``width`` word hashes from each position on; empty for shorter texts."""
    whole = F.size(hashes) - (width - 1)
    grams = F.transform(
        F.sequence(F.lit(1), F.greatest(whole, F.lit(1))), lambda i: F.xxhash64(*[F.get(F.col(hashes), i + (k - 1)) for k in range(width)])
    )
    return F.when(whole > 0, grams).otherwise(F.array().cast("array<bigint>"))


def fingerprints(grams: str, span: int = SPAN) -> Column:
    """The distinct minima of all windows of ``span`` gram hashes; texts of fewer grams keep their least."""
    count = F.size(grams) - (span - 1)
    minima = F.transform(
        F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.least(*[F.get(F.col(grams), i + k) for k in range(span)])
    )
    return F.when(F.size(grams) > 0, F.array_distinct(minima)).otherwise(F.array().cast("array<bigint>"))


def _hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))


def _windows(df: DataFrame, widths: list[int], keep: list[str]) -> DataFrame:
    """One row per window of each of the widths, in one pass: kept columns, position, width and two hashes of its word hashes (128 bits)."""

    def grams(width: int) -> Column:
        whole = F.size("h") - (width - 1)
        here = lambda i: [F.get(F.col("h"), i + (k - 1)) for k in range(width)]
        found = F.transform(
            F.sequence(F.lit(1), F.greatest(whole, F.lit(1))),
            lambda i: F.struct((i - 1).alias("pos"), F.lit(width).alias("width"), F.xxhash64(*here(i)).alias("x"), F.xxhash64(F.lit(width), *here(i)).alias("y")),
        )
        return F.when(whole > 0, found).otherwise(F.array().cast("array<struct<pos:int,width:int,x:bigint,y:bigint>>"))

    # the outer form: for the plain one the optimiser adds a filter that would evaluate the arrays again inside each lambda
    every = [grams(w) for w in widths]
    rows = df.withColumn("g", F.concat(*every) if len(every) > 1 else every[0]).select(*keep, F.explode_outer("g").alias("g"))
    return rows.where("g is not null").select(*keep, "g.pos", "g.width", "g.x", "g.y")


def _empty(df: DataFrame, *fields: str) -> DataFrame:
    """A table of these columns without rows, as a plan."""
    return df.sparkSession.range(0).select(*[F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in fields])


def _sized(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def matches(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs(key, w) x items(item, w): every place (key, pos, width, x, y) of a document where a window of any item occurs, and the
    items' windows (item, width, x, y).

    Places meet the distinct windows, so a window that many items share is one row a place.
    """
    items = items.where(F.size("w") > 0).transform(_hashed).withColumn("width", F.least(F.size("w"), F.lit(WINDOW)))
    items = written(items, "items")
    widths = [r["width"] for r in items.select("width").distinct().orderBy("width").collect()]  # at most WINDOW values
    own = _empty(docs, "item string", "width int", "x bigint", "y bigint")
    for width in widths:
        own = own.union(_windows(items.where(F.col("width") == width), [width], ["item"]).select("item", "width", "x", "y"))
    own = written(own.distinct(), "windows")
    distinct = written(own.select("width", "x", "y").distinct(), "distinct")
    wanted = _sized(distinct, distinct.count() <= BROADCAST_ROWS)
    found = _empty(docs, "key binary", "pos int", "width int", "x bigint", "y bigint")
    short = [w for w in widths if w < WINDOW]
    if short:
        found = found.union(_windows(docs.transform(_hashed), short, ["key"]))
    if WINDOW in widths:
        prints = items.where(F.col("width") == WINDOW).withColumn("g", gram_hashes("h", GRAM))
        prints = prints.select(F.explode(fingerprints("g")).alias("print")).distinct()
        few = prints.count() <= BROADCAST_ROWS
        rows = docs.transform(_hashed).withColumn("g", gram_hashes("h", GRAM)).select("key", F.explode_outer(fingerprints("g")).alias("print"))
        hits = written(rows.join(_sized(prints, few), "print", "left_semi").select("key").distinct(), "hits")
        part = docs.join(_sized(hits, hits.count() <= BROADCAST_ROWS), "key", "left_semi")
        found = found.union(_windows(part.transform(_hashed), [WINDOW], ["key"]))
    found = written(found.join(wanted, ["width", "x", "y"], "left_semi").select("key", "pos", "width", "x", "y"), "places")
    return found, own


def covered(spans: str) -> Column:
    """Number of positions inside the union of spans (an array of (pos, width))."""
    step = F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["pos"] + s["width"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), s["pos"] + s["width"] - F.greatest(acc["end"], s["pos"]))).alias("n"),
        ),
    )
    return step["n"]


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", carry: bool = False) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated), a row for each document row.

    With ``carry`` all input columns come first instead of the id alone.
    """
    body = docs[text_col].cast("string")
    # rows are told apart by id and text
    key = F.unhex(F.md5(F.concat_ws("|", F.coalesce(docs[id_col].cast("string"), F.lit("-")), F.xxhash64(body).cast("string"), F.crc32(body.cast("binary")).cast("string"))))
    keyed = docs.select(key.alias("key"), words(body).alias("w"))
    items = benchmark.select(benchmark[item_col].cast("string").alias("item"), words(benchmark[item_text].cast("string")).alias("w"))
    items = items.withColumn("item", F.coalesce("item", F.lit("")))
    found, own = matches(keyed, items)
    spans = found.groupBy("key").agg(F.collect_set(F.struct("pos", "width")).alias("spans")).select("key", covered("spans").alias("n_hit"))
    # a document's list of items follows from its distinct windows; a window of many items is looked up once a document
    in_docs = found.select("key", "width", "x", "y").distinct()
    named = in_docs.join(_sized(own, own.count() <= BROADCAST_ROWS), ["width", "x", "y"]).select("key", "item").distinct()
    named = named.groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    named = named.select("key", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    per = spans.join(named, "key")
    per = written(per, "contaminated")
    mine = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else [docs[id_col].alias("id")]
    out = docs.select(key.alias("key"), *mine, F.size(words(body)).cast("long").alias("n_words"))
    out = out.join(_sized(per, per.count() <= BROADCAST_ROWS), "key", "left")
    return out.select(
        *(["row.*"] if carry else [F.col("id").alias(id_col)]),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.lit(EMPTY_DIGEST)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    """The contract's counts of every whole document against the whole benchmark."""
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS width, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, p, width, array_to_string(w[p:p + width - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, width, unnest(range(1, greatest(len(w) - width, -1) + 2)) AS p FROM d, (SELECT DISTINCT width FROM bw) WHERE len(w) >= width)
), hit AS (SELECT doc_id, p, dw.width AS width, item FROM dw JOIN bw ON dw.phrase = bw.phrase AND dw.width = bw.width
), cov AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + width)) AS q FROM hit) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, 'e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855') AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
