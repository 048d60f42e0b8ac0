"""Spelling variant grouping by pivotal grams.

Two words are near if one edit (a code point inserted, deleted or replaced) makes one the
other. Grams (pairs of neighbouring code points) are ordered by how many words have them,
rarest first.

* A word's prefix is its first three grams in that order, with all others equal to the
  third. Its pivots are two disjoint grams of the prefix, the pair that the fewest words
  share in sum, chosen by dynamic programming over positions.
* One edit leaves one pivot whole. Of two near words, the one whose prefix ends earlier in
  the order finds that pivot in the other's prefix: pivots are joined with prefixes.
* Position limits: what lies before the edit has the same place in both words from the
  left, what lies behind it from the right. So a pivot meets a gram of the other word
  only with all that precedes it (edit behind it) or follows it (edit before it, the
  same on reversed words): the key is a part of the word, and what is left is the window
  that holds the edit.
* A key with many pivots and prefixes is split by the place of the edit: the key of a
  place is all of the word but that code point, and the word itself where the other word
  has one more. At most an alphabet of words shares such a key at a place, so no frequent
  beginning makes all pairs of its words. An edit more than SPAN places behind the key
  waits for the next round, in which these places belong to the key.
* Pairs that share a key are verified by their edit distance. They are pairs of numbers,
  dealt in order of count and word, so that the form is the smallest number.

Words of more than LONG code points have their first and last LONG / 2 as pivots (an edit
leaves one of them whole), so that a word's rows do not grow with its length.

A word's form is its near word with the largest count (ties: the smallest), where that is
FACTOR times its own or more; its root is the last form on the way. Counts grow by FACTOR
with each step, so forms end.

Defined results: null texts, empty texts and texts without letters have no words; a text
without an id counts as the contract's text ``:<run>`` with no id before it. Repeated rows
count again, each with its own id. Very long texts and words are whole. An empty table
gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import Memo, blocks, drop_written, scratch, small_batches, spread_join, written

#: Code points of a gram; grams of a prefix for one edit (GRAM + 1); pivots.
GRAM, PREFIX = 2, 3
SHORTEST, SEEN, FACTOR = 7, 2, 10
#: From how many code points on the ends are the pivots.
LONG = 64
#: Places at which a round looks for the edit; a key is split if it makes more than CROWDED pairs a row.
SPAN, CROWDED = 64, 12
#: Distinct words that a task counts before it hands them on.
FLUSH = 200_000
#: Words that a task cuts into grams, about.
TASK_WORDS = 50_000

#: Code points of words: A-Z to a-z, letters to themselves, the rest to spaces (Latin-1 bytes, which are the code points).
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def count_words(docs: DataFrame, spoil: int = 31) -> DataFrame:
    """(word, n): the letter runs of docs(id, body), each with a code point deleted where ``spoil`` divides its hash with the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        utf8 = Memo(lambda w: w.decode("latin-1").encode())
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in counts], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for block in blocks(batches, "body"):
            for key, text in zip(block.column("id").to_pylist(), block.column("body").to_pylist(), strict=True):
                seed = zlib.crc32(b"%s:" % (b"" if key is None else str(key).encode()))
                # a character beyond U+00FF becomes ?, which is no letter
                for word, n in Counter((text or "").encode("latin-1", "replace").translate(_FOLD).split()).items():
                    if len(word) < SHORTEST:
                        continue
                    mark = zlib.crc32(utf8[word], seed)
                    if mark % spoil == 0:
                        at = mark % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < SHORTEST:
                            continue
                    counts[word] += n
            utf8.trim()
            if len(counts) > FLUSH:
                yield out()
                counts.clear()
        yield out()

    return docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def pivots(prefix: list[tuple[int, int]]) -> list[int]:
    """Places of two disjoint grams of ``prefix(place, cost)``, in order of place, with the least cost in sum (the first such pair)."""
    best: tuple[int, int, int] | None = None
    ahead, single = 0, None  # the cheapest gram that ends before the one looked at
    for place, cost in prefix:
        while prefix[ahead][0] + GRAM <= place:
            if single is None or prefix[ahead][1] < single[1]:
                single = prefix[ahead]
            ahead += 1
        if single is not None and (best is None or single[1] + cost < best[0]):
            best = (single[1] + cost, single[0], place)
    return list(best[1:])


def _windows(words: DataFrame, grams: dict[str, int]) -> DataFrame:
    """(pivot, rev, text, id, a, rank): rows of pivots and of prefix grams; text[:a] is the key, the edit is behind it. ``rev``: reversed words."""
    order = {g: i for i, (g, _) in enumerate(sorted(grams.items(), key=lambda x: (x[1], x[0])))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for word, at in zip(batch.column("word").to_pylist(), batch.column("id").to_pylist(), strict=True):
                size, back = len(word), word[::-1]
                if size >= LONG:
                    rows += [(p, r, t, at, LONG // 2, 0) for p in (True, False) for r, t in ((False, word), (True, back))]
                if size > LONG:
                    continue
                places = sorted((order[word[i : i + GRAM]], i) for i in range(size - GRAM + 1))
                last = places[PREFIX - 1][0]
                prefix = sorted((i, grams[word[i : i + GRAM]]) for g, i in places if g <= last)
                for pivot, chosen in ((True, pivots(prefix)), (False, [i for i, _ in prefix])):
                    rows += [(pivot, False, word, at, i + GRAM, last) for i in chosen]
                    rows += [(pivot, True, back, at, size - i, last) for i in chosen]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            types = [pa.bool_(), pa.bool_(), pa.string(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["pivot", "rev", "text", "id", "a", "rank"])

    return words.mapInArrow(run, "pivot boolean, rev boolean, text string, id long, a int, rank int")


def _key(*parts: Column) -> Column:
    """A hash of the parts whose last bit is ``rev``, so that no reversed word meets one that is not."""
    return F.shiftleft(F.xxhash64(*parts), 1).bitwiseOR(F.col("rev").cast("long"))


def _open(rows: DataFrame) -> DataFrame:
    """Rows with the key of an edit anywhere behind ``a``."""
    return rows.withColumn("key", _key(F.expr("substr(text, 1, a)")))


def _placed(rows: DataFrame) -> DataFrame:
    """A row for each of the next SPAN places of the edit, keyed by the text without that code point, and one for the text itself (place -1)."""
    last = F.least(F.col("a") + SPAN, F.length("text"))
    rows = rows.withColumns({"last": last, "place": F.explode(F.sequence("a", last))})
    rows = rows.withColumn("place", F.when(F.col("place") < F.col("last"), F.col("place")).otherwise(-1))
    rest = F.when(F.col("place") < 0, F.col("text")).otherwise(F.concat(F.expr("substr(text, 1, place)"), F.expr("substr(text, place + 2)")))
    return rows.withColumn("key", _key(rest, F.col("a")))


def _meet(rows: DataFrame) -> DataFrame:
    """(id, other): words whose pivots (rows of one) meet a gram of a prefix that does not end earlier, at one edit."""
    one = rows.where("pivot").select("key", "text", "id", "rank", "place")
    two = rows.where("not pivot").select("key", F.col("text").alias("found"), F.col("id").alias("other"), F.col("rank").alias("rank2"), F.col("place").alias("place2"))
    pairs = one.join(two, "key").where("id <> other and rank <= rank2 and (place = place2 or place < 0 or place2 < 0)")
    return pairs.where("abs(length(text) - length(found)) <= 1").where(F.levenshtein("text", "found", 1) == 1).select("id", "other")


def near_words(words: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(id, other): the pairs of ``words(id, word)`` (distinct, written) at one edit, in both directions."""
    cut = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr("word", i, F.lit(GRAM)))).alias("gram"))
    grams = {r[0]: r[1] for r in cut.groupBy("gram").count().collect()}  # at most the pairs of 90 letters
    dealt = words.repartition(words.count() // TASK_WORDS + 1)
    rows, found = written(_open(_windows(dealt, grams)), "windows"), words.select("id", F.col("id").alias("other")).limit(0)
    while not rows.isEmpty():
        p, q = F.count_if("pivot"), F.count_if(~F.col("pivot"))
        # a pivot is in its own word's prefix, so a key with one prefix has one word
        sizes = rows.groupBy("key").agg(p.alias("p"), q.alias("q")).where("p > 0 and q > 1")
        split = F.col("p") * F.col("q") > crowded * (F.col("p") + F.col("q"))
        sizes = written(sizes.select("key", (F.col("p") + F.col("q")).alias("m"), split.alias("split")), "sizes")
        met = written(spread_join(rows, sizes, ["key"], rows.count()).drop("m"), "met")
        drop_written(rows)
        drop_written(sizes)
        for some in (met.where("not split").withColumn("place", F.lit(-1)), _placed(met.where("split"))):
            found = found.union(written(_meet(some), "pairs"))
        further = met.where("split").where(F.col("a") + SPAN <= F.length("text")).withColumn("a", F.col("a") + SPAN)
        rows = written(_open(further.drop("split")), "windows")
        drop_written(met)
    return found.union(found.select("other", "id")).repartition("id").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms(word, form)`` (written): each round doubles the steps that are taken."""
    step = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = written(step.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        step = after.select("word", "root")
        if after.where("moved").isEmpty():
            return step


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spoil: int = 31) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of at least SHORTEST code points and SEEN occurrences."""
    spark = docs.sparkSession
    source = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("body"))
    with scratch(spark) as kept:
        with small_batches(spark):
            counted = count_words(source, spoil).where(F.col("n") >= SEEN).orderBy(F.desc("n"), "word")
            words = written(counted.withColumn("id", F.monotonically_increasing_id()), "words")
        best = near_words(words).groupBy("id").agg(F.count("*").alias("n_near"), F.min("other").alias("best"))
        forms = words.select(F.col("id").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
        best = words.join(best, "id").join(forms, "best")
        far = F.col("form_n") >= FACTOR * F.col("n")
        best = best.select("word", "n_near", F.when(far, F.col("form")).alias("form"), F.when(far, F.col("form_n")).alias("form_n"))
        best = written(best, "near")
        roots = _roots(best.where("form is not null").select("word", "form"))
        out = words.join(best, "word", "left").join(roots, "word", "left")
        out = written(out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"), "variants")
        kept.append(out)
    return out


def op13_pivotal_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """The words of all whole documents with their forms and roots."""
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
