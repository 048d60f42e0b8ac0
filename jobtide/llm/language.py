"""Language identification by word-first backoff.

A word that was seen in training scores its log frequency in each language; an unseen
word falls back to its character 4-grams, then 3-grams, 2-grams and single characters:
the longest order of which any is known gives the mean log frequency. A text's scores
are the sums over its words; the language is the largest, the score its posterior.

Training takes a documented sample of at most MAX_TRAIN_DOCS texts a language, chosen
by a hash of the id; every word and gram of the sample is in the model, so what is sent to
the tasks is bounded by the sample. A word or gram has an entry for each language that it
occurs in and no more; the other languages share one value.

Defined results: a letter is a character of Unicode category L, in training and in
scoring. Null texts and texts without a letter are ``und`` with score 0; ties go to the
first language in name order, which is also the answer for words of which no gram is
known. With no training rows every text is ``und``. Repeated rows each give a row; a
null id is carried (and never trained on). Very long texts are scored whole. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import blocks, segment_ids, text_bytes

MAX_TRAIN_DOCS = 4000
ORDERS = (4, 3, 2, 1)
MEMO_WORDS = 300_000
UNKNOWN = "und"

def _letter_runs() -> re.Pattern:
    """Runs of letters: word characters but digits, ``_`` and the numeric signs (such as a superscript 2) that count as word characters too."""
    signs = "".join(c for c in map(chr, range(0x80, 0x110000)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())
    return re.compile(rf"[^\W\d_{signs}]+")


_LETTERS = _letter_runs()


def training_rows(docs: DataFrame, id_col: str, lang_col: str, per_language: int = MAX_TRAIN_DOCS) -> DataFrame:
    """At most about ``per_language`` rows of each language, by a hash of the id."""
    named = docs.where(docs[lang_col].isNotNull() & docs[id_col].isNotNull())
    sizes = named.groupBy(F.col(lang_col).alias("_lang")).agg((per_language / F.count("*")).alias("_share"))
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit("language")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return named.join(F.broadcast(sizes), named[lang_col] == sizes["_lang"]).where(place < F.col("_share"))


class Entries(NamedTuple):
    """Log frequencies of the keys of one table: ``floor`` of each language, and for each key what its own languages have above that."""

    keys: dict[str, int]
    floor: np.ndarray
    begin: np.ndarray
    lang: np.ndarray
    above: np.ndarray


class Model:
    """Log frequencies of words and of character grams, by language, and only for the languages that have them."""

    def __init__(self, languages: list[str], words: pa.Table, grams: pa.Table):
        self.languages = languages
        self.words, self.grams = self._entries(words), self._entries(grams)

    def _entries(self, table: pa.Table) -> Entries:
        keys: dict[str, int] = {}
        at = np.array([keys.setdefault(k, len(keys)) for k in table.column("key").to_pylist()], np.int64)
        number = {x: i for i, x in enumerate(self.languages)}
        lang = np.array([number[x] for x in table.column("lang").to_pylist()], np.int64)
        n = table.column("n").to_numpy().astype(float)
        total = np.bincount(lang, weights=n, minlength=len(self.languages)) + 0.5 * max(1, len(keys))
        by = np.argsort(at, kind="stable")
        begin = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(keys)))])
        return Entries(keys, np.log(0.5 / total), begin, lang[by].astype(np.int32), np.log((n[by] + 0.5) / 0.5))


def _word_column(text):
    """Lower-cased letter runs."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}]+"), "")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = MAX_TRAIN_DOCS) -> Model:
    """Count words and grams of the sample; grams come from the counted words, not from the texts again."""
    rows = training_rows(docs.select(id_col, text_col, lang_col), id_col, lang_col, per_language)
    words = rows.select(F.col(lang_col).alias("lang"), F.explode(_word_column(F.coalesce(text_col, F.lit("")))).alias("key"))
    words = words.groupBy("lang", "key").agg(F.count("*").alias("n"))
    marked = F.concat(F.lit("<"), F.col("key"), F.lit(">"))
    # the marks alone are no grams: single characters come from the word itself
    grams = [_grams(words, marked if k > 1 else F.col("key"), k) for k in ORDERS]
    gram_counts = grams[0]
    for g in grams[1:]:
        gram_counts = gram_counts.unionByName(g)
    gram_counts = gram_counts.groupBy("lang", "key").agg(F.sum("n").alias("n"))
    # bounded by the sample
    tables = [counts.select("lang", "key", "n").toArrow() for counts in (words, gram_counts)]
    names = [r[0] for r in rows.select(lang_col).distinct().orderBy(lang_col).collect()]  # bounded by the languages
    return Model(names, *tables)


def _grams(words: DataFrame, marked, k: int) -> DataFrame:
    """The k-grams of each counted word between its marks, with the word's count."""
    starts = F.when(F.length(marked) >= k, F.sequence(F.lit(1), F.length(marked) - (k - 1)))
    rows = words.select("lang", "n", marked.alias("marked"), F.explode(starts).alias("at"))
    return rows.select("lang", "n", F.substr("marked", F.col("at"), F.lit(k)).alias("key"))


class Scorer:
    """Score rows of tokens, remembered by their bytes; row 0 is for tokens without letters."""

    def __init__(self, model: Model):
        self.model = model
        self.width = len(model.languages)
        self.clear()

    def clear(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.rows = np.zeros((1, self.width), np.float32)

    def parts(self, word: str) -> tuple[Entries, list[int]]:
        """The entries whose mean is the word's score: its own, or those of its known grams of the longest order that has any."""
        at = self.model.words.keys.get(word)
        if at is not None:
            return self.model.words, [at]
        get = self.model.grams.keys.get
        for k in ORDERS:
            marked = f"<{word}>" if k > 1 else word
            known = [g for g in map(get, [marked[i : i + k] for i in range(len(marked) - k + 1)]) if g is not None]
            if known:
                return self.model.grams, known
        return self.model.grams, []

    def learn(self, tokens: list[bytes]) -> None:
        """Add the score rows of new tokens: sums over their words."""
        named = 0
        used: dict[int, tuple[Entries, list[int], list[int], list[float]]] = {id(t): (t, [], [], []) for t in (self.model.words, self.model.grams)}
        for token in tokens:
            text = token.decode().lower()
            words = [text] if text.isalpha() else _LETTERS.findall(text)
            if not words:
                self.memo[token] = 0
                continue
            self.memo[token] = len(self.rows) + named
            for word in words:
                table, own = self.parts(word)
                if own:
                    _, at, owners, shares = used[id(table)]
                    at += own
                    owners += [named] * len(own)
                    shares += [1 / len(own)] * len(own)
            named += 1
        fresh = np.zeros(named * self.width)
        for table, at, owners, shares in used.values():
            if not at:
                continue
            at, owners, shares = np.array(at), np.array(owners), np.array(shares)
            fresh += np.outer(np.bincount(owners, weights=shares, minlength=named), table.floor).reshape(-1)
            sizes = table.begin[at + 1] - table.begin[at]
            place = np.arange(int(sizes.sum())) + np.repeat(table.begin[at] - np.cumsum(sizes) + sizes, sizes)
            cell = np.repeat(owners, sizes) * self.width + table.lang[place]
            fresh += np.bincount(cell, weights=np.repeat(shares, sizes) * table.above[place], minlength=len(fresh))
        self.rows = np.concatenate([self.rows, fresh.reshape(named, self.width).astype(np.float32)])

    def __call__(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        if len(self.memo) > MEMO_WORDS:
            self.clear()
        lists = [t.split() for t in texts]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        self.learn(list(set().union(*lists).difference(self.memo)))
        at = np.fromiter((i for ws in lists for i in map(self.memo.__getitem__, ws)), np.int64, int(counts.sum()))
        row = segment_ids(counts)
        some = np.bincount(row[at > 0], minlength=len(texts)) > 0
        total = np.stack([np.bincount(row, weights=self.rows[at, j], minlength=len(texts)) for j in range(self.width)], axis=1) if self.width else np.zeros((len(texts), 1))
        best = total.argmax(axis=1)
        score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        known = some & (self.width > 0)
        return [self.model.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, score, 0.0)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score), a row for each input row; one Arrow map, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for block in blocks(batches, "body"):
            names, score = scorer(text_bytes(block.column("body")))
            yield pa.RecordBatch.from_arrays([block.column("id"), pa.array(names, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    source = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("body"))
    return source.mapInArrow(run, "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def fold(id_col: str, parts: int):
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def op8_word_backoff_language(spark, sf_dir: str) -> DataFrame:
    """Languages of all whole documents, learned from the documents outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(fold("doc_id", 4) != 2))
    out = predict(docs, model)
    return out.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
