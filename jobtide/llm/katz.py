"""Language-model scoring by Katz backoff over n-grams.

P(w | h) = d(c) * c / T(h) for a word w seen c times behind the history h (T(h): all words
behind h), else a(h) * P(w | h without its first word). d are Good-Turing discounts for
counts of 1 to SMALL. a(h) spreads exactly what discounting left over the words that were
never seen behind h, so that the probabilities behind every history sum to one. Below
single words stands one class for all unknown words, which gets what is left there.

Texts become blocks of at most BLOCK_TOKENS tokens (``token_blocks``), written once. Then,
an order at a time:

1. Each block asks, for every different n-gram it has, by how many training tokens it was
   seen: one message to each bucket, with the histories, the words, the block's own
   training counts and the probability of the shorter gram (of a single word its count, which
   tells it and is smaller). Buckets are dealt by history;
   a history with a thousandth of all tokens is hot and dealt by history and word.
2. A bucket adds the counts up: it is the partition of the n-gram table. It answers each block
   with the counts, and with the counts of counts and sums behind each history that
   the block needs for its weights. The answers are written.
3. Counts of counts of the whole order, and the sums of hot histories (at most 1,000), are
   added up by Spark and read by the driver.

So a gram crosses the network once per block and not once per token, and as few bytes; counts
cover all training texts and grow with them. In the end each block evaluates its tokens
by recursion over the orders and sums by text.

Defined results: a null text is empty, and every text has its end as a last token. Words
are known by 64-bit hashes. A row with a null id is scored and not learned from; repeated
rows are learned and scored each. With no training text every score is 0. A discount that
Good-Turing leaves undefined or outside (0, 1) is (r - 0.5) / r. A history behind which
nothing is discounted (all counts above SMALL) has one token added to its total.
Very long texts are blocks of their own. Extra columns are ignored, whatever their
names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language import fold
from .textkit import Memo, blocks, mix, scratch, segment_ids, small_batches, text_bytes, trim, written

ORDER = 2
#: Counts up to this are discounted.
SMALL = 5
BLOCK_TOKENS, BUCKET_TOKENS = 2_000_000, 500_000
#: A history with fewer training tokens is never hot.
HOT_TOKENS, HOT_HISTORIES = 10_000, 1000

_STEP = np.uint64(0x9E3779B97F4A7C15)
_CODEC = pa.Codec("zstd", 6)


def packed(values: np.ndarray) -> bytes:
    """Bytes of non-negative integers (by planes of equal rank) or of doubles, compressed; the first nine tell size and kind."""
    if values.dtype.kind == "f":
        raw, kind = values.astype("<f8").tobytes(), 0
    else:
        kind = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
        raw = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :kind].T.tobytes()
    return bytes([kind]) + len(raw).to_bytes(8, "little") + (_CODEC.compress(raw, asbytes=True) if raw else b"")


def unpacked(data: bytes) -> np.ndarray:
    kind, size = data[0], int.from_bytes(data[1:9], "little")
    raw = np.frombuffer(_CODEC.decompress(data[9:], size, asbytes=True) if size else b"", np.uint8)
    if not kind:
        return raw.view("<f8")
    out = np.zeros((size // kind, 8), np.uint8)
    out[:, :kind] = raw.reshape(kind, -1).T
    return out.reshape(-1).view("<u8")


class Level(NamedTuple):
    """What the driver knows of one order: discounts by count (0 to SMALL), and the sums of hot histories by key."""

    discounts: np.ndarray
    hot: dict[int, tuple[np.ndarray, float]]


def rates(counts: np.ndarray, level: Level) -> np.ndarray:
    """The discount of each count."""
    return np.append(level.discounts, 1.0)[np.minimum(counts, SMALL + 1)]


def totals(sums: np.ndarray) -> np.ndarray:
    """Tokens behind each history, from its counts of counts and the sum above; one more where nothing is discounted."""
    discounted = sums[:, :SMALL] @ np.arange(1, SMALL + 1)
    total = (discounted + sums[:, SMALL]).astype(float)
    return total + ((discounted == 0) & (total > 0))


class Plan(NamedTuple):
    buckets: int
    hot_from: int


def discounts(seen: list[int]) -> np.ndarray:
    """Good-Turing discounts of the counts 1 to SMALL (place 0 is 0), from how many grams have each count 1 to SMALL + 1."""
    out = np.array([0.0] + [(r - 0.5) / r for r in range(1, SMALL + 1)])
    if seen[0] > 0:
        common = (SMALL + 1) * seen[SMALL] / seen[0]
        for r in range(1, SMALL + 1):
            if seen[r - 1] > 0 and common < 1:
                value = ((r + 1) * seen[r] / (r * seen[r - 1]) - common) / (1 - common)
                out[r] = value if 0 < value < 1 else out[r]
    return out


# --- texts to blocks ---

BLOCK_SCHEMA = "block long, ids array<long>, held array<boolean>, sizes array<long>, vocabulary binary, tokens binary"


def token_blocks(docs: DataFrame, limit: int = BLOCK_TOKENS) -> DataFrame:
    """docs(id, held, body) -> rows of ``BLOCK_SCHEMA``: word hashes (the end is the empty word), numbers of words text after text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: Memo = Memo(lambda w: len(number))
        state: dict[str, list] = {"ids": [], "held": [], "sizes": [], "parts": []}
        made = 0

        def out() -> pa.RecordBatch:
            nonlocal made
            tokens = np.concatenate(state["parts"])
            words = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), np.uint64, len(number))
            often = np.argsort(-np.bincount(tokens, minlength=len(words)), kind="stable")
            place = np.empty(len(words), np.int64)
            place[often] = np.arange(len(words))
            row = [(TaskContext.get().partitionId() << 32) + made], [state["ids"]], [state["held"]], [state["sizes"]], [words[often].tobytes()], [packed(place[tokens])]
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types, strict=True)], ["block", "ids", "held", "sizes", "vocabulary", "tokens"])
            made += 1
            number.clear()
            for x in state.values():
                x.clear()
            return batch

        for part in blocks(batches, "body"):
            texts = [[*t.lower().split(), b""] for t in text_bytes(part.column("body"))]
            sizes = list(map(len, texts))
            if state["parts"] and sum(map(len, state["parts"])) + sum(sizes) > limit:
                yield out()
            state["ids"] += part.column("id").to_pylist()
            state["held"] += part.column("held").to_pylist()
            state["sizes"] += sizes
            state["parts"].append(np.fromiter((i for t in texts for i in map(number.__getitem__, t)), np.int64, sum(sizes)))
        if state["parts"]:
            yield out()

    return docs.mapInArrow(run, BLOCK_SCHEMA)


# --- a block's grams ---


class Grams(NamedTuple):
    """The different grams of one order in a block, by bucket and then by history and word."""

    at: np.ndarray  # gram of each token
    history: np.ndarray  # history (a gram of the order below, or one past the last for the start of a text)
    word: np.ndarray  # number of the last word
    trained: np.ndarray  # training tokens of the block
    bucket: np.ndarray
    keys: np.ndarray  # hash of each history
    hot: np.ndarray  # of each history


class Block:
    """One block of texts and the answers it has so far."""

    def __init__(self, row: dict, answers: dict[int, list[dict]], plan: Plan, levels: list[Level]):
        self.ids, self.held, self.sizes = row["ids"], np.array(row["held"], bool), np.array(row["sizes"], np.int64)
        self.hashes = np.frombuffer(row["vocabulary"], np.uint64)
        self.tokens = unpacked(row["tokens"]).astype(np.int64)
        self.text = segment_ids(self.sizes)
        self.first = np.zeros(len(self.tokens), bool)
        self.first[np.cumsum(self.sizes) - self.sizes] = True
        self.plan, self.levels, self.answers = plan, levels, answers
        self.words = self.hashes  # from the first answers on: numbers of words, the same everywhere
        self.below: Grams | None = None
        self.keys = np.zeros(0, np.uint64)  # of the grams of the order below
        self.counts = np.zeros(0, np.int64)
        self.low = np.ones(len(self.hashes))  # probability of each gram without its first word; below single words: the unknown class
        self.order, self.start_count = 0, None  # orders taken in; training texts

    def grams(self) -> Grams:
        """The grams of the next order."""
        if self.below is None:
            history = np.zeros(len(self.tokens), np.int64)
            keys, hot, count = np.zeros(1, np.uint64), np.ones(1, bool), 1
        else:
            count = len(self.keys) + 1
            history = np.concatenate([[0], self.below.at[:-1]])
            history[self.first] = count - 1
            keys = np.append(self.keys, np.uint64(1))
            # as many texts start as end
            if self.start_count is None:
                self.start_count = self.counts[self.below.at[-1]]
            hot = np.append(self.counts, self.start_count) >= self.plan.hot_from
        code, at = np.unique(history * len(self.words) + self.tokens, return_inverse=True)
        history, word = code // len(self.words), code % len(self.words)
        spread = np.where(hot[history], mix(keys[history] + self.words[word] * _STEP), keys[history])
        bucket = (spread % np.uint64(self.plan.buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        at = place[at]
        trained = np.bincount(at[~self.held[self.text]], minlength=len(by))
        return Grams(at, history[by], word[by], trained, bucket[by], keys, hot)

    def messages(self, grams: Grams, block: int) -> pa.Table:
        """One row for each bucket that has grams of the block."""
        low = self._shorter(grams, self.counts if self.order == 1 else self.low)
        cuts = np.flatnonzero(np.diff(grams.bucket)) + 1
        rows = []
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(grams.bucket)], strict=True):
            starts = np.flatnonzero(np.diff(grams.history[a:b], prepend=-1))
            values, code = np.unique(low[a:b], return_inverse=True)
            histories = grams.history[a:b][starts]
            rows.append((int(grams.bucket[a]), block, grams.keys[histories].tobytes(), packed(grams.hot[histories].astype(np.int64)), packed(np.diff(np.append(starts, b - a))), packed(self.words[grams.word[a:b]]), packed(grams.trained[a:b]), packed(values), packed(code)))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), *[pa.binary()] * 7], strict=True)], names=MESSAGE)

    def _shorter(self, grams: Grams, values: np.ndarray) -> np.ndarray:
        """The value (count or probability) of each gram without its first word."""
        out = np.ones(len(grams.history), values.dtype)
        if self.below is not None:
            out[grams.at] = values[self.below.at]
        return out

    def climb(self) -> None:
        """Take in the answers to the next order: counts, and with them the probabilities of its grams."""
        grams, level = self.grams(), self.levels[self.order]
        shorter = self._shorter(grams, self.low)
        counts = np.zeros(len(grams.history), np.int64)
        sums = np.zeros((len(grams.keys), SMALL + 1), np.int64)
        lows = np.zeros(len(grams.keys))
        numbers = np.zeros(len(grams.history), np.uint64)
        for row in self.answers[self.order]:
            a, b = np.searchsorted(grams.bucket, [row["bucket"], row["bucket"] + 1])
            counts[a:b] = unpacked(row["counts"])
            if row["numbers"] is not None:
                numbers[a:b] = unpacked(row["numbers"])
            own = np.unique(grams.history[a:b])
            cold = own[~grams.hot[own]]
            if len(cold):
                sums[cold] = unpacked(row["sums"]).reshape(-1, SMALL + 1)
                lows[cold] = unpacked(row["lows"])
        for i in np.flatnonzero(grams.hot).tolist():
            sums[i], lows[i] = level.hot.get(int(grams.keys[i].view(np.int64)), (sums[i], lows[i]))
        if self.below is None:
            lows[:] = 0  # the class of unknown words is never among the seen
        total = totals(sums)
        kept = sums[:, :SMALL] @ (np.arange(1, SMALL + 1) * level.discounts[1:]) + sums[:, SMALL]
        back = np.where(total > 0, (total - kept) / np.where(total > 0, total, 1) / (1 - lows), 1.0)
        seen = rates(counts, level) * counts / np.where(total > 0, total, 1)[grams.history]
        low = np.where(counts > 0, seen, back[grams.history] * shorter)
        if self.below is None:
            by_word = np.zeros(len(self.hashes), np.uint64)
            by_word[grams.word] = numbers
            self.words = by_word
            self.word_counts = np.zeros(len(self.hashes), np.int64)
            self.word_counts[grams.word] = counts
            self.keys = mix(by_word[grams.word] * _STEP + np.uint64(7))
        else:
            self.keys = mix(grams.keys[grams.history] * _STEP + self.words[grams.word])
        self.below, self.counts, self.low = grams, counts, low
        self.order += 1

    def scores(self) -> np.ndarray:
        """Sum of log10 probabilities of each text."""
        return np.bincount(self.text, weights=np.log10(self.low[self.below.at]), minlength=len(self.sizes))


# --- buckets ---

MESSAGE = ["bucket", "block", "keys", "hot", "sizes", "words", "trained", "values", "codes"]
MESSAGE_SCHEMA = "bucket long, block long, keys binary, hot binary, sizes binary, words binary, trained binary, values binary, codes binary"
#: kind 0: an answer to a block; 1: grams by count; 2: what a bucket has of a hot history.
ANSWER_SCHEMA = "kind int, level int, block long, bucket long, counts binary, sums binary, lows binary, numbers binary, key long, parts array<long>, low double"


def _bucket_answers(level: int, buckets: int, words: Level | None = None):
    """``words``: what is known of single words, for the level above them."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket, rows = key[0].as_py(), table.to_pylist()
        keys = [np.frombuffer(r["keys"], np.uint64) for r in rows]
        hot = [unpacked(r["hot"]).astype(bool) for r in rows]
        sizes = [unpacked(r["sizes"]).astype(np.int64) for r in rows]
        length = np.array([int(s.sum()) for s in sizes])
        history, owner = np.unique(np.concatenate(keys), return_inverse=True)  # the histories of this bucket
        is_hot = np.zeros(len(history), bool)
        is_hot[owner] = np.concatenate(hot)
        of = np.repeat(owner, np.concatenate(sizes))
        word = np.concatenate([unpacked(r["words"]) for r in rows])
        trained = np.concatenate([unpacked(r["trained"]) for r in rows]).astype(np.int64)
        low = np.concatenate([unpacked(r["values"])[unpacked(r["codes"]).astype(np.int64)] for r in rows])
        if words is not None:
            low = low.astype(np.int64)
            low = rates(low, words) * low / max(1, *totals(words.hot[0][0][None]))
        by = np.lexsort((word, of))
        fresh = np.ones(len(by), bool)
        fresh[1:] = (of[by][1:] != of[by][:-1]) | (word[by][1:] != word[by][:-1])
        gram = np.empty(len(by), np.int64)
        gram[by] = np.cumsum(fresh) - 1
        first = by[fresh]
        count = np.bincount(gram, weights=trained).astype(np.int64)
        owns, lows = of[first], low[first]
        sums = np.zeros((len(history), SMALL + 1), np.int64)
        some = count > 0
        np.add.at(sums, (owns[some], np.minimum(count[some], SMALL + 1) - 1), np.where(count[some] > SMALL, count[some], 1))
        below = np.bincount(owns[some], weights=lows[some], minlength=len(history))
        out = []
        rank = np.empty(len(count), np.int64)  # frequent words get small numbers, whose upper bytes compress to nothing
        rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
        ends = np.cumsum(length)
        places = np.cumsum([len(k) for k in keys])
        for r, k, a, b, end in zip(rows, keys, ends - length, ends, places, strict=True):
            own = owner[end - len(k) : end]
            own = own[~is_hot[own]]
            numbers = packed(rank[gram[a:b]] * buckets + bucket) if level == 0 else None
            out.append((0, level, r["block"], bucket, packed(count[gram[a:b]]), packed(sums[own].reshape(-1)), packed(below[own]), numbers, None, None, None))
        grams = [int((count == n).sum()) for n in range(1, SMALL + 2)] + [int(some.sum())]
        out.append((1, level, None, bucket, None, None, None, None, None, grams, 0.0))
        for i in np.flatnonzero(is_hot).tolist():
            out.append((2, level, None, bucket, None, None, None, None, int(history[i].view(np.int64)), sums[i].tolist() + [0], float(below[i])))
        trim()
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4, pa.int64(), pa.list_(pa.int64()), pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[f.split()[0] for f in ANSWER_SCHEMA.split(", ")])

    return run


def _rows_of(table: pa.Table, levels: int) -> dict[int, list[dict]]:
    found: dict[int, list[dict]] = {i: [] for i in range(levels)}
    for row in table.select(["level", "bucket", "counts", "sums", "lows", "numbers"]).to_pylist():
        found[row["level"]].append(row)
    return found


def _climbed(row: dict, answers: pa.Table | None, plan: Plan, levels: list[Level]) -> Block:
    trim()
    block = Block(row, _rows_of(answers, len(levels)) if answers is not None else {}, plan, levels)
    for _ in levels:
        block.climb()
    return block


def _messages(texts: DataFrame, answers: DataFrame | None, plan: Plan, levels: list[Level]) -> DataFrame:
    def send(row: dict, found: pa.Table | None) -> pa.Table:
        block = _climbed(row, found, plan, levels)
        return block.messages(block.grams(), row["block"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from send(batch.slice(i, 1).to_pylist()[0], None).to_batches()

    if answers is None:
        return texts.mapInArrow(first, MESSAGE_SCHEMA)
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda left, right: send(left.to_pylist()[0], right), MESSAGE_SCHEMA)


def _level(answers: DataFrame) -> tuple[Level, int]:
    """Discounts and hot histories of one order's answers, and the number of different grams seen in training."""
    parts = [F.sum(F.col("parts")[i]).alias(f"p{i}") for i in range(SMALL + 2)]
    rows = answers.where("kind > 0").groupBy("kind", "key").agg(*parts, F.sum("low").alias("low")).collect()  # at most HOT_HISTORIES and one
    seen = next(([int(r[f"p{i}"]) for i in range(SMALL + 2)] for r in rows if r["kind"] == 1), [0] * (SMALL + 2))
    hot = {r["key"]: (np.array([r[f"p{i}"] for i in range(SMALL + 1)], np.int64), r["low"]) for r in rows if r["kind"] == 2}
    return Level(discounts(seen[: SMALL + 1]), hot), seen[SMALL + 1]


SCORE_SCHEMA = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, block_tokens: int = BLOCK_TOKENS, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each input row.

    ``held_out``: condition of the rows that are not learned from (null counts as true; a null id is never
    learned from and never reported as held out).
    """
    spark = docs.sparkSession
    source = docs.select(docs[id_col].cast("long").alias("id"), held_out.alias("held"), docs[text_col].cast("string").alias("body"))
    source = source.withColumn("held", F.coalesce("held", F.lit(True)) | F.col("id").isNull())
    with scratch(spark) as kept, small_batches(spark):
        texts = written(token_blocks(source, block_tokens), "blocks")
        total = texts.agg(F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()[0]
        plan = Plan(-(-total // bucket_tokens) or 1, max(HOT_TOKENS, -(-total // HOT_HISTORIES)))
        levels: list[Level] = []
        answers, kinds = None, 0
        for i in range(order):
            asked = _messages(texts, answers, plan, levels)
            got = written(asked.groupBy("bucket").applyInArrow(_bucket_answers(i, plan.buckets, levels[0] if i == 1 else None), ANSWER_SCHEMA), "answers")
            level, types = _level(got)
            levels.append(level)
            kinds = kinds if i else types
            got = got.where("kind = 0").drop("key", "parts", "low", "kind")
            answers = got if answers is None else answers.union(got)
        counts = levels[0].hot.get(0, (np.zeros(SMALL + 1, np.int64), 0.0))[0]
        learned = int(counts[:SMALL] @ np.arange(1, SMALL + 1) + counts[SMALL])

        def finish(left: pa.Table, right: pa.Table) -> pa.Table:
            block = _climbed(left.to_pylist()[0], right, plan, levels)
            known = block.word_counts[block.tokens]
            base = np.log10((known + 1) / (learned + kinds + 1))
            by_text = lambda x: np.bincount(block.text, weights=x, minlength=len(block.sizes))
            columns = [pa.array(block.ids, pa.int64()), pa.array(block.held), pa.array(block.sizes), pa.array(by_text(known > 0).astype(np.int64)), pa.array(np.full(len(block.sizes), learned)), pa.array(by_text(base)), pa.array(block.scores())]
            return pa.table(columns, names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        out = written(texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, SCORE_SCHEMA), "scores")
        kept.append(out)
    return out.withColumn("held_out", F.col("held_out") & F.col("id").isNotNull()).withColumnRenamed("id", id_col)


def op11_katz_backoff(spark, sf_dir: str) -> DataFrame:
    """The contract's counts, base and Katz scores of all whole documents; a seventh is held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score(docs, fold("doc_id", 7) == 2)
    return out.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})  # sums in another order differ beyond


def crc32_sql(data: str) -> str:
    """DuckDB expression: CRC-32 of a text, byte by byte; ``crc`` is the usual table of 256 values (``CRC_SQL``)."""
    octets = f"list_transform(range(octet_length(encode({data}))), lambda i: CAST('0x' || hex(encode({data}))[2 * i + 1 : 2 * i + 2] AS BIGINT))"
    return f"xor(4294967295, list_reduce({octets}, lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1]), 4294967295))"


CRC_SQL = "crc_table AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, b: xor(a >> 1, (a & 1) * 3988292384), i)) AS crc)"


def _discounts_sql(grams: str) -> str:
    """(r, d) of the counts 1 to SMALL of a table of grams."""
    return f"""
    SELECT r, coalesce(CASE WHEN common < 1 AND ratio > common AND ratio < 1 THEN (ratio - common) / (1 - common) END, (r - 0.5) / r) AS d
    FROM (SELECT r, (SELECT {SMALL + 1}.0 * count(*) FILTER (c = {SMALL + 1}) / nullif(count(*) FILTER (c = 1), 0) FROM {grams}) AS common,
        (SELECT (r + 1.0) * count(*) FILTER (c = r + 1) / nullif(r * count(*) FILTER (c = r), 0) FROM {grams}) AS ratio FROM range(1, {SMALL + 1}) t(r))"""


OP11_SQL = f"""
WITH {CRC_SQL}, docs AS MATERIALIZED (
  SELECT row_number() OVER () AS n, doc_id, coalesce({crc32_sql("CAST(doc_id AS VARCHAR)")} % 7 = 2, false) AS held_out, doc_id IS NOT NULL AS known,
    list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), ' ') AS words
  FROM documents, crc_table
), places AS MATERIALIZED (
  SELECT n, held_out OR NOT known AS held, unnest(list_prepend('', words[:-2])) AS v, unnest(words) AS w FROM docs
), uni AS MATERIALIZED (SELECT w, count(*) AS c FROM places WHERE NOT held GROUP BY w),
bi AS MATERIALIZED (SELECT v, w, count(*) AS c FROM places WHERE NOT held GROUP BY v, w),
d1 AS MATERIALIZED ({_discounts_sql("uni")}), d2 AS MATERIALIZED ({_discounts_sql("bi")}),
total AS MATERIALIZED (
  SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v, coalesce(sum(c), 0) + (count(*) > 0 AND coalesce(min(c), 0) > {SMALL})::INT AS t1,
    coalesce(sum(coalesce(d, 1) * c), 0) AS kept1 FROM uni LEFT JOIN d1 ON c = r
), p1 AS MATERIALIZED (SELECT w, c, coalesce(d, 1) * c / t1 AS p FROM uni LEFT JOIN d1 ON c = r, total),
unknown AS MATERIALIZED (SELECT CASE WHEN t1 > 0 THEN (t1 - kept1) / t1 ELSE 1 END AS p FROM total),
behind AS MATERIALIZED (
  SELECT v, sum(bi.c) + (min(bi.c) > {SMALL})::INT AS t, sum(coalesce(d, 1) * bi.c) AS kept, sum(p1.p) AS low
  FROM bi JOIN p1 USING (w) LEFT JOIN d2 ON bi.c = r GROUP BY v
), p2 AS MATERIALIZED (SELECT v, w, coalesce(d, 1) * bi.c / t AS p FROM bi JOIN behind USING (v) LEFT JOIN d2 ON bi.c = r)
SELECT doc_id, held_out, len(words)::BIGINT AS n_tokens, n_known::BIGINT AS n_known, total.n AS train_tokens, round(base_score, 6) AS base_score, round(score, 6) AS score
FROM docs JOIN (
  SELECT places.n, count(p1.c) AS n_known, sum(log10((coalesce(p1.c, 0) + 1) / (total.n + total.v + 1))) AS base_score,
    sum(log10(coalesce(p2.p, CASE WHEN t IS NULL THEN 1 ELSE (t - kept) / t / (1 - low) END * coalesce(p1.p, unknown.p)))) AS score
  FROM places LEFT JOIN p1 USING (w) LEFT JOIN p2 USING (v, w) LEFT JOIN behind USING (v), total, unknown GROUP BY places.n
) s USING (n), total
"""
