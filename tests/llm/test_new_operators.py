"""op11 to op13 on small tables against brute force, with nulls, ties, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobtide.llm import katz as K
from jobtide.llm import spelling as S
from jobtide.llm import vectors as V
from jobtide.llm.language import fold

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- op11 ---


def tokens(text):
    return [w.translate(LOW) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + ["</s>"]


class Model:
    """Katz backoff, one gram at a time."""

    def __init__(self, texts, order):
        self.counts = [Counter() for _ in range(order)]
        for text in texts:
            for m in range(order):
                padded = ["<s>"] * m + text
                for i in range(len(text)):
                    self.counts[m][tuple(padded[i : i + m + 1])] += 1
        self.after = [defaultdict(list) for _ in range(order)]
        for m, counts in enumerate(self.counts):
            for gram, c in counts.items():
                self.after[m][gram[:-1]].append((gram[-1], c))
        self.rates = [self.discounts(Counter(c.values())) for c in self.counts]
        self.known, self.order = {}, order

    @staticmethod
    def discounts(n):
        out = {}
        for r in range(1, 6):
            out[r] = (r - 0.5) / r
            if n[1] and n[r] and 6 * n[6] / n[1] < 1:
                common = 6 * n[6] / n[1]
                value = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
                out[r] = value if 0 < value < 1 else out[r]
        return out

    def p(self, history, word):
        if history is None:
            return 1.0  # the class of unknown words
        m, shorter = len(history), history[1:] if history else None
        if history not in self.known:
            seen = self.after[m].get(history, [])
            total = sum(c for _, c in seen) + (bool(seen) and all(c > 5 for _, c in seen))
            kept = sum(self.rates[m].get(c, 1) * c for _, c in seen)
            low = sum(self.p(shorter, w) for w, _ in seen) if m else 0
            self.known[history] = (total, (total - kept) / total / (1 - low) if total else 1.0)
        total, back = self.known[history]
        c = self.counts[m].get((*history, word), 0)
        return self.rates[m].get(c, 1) * c / total if c else back * self.p(shorter, word)

    def score(self, text):
        padded = ["<s>"] * (self.order - 1) + text
        return sum(math.log10(self.p(tuple(padded[i : i + self.order - 1]), padded[i + self.order - 1])) for i in range(len(text)))


def katz_rows():
    draw = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    rows = [(i, " ".join(draw.choices(words, weights, k=draw.randint(0, 60)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "W1 w2\tW3\nunseen words é É"), (203, "hot " * 3000), (5, "repeated id w1"), (None, "null id w1 w2")]
    return rows


@pytest.mark.parametrize(("order", "block", "bucket", "hot"), [(1, 500, 300, 100), (2, 4_000_000, 500_000, 10_000), (2, 700, 400, 60), (3, 900, 500, 40)])
def test_katz_scores_equal_a_loop(spark, monkeypatch, order, block, bucket, hot):
    monkeypatch.setattr(K, "HOT_TOKENS", hot)
    rows = katz_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tokens", F.lit("clash")).withColumn("block", F.lit(1)).repartition(3)
    got = K.score(df, fold("doc_id", 7) == 2, order=order, block_tokens=block, bucket_tokens=bucket).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    training = [tokens(t) for i, t in rows if i is not None and not held(i)]
    model, unigrams = Model(training, order), Counter(w for t in training for w in t)
    n = sum(unigrams.values())
    want = []
    for i, text in rows:
        own = tokens(text)
        base = sum(math.log10((unigrams[w] + 1) / (n + len(unigrams) + 1)) for w in own)
        want.append((str(i), held(i), len(own), sum(w in unigrams for w in own), n, round(base, 6), round(model.score(own), 6)))
    key = lambda r: (r[0], r[2], r[5])
    found = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got]
    for one, two in zip(sorted(found, key=key), sorted(want, key=key), strict=True):
        assert one[:5] == two[:5] and one[5:] == pytest.approx(two[5:], abs=2e-6)
    # behind every history the probabilities of all words and of the unknown class sum to one
    for history in [(), *[tuple(h) for h in model.after[-1]]][:40]:
        if len(history) < order:
            assert math.fsum(model.p(history, w) for w in [*unigrams, None]) == pytest.approx(1, abs=1e-9)


def test_katz_without_rows_or_training(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert K.score(empty, fold("doc_id", 7) == 2).count() == 0
    alone = K.score(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), F.lit(True)).collect()
    assert [(r.n_known, r.train_tokens, r.base_score, r.score) for r in alone] == [(0, 0, 0.0, 0.0)] * 2


def test_katz_learns_word_order(spark):
    """On held-out texts of a language with order, two words tell more than one."""
    draw = random.Random(1)
    follow = {f"w{i}": [f"w{draw.randrange(50)}" for _ in range(3)] for i in range(50)}

    def text():
        words = [f"w{draw.randrange(50)}"]
        for _ in range(80):
            words.append(draw.choice(follow[words[-1]]))
        return " ".join(words)

    df = spark.createDataFrame([(i, text()) for i in range(150)], "doc_id long, text string")
    one, two = (K.score(df, fold("doc_id", 7) == 2, order=n).where("held_out").agg(F.sum("score")).first()[0] for n in (1, 2))
    base = K.score(df, fold("doc_id", 7) == 2).where("held_out").agg(F.sum("base_score")).first()[0]
    assert two > 0.5 * one and one > 1.05 * base


# --- op12 ---


def codes_by_loop(rows, parts=16, entries=64, rounds=2):
    """rows(vec_id, label, vector) -> codes, errors and codebooks, one distance at a time."""
    kept = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][2]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [[list(cut(v)[p]) for _, _, v in sorted(kept, key=lambda r: (r[0] is None, r[0], r[2]))[:entries]] for p in range(parts)]

    def nearest(book, x):
        return min(range(len(book)), key=lambda e: (sum((a - b) ** 2 for a, b in zip(x, book[e], strict=True)), e))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, _, v in kept:
            for p, x in enumerate(cut(v)):
                groups[p, nearest(books[p], x)].append(x)
        for (p, e), xs in groups.items():
            books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out, errors = [], defaultdict(int)
    for i, label, v in kept:
        own = [(nearest(books[p], x), x, books[p]) for p, x in enumerate(cut(v))]
        error = sum(sum((a - b) ** 2 for a, b in zip(x, book[e], strict=True)) for e, x, book in own)
        errors[label] += error
        out.append((i, label, "".join(f"{e:02x}" for e, _, _ in own), error))
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    return sorted((str(i), code, error, errors[label], digest) for i, label, code, error in out)


def vector_rows(seed, n, width=3, spread=0.4):
    rng = np.random.default_rng(seed)
    rows = [(i, int(i % 3) if i % 7 else None, [float(x) for x in np.round(rng.normal(0, spread, 16 * width), 2)]) for i in range(n)]
    tied = [0.25] * (16 * width)
    return rows + [(n + i, 1, tied) for i in range(5)] + [(n + 9, 1, None), (n + 10, 1, [None] + tied[1:]), (n + 11, 1, [float("nan")] + tied[1:]), (n + 12, 1, [float("inf")] + tied[1:])]


@pytest.mark.parametrize(("seed", "n", "width"), [(1, 200, 3), (2, 20, 1), (3, 90, 4)])
def test_vector_codes_equal_a_loop(spark, seed, n, width):
    rows = vector_rows(seed, n, width)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("code", F.lit(1)).withColumn("part", F.lit("x"))
    rows = [(i, label, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, label, v in rows]
    got = V.compress(df.repartition(4)).collect()
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == codes_by_loop(rows)


def test_vector_edge_cases(spark):
    schema = "vec_id long, label int, embedding array<float>"
    assert V.compress(spark.createDataFrame([], schema)).count() == 0
    repeated = [(1, 0, [0.5] * 16), (1, 0, [0.5] * 16), (None, None, [0.5] * 16), (2, 0, [-0.1] * 16)]
    got = V.compress(spark.createDataFrame(repeated, schema)).collect()
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == codes_by_loop([(i, x, [float(np.float32(y)) for y in v]) for i, x, v in repeated])
    odd = V.compress(spark.createDataFrame([(1, 0, [0.5] * 16), (2, 0, [0.5] * 32), (3, 1, [])], schema)).collect()
    assert {r.vec_id: (r.code, r.error) for r in odd} == {1: ("00" * 16, 0), 2: (None, None), 3: (None, None)}
    assert [r.code for r in V.compress(spark.createDataFrame([(1, 0, [0.5] * 5)], schema)).collect()] == [None]
    with pytest.raises(Exception, match="not supported"):
        V.compress(spark.createDataFrame([(1, 0, [3e6] * 16)], schema)).collect()


def test_bitmask_candidates_hold_every_nearest_entry():
    rng = np.random.default_rng(8)
    for dims, entries in ((1, 64), (4, 64), (9, 3)):
        book = V.Slices(rng.integers(-50, 50, (entries, dims)))
        parts = rng.integers(-80, 80, (500, dims))
        squares = ((parts[:, None, :] - book.entries[None]) ** 2).sum(axis=2)
        mask = book.candidates(parts)
        nearest = squares == squares.min(axis=1, keepdims=True)
        inside = (mask[:, None] >> np.arange(entries, dtype=np.uint64)) & np.uint64(1) == 1
        assert (inside | ~nearest).all()
        at, least = book.nearest(parts)
        assert (at == squares.argmin(axis=1)).all() and (least == squares.min(axis=1)).all()
    assert inside.sum() < inside.size or entries == 3


# --- op13 ---


def variants_by_loop(rows, spoil=31):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOW)
            mark = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if mark % spoil == 0:
                word = word[: mark % len(word)] + word[mark % len(word) + 1 :]
            if len(word) >= 7:
                counts[word] += 1
    words = {w: n for w, n in counts.items() if n >= 2}
    near = defaultdict(set)
    by_gap = defaultdict(set)
    for w in words:
        for k in range(len(w)):
            shorter = w[:k] + w[k + 1 :]
            by_gap[k, shorter].add(w)
            if shorter in words:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in by_gap.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in words.items():
        if near[w]:
            best = min(near[w], key=lambda v: (-words[v], v))
            if words[best] >= 10 * n:
                form[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return out


def edited(draw, word, letters):
    k, c = draw.randrange(len(word)), draw.choice(letters)
    return draw.choice([word[:k] + word[k + 1 :], word[:k] + c + word[k:], word[:k] + c + word[k + 1 :], word + c])


def spelling_rows(seed, letters="abé", n=250):
    draw = random.Random(seed)
    words = ["".join(draw.choice(letters) for _ in range(draw.randint(6, 12))) for _ in range(25)]
    words += ["a" * k for k in (7, 8, 9, 63, 64, 65, 66, 130)] + ["ab" * 32, "ab" * 32 + "a", "b" + "ab" * 32, "x" + "a" * 64, "ÀÉÖ" * 4]
    rows = []
    for i in range(n):
        some = [draw.choice(words) for _ in range(30)]
        some = [edited(draw, w, letters) if draw.random() < 0.3 else w for w in some]
        rows.append((i, " ".join(w.upper() if draw.random() < 0.1 else w for w in some)))
    return rows + [(900, None), (901, ""), (902, "1 22 333 …"), (903, "Ωmega œuvre naïveté naïveté"), (3, "repeated " * 40), (None, "nullids nullids")]


@pytest.mark.parametrize(("seed", "letters", "crowded"), [(1, "abé", 12), (2, "ab", 0), (3, "abcdefghijklmnop", 12), (4, "abc", 2)])
def test_spelling_variants_equal_a_loop(spark, monkeypatch, seed, letters, crowded):
    monkeypatch.setattr(S, "CROWDED", crowded)
    monkeypatch.setattr(S.near_words, "__defaults__", (crowded,))
    rows = spelling_rows(seed, letters)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1)).repartition(3)
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in S.spelling_variants(df).collect()}
    assert got == variants_by_loop(rows)
    assert S.spelling_variants(df.limit(0)).count() == 0


def test_pivots_are_the_cheapest_disjoint_pair():
    draw = random.Random(6)
    for _ in range(300):
        places = sorted(draw.sample(range(14), draw.randint(3, 8)))
        prefix = [(p, draw.randint(1, 9)) for p in places]
        a, b = S.pivots(prefix)
        cost = dict(prefix)
        assert b - a >= 2 and cost[a] + cost[b] == min(x + y for i, x in prefix for j, y in prefix if j - i >= 2)


def test_a_crowded_beginning_makes_no_square(spark):
    """6,000 words that share their rarest grams: the pairs that are looked at grow with the words."""
    draw = random.Random(3)
    words = sorted({"qzx" + "".join(draw.choice("abcdefgh") for _ in range(9)) for _ in range(6000)})
    begin = time.time()
    got = S.spelling_variants(spark.createDataFrame([(i, f"{w} {w}") for i, w in enumerate(words)], "doc_id long, text string"), spoil=1 << 40).count()
    assert got == len(words) and time.time() - begin < 120


@pytest.mark.parametrize(("seed", "letters", "span"), [(7, "ab", 9), (8, "abé", 5)])
def test_edits_beyond_the_places_of_a_round(spark, monkeypatch, seed, letters, span):
    monkeypatch.setattr(S, "SPAN", span)
    monkeypatch.setattr(S, "TASK_WORDS", 100)
    monkeypatch.setattr(S.near_words, "__defaults__", (0,))
    draw = random.Random(seed)
    word = "".join(draw.choice(letters) for _ in range(70))
    rows = [(i, " ".join([word, *(edited(draw, w, letters) for w in (word, word[:20], word[:8]) for _ in range(2))])) for i in range(80)]
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in S.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == variants_by_loop(rows)


def test_crowded_keys_are_split_in_one_round(spark, monkeypatch):
    """3,000 words that share their rarest grams: keys are counted once, and a row is looked at at most once a place."""
    made = []
    monkeypatch.setattr(S, "written", lambda df, label, real=S.written: made.append((label, real(df, label))) or made[-1][1])
    draw = random.Random(3)
    words = sorted({"qzx" + "".join(draw.choice("abcd") for _ in range(9)) for _ in range(3000)})
    docs = spark.createDataFrame([(i, f"{w} {w}") for i, w in enumerate(words)], "doc_id long, text string")
    assert S.spelling_variants(docs, spoil=1 << 40).where("n_near > 0").count() > 0
    assert [label for label, _ in made].count("sizes") == 1
