"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Each word enters as a word embedding and the mean of its hashed character-gram
embeddings (3 to 5 characters, with marks at both ends). A gated recurrent layer reads
each window of WINDOW words in both directions, attention pools its states, and a
linear layer gives the window's logit. Windows overlap by WINDOW - STRIDE words and
cover the whole text; the text's score is that of its highest window.

Labels are of texts, so training follows the multiple-instance rule: in a round, the
windows of each text that score highest under the present network stand for it, in
toxic and clean texts alike (the latter are the hardest negatives). The first rounds
take windows at random. The sample is bounded by MAX_TRAIN_DOCS texts a class, chosen
by a hash of the id; labels, language, source and id are never inputs.

Defined results: null and empty texts have one window of padding and so a score, as
has every text. Labels that are null, or ids with several labels that differ, are not
learned from. Repeated rows each give a row; a null id is carried and counts as not
held out. With no labelled text of either class all scores are 0. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import blocks, mix, text_bytes

WINDOW, STRIDE = 24, 16
HIDDEN, WORD_DIM, CHAR_DIM, ATTEND = 8, 8, 8, 8
VOCABULARY, CHAR_BUCKETS = 20_000, 1 << 14
MAX_TRAIN_DOCS = 1500
UPDATES, PASSES, SELECTIONS, BATCH, MAX_WINDOWS = 250, 6, 9, 96, 30_000
RATE, DECAY, SEED = 0.02, 1e-4, 7
MIN_COUNT, WORD_DROPOUT, DROPOUT = 4, 0.3, 0.15
MEMO_WORDS = 200_000
#: Windows that go through the network at one time.
WIDTH = 4096


GRAM_SIZES = (3, 4, 5)


def gram_table(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the character grams of all words, one word after the other by gram size.

    Words are marked with ``^`` and ``$``, so that each has at least one gram of the
    least size; the empty word has its two marks and one more.
    """
    marked = [f"^{n}$" if n else "^$$" for n in names]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    word = np.repeat(np.arange(len(names)), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    place = np.arange(len(points))
    buckets, owners = [], []
    for k in GRAM_SIZES:
        at = place[place + k <= ends]
        key = np.full(len(at), k, np.uint64)
        for j in range(k):
            key = mix(key + points[at + j])
        buckets.append((key % np.uint64(CHAR_BUCKETS)).astype(np.int64))
        owners.append(word[at])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(buckets)[order], np.bincount(owner, minlength=len(names))


def plain(token: bytes) -> str:
    """The token in lower case without marks at its ends."""
    return token.decode().lower().strip(".,!?;:*#&%$|<>\"'()[]{}-_=+/\\")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    """All weights; ``words`` gives the embedding row of the training vocabulary (row 0: any other word)."""

    words: dict[str, int]
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    shift: float = 0.0

    def start(self) -> Network:
        rng = np.random.default_rng(SEED)
        inputs, h = WORD_DIM + CHAR_DIM, HIDDEN

        def small(*shape: int, scale: float | None = None) -> np.ndarray:
            return (rng.standard_normal(shape) * (scale or (1 / np.sqrt(shape[0])))).astype(np.float32)

        self.weights = {
            "word": small(len(self.words) + 1, WORD_DIM, scale=0.1), "char": small(CHAR_BUCKETS, CHAR_DIM, scale=0.3),
            "w0": small(inputs, 3 * h), "w1": small(inputs, 3 * h), "b0": np.zeros(3 * h, np.float32), "b1": np.zeros(3 * h, np.float32),
            "u0": small(h, 3 * h), "u1": small(h, 3 * h), "att": small(2 * h, ATTEND), "v": small(ATTEND), "out": small(2 * h), "bias": np.zeros(1, np.float32),
        }
        return self

    def embed(self, numbers: np.ndarray, buckets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Inputs of words: their embedding rows beside the means of their grams' rows."""
        chars = np.add.reduceat(self.weights["char"][buckets], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None].astype(np.float32)
        return np.concatenate([self.weights["word"][numbers], chars], axis=1)


def recur(gates: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (time, windows, HIDDEN) from input projections (time, windows, 3 x HIDDEN): update, reset, new."""
    h = HIDDEN
    state = np.zeros((gates.shape[1], h), np.float32)
    out = np.empty((gates.shape[0], gates.shape[1], h), np.float32)
    for t in range(len(gates)):
        a = state @ u
        zr = 1 / (1 + np.exp(-(gates[t, :, : 2 * h] + a[:, : 2 * h])))
        n = np.tanh(gates[t, :, 2 * h :] + zr[:, h:] * a[:, 2 * h :])
        new = n + zr[:, :h] * (state - n)
        if keep is not None:
            keep.append((state, a, zr, n))
        state = np.where(mask[t][:, None], new, state)
        out[t] = state
    return out


def forward(w: dict, gates: list[np.ndarray], mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Window logits. ``gates``: both directions' input projections, in text order; mask (time, windows)."""
    store: list[list] = [[], []]
    fore = recur(gates[0], mask, w["u0"], store[0] if keep is not None else None)
    back = recur(gates[1][::-1], mask[::-1], w["u1"], store[1] if keep is not None else None)[::-1]
    states = np.concatenate([fore, back], axis=2)
    seen = np.tanh(states @ w["att"])
    energy = np.where(mask, seen @ w["v"], -1e9)
    weight = np.exp(energy - energy.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", weight, states)
    if keep is not None:
        keep |= {"states": states, "seen": seen, "weight": weight, "pooled": pooled, "store": store}
    return pooled @ w["out"] + w["bias"][0]


def gradients(w: dict, x: np.ndarray, mask: np.ndarray, target: np.ndarray, weigh: np.ndarray | float = 1.0) -> tuple[float, dict, np.ndarray]:
    """(loss, weight gradients, input gradients) of the mean logistic loss; x (time, windows, inputs)."""
    h = HIDDEN
    gates = [x @ w["w0"] + w["b0"], x @ w["w1"] + w["b1"]]
    kept: dict = {}
    logit = forward(w, gates, mask, kept)
    p = sigmoid(logit)
    loss = float(np.mean(weigh * (-target * np.log(p + 1e-9) - (1 - target) * np.log(1 - p + 1e-9))))
    d = (weigh * (p - target) / len(target)).astype(x.dtype)
    states, seen, weight = kept["states"], kept["seen"], kept["weight"]
    g = {"out": kept["pooled"].T @ d, "bias": d.sum(keepdims=True)}
    d_pooled = d[:, None] * w["out"]
    d_states = weight[:, :, None] * d_pooled
    d_weight = np.einsum("nh,tnh->tn", d_pooled, states)
    d_energy = weight * (d_weight - (weight * d_weight).sum(axis=0))
    g["v"] = np.einsum("tn,tnk->k", d_energy, seen)
    d_seen = d_energy[:, :, None] * w["v"] * (1 - seen**2)
    g["att"] = np.einsum("tnh,tnk->hk", states, d_seen)
    d_states = d_states + d_seen @ w["att"].T
    d_x = np.zeros_like(x)
    for side in (0, 1):
        order = slice(None) if side == 0 else slice(None, None, -1)
        d_h, m, u = d_states[:, :, side * h : (side + 1) * h][order], mask[order], w[f"u{side}"]
        d_gates = np.zeros((len(x), x.shape[1], 3 * h), np.float32)
        d_u = np.zeros_like(u)
        carry = np.zeros((x.shape[1], h), np.float32)
        for t in range(len(x) - 1, -1, -1):
            before, a, zr, n = kept["store"][side][t]
            total = carry + d_h[t]
            live = np.where(m[t][:, None], total, 0)
            z, r = zr[:, :h], zr[:, h:]
            d_n = live * (1 - z) * (1 - n**2)
            d_z = live * (before - n) * z * (1 - z)
            d_r = d_n * a[:, 2 * h :] * r * (1 - r)
            d_a = np.concatenate([d_z, d_r, d_n * r], axis=1)
            d_gates[t] = np.concatenate([d_z, d_r, d_n], axis=1)
            d_u += before.T @ d_a
            carry = live * z + d_a @ u.T + np.where(m[t][:, None], 0, total)
        d_gates = d_gates[order]
        g[f"u{side}"], g[f"b{side}"] = d_u, d_gates.sum(axis=(0, 1))
        g[f"w{side}"] = np.einsum("tni,tng->ig", x, d_gates)
        d_x += d_gates @ w[f"w{side}"].T
    return loss, g, d_x


class Adam:
    def __init__(self, weights: dict):
        self.weights, self.step = weights, 0
        self.first = {k: np.zeros_like(v) for k, v in weights.items()}
        self.second = {k: np.zeros_like(v) for k, v in weights.items()}

    def apply(self, grads: dict, rate: float) -> None:
        self.step += 1
        for k, g in grads.items():
            self.first[k] += 0.1 * (g - self.first[k])
            self.second[k] += 0.01 * (g * g - self.second[k])
            move = self.first[k] / (1 - 0.9**self.step) / (np.sqrt(self.second[k] / (1 - 0.99**self.step)) + 1e-6)
            self.weights[k] -= rate * (move + DECAY * self.weights[k])


def windows_of(counts: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions (windows, WINDOW), text of each window): all overlapping windows; ``end`` is the padding position."""
    per = np.maximum(1, -(-(counts - (WINDOW - STRIDE)) // STRIDE))
    text = np.repeat(np.arange(len(counts)), per)
    begin = (np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)) * STRIDE
    at = begin[:, None] + np.arange(WINDOW)
    return np.where(at < counts[text][:, None], offsets[text][:, None] + at, end), text


def run_windows(w: dict, table: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Logits of windows of positions ``at``; ``table`` has the projections of each id, row 0 is padding."""
    out = np.empty(len(at), np.float32)
    for i in range(0, len(at), WIDTH):
        tokens = ids[at[i : i + WIDTH].T]
        rows = table[tokens]
        out[i : i + WIDTH] = forward(w, [rows[:, :, : 3 * HIDDEN], rows[:, :, 3 * HIDDEN :]], tokens > 0)
    return out


class Scorer:
    """Scores texts with a trained network; projections of words are remembered by their bytes, row 0 is padding."""

    def __init__(self, net: Network):
        self.net = net
        self.into = np.concatenate([net.weights["w0"], net.weights["w1"]], axis=1)
        self.plus = np.concatenate([net.weights["b0"], net.weights["b1"]])
        self.clear()

    def clear(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.table = np.zeros((1, 6 * HIDDEN), np.float32)

    def learn(self, tokens: list[bytes]) -> None:
        """Add the projections of new tokens."""
        if not tokens:
            return
        names = [plain(t) for t in tokens]
        numbers = np.array([self.net.words.get(n, 0) for n in names])
        rows = self.net.embed(numbers, *gram_table(names)) @ self.into + self.plus
        self.memo.update(zip(tokens, range(len(self.table), len(self.table) + len(tokens)), strict=True))
        self.table = np.concatenate([self.table, rows.astype(np.float32)])

    def window_logits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(logits, text of each window)."""
        if len(self.memo) > MEMO_WORDS:
            self.clear()
        lists = [t.split() for t in texts]
        self.learn(list(set().union(*lists).difference(self.memo)))
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        get = self.memo.__getitem__
        ids = np.fromiter((i for ws in lists for i in map(get, ws)), np.int64, int(counts.sum()))
        at, text = windows_of(counts, np.cumsum(counts) - counts, len(ids))
        return run_windows(self.net.weights, self.table, np.append(ids, 0), at), text

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        logit, text = self.window_logits(texts)
        starts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        return sigmoid(np.maximum.reduceat(logit, starts).astype(float) + self.net.shift)


def train(texts: list[bytes], labels: list[int], updates: int = UPDATES) -> Network:
    """Fit a network to labelled texts (see the module's text)."""
    rng = np.random.default_rng(SEED)
    lists = [t.split() for t in texts]
    target = np.array(labels, np.float32)
    tokens = sorted({w for ws in lists for w in ws})
    plains = [plain(t) for t in tokens]
    names = sorted(set(plains) | {""})
    number = dict(zip(names, range(1, len(names) + 1), strict=True))
    of_token = dict(zip(tokens, map(number.__getitem__, plains), strict=True))
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.append(np.fromiter((of_token[w] for ws in lists for w in ws), np.int64, int(counts.sum())), 0)
    often = np.bincount(flat[:-1], minlength=len(names) + 1)
    common = [i for i in np.argsort(-often, kind="stable")[:VOCABULARY].tolist() if i and often[i] >= MIN_COUNT]
    net = Network({names[i - 1]: j + 1 for j, i in enumerate(common)}).start()
    w, adam = net.weights, Adam(net.weights)
    word_of = np.array([0] + [net.words.get(n, 0) for n in names])
    buckets, sizes = gram_table(["", *names])  # row 0: padding
    gram_at = np.cumsum(sizes) - sizes
    at, text = windows_of(counts, np.cumsum(counts) - counts, len(flat) - 1)
    starts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    per = np.append(starts[1:], len(text)) - starts
    clean, toxic = target == 0, target > 0
    weigh = np.where(toxic, 1.0, np.clip(toxic.sum() / max(1, clean.sum()), 0.3, 1)).astype(np.float32)
    windows_toxic = np.flatnonzero(toxic[text])
    for phase in range(PASSES + SELECTIONS):
        if phase < PASSES:
            if phase and adam.step >= updates:
                continue
            # windows of toxic texts and as many of clean ones, all as their texts are marked
            chosen = np.concatenate([rng.permutation(windows_toxic)[:MAX_WINDOWS], rng.choice(np.flatnonzero(clean[text]), min(len(windows_toxic), MAX_WINDOWS))])
            weight = np.ones(len(target), np.float32)
        else:
            table = net.embed(word_of, buckets, sizes) @ np.concatenate([w["w0"], w["w1"]], axis=1) + np.concatenate([w["b0"], w["b1"]])
            logit = run_windows(w, table, flat, at)
            best = np.lexsort((-logit, text))
            # the best window of each text; of clean texts the next two and one at random as well
            next_two = [best[(starts + np.minimum(k, per - 1))[clean]] for k in (1, 2)]
            chosen = np.concatenate([best[starts], *next_two, (starts + rng.integers(0, per))[clean]])
            weight = weigh
        rate = RATE * (1 if phase < PASSES else 0.5 if phase < PASSES + SELECTIONS - 3 else 0.15)
        rng.shuffle(chosen)
        for i in range(0, len(chosen), BATCH):
            pick = chosen[i : i + BATCH]
            own, back = np.unique(flat[at[pick].T], return_inverse=True)
            back = back.reshape(WINDOW, -1)
            numbers = word_of[own]
            numbers[rng.random(len(own)) < WORD_DROPOUT] = 0  # so that characters carry their part
            spread = np.repeat(gram_at[own] - np.cumsum(sizes[own]) + sizes[own], sizes[own]) + np.arange(sizes[own].sum())
            inputs = net.embed(numbers, buckets[spread], sizes[own])
            _, grads, d_x = gradients(w, inputs[back] * (rng.random((*back.shape, 1)) >= DROPOUT).astype(np.float32), own[back] > 0, target[text[pick]], weight[text[pick]])
            d_own = np.zeros(inputs.shape, np.float32)
            np.add.at(d_own, back.ravel(), d_x.reshape(-1, inputs.shape[1]))
            grads["word"], grads["char"] = np.zeros_like(w["word"]), np.zeros_like(w["char"])
            np.add.at(grads["word"], numbers, d_own[:, :WORD_DIM])
            np.add.at(grads["char"], buckets[spread], np.repeat(d_own[:, WORD_DIM:] / sizes[own][:, None], sizes[own], axis=0))
            adam.apply(grads, rate)
    net.shift = threshold_shift(Scorer(net), texts, target)
    return net


def threshold_shift(scorer: Scorer, texts: list[bytes], target: np.ndarray) -> float:
    """The shift that puts 0.5 midway between the classes, at the point of fewest errors on the training texts."""
    logit = np.concatenate([np.log(p / (1 - p)) for p in (np.clip(scorer(texts[i : i + 200]), 1e-9, 1 - 1e-9) for i in range(0, len(texts), 200))])
    order = np.argsort(logit)
    sorted_logit, positive = logit[order], target[order] > 0
    below = np.concatenate([[0], np.cumsum(positive)]) / max(1, positive.sum())
    above = 1 - np.concatenate([[0], np.cumsum(~positive)]) / max(1, (~positive).sum())
    errors = below + above
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    edge = np.concatenate([[sorted_logit[0] - 1], sorted_logit, [sorted_logit[-1] + 1]])
    return -float((edge[best[0]] + edge[best[-1] + 1]) / 2)


def fold(id_col: str, parts: int):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int) -> tuple[list[bytes], list[int]]:
    """At most ``per_class`` labelled texts of each class, by a hash of the id."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id"))
    known = known.agg(F.min(label_col).alias("y"), F.max(label_col).alias("y2")).where("y = y2")
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("id", F.lit("toxicity")), "id").limit(per_class) for y in (0, 1)]
    ids = picked[0].union(picked[1]).select("id", "y")
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("body")).join(F.broadcast(ids), "id")
    table = rows.select("id", "y", "body").toArrow().sort_by([("id", "ascending"), ("body", "ascending")])
    return text_bytes(table.column("body").combine_chunks()), table.column("y").to_pylist()


def score(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row; one Arrow map, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value else None
        for block in blocks(batches, "body", 1 << 20):
            texts = text_bytes(block.column("body"))
            found = scorer(texts) if scorer else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([block.column("id"), pa.array(found, pa.float64())], ["id", "score"])

    source = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("body"))
    return source.mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)


def op5_bigru_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all whole documents, learned from the labels outside the held-out fold."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    texts, truth = sample(docs, labels.where(fold("doc_id", 5) != 0), "doc_id", "text", "toxic", MAX_TRAIN_DOCS)
    net = train(texts, truth) if len(set(truth)) == 2 else None
    out = score(docs, net)
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
