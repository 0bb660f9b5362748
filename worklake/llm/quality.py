"""Quality classifier: random-indexing word vectors pooled per document, a two-layer numpy network, calibrated probabilities.

Words and their shapes have sparse random index vectors, fixed by a hash; a word's vector is the sum of the index vectors around it
in the labelled sample. A document is the mean of its words' vectors, the mean of its shapes' index vectors, and the shares of
distinct, repeated and long-repeated words. The network learns from a bounded sample of labelled rows: at most LABELLED, taken by a
hash of the id. A fifth of it is kept from training and fits the temperature by which the logits are divided.

Null or empty text: the pooled vectors are zero, and the score is what the network gives to that. Labels that are null teach nothing;
a document with several labels counts once for each. No labels, or one kind only: that kind's share (0.5 without any) for all.
Repeated rows and null ids: each row is scored by itself.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklake.llm.common import map_texts, query, table

LABELLED = 5000
WORDS = 1 << 15  # rows of word vectors; a word's row is a hash
SHAPES = 1 << 10
DIM = 64
NONZERO = 6  # of an index vector
AROUND = 2  # words on each side
HIDDEN = 32
CACHED = 300_000  # words whose rows a worker remembers
CUT = 0.3

_RUN = re.compile(r"(.)\1{2,}", re.DOTALL)


def _shape(word: str) -> str:
    kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word[:24])
    return re.sub(r"(.)\1+", r"\1", kinds, flags=re.DOTALL) + ("+" if _RUN.search(word[:64]) else "")


def index_vectors(rows: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    out = np.zeros((rows, DIM), np.float32)
    for _ in range(NONZERO):
        out[np.arange(rows), rng.integers(0, DIM, rows)] += rng.choice(np.float32([-1, 1]), rows)
    return out


class Words:
    """Rows of the words of texts, with what was seen before remembered."""

    def __init__(self):
        self.seen: dict[str, tuple[int, int]] = {}

    def row(self, word: str) -> tuple[int, int]:
        got = self.seen.get(word)
        if got is None:
            if len(self.seen) >= CACHED:
                self.seen.clear()
            got = (xxhash.xxh32_intdigest(word.lower()) % WORDS, xxhash.xxh32_intdigest(_shape(word), 1) % SHAPES)
            self.seen[word] = got
        return got

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(words, 2) rows of all texts, one after the other, and the number of words of each text."""
        parts, counts = [np.zeros((0, 2), np.int32)], []
        for a in range(0, len(texts), 200):  # few words at once as Python objects
            split = [t.split() for t in texts[a:a + 200]]
            counts += [len(s) for s in split]
            parts.append(np.array([self.row(w) for s in split for w in s], np.int32).reshape(-1, 2))
        return np.concatenate(parts), np.array(counts, np.int64)


def word_vectors(rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Random indexing: sums of the index vectors of the words around, weakened by the square root of the word's count."""
    index = index_vectors(WORDS, 1)
    doc = np.repeat(np.arange(len(counts)), counts)
    total = index.copy()
    for off in range(1, AROUND + 1):
        same = doc[:-off] == doc[off:] if len(doc) > off else np.zeros(0, bool)
        left, right = rows[:-off, 0][same], rows[off:, 0][same]
        for at, around in ((left, right), (right, left)):
            order = np.argsort(at, kind="stable")
            for a in range(0, len(order), 200_000):
                part = order[a:a + 200_000]
                own, first = np.unique(at[part], return_index=True)
                total[own] += np.add.reduceat(index[around[part]], first, axis=0)
    return total / np.maximum(1, np.linalg.norm(total, axis=1, keepdims=True))


def pooled(rows: np.ndarray, counts: np.ndarray, vectors: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """A row of features a document."""
    out = np.zeros((len(counts), 2 * DIM + 4), np.float32)
    ends = np.cumsum(counts)
    for i, (a, b) in enumerate(zip(ends - counts, ends)):
        if b == a:
            continue
        n, own = b - a, rows[a:b]
        words, times = np.unique(own[:, 0], return_counts=True)
        kinds, uses = np.unique(own[:, 1], return_counts=True)
        out[i, :DIM] = (times / n) @ vectors[words]
        out[i, DIM:2 * DIM] = (uses / n) @ shapes[kinds]
        out[i, 2 * DIM:] = (len(words) / n, times.max() / n, float(np.mean(own[1:, 0] == own[:-1, 0])) if n > 1 else 0.0, np.log1p(n) / 10)
    return out


class Network:
    """Features, tanh, logit; the logit over the temperature gives the probability."""

    def __init__(self, vectors, shapes, mean, scale, w1, b1, w2, b2, temperature):
        self.vectors, self.shapes, self.mean, self.scale = vectors, shapes, mean, scale
        self.w1, self.b1, self.w2, self.b2, self.temperature = w1, b1, w2, b2, temperature

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
        z = self.logits(pooled(rows, counts, self.vectors, self.shapes)) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(texts: list[str], labels: list[int], epochs: int = 60, seed: int = 7) -> Network | float:
    """The network of a bounded sample; the share of 1 (0.5 without rows) where there is only one kind."""
    y = np.array(labels, np.float64)
    if len(set(labels)) < 2:
        return float(y.mean()) if labels else 0.5
    rows, counts = Words().of(texts)
    vectors, shapes = word_vectors(rows, counts), index_vectors(SHAPES, 2)
    x = pooled(rows, counts, vectors, shapes)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    cut = len(y) // 5 if len(y) >= 10 else 0
    held, used = order[:cut], order[cut:]
    mean, scale = x[used].mean(0), x[used].std(0) + 1e-3
    d = x.shape[1]
    net = Network(vectors, shapes, mean, scale, rng.normal(0, d ** -0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN ** -0.5, HIDDEN), 0.0, 1.0)
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    xs = (x - mean) / scale
    for _ in range(epochs):
        rng.shuffle(used)
        for a in range(0, len(used), 128):
            part = used[a:a + 128]
            h = np.tanh(xs[part] @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -40, 40)))
            g = (p - y[part]) / len(part)
            back = np.outer(g, params[2]) * (1 - h * h)
            grads = [xs[part].T @ back + 1e-3 * params[0], back.sum(0), h.T @ g + 1e-3 * params[2], g.sum(keepdims=True)]
            step += 1
            for q, grad, m, v in zip(params, grads, first, second):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                q -= 0.003 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    net.b2 = float(params[3][0])
    if len(set(y[held])) == 2:
        z = net.logits(x[held])

        def loss(t: float) -> float:
            return float(np.mean(np.logaddexp(0, z / t) - y[held] * z / t))
        net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def sample(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> tuple[list[str], list[int]]:
    """Texts and labels of at most `most` labelled rows, by a hash of the id."""
    labels = labels.select("doc_id", F.col("quality").cast("int").alias("label")).where("label IN (0, 1) AND doc_id IS NOT NULL")
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "label", F.xxhash64("text")).limit(most).collect()
    return [r.text or "" for r in rows], [r.label for r in rows]


def score(docs: DataFrame, net: Network | float) -> DataFrame:
    """doc_id, score; whole texts."""
    def make():
        words = Words()

        def fn(cols):
            if isinstance(net, float):
                return {"doc_id": cols["doc_id"], "score": [net] * len(cols["text"])}
            return {"doc_id": cols["doc_id"], "score": net.probability(*words.of(cols["text"]))}
        return fn
    return map_texts(docs.select("doc_id", "text"), make, "doc_id long, score double")


def _fold(docs: DataFrame):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


@query("op3_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = fit(*sample(docs, labels.where(_fold(labels) != 0)))
    return score(docs, net).select("doc_id", F.coalesce(_fold(docs) == 0, F.lit(False)).alias("held_out"), "score",
                                   (F.col("score") >= CUT).cast("int").alias("predicted"))
