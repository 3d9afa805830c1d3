"""Quality by random-indexing word vectors, pooled per document, under a two-layer numpy network.

Words are runs without white space. Each gives up to three tokens: itself (lower case, without punctuation around it; none if
nothing is left); its shape (classes of its characters, runs collapsed, at most SHAPE long); and a mark if it repeats the word
before it. The VOCABULARY most frequent words of the training sample are tokens of their own; all other words, also those that
the sample never held, share BUCKETS tokens by a hash, which learn from the sample's rarer words. Every token has a sparse ternary index vector, drawn from
a hash of the token; its word vector adds the sum of the index vectors found within SPAN tokens of it in the training
sample, scaled to length 1. A document is the mean of its tokens' vectors (zero without words). The network has one hidden
layer; its output is calibrated by a temperature chosen on a part of the sample that the weights have not seen.

At most PER_CLASS labelled documents of either class are used. Without both classes every text is good (score 1). Every row
gets a score, also where a doc_id repeats or is null; equal texts have equal scores; null is empty. A very long text is read in
parts. An empty table gives an empty result. Labels, lang, source and doc_id are never read by the model; other columns may
have any name.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .labelled import kept, released, sample, score_table

PER_CLASS = 1500
VOCABULARY, BUCKETS, SHAPES, SHAPE = 8000, 4096, 400, 8
DIM, NONZERO, SPAN = 64, 8, 2
HIDDEN, EPOCHS, RATE, SEED = 32, 60, 0.01, 11
THRESHOLD = 0.3
#: Raw words remembered at most; beyond that the memory starts anew.
MEMORY = 50_000
#: Characters of a text that are read at a time.
PART = 1 << 17

_SPACE = re.compile(r"\s")
_EDGE = re.compile(r"^\W+|\W+$")


def shape_of(word: str) -> str:
    out = ""
    for c in word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c if c.isascii() else "?"
        if out[-1:] != k:
            out += k
            if len(out) == SHAPE:
                break
    return out


def index_vector(token: str) -> np.ndarray:
    h = hashlib.sha256(token.encode()).digest()
    out = np.zeros(DIM, np.float32)
    for i in range(NONZERO):
        out[h[2 * i] % DIM] += 1 if h[2 * i + 1] & 1 else -1
    return out / np.sqrt(NONZERO)


class Reader:
    """Words to ids: word (0: nothing but punctuation; those of the vocabulary, then the buckets), shape (0: rare)."""

    def __init__(self, words: list[str], shapes: list[str]) -> None:
        self.words, self.shapes = {w: i + 1 for i, w in enumerate(words)}, {s: i + 1 for i, s in enumerate(shapes)}
        self.memory: dict[str, int] = {}

    def word_id(self, word: str) -> int:
        if not word:
            return 0
        return self.words.get(word) or 1 + len(self.words) + zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS

    def _look(self, raw: str) -> int:
        if len(self.memory) >= MEMORY:
            self.memory.clear()
        got = self.word_id(_EDGE.sub("", raw).lower()) * 1024 + self.shapes.get(shape_of(raw), 0)
        self.memory[raw] = got
        return got

    def ids(self, text: str, last: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, str | None]:
        """Words, shapes, repeats; and the last word. `last` is the one before the text."""
        raw, memory = text.split(), self.memory
        both = np.array([memory[w] if w in memory else self._look(w) for w in raw], np.int64)
        same = np.array([a == b for a, b in zip([last, *raw], raw, strict=False)], bool)
        return both >> 10, both & 1023, same, raw[-1] if raw else last


def _parts(text: str):
    """A text in parts of about PART characters, cut at white space."""
    at = 0
    while at < len(text):
        gap = _SPACE.search(text, at + PART)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


class Model:
    def __init__(self, reader: Reader | None, word=None, shape=None, repeat=None, layers=None, temperature: float = 1.0) -> None:
        self.reader, self.word, self.shape, self.repeat, self.layers, self.temperature = reader, word, shape, repeat, layers, temperature

    def __getstate__(self):
        if self.reader is not None:
            self.reader.memory = {}
        return self.__dict__

    def pooled(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), DIM), np.float32)
        for i, t in enumerate(texts):
            words, shapes, repeats, last = np.zeros(len(self.word), np.int64), np.zeros(len(self.shape), np.int64), 0, None
            for part in _parts(t):
                w, s, r, last = self.reader.ids(part, last)
                words += np.bincount(w, minlength=len(words))
                shapes += np.bincount(s, minlength=len(shapes))
                repeats += int(r.sum())
            if shapes.any():
                at = np.flatnonzero(words)
                total = words[at].astype(np.float32) @ self.word[at] + shapes.astype(np.float32) @ self.shape + repeats * self.repeat
                out[i] = total / shapes.sum()
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        mean, scale, w1, b1, w2, b2 = self.layers
        hidden = np.maximum((x - mean) / scale @ w1 + b1, 0)
        z = hidden @ w2 + b2
        return z[:, 1] - z[:, 0]

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.reader is None:
            return np.ones(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.logits(self.pooled(texts)).astype(np.float64) / self.temperature, -40, 40)))


def word_vectors(texts: list[str]) -> Model:
    """Random indexing over the sample."""
    words, shapes = Counter(), Counter()
    for t in texts:
        for raw in t.split():
            w = _EDGE.sub("", raw).lower()
            if w:
                words[w] += 1
            shapes[shape_of(raw)] += 1
    top = lambda c, n: [k for k, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:n]]
    reader = Reader(top(words, VOCABULARY), top(shapes, SHAPES))
    index_w = np.array([np.zeros(DIM, np.float32), *[index_vector(f"w {w}") for w in reader.words], *[index_vector(f"b {i}") for i in range(BUCKETS)]])
    index_s = np.array([index_vector("s rare"), *[index_vector(f"s {s}") for s in reader.shapes]])
    index_r = index_vector("repeat")
    context_w, context_s, context_r = np.zeros_like(index_w), np.zeros_like(index_s), np.zeros_like(index_r)
    for t in texts:
        w, s, r, _ = reader.ids(t)
        if not len(w):
            continue
        here = index_w[w] + index_s[s] + r[:, None] * index_r
        near = np.zeros_like(here)
        for k in range(1, SPAN + 1):
            near[k:] += here[:-k]
            near[:-k] += here[k:]
        np.add.at(context_w, w, near)
        np.add.at(context_s, s, near)
        context_r += near[r].sum(axis=0)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-9)
    word = index_w + unit(context_w)
    word[0] = 0
    return Model(reader, word, index_s + unit(context_s), index_r + unit(context_r))


def train(texts: list[str], labels: list[int]) -> Model:
    y = np.array(labels)
    if len(set(labels)) < 2:
        return Model(None)
    model = word_vectors(texts)
    x = model.pooled(texts)
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(y))
    spare, use = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[use].mean(axis=0), x[use].std(axis=0) + 1e-3
    p = [rng.normal(0, np.sqrt(2 / DIM), (DIM, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, 2)), np.zeros(2)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    share = np.array([len(use) / max(1, 2 * (y[use] == k).sum()) for k in (0, 1)])
    for _ in range(EPOCHS):
        rng.shuffle(use)
        for s in range(0, len(use), 64):
            at = use[s : s + 64]
            a = (x[at] - mean) / scale
            h = np.maximum(a @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            q = np.exp(z - z.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            q[np.arange(len(at)), y[at]] -= 1
            q *= share[y[at]][:, None] / len(at)
            back = (q @ p[2].T) * (h > 0)
            grads = [a.T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ q + 1e-4 * p[2], q.sum(axis=0)]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    model.layers = (mean, scale, *[a.astype(np.float32) for a in p])
    if len(spare):
        logit, sign = model.logits(x[spare]).astype(np.float64), 2 * y[spare] - 1
        tried = np.exp(np.linspace(np.log(0.25), np.log(20), 60))
        model.temperature = float(tried[np.argmin([np.logaddexp(0, -sign * logit / t).mean() for t in tried])])
    return model


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    return released(train, *sample(docs, labels, "quality", per_class))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are predicted good."""
    return kept(docs, fit(docs, labels), THRESHOLD, 1)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_table(docs, fit(docs, table(spark, sf_dir, "labels")), THRESHOLD)
