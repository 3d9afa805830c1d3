"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is lower-cased and cut at white space; the bag of a word holds its byte n-grams of 3 to 5 bytes, with a blank as the
mark of its ends, hashed into BUCKETS. A window of WINDOW words is scored by the softmax of a linear layer over the mean of
its n-grams' embeddings; windows begin every STEP words and a text's score is that of its most toxic window, so a few words
count in a long text as in a short one. Embeddings and layer are trained together by AdaGrad: of a toxic document the most
toxic windows carry the label, of others the most toxic-looking ones do. Part of a bag is left out at random while
training, so words that share only some n-grams with those seen (misspellings) are scored as well.

At scoring time embedding and layer collapse into one number for each bucket: the score is linear in the bag.

At most PER_CLASS labelled documents of either class are used. Without both classes no text is toxic (score 0). Texts without
words (empty, null, white space) have score 0. Every row gets a score, also where a doc_id repeats or is null; equal texts have
equal scores. An empty table gives an empty result. Labels, lang, source and doc_id are never read by the model; other columns
may have any name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .labelled import kept, released, sample, score_table

PER_CLASS = 1500
BUCKETS, DIM, SIZES = 1 << 18, 8, (3, 4, 5)
WINDOW, STEP = 8, 4
EPOCHS, RATE, DROP, SEED = 12, 0.3, 0.4, 7
THRESHOLD = 0.5
#: Characters that one numpy pass covers; a longer text is scored in parts of LONG windows, with the same result.
BLOCK, LONG = 1 << 17, 4096
_SPACES = bytes(32 if b in (9, 10, 11, 12, 13, 32) else b for b in range(256))


class Bags:
    """N-grams of a block of texts. `bucket` by n-gram, `word` (index of the word that an n-gram begins in or before)."""

    def __init__(self, texts: list[str]) -> None:
        raw = [t.lower().encode().translate(_SPACES) for t in texts]
        data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
        blank = data == 32
        starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
        self.n_words = len(starts)
        ends = np.cumsum([len(r) + 1 for r in raw])
        # words up to the end of each text
        self.upto = np.searchsorted(starts, ends + 1, side="left")
        solid = np.append(0, np.cumsum(blank))
        code = data.astype(np.uint32)
        word_of = np.cumsum(np.append(False, blank[:-1] & ~blank[1:])) - 1
        buckets, words = [], []
        h = code.copy()
        for n in range(2, max(SIZES) + 1):
            h = h[: len(data) - n + 1] * np.uint32(16777619) ^ code[n - 1 :]
            if n in SIZES:
                # inside an n-gram there is no blank; it may begin or end with one
                inner = solid[n - 1 : len(data)] - solid[1 : len(data) - n + 2]
                at = np.flatnonzero(inner == 0)
                x = h[at] ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
                x ^= x >> np.uint32(15)
                x *= np.uint32(0x85EBCA6B)
                buckets.append((x >> np.uint32(32 - 18)).astype(np.int32))
                words.append(word_of[at + 1].astype(np.int32))
        self.bucket, self.word, self.cut = np.concatenate(buckets), np.concatenate(words), None

    def sort(self) -> None:
        """N-grams in the order of their words; `cut` (where each word's begin) takes the place of `word`."""
        order = np.argsort(self.word, kind="stable")
        self.bucket = self.bucket[order]
        self.cut = np.append(0, np.cumsum(np.bincount(self.word, minlength=self.n_words)))
        self.word = None

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and end word of every window, and its text. A text without words has one empty window."""
        lo = np.append(0, self.upto[:-1])
        n = self.upto - lo
        many = np.maximum(1, -(-np.maximum(n - WINDOW, 0) // STEP) + 1)
        text = np.repeat(np.arange(len(n)), many)
        k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        first = lo[text] + k * STEP
        return first, np.minimum(first + WINDOW, self.upto[text]), text


def _blocks(texts: list[str]):
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK):
            size += len(texts[end])
            end += 1
        yield at, texts[at:end]
        at = end


def _parts(text: str) -> list[str]:
    """A long text in parts of LONG windows, with the words that their last windows share with the next part."""
    raw = text.encode()
    blank = np.frombuffer(b" " + raw.translate(_SPACES), np.uint8) == 32
    starts = np.flatnonzero(blank[:-1] & ~blank[1:])
    many = LONG * STEP
    cuts = range(0, max(1, len(starts) - (WINDOW - STEP)), many)
    ends = [starts[k + many + WINDOW - STEP] if k + many + WINDOW - STEP < len(starts) else len(raw) for k in cuts]
    return [raw[0 if not len(starts) else starts[k] : e].decode() for k, e in zip(cuts, ends, strict=True)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """worth: contribution of each bucket to the logit of class 1 against class 0; bias."""

    def __init__(self, worth: np.ndarray | None, bias: float) -> None:
        self.worth, self.bias = worth, bias

    def logits(self, bags: Bags) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if bags.cut is None:
            total = np.append(0, np.cumsum(np.bincount(bags.word, self.worth[bags.bucket], bags.n_words)))
            count = np.append(0, np.cumsum(np.bincount(bags.word, minlength=bags.n_words)))
        else:
            total, count = np.append(0, np.cumsum(self.worth[bags.bucket], dtype=np.float64))[bags.cut], bags.cut
        a, b, text = bags.windows()
        return (total[b] - total[a]) / np.maximum(count[b] - count[a], 1) + self.bias, a, b, text

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts))
        if self.worth is None:
            return out
        for at, part in _blocks(texts):
            if len(part) == 1 and len(part[0]) > BLOCK and len(parts := _parts(part[0])) > 1:
                out[at] = max(self.scores([p])[0] for p in parts)
                continue
            bags = Bags(part)
            logit, _, _, text = self.logits(bags)
            best = np.maximum.reduceat(logit, np.flatnonzero(np.diff(text, prepend=-1)))
            out[at : at + len(part)] = np.where(np.diff(bags.upto, prepend=0) > 0, _sigmoid(best), 0)
        return out


def train(texts: list[str], labels: list[int]) -> Model:
    y = np.array(labels)
    if len(set(labels)) < 2:
        return Model(None, 0.0)
    rng = np.random.default_rng(SEED)
    table_ = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    layer = rng.normal(0, 1, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen, seen_l, seen_b = np.full(BUCKETS, 1e-6, np.float32), np.full((DIM, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    blocks = []
    for at, part in _blocks(texts):
        bags = Bags(part)
        bags.sort()
        blocks.append((at, bags))
    share = {0: len(y) / (2 * (y == 0).sum()), 1: len(y) / (2 * (y == 1).sum())}
    for epoch in range(EPOCHS * min(2, max(1, 2 * PER_CLASS // len(y)))):  # small samples are gone over more often
        model = Model(table_ @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0]))
        picked = []
        for i, (at, bags) in enumerate(blocks):
            logit, a, b, text = model.logits(bags)
            # the most toxic windows of each text; at first any
            rank = rng.random(len(logit)) if epoch < 2 else -logit
            order = np.lexsort((rank, text))
            nth = np.arange(len(text)) - np.repeat(np.flatnonzero(np.diff(text[order], prepend=-1)), np.bincount(text))
            take = order[nth < (6 if epoch < 2 else 2)]
            most = 1 if epoch >= 4 else 6
            chosen = take[(y[at + text[take]] == 0) | (nth[nth < (6 if epoch < 2 else 2)] < most)]
            picked += [(i, a[w], b[w], y[at + text[w]]) for w in chosen]
        rng.shuffle(picked)
        size = min(max(len(picked) // 40, 16), 256)  # small samples take as many steps as large ones
        for s in range(0, len(picked), size):
            part = picked[s : s + size]
            ids = [blocks[i][1].bucket[blocks[i][1].cut[a] : blocks[i][1].cut[b]] for i, a, b, _ in part]
            ids = [x[rng.random(len(x)) >= DROP] for x in ids]
            n = np.array([len(x) for x in ids])
            if not n.sum():
                continue
            label = np.array([p[3] for p in part])[n > 0]
            ids, n = [x for x in ids if len(x)], n[n > 0]
            flat, row = np.concatenate(ids), np.repeat(np.arange(len(n)), n)
            mean = np.add.reduceat(table_[flat], np.cumsum(n) - n) / n[:, None]
            z = mean @ layer + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(n)), label] -= 1
            g = p * np.array([share[0], share[1]])[label][:, None] / len(n)
            gl, gb = mean.T @ g, g.sum(axis=0)
            gm = (g @ layer.T) * (len(n) / n[:, None])
            at_, back = np.unique(flat, return_inverse=True)
            grad = np.zeros((len(at_), DIM), np.float32)
            for d in range(DIM):
                grad[:, d] = np.bincount(back, gm[row, d], len(at_))
            seen[at_] += (grad**2).mean(axis=1)
            table_[at_] -= RATE * grad / np.sqrt(seen[at_])[:, None]
            seen_l += gl**2
            layer -= 0.1 * RATE * gl / np.sqrt(seen_l)
            seen_b += gb**2
            bias -= 0.1 * RATE * gb / np.sqrt(seen_b)
    return Model((table_ @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    return released(train, *sample(docs, labels, "toxic", per_class))


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic."""
    return kept(docs, fit(docs, labels), THRESHOLD, 0)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_table(docs, fit(docs, table(spark, sf_dir, "labels")), THRESHOLD)
