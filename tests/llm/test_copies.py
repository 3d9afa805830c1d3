"""The pipeline's near copies against all pairs."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from featurelab.llm import copies

from .conftest import rows


def slow_kept(docs):
    """Rows (doc_id, text, ...) that stay: the least of each component of pairs with a similarity of 0.8 or more, by all pairs."""
    sets = []
    for r in docs:
        w = (r[1] or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if 9 * len(a & b) >= 4 * (len(a) + len(b)) and (a or not b):
                root[find(j)] = find(i)
    least = {}
    for i, r in enumerate(docs):
        least.setdefault(find(i), []).append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in least.values()]


def some_docs(n, group):
    """Texts that share a common line, and a group of near copies that is too long for a list of all pairs."""
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    line = "this line is in every text of the table and says nothing"
    out, body = [], rnd.choices(words, k=60)
    for i in range(n):
        x = rnd.choices(words, k=rnd.randint(8, 40))
        out.append(" ".join(x) + " " + line)
        if i % 5 == 0:
            y = x.copy()
            for _ in range(rnd.randint(1, 2)):
                y[rnd.randrange(len(y))] = "changed"
            out.append(" ".join(y) + " " + line)
    for _ in range(group):
        x = body.copy()
        for _ in range(rnd.randint(1, 2)):
            x[rnd.randrange(60)] = rnd.choice(words)
        out.append(" ".join(x))
    rnd.shuffle(out)
    return list(enumerate(out))


def test_near_dedup_finds_all_similar_pairs(spark, sf):
    docs = some_docs(150, 100)
    df = spark.createDataFrame([(*d, "en", "s", 1) for d in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    want = slow_kept(docs)
    got = [tuple(r) for r in corpus_pipeline._near_dedup(spark, df, sf).select("doc_id", "text").collect()]
    assert len(want) < len(docs) - 30 and sorted(got) == sorted(want)


@pytest.mark.parametrize("pairwise, often", [(1, 1), (3, 2), (64, 8)])
def test_long_lists_and_frequencies_lose_nothing(spark, monkeypatch, pairwise, often):
    monkeypatch.setattr(copies, "PAIRWISE", pairwise)
    monkeypatch.setattr(copies, "OFTEN", often)
    monkeypatch.setattr(copies, "BLOCK", 7)
    docs = some_docs(60, 40)
    got = copies.one_of_each(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert sorted(tuple(r) for r in got) == sorted(slow_kept(docs))


def test_rows_are_told_apart_by_all_columns(spark, edge, sf):
    """A doc_id that repeats with unrelated texts loses none; rows without a doc_id are compared like others."""
    got = corpus_pipeline._near_dedup(spark, edge, sf)
    assert got.columns == edge.columns
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter(r[:2] for r in slow_kept(rows()))
    words = " ".join(f"w{i}" for i in range(50))
    docs = [(1, words), (1, "quite another text than the one before"), (None, words + " end"), (None, "no other row has this text"), (None, "no other row has this text"), (2, words)]
    for df in (spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(docs[::-1], "doc_id bigint, text string")):
        left = Counter(tuple(r) for r in corpus_pipeline._near_dedup(spark, df, sf).collect())
        assert left == Counter([(1, words), (1, "quite another text than the one before"), (None, "no other row has this text")])


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50, 1000])
def test_lists_come_in_any_batches(size):
    """Short lists give all allowed pairs, long ones all members once and a chain of pairs, however the batches are cut."""
    rng = np.random.default_rng(size)
    rows_ = sorted({(int(h), int(n) << 32 | int(rng.integers(0, 3)), int(i)) for i, (h, n) in enumerate(zip(rng.integers(0, 70, 160) ** 2 // 70, rng.integers(8, 14, 160), strict=True))})
    cols = [np.array(c, np.int64) for c in zip(*rows_, strict=True)]
    h, pos, sid = cols
    batches = [pa.RecordBatch.from_arrays([pa.array(c[k : k + size]) for c in (h, sid, pos)], names=["h", "sid", "pos"]) for k in range(0, len(h), size)]
    got = [r for b in copies._scan(batches, 4) for r in b.to_pylist()]
    lists = {}
    for k, p, i in rows_:
        lists.setdefault(k, []).append((p, i))
    want, chain, members = set(), set(), Counter()
    for k, own in lists.items():
        if len(own) > 4:
            members.update((i, k, p) for p, i in own)
        for x in range(len(own)):
            for y in range(x + 1, len(own)):
                (p, a), (q, b) = own[x], own[y]
                n, m = p >> 32, q >> 32
                if len(own) <= 4 and 9 * min(n - (p & 0xFFFFFFFF), m - (q & 0xFFFFFFFF)) >= 4 * (n + m):
                    want.add((a, b))
                if len(own) > 4 and y - x <= 2 and 9 * min(n, m) >= 4 * (n + m):
                    chain.add((a, b))
    assert {(r["a"], r["b"]) for r in got if r["b"] is not None} == want | chain and want and chain
    assert Counter((r["a"], r["h"], r["pos"]) for r in got if r["h"] is not None) == members


@pytest.mark.parametrize("size, few", [(1, False), (5, False), (1000, False), (1000, True)])
def test_blocks_of_long_lists_meet_once(size, few):
    rng = np.random.default_rng(3)
    base, sets = rng.integers(-(2**63), 2**63 - 1, 400), []
    for i in range(60):  # sizes on both sides of a power of two, some of them close, some far apart
        own = np.concatenate([base[i % 3 * 100 : i % 3 * 100 + 60 + i % 9], rng.integers(-(2**63), 2**63 - 1, i % 12)])
        sets.append(np.unique(own))
    comp, block = rng.integers(0, 4, 60), rng.integers(0, 3, 60)
    rows_ = sorted((1, min(block[i], o), max(block[i], o), block[i], i, len(sets[i]) << 32, comp[i]) for i in range(60) for o in range(3))
    cols = [pa.array(np.array(c, np.int64)) for c in zip(*rows_, strict=True)] + [pa.array([copies.parities(sets[r[4]]).tobytes() for r in rows_], pa.binary())]
    names = ["h", "s", "t", "block", "sid", "pos", "comp", "bits"]
    whole = pa.RecordBatch.from_arrays(cols, names=names)
    got = Counter(frozenset((r["a"], r["b"])) for b in copies._across((whole.slice(k, size) for k in range(0, len(rows_), size)), few) for r in b.to_pylist())
    far = {frozenset((i, j)): copies.least_difference(copies.parities(sets[i]), copies.parities(sets[j])) for i in range(60) for j in range(i) if comp[i] != comp[j]}
    n = {p: sum(len(sets[i]) for i in p) for p in far}
    want = {p for p, d in far.items() if 9 * min(len(sets[i]) for i in p) >= 4 * n[p] and 9 * d <= n[p]}
    truly = {p for p in far if 9 * len(np.intersect1d(*[sets[i] for i in p])) >= 4 * n[p]}
    assert max(got.values()) == 1 and truly <= want and 50 < len(want) < len(far) / 2
    assert set(got) < want if few else set(got) == want
    if few:
        assert {frozenset(comp[i] for i in p) for p in want} == {frozenset(comp[i] for i in p) for p in got}


def test_parities_bound_the_difference():
    rng = np.random.default_rng(1)
    for n, m, both in ((0, 0, 0), (1, 0, 0), (5, 9, 3), (300, 260, 250), (1000, 70, 60), (64, 65, 64), (2000, 2100, 0)):
        every = np.unique(rng.integers(-(2**63), 2**63 - 1, n + m))
        x, y = every[:n], np.concatenate([every[: min(both, n)], every[n : n + m - both]])
        far = copies.least_difference(copies.parities(x), copies.parities(y))
        assert far <= len(np.setxor1d(x, y))
    assert far > (2000 + 2100) / 9


@pytest.mark.parametrize("bits", [1, 3])
def test_sets_with_the_same_short_hash_are_told_apart(spark, monkeypatch, bits):
    docs = some_docs(30, 12) + [(1000, ""), (1001, None), (1002, " ")]
    docs += [(2000 + i, t) for i, t in docs if i % 3 == 0]  # equal texts, equal sets
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    sets = copies.distinct_sets(df, bits)
    want = {}
    for i, t in docs:
        s = copies.shingle_set(t).tobytes()
        want[s] = min(want.get(s, i), i)
    got = sets.select("sid", "doc_id").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(want.values()) and len({r["sid"] for r in got}) == len(want)
    whole = copies.distinct_sets
    monkeypatch.setattr(copies, "distinct_sets", lambda d: whole(d, bits))
    left = copies.one_of_each(df)
    assert sorted(tuple(r) for r in left.collect()) == sorted(slow_kept(docs))
    copies.drop_sets(left)
    assert not [t for t in spark.catalog.listTables() if t.name == left._sets_table]


def near_copies(n, group):
    """Long texts, some with copies that differ in a few words, and a group of such copies."""
    rnd, out = random.Random(8), []
    words = [f"w{i}" for i in range(3000)]
    for i in range(n):
        x = rnd.choices(words, k=400)
        out.append(" ".join(x))
        for _ in range(group if i == 0 else i % 2):
            y = x.copy()
            y[rnd.randrange(400)] = rnd.choice(words)
            out.append(" ".join(y))
    rnd.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("many", [1000, 2])
def test_simhash_brings_near_copies_together(spark, monkeypatch, sf, many):
    """Without the exact check, what SimHash links and whole sets confirm is one group; frequent sets (many = 2) lose nothing."""
    docs = near_copies(20, 30)
    sets = [copies.shingle_set(t) for _, t in docs]
    fps = [int(x) for x in copies.fingerprints_of_sets(sets)]
    alike = lambda x, y: 9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y))
    close = [(i, j) for i in range(len(docs)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4 and alike(sets[i], sets[j])]
    root = list(range(len(docs)))
    for i, j in close * 4:
        root[i] = root[j] = min(root[i], root[j])
    whole = copies.postings
    monkeypatch.setattr(copies, "MANY", many)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    assert sorted(tuple(r) for r in corpus_pipeline._near_dedup(spark, df, sf).collect()) == sorted(slow_kept(docs))
    monkeypatch.setattr(copies, "postings", lambda s: whole(s).limit(0))
    got = {r["doc_id"] for r in corpus_pipeline._near_dedup(spark, df, sf).collect()}
    assert len(close) > 30 and got == {i for i in range(len(docs)) if root[i] == i}
