"""Vector codes, filter audit and line dedup against their SQL, brute force and edge cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from featurelab.llm import audit, codes, lines, queries

from ..compare import connection, same
from .conftest import COLUMNS, rows

NEW = ["op11_vector_codes", "op12_filter_audit", "op13_line_dedup"]


@pytest.mark.parametrize("name", NEW)
def test_query_equals_its_sql(spark, sf, name):
    same(queries.queries()[name](spark, sf), connection(sf), queries.oracle_sql()[name])


# --- 11 vector codes ---------------------------------------------------------------------------------------------------


def slow_nearest(points, book):
    d = ((points[:, None, :] - book[None]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)


@pytest.mark.parametrize("n, d, entries, spread", [(1, 1, 1, 3), (5, 4, 64, 2), (500, 4, 64, 3), (3000, 4, 64, 200), (700, 2, 7, 1), (400, 9, 200, 40), (50, 3, 3, 0)])
def test_trees_equal_plain_assignment(n, d, entries, spread):
    rng = np.random.default_rng(n)
    points, book = rng.integers(-spread, spread + 1, (n, d)), rng.integers(-spread, spread + 1, (entries, d))  # small spreads give many ties
    tree, place = codes.Tree.of(points)
    entry, error = slow_nearest(points, book)
    got, off = tree.nearest(book)
    assert (got == entry[place]).all() and (off == error[place]).all()
    count, total = tree.totals(book)
    assert count.tolist() == np.bincount(entry, minlength=entries).tolist()
    assert all((total[e] == points[entry == e].sum(axis=0)).all() for e in range(entries))


def test_boxes_decide_whole_subtrees():
    """Far clusters: no point is compared."""
    rng = np.random.default_rng(1)
    centres = np.array([[0, 0], [0, 10_000], [10_000, 0], [10_000, 10_000]])
    tree, _ = codes.Tree.of((centres[:, None] + rng.integers(-9, 9, (4, 256, 2))).reshape(-1, 2))
    *decided, (first, _, _, _) = tree.undecided(centres)
    assert len(first) == 0 and sum(len(d[0]) for d in decided) == 4


VECTORS = "vec_id bigint, embedding array<float>, label int, error bigint, code string, part int"


def vectors(n, dim=32, seed=2):
    rng = np.random.default_rng(seed)
    return [(i * 3, [float(x) for x in np.round(rng.normal(size=dim), 2).astype(np.float32)], [None, 1, 2][i % 3], 1, "c", 2) for i in range(n)]


def brute_codes(rows, parts=16, entries=64, rounds=2):
    good = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    q = [np.floor(np.array(r[1], np.float32).astype(float) * 256).astype(np.int64) for r in good]
    order = sorted(range(len(good)), key=lambda i: (good[i][0] is None, good[i][0] or 0, q[i].tolist()))
    d, code, error, final = len(q[0]) // parts, [""] * len(good), [0] * len(good), []
    for k in range(parts):
        p = np.array([x[k * d : (k + 1) * d] for x in q])
        book = p[order[:entries]].copy()
        for _ in range(rounds):
            e, _ = slow_nearest(p, book)
            book = np.array([[int(t) // int((e == j).sum()) for t in p[e == j].sum(axis=0)] if (e == j).any() else book[j] for j in range(len(book))])
        e, off = slow_nearest(p, book)
        final += book.ravel().tolist()
        for i in range(len(good)):
            code[i] += f"{e[i]:02x}"
            error[i] += int(off[i])
    by_label = Counter()
    for r, x in zip(good, error, strict=True):
        by_label[r[2]] += x
    sha = hashlib.sha256(",".join(map(str, final)).encode()).hexdigest()
    return Counter((r[0], c, x, by_label[r[2]], sha) for r, c, x in zip(good, code, error, strict=True))


def coded(df):
    found, books = codes.vector_codes(df)
    return Counter(tuple(r) for r in codes.with_label_errors(found).select("vec_id", "code", "error", "label_error", codes.digest(books)).collect())


@pytest.mark.parametrize("n", [3, 70, 400])
def test_codes_on_odd_rows(spark, monkeypatch, n):
    monkeypatch.setattr(codes, "BLOCK_ROWS", 100)
    some = vectors(n)
    bad = [None, *[[x] + some[0][1][1:] for x in (None, float("nan"), float("inf"), float("-inf"))]]
    some += [some[1], some[1], (None, *some[2][1:]), (some[0][0], *some[2][1:]), *[(-k, b, 1, 1, "c", 2) for k, b in enumerate(bad)]]
    assert coded(spark.createDataFrame(some, VECTORS).repartition(5)) == brute_codes(some)


def test_codes_without_vectors_and_of_other_lengths(spark):
    df = spark.createDataFrame([], VECTORS)
    assert coded(df) == {} and coded(spark.createDataFrame([(1, None, 1, 1, "c", 2)], VECTORS)) == {}
    assert {(r[0], r[1], r[2]) for r in coded(spark.createDataFrame([(1, [], 1, 1, "c", 2), (2, [], 1, 1, "c", 2)], VECTORS))} == {(1, "00" * 16, 0), (2, "00" * 16, 0)}
    with pytest.raises(Exception, match="one length"):
        coded(spark.createDataFrame([(1, [1.0] * 16, 1, 1, "c", 2), (2, [1.0] * 32, 1, 1, "c", 2)], VECTORS))
    with pytest.raises(Exception, match="too large"):
        coded(spark.createDataFrame([(1, [1e30] * 16, 1, 1, "c", 2)], VECTORS))


# --- 12 filter audit ---------------------------------------------------------------------------------------------------


def slow_audit(docs, labels):
    import re

    mask, first = [], {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    for doc_id, text, _ in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)), doc_id is not None and doc_id > first[t])
        mask.append({f for f, bad in zip("ABCDE", fails, strict=True) if bad})
    out = {}
    for part in {d[2] or "" for d in docs}:
        mine = [(m, d[0]) for m, d in zip(mask, docs, strict=True) if (d[2] or "") == part]
        for order in permutations("ABCDE"):
            alive = mine
            for k, f in enumerate(order):
                gone = [x for x in alive if f in x[0]]
                alive = [x for x in alive if f not in x[0]]
                lost = [sum(any(q[c] == 1 for q in labels if q[0] == i and i is not None) for _, i in gone) for c in (1, 2)]
                out[part, "".join(order), k + 1] = [len(alive), len(gone), sum(f in m for m, _ in mine) - len(gone), sum(m == {f} for m, _ in mine), *lost]
    total = Counter()
    for (part, order, step), v in out.items():
        total[part, order[step - 1]] += v[1]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(df, labels):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in audit.audit(df, labels).collect()}


def test_audit_on_odd_rows(spark):
    plain = " ".join(f"w{i}" for i in range(120))
    docs = [(i, t, lang) for i, (t, lang) in enumerate([(None, "en"), ("", None), ("", ""), (plain, "en"), (plain, "fr"), (plain + " #", "en"), (plain.upper(), "en"), ("a b " * 200, "en"), ("É ÀB cd|", None)])]
    docs += [(3, plain, "en"), (3, plain, "de"), (None, plain, "en"), (None, plain, "en"), (8, "other $", None), (50, "x " * 100_000 + "Y%", "en"), *[(100 + i, plain, "en") for i in range(30)]]
    labels = [(3, 1, 0), (3, 0, 1), (4, None, 1), (7, 1, 1), (None, 1, 1), (999, 1, 1), (1, 0, 0), (100, 1, None), (100, 1, None)]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id bigint, text string, lang string, mask int, n int").repartition(4)
    known = spark.createDataFrame([(*x, "p") for x in labels], "doc_id bigint, quality int, toxic int, part string")
    assert audited(df, known) == slow_audit(docs, labels)
    assert len(audited(df, known.limit(0))) == 600 * 4 and audited(df.limit(0), known) == {}


# --- 13 line dedup -----------------------------------------------------------------------------------------------------


def slow_lines(docs, min_chars=40, min_docs=5):
    blank, holders = " \t\n\x0b\x0c\r", defaultdict(set)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(blank).translate(lower)
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            holders[key(line)].add(doc_id)
    least = lambda i: (i is not None, i or 0)
    top = {k: max(v, key=least) for k, v in holders.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = []
    for doc_id, text in docs:
        every = (text or "").split("\n")
        kept = [x for x in every if key(x) not in top or top[key(x)] == doc_id]
        out.append((doc_id, "\n".join(kept), len(every), len(every) - len(kept)))
    return Counter(out)


def line_docs():
    rnd, a, b = random.Random(5), "This line is shared by very many of the documents", "é" * 30 + " another shared line"
    docs = [(i, "\n".join(rnd.choice([a, b, a.upper() + " \t", "\r  " + a, "short", "", f"a line of document {i} alone, and long enough", "É" * 45, "é" * 45, "x" * 39, "y" * 40, "z" * 39 + "é"]) for _ in range(rnd.randint(0, 9)))) for i in range(60)]
    docs += [(None, a), (None, a + "\n" + b), (None, None), (70, None), (71, ""), (72, "\n"), (3, a), (3, "y" * 40), (3, "y" * 40), (80, "\n".join([a, "own"] * 3000))]
    four = "a line that only four documents have, one of them twice"
    return docs + [(200 + i, four) for i in range(4)] + [(200, four + "\n" + four), (300, "five with null, " * 4), *[(None if i == 4 else 400 + i, "five with a null among them " * 3) for i in range(5)]]


@pytest.mark.parametrize("waiting", [0, 3, 50_000])
def test_lines_on_odd_rows(spark, waiting):
    docs = line_docs()
    df = spark.createDataFrame([(*d, "d", 3) for d in docs], "doc_id bigint, text string, digest string, place int").repartition(6)
    bitmaps = lines.keep_bitmaps(df, waiting=waiting)
    got = lines._applied(df, bitmaps, "doc_id bigint, text string, n_lines bigint, n_dropped bigint", lambda kept: ("text", kept))
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()) == slow_lines(docs)
    assert lines.without_repeats(df.limit(0)).count() == 0 and lines.keep_bitmaps(df.limit(0)).count() == 0


@pytest.mark.parametrize("cut", [1, 2, 3, 5, 7, 100])
@pytest.mark.parametrize("waiting", [0, 2, 1000])
def test_streams_cut_anywhere_agree(spark, monkeypatch, cut, waiting):
    """A hot line, cut into ranges within documents."""
    rnd = random.Random(cut)
    found = sorted(((bytes([g]), d, h, b"p") for g in range(4) for d in range(rnd.choice([1, 4, 5, 30])) for h in range(rnd.randint(1, 3))), key=lambda r: (r[0], -r[1], r[2]))
    size = -(-len(found) // cut)
    every = [x for k in range(cut) for x in lines.stream(found[k * size : (k + 1) * size], k, 5, waiting)]
    streamed = spark.createDataFrame(every, lines._STREAMED) if every else spark.createDataFrame([], lines._STREAMED)
    monkeypatch.setattr(lines, "streamed", lambda *a: streamed)
    monkeypatch.setattr(lines, "occurrences", lambda d, n: d)
    got = Counter((r["doc_id"], r["h"]) for r in lines.dropped(spark.createDataFrame([(1,)], "x int")).collect())
    docs = defaultdict(set)
    for g, d, _, _ in found:
        docs[g].add(d)
    assert got == Counter((d, h) for g, d, h, _ in found if len(docs[g]) >= 5 and d != max(docs[g]))


def test_bitmaps_are_compressed():
    at = [np.array(p, "<i4").tobytes() for p in ([5, 900], [5, 7], [100_000])]
    bitmap, n = lines.packed(at)
    keep = lines.stays(bitmap, 200_000)
    assert n == 4 and np.flatnonzero(~keep).tolist() == [5, 7, 900, 100_000] and len(bitmap) < 200 and len(zlib.decompress(bitmap)) == 12_501


def test_new_operators_on_the_edge_frame(spark, edge):
    plain = [(r[0], r[1]) for r in rows()]
    got = lines.without_repeats(edge)
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()) == slow_lines(plain)
    labels = spark.createDataFrame([(3, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert audited(edge, labels) == slow_audit([(r[0], r[1], r[2]) for r in rows()], [(3, 1, 0)])
    assert audited(spark.createDataFrame([], COLUMNS), labels) == {}
