"""Vector codes: product quantization, its codebooks refined by the filtering form of Lloyd's algorithm.

Components become integers, floor(256 x). Vectors are cut into PARTS equal consecutive parts, each with a codebook of at most ENTRIES
entries, at first those of the smallest vec_ids. Every partition cuts its vectors into blocks and keeps for each block and part a
kd-tree: the points in the tree's order and, for each node, its bounding box, count and sum. The trees are made once and kept as a
table. A round sends the codebooks (a few hundred kB) to the blocks and walks each tree down level by level: entries that are
farther than another one from every point of a node's box are ruled out, and a node with one entry left gives that entry its
cached sum and count as a whole; only leaves that are still undecided compare points. All is integer arithmetic, so results don't
depend on how rows are dealt.

Rows whose vector is null or holds a null or non-finite component are dropped. Ties go to the lower index. Rows without vec_id come
last among the smallest, rows with equal vec_id in the order of their integers; repeated rows count as often as they occur, also among
the first entries. With fewer than ENTRIES rows the codebooks are smaller; no rows give no rows. Vectors without components have code 00 in each
part and error 0. Vectors of different lengths, a length that PARTS does not divide and components so large that squared distances exceed 62 bits
(2^25 and more for 64 components) are errors. Only vec_id, embedding and label are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, table, tidy, with_hot_keys, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows and components of a block at most, points of a leaf at least.
BLOCK_ROWS, BLOCK_SIZE, LEAF = 4096, 1 << 20, 12

_BLOCK = "vec_ids array<bigint>, labels array<bigint>, dim int, points binary, places binary, low binary, high binary, sums binary"


class Tree:
    """A kd-tree over integer points: level l cuts the points, in the tree's order, into 2**l runs of equal size (up to one)."""

    def __init__(self, points: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray):
        self.points, self.low, self.high, self.sums = points, low, high, sums  # nodes: the root, then level by level

    @staticmethod
    def levels(n: int) -> int:
        return max(0, int(np.log2(max(1, n // LEAF))))

    @staticmethod
    def bounds(n: int, level: int) -> np.ndarray:
        return np.arange((1 << level) + 1) * n >> level

    @classmethod
    def of(cls, points: np.ndarray) -> tuple[Tree, np.ndarray]:
        """The tree and the points' places in the tree's order. Each node is cut at the median of its widest side."""
        n, place = len(points), np.arange(len(points))
        low, high, sums = [], [], []
        for level in range(cls.levels(n) + 1):
            p, at = points[place], cls.bounds(n, level)
            low.append(np.minimum.reduceat(p, at[:-1], axis=0))
            high.append(np.maximum.reduceat(p, at[:-1], axis=0))
            sums.append(np.add.reduceat(p, at[:-1], axis=0))
            if level < cls.levels(n):
                node = np.repeat(np.arange(1 << level), np.diff(at))
                side = (high[-1] - low[-1]).argmax(axis=1)
                place = place[np.lexsort((p[np.arange(n), side[node]], node))]
        return cls(points[place], *map(np.concatenate, (low, high, sums))), place

    def undecided(self, book: np.ndarray):
        """Walks down the tree: (nodes' runs and the only entry left for each) of every level, and at last the leaves with several entries:
        (start, end, entries) arrays and offsets into the entries.

        Yields (first, last, node, entry) for decided nodes and ends with (first, last, offsets, entries), where entries ascend.
        """
        n, top = len(self.points), self.levels(len(self.points))
        node, entry = np.zeros(len(book), np.int64), np.arange(len(book))  # pairs, by node, then entry
        for level in range(top + 1):
            base, at = (1 << level) - 1, self.bounds(n, level)
            low, high = self.low[base + node], self.high[base + node]
            z = book[entry]
            starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            size = np.diff(np.r_[starts, len(node)])
            mid = ((2 * z - low - high) ** 2).sum(axis=1)
            nearest = np.flatnonzero(mid == np.repeat(np.minimum.reduceat(mid, starts), size))
            best = nearest[np.flatnonzero(np.r_[True, node[nearest][1:] != node[nearest][:-1]])]  # the lowest entry nearest to the middle
            star = np.repeat(best, size)
            step = z - z[star]
            corner = np.where(step > 0, high, low)  # of the box, where the entry does best against the one nearest to the middle
            gap = (step * (z + z[star] - 2 * corner)).sum(axis=1)
            left = (gap < 0) | ((gap == 0) & (entry <= entry[star]))
            node, entry = node[left], entry[left]
            starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            size = np.diff(np.r_[starts, len(node)])
            one = starts[size == 1]
            yield at[node[one]], at[node[one] + 1], base + node[one], entry[one]
            rest = np.repeat(size > 1, size)
            node, entry = node[rest], entry[rest]
            if not len(node):
                break
            if level < top:  # both children get the entries
                starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
                size = np.diff(np.r_[starts, len(node)])
                twice = np.repeat(starts, 2 * size) + _count(np.repeat(size, 2))
                node, entry = 2 * np.repeat(node[starts], 2 * size) + (np.repeat(np.tile([0, 1], len(starts)), np.repeat(size, 2))), entry[twice]
        starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, np.int64)
        yield at[node[starts]], at[node[starts] + 1], np.r_[starts, len(node)], entry

    def leaves(self, book: np.ndarray, first: np.ndarray, last: np.ndarray, offsets: np.ndarray, entries: np.ndarray):
        """(places in the tree's order, entry, squared distance) of the points of undecided leaves, leaves with about as many entries at a time."""
        size = np.diff(offsets)
        for most in (2, 4, 8, 16, 32, 64, *range(128, len(book) + 64, 64)):
            here = np.flatnonzero((size <= most) & (size > (most // 2 if most <= 64 else most - 64)))
            if not len(here):
                continue
            some = entries[np.minimum(offsets[here][:, None] + np.arange(most), offsets[here + 1][:, None] - 1)]  # the last is repeated
            width = int((last - first)[here].max())
            at = np.minimum(first[here][:, None] + np.arange(width), last[here][:, None] - 1)
            d = np.zeros((len(here), width, most), np.int64)
            for k in range(book.shape[1]):
                d += (self.points[at, k][:, :, None] - book[some, k][:, None, :]) ** 2
            nearest = d.argmin(axis=2)  # the first, so the lower entry
            real = np.arange(width) < (last - first)[here][:, None]
            yield at[real], np.take_along_axis(some, nearest, 1)[real], np.take_along_axis(d, nearest[:, :, None], 2)[:, :, 0][real]

    def totals(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each entry, the count and the componentwise sum of the points nearest to it."""
        count, total = np.zeros(len(book), np.int64), np.zeros(book.shape, np.int64)
        *decided, rest = self.undecided(book)
        for first, last, node, entry in decided:
            np.add.at(count, entry, last - first)
            np.add.at(total, entry, self.sums[node])
        for at, entry, _ in self.leaves(book, *rest):
            np.add.at(count, entry, 1)
            np.add.at(total, entry, self.points[at])
        return count, total

    def nearest(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry and squared distance of each point, in the tree's order."""
        entry, error = np.zeros(len(self.points), np.int64), np.zeros(len(self.points), np.int64)
        *decided, rest = self.undecided(book)
        for first, last, _, e in decided:
            at = np.repeat(first, last - first) + _count(last - first)
            entry[at] = np.repeat(e, last - first)
            error[at] = ((self.points[at] - book[entry[at]]) ** 2).sum(axis=1)
        for at, e, d in self.leaves(book, *rest):
            entry[at], error[at] = e, d
        return entry, error


def _count(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def kept(rows: DataFrame) -> DataFrame:
    """vec_id, embedding, label of the rows whose vector is whole."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(F.col("vec_id").cast("bigint"), "embedding", F.col("label").cast("bigint")).filter(F.col("embedding").isNotNull() & fine)


def integers(values: np.ndarray) -> np.ndarray:
    """floor(256 x), exactly; too large ones are an error."""
    q = np.floor(values.astype(np.float64) * SCALE)
    if len(q) and not q.shape[-1] * 4.0 * np.abs(q).max(initial=0) ** 2 < 1 << 62:
        raise ValueError("a component is too large for exact squared distances")
    return q.astype(np.int64)


def first_books(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """[part, entry, place]: the parts of the vectors with the smallest vec_ids. At most `entries` rows come to the driver."""
    own = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), own).select("embedding").limit(entries).collect()
    if not rows:
        return np.zeros((parts, 0, 0), np.int64)
    if len({len(r[0]) for r in rows}) > 1 or len(rows[0][0]) % parts:
        raise ValueError(f"vectors need one length that {parts} divides")
    got = integers(np.array([r[0] for r in rows], np.float64).reshape(len(rows), -1))
    return np.ascontiguousarray(got.reshape(len(got), parts, -1).transpose(1, 0, 2))


def blocks(vectors: DataFrame, dim: int, parts: int = PARTS) -> DataFrame:
    """Blocks of vectors with the trees of all parts."""
    rows = max(1, min(BLOCK_ROWS, BLOCK_SIZE // max(1, dim)))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, rows):
                some = b.slice(at, rows)
                column = some.column(1)
                if any(n != dim for n in np.unique(np.diff(column.offsets.to_numpy()))):
                    raise ValueError(f"vectors need one length that {parts} divides")
                q = integers(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim))
                trees = [Tree.of(np.ascontiguousarray(q[:, k * dim // parts : (k + 1) * dim // parts])) for k in range(parts)]
                whole = lambda name, kind: np.concatenate([getattr(t, name).ravel() for t, _ in trees]).astype(kind).tobytes()
                one = {"dim": [dim], "points": [whole("points", "<i4")], "places": [np.concatenate([p for _, p in trees]).astype("<u2").tobytes()]}
                one |= {"low": [whole("low", "<i4")], "high": [whole("high", "<i4")], "sums": [whole("sums", "<i8")]}
                lists = {n: pa.array([c.to_pylist()], pa.list_(pa.int64())) for n, c in (("vec_ids", some.column(0)), ("labels", some.column(2)))}
                yield batch_of(_BLOCK, one | lists)

    return vectors.select("vec_id", "embedding", "label").mapInArrow(tidy(run), _BLOCK)


def _trees(n: int, dim: int, parts: int, columns: dict) -> list[Tree]:
    d, nodes = dim // parts, (2 << Tree.levels(n)) - 1
    shapes = {"points": (n, "<i4"), "low": (nodes, "<i4"), "high": (nodes, "<i4"), "sums": (nodes, "<i8")}
    whole = {c: np.frombuffer(columns[c], kind).astype(np.int64).reshape(parts, rows, d) for c, (rows, kind) in shapes.items()}
    return [Tree(whole["points"][k], whole["low"][k], whole["high"][k], whole["sums"][k]) for k in range(parts)]


def refined(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round. Each task adds its blocks up first; the driver gets one row for each entry."""
    parts, entries, d = books.shape
    schema = "part int, entry int, n bigint, total array<bigint>"
    sent = trees.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        import pyarrow as pa

        now = sent.value
        count, total = np.zeros((parts, entries), np.int64), np.zeros(now.shape, np.int64)
        for b in batches:
            for row in b.to_pylist():
                for k, tree in enumerate(_trees(row["n"], parts * d, parts, row)):
                    n, s = tree.totals(now[k])
                    count[k] += n
                    total[k] += s
        part, entry = np.nonzero(count)
        sums = pa.array(list(total[part, entry]), pa.list_(pa.int64()))
        yield batch_of(schema, {"part": part, "entry": entry, "n": count[part, entry], "total": sums})

    own = trees.select(F.size("vec_ids").alias("n"), "points", "low", "high", "sums")
    each = own.mapInArrow(tidy(run), schema)
    if d:
        each = each.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(d)]).alias("total"))
    out = books.copy()
    for r in each.collect() if d else []:
        out[r["part"], r["entry"]] = np.array(r["total"], np.int64) // r["n"]
    return out


def assigned(trees: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error of every vector."""
    parts, _, d = books.shape
    schema = "vec_id bigint, label bigint, code string, error bigint"
    sent = trees.sparkSession.sparkContext.broadcast(books)
    digits = np.frombuffer("".join(f"{i:02x}" for i in range(256)).encode(), "S2")

    def run(batches):
        now = sent.value
        for b in batches:
            for row in b.to_pylist():
                n = len(row["vec_ids"])
                code, error = np.zeros((n, parts), np.int64), np.zeros(n, np.int64)
                place = np.frombuffer(row["places"], "<u2").reshape(parts, n)
                if d:
                    for k, tree in enumerate(_trees(n, parts * d, parts, row)):
                        code[place[k], k], e = tree.nearest(now[k])
                        error[place[k]] += e
                text = [c.tobytes().decode() for c in digits[code]]
                yield batch_of(schema, {"vec_id": row["vec_ids"], "label": row["labels"], "code": text, "error": error})

    return trees.mapInArrow(tidy(run), schema)


def vector_codes(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error of every whole vector; the codebooks [part, entry, place]). At most 256 entries, as a code has two digits."""
    if entries > 256:
        raise ValueError("codes have two hexadecimal digits: at most 256 entries")
    vectors = kept(rows)
    books = first_books(vectors, parts, entries)
    dim = books.shape[0] * books.shape[2]
    trees = written(blocks(vectors, dim, parts), "codes-trees")
    for _ in range(rounds):
        books = refined(trees, books)
    return assigned(trees, books), books


def with_label_errors(codes: DataFrame) -> DataFrame:
    """codes with label_error, the sum of error over equal labels (nulls together)."""
    keyed = written(codes.withColumns({"_none": F.col("label").isNull(), "_label": F.coalesce("label", F.lit(0).cast("bigint"))}), "codes")
    sums = written(keyed.groupBy("_none", "_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")), "codes-labels")
    return with_hot_keys(keyed, sums, ["_none", "_label"], "_n").drop("_none", "_label")


def digest(books: np.ndarray) -> Column:
    return F.lit(hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest())


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes(table(spark, sf_dir, "embeddings"))
    return with_label_errors(codes).select("vec_id", "code", "error", "label_error", digest(books).alias("codebooks_sha256"))


def _round(now: str) -> str:
    """SQL of the nearest entry of each point: at (row, part, entry, distance) from codebook entries (part, entry, place, c)."""
    return f"""SELECT DISTINCT ON (row, part) row, part, entry, d FROM (
    SELECT p.row, p.part, e.entry, sum((p.q - e.c) * (p.q - e.c))::BIGINT AS d
    FROM points p JOIN {now} e ON p.part = e.part AND p.place = e.place GROUP BY p.row, p.part, e.entry) ORDER BY row, part, d, entry"""


def _moved(now: str, at: str) -> str:
    return f"""SELECT e.part, e.entry, e.place, coalesce(((s.t - (s.t % s.n + s.n) % s.n) // s.n)::BIGINT, e.c) AS c FROM {now} e LEFT JOIN (
    SELECT a.part, a.entry, p.place, sum(p.q)::BIGINT AS t, count(*) AS n FROM {at} a JOIN points p ON a.row = p.row AND a.part = p.part
    GROUP BY ALL) s ON e.part = s.part AND e.entry = s.entry AND e.place = s.place"""


OP11_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q,
    row_number() OVER (ORDER BY vec_id NULLS LAST, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding]) - 1 AS row
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), points AS MATERIALIZED (
  SELECT row, (k - 1) // (n // 16) AS part, (k - 1) % (n // 16) AS place, v AS q
  FROM (SELECT row, len(q) AS n, unnest(q) AS v, generate_subscripts(q, 1) AS k FROM kept)
), b0 AS MATERIALIZED (SELECT part, row AS entry, place, q AS c FROM points WHERE row < 64),
a0 AS MATERIALIZED ({_round("b0")}), b1 AS MATERIALIZED ({_moved("b0", "a0")}),
a1 AS MATERIALIZED ({_round("b1")}), b2 AS MATERIALIZED ({_moved("b1", "a1")}),
a2 AS MATERIALIZED ({_round("b2")}),
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
  FROM a2 JOIN kept USING (row) GROUP BY row, vec_id, label
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, place)) FROM b2) AS codebooks_sha256 FROM coded
"""
