"""Packing token sequences as a cutting-stock problem solved by column generation.

A document's ids are cut into pieces of the full sequence length and one shorter tail. Full pieces are sequences of their
own. Tails are put into classes of length (rounded up to GRAIN tokens); their histogram is the demand of a cutting-stock
problem. A linear program over packing patterns is solved by a revised simplex method whose columns come from an unbounded
knapsack solved by dynamic programming over the dual prices. Its solution is rounded down; what is left of the demand (less
than one sequence for each pattern) is packed best-fit decreasing, which gives more patterns. All of this works on the
histogram, whose size does not depend on the corpus. Then documents are ranked within their class by a distributed order,
and a rank belongs to a place in an instance of a pattern by arithmetic alone.

Null text is empty: a document of the end id alone. Rows that repeat a doc_id are packed each for themselves. Pieces of one class
rank by doc_id (null first), start and digest of their ids; equal ones are interchangeable. A long text is as many full pieces
and one tail. An empty table gives an empty result. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batch_of, before, ordered, small, table, tidy, written

LENGTH, GRAIN, END_ID = 2048, 4, 1
#: Columns generated at most for one program; the solution at that point is feasible and only a little less tight.
MAX_COLUMNS = 4000
#: Pieces of the packing that offers the first patterns.
START_PIECES = 4000

_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids binary"


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, length: int = LENGTH, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, ids (little-endian unsigned 32-bit; null without keep_ids)."""

    def run(batches):
        from .tokens import tokenizer

        tok, names = tokenizer(tokenizer_path, "byte"), [f.split(" ")[0] for f in _PIECES.split(", ")]
        for b in small(batches):
            doc_ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for first, ids, off in tok.encode(texts):
                out = {n: [] for n in names}
                for k in range(len(off) - 1):
                    own = np.append(ids[off[k] : off[k + 1]], np.uint32(end_id)).astype("<u4").tobytes()
                    n = len(own) // 4
                    for s in range(0, n, length):
                        part = own[4 * s : 4 * (s + length)]
                        for name, v in zip(names, (doc_ids[first + k], s, len(part) // 4, zlib.crc32(part), n, part if keep_ids else None), strict=True):
                            out[name].append(v)
                yield batch_of(_PIECES, out)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(tidy(run), _PIECES)


def knapsack(price: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best worth and counts (by size, index 0 unused) of items with integer sizes 1.. and given prices, any number of each."""
    worth, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        with_one = worth[c - 1 :: -1][:c] + price[1 : c + 1]
        k = int(with_one.argmax())
        worth[c], took[c] = (with_one[k], k + 1) if with_one[k] > worth[c - 1] else (worth[c - 1], 0)
    counts, c = np.zeros(capacity + 1, np.int64), capacity
    while c > 0:
        if took[c]:
            counts[took[c]] += 1
            c -= took[c]
        else:
            c -= 1
    return float(worth[capacity]), counts


def solve(demand: np.ndarray, capacity: int, most: int = MAX_COLUMNS) -> list[tuple[np.ndarray, float]]:
    """The linear program min sum(x) with patterns covering the demand (by size, index 0 unused): patterns with x > 0."""
    sizes = np.flatnonzero(demand)
    m = len(sizes)
    if not m:
        return []
    fit = capacity // sizes
    columns = [np.where(np.arange(m) == i, fit[i], 0) for i in range(m)]
    inverse = np.diag(1.0 / fit)
    x = inverse @ demand[sizes]
    # patterns of a packing of a scaled-down demand are offered first, which saves most of the way to the optimum
    share = min(1.0, START_PIECES / demand.sum())
    pool = np.unique(np.array(best_fit(np.ceil(demand * share), capacity))[:, sizes], axis=0)
    for _ in range(most):
        dual = inverse.sum(axis=0)
        worths = pool @ dual
        best = int(worths.argmax())
        if worths[best] > 1 + 1e-7:
            column = pool[best]
        else:
            price = np.full(capacity + 1, -np.inf)
            price[sizes] = dual
            price[price <= 0] = -np.inf
            worth, counts = knapsack(price, capacity)
            if worth <= 1 + 1e-7:
                break
            column = counts[sizes]
        step = inverse @ column
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        by = ratio[out]
        x = np.maximum(x - by * step, 0)
        x[out] = by
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        columns[out] = column
    full = []
    for c, v in zip(columns, x, strict=True):
        if v > 0:
            p = np.zeros(capacity + 1, np.int64)
            p[sizes] = c
            full.append((p, float(v)))
    return full


def best_fit(demand: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Patterns for a small demand: largest pieces first, each into the sequence with the least room that takes it."""
    open_, out = [[] for _ in range(capacity + 1)], []  # sequences by room
    for size in range(capacity, 0, -1):
        for _ in range(int(demand[size])):
            room = next((r for r in range(size, capacity + 1) if open_[r]), None)
            if room is None:
                room, at = capacity, len(out)
                out.append(np.zeros(capacity + 1, np.int64))
            else:
                at = open_[room].pop()
            out[at][size] += 1
            open_[room - size].append(at)
    return out


@dataclass
class Plan:
    """Runs of places, by class: from which rank on, pattern, places of the class in it, slots before, first sequence."""

    table: dict[int, np.ndarray]
    sequences: int
    bound: float


def plan(demand: np.ndarray, capacity: int) -> Plan:
    left, chosen = demand.astype(np.int64).copy(), []
    solution = solve(demand, capacity)
    for p, x in solution:
        # no more instances than the demand that is left fills
        used = p > 0
        k = int(min(np.floor(x + 1e-9), (left[used] // p[used]).min()))
        if k > 0:
            chosen.append((p, k))
            left -= k * p
    chosen += [(p, 1) for p in best_fit(left, capacity)]
    rank, rows, first = np.zeros(capacity + 1, np.int64), {}, 0
    for p, k in chosen:
        slots = 0
        for size in np.flatnonzero(p)[::-1]:
            rows.setdefault(int(size), []).append((rank[size], p[size], slots, first))
            rank[size] += p[size] * k
            slots += p[size]
        first += k
    return Plan({s: np.array(r, np.int64) for s, r in rows.items()}, first, sum(x for _, x in solution))


_ASSIGNED = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, slot bigint"


def pack(cut: DataFrame, length: int = LENGTH, grain: int = GRAIN) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for pieces() (written; ids are not read)."""
    capacity = length // grain
    cut = cut.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.ceil(F.col("length") / grain).cast("int").alias("cls"))
    counts = np.zeros(capacity + 1, np.int64)
    for c, n in cut.groupBy("cls").agg(F.count("*").alias("n")).collect():  # as many rows as classes
        counts[c] = n
    demand = counts.copy()
    demand[capacity] = 0
    made = plan(demand, capacity)
    base = np.cumsum(counts) - counts
    line = before(ordered(cut, ["cls", F.col("doc_id"), "start", "ids_crc32"], "pack-order"), {"_earlier": F.lit(1)})

    def run(batches):
        for b in batches:
            cls = b.column("cls").to_numpy()
            rank = b.column("_earlier").to_numpy() + b.column("_row").to_numpy() - base[cls]
            sequence, slot = np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int64)
            for c in np.unique(cls):
                at = np.flatnonzero(cls == c)
                if c == capacity:
                    sequence[at] = made.sequences + rank[at]
                    continue
                runs = made.table[int(c)]
                r = runs[np.searchsorted(runs[:, 0], rank[at], side="right") - 1]
                within = rank[at] - r[:, 0]
                sequence[at] = r[:, 3] + within // r[:, 1]
                slot[at] = r[:, 2] + within % r[:, 1]
            yield batch_of(_ASSIGNED, {n: b.column(n) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")} | {"sequence_id": sequence, "slot": slot})

    placed = line.mapInArrow(run, _ASSIGNED)
    w = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(w), F.lit(0)).cast("bigint")).drop("slot")


def sequences(packed: DataFrame, cut: DataFrame, length: int = LENGTH, pad: int = 0) -> DataFrame:
    """sequence_id, ids (array, padded to length unless its size is a power of two): what a trainer reads.

    ``cut`` is pieces(keep_ids=True) of a table without repeated doc_ids.
    """
    rows = packed.join(cut.select("doc_id", "start", "ids"), ["doc_id", "start"])
    got = rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))

    def run(batches):
        for b in batches:
            out = []
            for p in b.column(1).to_pylist():
                ids = np.frombuffer(b"".join(x["ids"] for x in p), "<u4").astype(np.int64)
                if len(ids) & (len(ids) - 1):
                    ids = np.pad(ids, (0, length - len(ids)), constant_values=pad)
                out.append(ids)
            yield batch_of("sequence_id bigint, ids array<bigint>", {"sequence_id": b.column(0), "ids": out})

    return got.mapInArrow(run, "sequence_id bigint, ids array<bigint>")


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    import public_tokenizers

    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    return pack(written(pieces(docs, path).drop("ids"), "pack-pieces"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
