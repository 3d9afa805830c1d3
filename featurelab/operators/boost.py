"""Gradient-boosted trees over binned columns: all folds and classes grow at once, one pass over the data for each level.

Columns are binned once (at most BINS bins by exact quantiles, a bin for each value if there are few). Rows with the same bins and
part (and class) always have the same margins, so they are summed up to one row with a weight first: passes grow with the different
rows, not with all of them. Rows lie in blocks: their bins, target, weight, part and margins, in a table of the shared folder. For each level of a tree every task adds up
gradients and Hessians of its blocks by (model, node, column, bin), where a model is a fold and a class; these histograms are
exchanged by (model, node, column), summed in the order of the blocks and reduced to the best cut of each, and only the cuts come
to the driver; histograms of at most SMALL bytes in all come to it themselves, which spares a stage. After TREES_A_TABLE trees the margins are written anew, so later passes walk only the trees since then.

Second-order boosting as usual: squared loss, logistic loss for two classes, softmax over all classes for more; a leaf is worth
-G / (H + L2), a cut gains G_l^2/(H_l + L2) + G_r^2/(H_r + L2) - G^2/(H + L2), both sides keep at least MIN_HESSIAN. Ties go to the
lower column and bin.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.rdd import portable_hash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.order import counted, counted_percentiles
from ..functions.shared import dropped, stored
from .splits import Folds

BINS, L2, MIN_HESSIAN = 256, 1.0, 1.0
TREES_A_TABLE = 10
#: Rows and bytes of a block at most.
BLOCK_ROWS, BLOCK_BYTES = 1 << 16, 1 << 24
#: Bytes of all tasks' histograms of a level up to which the driver sums them; more are exchanged.
SMALL = 1 << 25
#: Rows whose margins a task keeps while it predicts.
KNOWN = 1 << 17


@dataclass
class Trees:
    """Trees of all models, nodes as in a heap (children of i: 2 i + 1, 2 i + 2). Arrays [tree, model, node]; column -1 is a leaf."""

    column: np.ndarray
    cut: np.ndarray  # bins up to this one go left
    value: np.ndarray
    cover: np.ndarray  # sum of Hessians

    @classmethod
    def empty(cls, trees: int, models: int, depth: int) -> Trees:
        shape = (trees, models, (2 << depth) - 1)
        return cls(np.full(shape, -1, np.int16), np.zeros(shape, np.int16), np.zeros(shape), np.zeros(shape))

    def some(self, first: int, last: int) -> Trees:
        return Trees(*[a[first:last] for a in (self.column, self.cut, self.value, self.cover)])

    def node(self, t: int, m: int, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node that each row of bins [column, row] reaches in at most `depth` steps."""
        at, rows, nodes = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1]), np.arange(self.column.shape[2])
        leaf = self.column[t, m] < 0
        if leaf[0]:
            return at
        flat, place = bins.ravel(), np.where(leaf, 0, self.column[t, m]).astype(np.int64) * len(rows)
        cut, left = np.where(leaf, BINS, self.cut[t, m]), np.where(leaf, nodes, 2 * nodes + 1)  # no bin is above BINS: rows stay in a leaf
        for _ in range(depth):
            at = left.take(at) + (flat.take(place.take(at) + rows) > cut.take(at))
        return at

    def margins(self, m: int, bins: np.ndarray) -> np.ndarray:
        depth, out = (self.column.shape[2] + 1).bit_length() - 2, np.zeros(bins.shape[1])
        for t in range(len(self.column)):
            out += self.value[t, m][self.node(t, m, bins, depth)]
        return out


def gradients(loss: str, y: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives [class, row] of the loss by the margins [class, row]."""
    if loss == "squared":
        return margin - y, np.ones_like(margin)
    p = shares(loss, margin)
    if loss == "logistic":
        return p - y, np.maximum(p * (1 - p), 1e-16)
    return p - (np.arange(len(margin))[:, None] == y), np.maximum(2 * p * (1 - p), 1e-16)


def shares(loss: str, margin: np.ndarray) -> np.ndarray:
    if loss == "logistic":
        return 1 / (1 + np.exp(-margin))
    e = np.exp(margin - margin.max(axis=0))
    return e / e.sum(axis=0)


def edges(df: DataFrame, columns: list[str]) -> list[np.ndarray]:
    """For each column the ascending upper ends of all bins but the last: at most BINS - 1 different numbers."""
    counts = counted(df, {c: F.col(c) for c in columns}, {"n": F.count("*")})
    counts = stored(counts, "boost-values")
    many = {r["name"]: r["k"] for r in counts.groupBy("name").agg(F.count("*").alias("k")).collect()}  # one row for each column
    few = [c for c in columns if many.get(c, 0) <= BINS]
    values: dict[str, list[float]] = {c: [] for c in columns}
    for r in counts.filter(F.col("name").isin(few)).select("name", "v").collect():  # at most BINS for each column
        values[r["name"]].append(r["v"])
    rest = counts.filter(~F.col("name").isin(few))
    cuts = counted_percentiles(rest, ["n"], [i / BINS for i in range(1, BINS)]) if len(few) < len(columns) else {}
    dropped(counts)
    return [np.array(sorted(values[c])[:-1] if c in few else sorted(set(cuts[c, "n"])), float) for c in columns]


def binned(x: np.ndarray, at: list[np.ndarray]) -> np.ndarray:
    """[column, row] of the bins of x [row, column]."""
    return np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(at)]).astype(np.uint8) if at else np.zeros((0, len(x)), np.uint8)


_BLOCK = "block bigint, n int, bins binary, y binary, w binary, part binary, margin binary"


def _batch(ddl: str, columns: dict):
    import pyarrow as pa

    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    fields = [f.split(" ") for f in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[n], kinds[k]) for n, k in fields], names=[n for n, _ in fields])


def _opened(row: dict, models: int):
    n = row["n"]
    bins = np.frombuffer(row["bins"], np.uint8).reshape(-1, n)
    return bins, np.frombuffer(row["y"]), np.frombuffer(row["w"]), np.frombuffer(row["part"], np.int32), np.frombuffer(row["margin"]).reshape(models, n)


@dataclass
class Boosted:
    """A fitted model of every fold. use[k][f]: the place among `columns` that holds feature f for fold k."""

    loss: str
    folds: Folds
    outputs: int
    columns: list[str]
    use: list[list[int]]
    at: list[np.ndarray]
    start: np.ndarray  # [fold, output]
    trees: Trees
    depth: int

    def predict(self, df: DataFrame, name: str = "proba") -> DataFrame:
        """df with `fold` that validates each row (0 without folds; rows of no fold are dropped) and the prediction: a double
        for squared loss, else the array of shares of all classes."""
        kind = T.DoubleType() if self.loss == "squared" else T.ArrayType(T.DoubleType())
        schema = T.StructType([f for f in df.schema.fields if f.name not in ("_fold", name)] + [T.StructField("_fold", T.IntegerType()), T.StructField(name, kind)])
        fold = F.lit(0) if self.folds.column is None else F.coalesce(*[F.when(self.folds.validates(k, self.folds.part()), k) for k in range(self.folds.n)])
        rows = df.drop(name).withColumn("_fold", fold).filter("_fold is not null")
        x = F.array(*[F.col(f"`{c}`").cast("double") for c in self.columns])
        sent = df.sparkSession.sparkContext.broadcast(self)

        def run(batches):
            import pyarrow as pa

            model, known = sent.value, {}
            for b in batches:
                x = b.column(b.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(model.columns))
                got, fold = model.outputs_of(x, b.column(b.num_columns - 2).to_numpy(), known)
                out = pa.array(got[0]) if model.loss == "squared" else pa.array(list(got.T), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], out], names=[*b.schema.names[:-1], name])

        return rows.select(*[F.col(f"`{f.name}`") for f in schema.fields[:-1]], x.alias("_x")).mapInArrow(run, schema).withColumnRenamed("_fold", "judged_by")

    def margins_of(self, x: np.ndarray, fold: np.ndarray, known: dict[bytes, np.ndarray] | None = None) -> np.ndarray:
        """[output, row]. known: margins by fold and bins that a task has had so far."""
        bins = binned(x, self.at) if self.columns else np.zeros((0, len(x)), np.uint8)
        if known is None or not len(x):
            return self._walked(bins, fold)
        row = np.concatenate([np.ascontiguousarray(fold, np.int32)[:, None].view(np.uint8), bins.T], axis=1)
        _, first, back = np.unique(np.ascontiguousarray(row).view(f"V{row.shape[1]}").ravel(), return_index=True, return_inverse=True)
        names = [r.tobytes() for r in row[first]]
        if len(known) + len(names) > KNOWN:
            known.clear()
        new = [i for i, name in enumerate(names) if name not in known]
        for i, margin in zip(new, self._walked(bins[:, first[new]], fold[first[new]]).T, strict=True):
            known[names[i]] = margin
        return np.stack([known[name] for name in names], axis=1)[:, back]

    def _walked(self, bins: np.ndarray, fold: np.ndarray) -> np.ndarray:
        out = np.zeros((self.outputs, bins.shape[1]))
        for k in np.unique(fold):
            rows = fold == k
            own = bins[self.use[k]][:, rows]
            for c in range(self.outputs):
                out[c, rows] = self.start[k, c] + self.trees.margins(k * self.outputs + c, own)
        return out

    def outputs_of(self, x: np.ndarray, fold: np.ndarray, known: dict[bytes, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        margin = self.margins_of(x, fold, known)
        if self.loss == "squared":
            return margin, fold
        p = shares(self.loss, margin)
        return (np.concatenate([1 - p, p]) if self.loss == "logistic" else p), fold

    def leaves(self, fold: int, output: int) -> list[list[tuple[float, list[tuple[int, float, float, float]]]]]:
        """For each tree its leaves: (value, [(feature, above, up to, share of the training weight that goes this way)]), in bins."""
        m, out = fold * self.outputs + output, []
        for t in range(len(self.trees.column)):
            column, cut, value, cover = (a[t, m] for a in (self.trees.column, self.trees.cut, self.trees.value, self.trees.cover))
            found = []

            def walk(i: int, path: list) -> None:
                if column[i] < 0:
                    found.append((float(value[i]), path))
                    return
                for child, lo, hi in ((2 * i + 1, -np.inf, float(cut[i])), (2 * i + 2, float(cut[i]), np.inf)):
                    walk(child, [*path, (int(column[i]), lo, hi, float(cover[child] / cover[i]))])

            walk(0, [])
            out.append(found)
        return out


def _packed(bins: np.ndarray):
    """Arrow binaries of bins [column, row]."""
    import pyarrow as pa

    width, n = bins.shape
    if not width:
        return pa.array([b""] * n, pa.binary())
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), n, [None, pa.py_buffer(np.ascontiguousarray(bins.T).tobytes())]).cast(pa.binary())


def in_bins(df: DataFrame, columns: list[str], at: list[np.ndarray], others: dict[str, Column]) -> DataFrame:
    """`bins` (a byte for each column) of the rows, and the other columns (int or double)."""
    x = F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).cast("array<double>")
    rows = df.select(x.alias("bins"), *[c.alias(n) for n, c in others.items()])
    schema = T.StructType([T.StructField("bins", T.BinaryType()), *rows.schema.fields[1:]])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(columns))
            yield pa.RecordBatch.from_arrays([_packed(binned(x, at) if columns else np.zeros((0, len(x)), np.uint8)), *b.columns[1:]], names=b.schema.names)

    return rows.mapInArrow(run, schema)


def _cells(df: DataFrame, columns: list[str], target: str, folds: Folds, at: list[np.ndarray], loss: str) -> DataFrame:
    """part, bins, y, w, y0, y1, y2: a row for all rows of the same part and bins (and class). w: how many, y: their mean, y0 + y1 + y2: their sum.

    Numbers are cut into three at fixed powers of two, such that sums of either of the first two are exact: the sum does not depend
    on the order, and no task holds all rows of a cell.
    """
    y = F.coalesce(F.col(f"`{target}`").cast("double"), F.lit(float("nan")))
    if loss != "squared":
        rows = in_bins(df, columns, at, {"part": folds.part().cast("int"), "y": y})
        got = rows.groupBy("part", "bins", "y").agg(F.count("*").cast("double").alias("w")).withColumns({"y0": F.col("y") * F.col("w"), "y1": F.lit(0.0), "y2": F.lit(0.0)})
    else:
        n, top = df.agg(F.count("*"), F.max(F.abs(y))).first()
        bits = max(1, 52 - int(n).bit_length())
        scale = max(int(np.frexp(top)[1]) if top and np.isfinite(top) else 0, -1000 + 2 * bits)
        one, two = 2.0 ** (scale - bits), 2.0 ** (scale - 2 * bits)
        rows = in_bins(df, columns, at, {"part": folds.part().cast("int"), "y": y})
        rows = rows.withColumn("y0", F.rint(F.col("y") / one) * one).withColumn("y1", F.rint((F.col("y") - F.col("y0")) / two) * two).withColumn("y2", F.col("y") - F.col("y0") - F.col("y1"))
        got = rows.groupBy("part", "bins").agg(F.count("*").cast("double").alias("w"), *[F.sum(c).alias(c) for c in ("y0", "y1", "y2")])
        got = got.withColumn("y", (F.col("y0") + F.col("y1") + F.col("y2")) / F.col("w"))
    return stored(got.select("part", "bins", "y", "w", "y0", "y1", "y2"), "boost-cells")


def _starts(cells: DataFrame, folds: Folds, loss: str, outputs: int) -> np.ndarray:
    """The margin that all rows begin with: the mean, the log odds, or 0 for softmax."""
    if loss == "softmax":
        return np.zeros((folds.n, outputs))
    names = ("y0", "y1", "y2", "w")
    row = cells.agg(*[F.sum(F.when(folds.trains(k, F.col("part")), F.col(c))) for k in range(folds.n) for c in names]).first()
    sums = np.array([v or 0.0 for v in row]).reshape(folds.n, len(names))
    mean = sums[:, :3].sum(axis=1) / np.maximum(sums[:, 3], 1)
    if loss == "logistic":
        mean = np.clip(mean, 1e-6, 1 - 1e-6)
        mean = np.log(mean / (1 - mean))
    return mean[:, None]


def fit(df: DataFrame, features: list[list[str]], target: str, row_id: str | None, folds: Folds, n_classes: int = 0, trees: int = 100, rate: float = 0.05, depth: int = 6) -> Boosted:
    """Models of all folds. features: for each feature its column, or a column for each fold; numeric and without missing values.
    target: a number, or the class from 0 (n_classes > 0). Rows whose part is null belong to no fold.

    Rows are told apart by what they hold alone, so sums, and so the trees, are the same however the rows are dealt; row_id is not read.
    """
    loss = "squared" if not n_classes else "logistic" if n_classes == 2 else "softmax"
    outputs = n_classes if loss == "softmax" else 1
    models, columns = folds.n * outputs, list(dict.fromkeys(c for f in features for c in f))
    use = [[columns.index(f[k] if len(f) > 1 else f[0]) for f in features] for k in range(folds.n)]
    df = df.filter(folds.part().isNotNull())
    at = edges(df, columns)
    counts = [max(2, *(len(at[places[f]]) + 1 for places in use)) for f in range(len(features))]  # bins of each feature
    cells = _cells(df, columns, target, folds, at, loss)
    start = _starts(cells, folds, loss, outputs)
    size = int(min(BLOCK_ROWS, max(256, BLOCK_BYTES // (len(columns) + 8 * models + 20))))
    state, tasks = _blocks(cells, len(columns), start.reshape(-1, 1), size)
    dropped(cells)
    grown = Trees.empty(trees, models, depth)
    fresh = _read(state)
    for t in range(trees):
        old = fresh
        if t and t % TREES_A_TABLE == 0:
            nxt = stored(_advanced(state, grown.some(t - TREES_A_TABLE, t), use, outputs), "boost-rows")
            dropped(state)
            state, fresh = nxt, _read(nxt)
        elif t:
            fresh = old.mapPartitions(_adder(grown.some(t - 1, t), use, outputs)).persist(StorageLevel.MEMORY_AND_DISK)
        _grow(fresh, grown, t, use, folds, loss, outputs, counts, rate, depth, tasks)
        if t:
            old.unpersist()
    fresh.unpersist()
    dropped(state)
    return Boosted(loss, folds, outputs, columns, use, at, start, grown, depth)


def _read(table: DataFrame) -> RDD:
    """The rows of a table of blocks, kept near; what is lost is read again."""
    return table.rdd.map(lambda row: row.asDict()).persist(StorageLevel.MEMORY_AND_DISK)


def _blocks(cells: DataFrame, width: int, start: np.ndarray, size: int) -> tuple[DataFrame, int]:
    """The table of blocks and how many tasks read it at most."""
    n, cores = -(-cells.count() // size), cells.sparkSession.sparkContext.defaultParallelism
    n = max(1, min(n if n <= cores else -(-n // cores) * cores, cores * 4, 10_000))  # all cores have as much to do
    rows = cells.select("bins", "y", "w", "part").repartition(n, "part", "bins") if n > 1 else cells.select("bins", "y", "w", "part").repartition(1)
    rows = rows.sortWithinPartitions("part", "bins", "y")

    def run(batches):
        from pyspark import TaskContext

        block, wait, waiting = TaskContext.get().partitionId() << 32, [], 0

        def made(some):
            bins, y, w, part = (np.concatenate(v, axis=-1) for v in zip(*some, strict=True))
            return _batch(_BLOCK, {"block": [block], "n": [len(y)], "bins": [bins.tobytes()], "y": [y.tobytes()], "w": [w.tobytes()], "part": [part.tobytes()], "margin": [np.repeat(start, len(y), axis=1).tobytes()]})

        for b in batches:
            lo = 0
            while lo < b.num_rows:
                s = b.slice(lo, size - waiting)
                bins = np.frombuffer(b"".join(s.column(0).to_pylist()), np.uint8).reshape(s.num_rows, width).T
                wait.append((bins, *[s.column(i).to_numpy(zero_copy_only=False).astype(kind) for i, kind in ((1, float), (2, float), (3, np.int32))]))
                waiting, lo = waiting + s.num_rows, lo + s.num_rows
                if waiting == size:
                    yield made(wait)
                    block, wait, waiting = block + 1, [], 0
        if waiting:
            yield made(wait)

    return stored(rows.mapInArrow(run, _BLOCK), "boost-rows"), n


def _advanced(blocks: DataFrame, trees: Trees, use: list[list[int]], outputs: int) -> DataFrame:
    """The blocks with the trees added to their margins."""
    add = _adder(trees, use, outputs)

    def run(batches):
        for b in batches:
            for row in add(b.to_pylist()):
                yield _batch(_BLOCK, {k: [v] for k, v in row.items()})

    return blocks.mapInArrow(run, _BLOCK)


def _adder(trees: Trees, use: list[list[int]], outputs: int):
    """A function of blocks (dictionaries) that adds the trees to their margins."""
    models = len(use) * outputs

    def add(rows):
        for row in rows:
            bins, _, _, _, margin = _opened(row, models)
            own = [bins[places] for places in use]
            yield row | {"margin": np.stack([margin[m] + trees.margins(m, own[m // outputs]) for m in range(models)]).tobytes()}

    return add


def histograms(blocks: RDD, trees: Trees, level: int, open_nodes: np.ndarray, use: list[list[int]], folds: Folds, loss: str, outputs: int, counts: list[int]) -> RDD:
    """((model, feature, first block), (g, h)): sums of gradients and Hessians [node of the level, bin], a row for each task.

    trees: the one that is growing. open_nodes [model, node]: which are to be cut. counts: how many bins each feature has.
    """
    models = len(use) * outputs

    def run(rows):
        width, total, first = 1 << level, {}, None
        for row in rows:
            bins, y, w, part, margin = _opened(row, models)
            first = row["block"] if first is None else first
            for k, places in enumerate(use):
                mine = np.flatnonzero(folds.trains(k, part))
                if not len(mine) or not open_nodes[k * outputs : (k + 1) * outputs].any():
                    continue
                own = bins[places][:, mine]
                g, h = (v * w[mine] for v in gradients(loss, y[mine], margin[k * outputs : (k + 1) * outputs, mine]))
                for c in range(outputs):
                    m = k * outputs + c
                    if not open_nodes[m].any():
                        continue
                    at = trees.node(0, m, own, level) - (width - 1)
                    here = at >= 0
                    here[here] = open_nodes[m][at[here]]
                    node, gg, hh, seen = (at, g[c], h[c], own) if here.all() else (at[here], g[c][here], h[c][here], own[:, here])
                    for f, count in enumerate(counts):
                        i = node * count + seen[f]
                        for kind, v in ((0, gg), (1, hh)):
                            s = np.bincount(i, v, width * count)
                            total[m, f, kind] = total[m, f, kind] + s if (m, f, kind) in total else s
        for m, f in sorted({(m, f) for m, f, _ in total}):
            yield (m, f, first), tuple(total[m, f, kind].reshape(width, counts[f]) for kind in (0, 1))

    return blocks.mapPartitions(run)


def best_cuts(hist: RDD, parts: int) -> RDD:
    """((model, feature), best cut of each node), from histograms summed in the order of the blocks. parts: 0 if one task has them all."""
    line = hist.repartitionAndSortWithinPartitions(parts, lambda k: portable_hash(k[:2])) if parts else hist
    return line.mapPartitions(_merged)


def _merged(rows):
    """((model, feature), best cut of each node) of histograms in the order of (model, feature, block)."""
    key, g, h = None, None, None
    for k, (more_g, more_h) in rows:
        if k[:2] != key:
            if key is not None:
                yield key, best(g, h)
            key, g, h = k[:2], more_g, more_h
        else:
            g, h = g + more_g, h + more_h
    if key is not None:
        yield key, best(g, h)


def best(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """[node, (gain, cut, G and H left, G and H)] of histograms [node, bin]; gain 0 if no cut is allowed or gains."""
    gl, hl = np.cumsum(g, axis=1), np.cumsum(h, axis=1)
    total, weight = gl[:, -1:], hl[:, -1:]
    gl, hl = gl[:, :-1], hl[:, :-1]
    gr, hr = total - gl, weight - hl
    fine = (hl >= MIN_HESSIAN) & (hr >= MIN_HESSIAN)
    gain = np.where(fine, gl**2 / (hl + L2) + gr**2 / (hr + L2) - total**2 / (weight + L2), 0.0)
    i = gain.argmax(axis=1)[:, None]
    at = lambda a: np.take_along_axis(a, i, 1)
    return np.concatenate([np.maximum(at(gain), 0), i, at(gl), at(hl), total, weight], axis=1)


def _grow(blocks: RDD, grown: Trees, t: int, use: list[list[int]], folds: Folds, loss: str, outputs: int, counts: list[int], rate: float, depth: int, tasks: int) -> None:
    models = len(use) * outputs
    open_nodes = np.ones((models, 1), bool)
    for level in range(depth):
        base = (1 << level) - 1
        size = models * (1 << level) * sum(counts) * 16 * tasks  # bytes of histograms at most
        hist = histograms(blocks, grown.some(t, t + 1), level, open_nodes, use, folds, loss, outputs, counts)
        if tasks > 1 and size <= SMALL:
            cuts_of = list(_merged(sorted(hist.collect(), key=lambda x: x[0])))
        else:
            cuts_of = sorted(best_cuts(hist, 0 if tasks == 1 else max(1, min(1000, size >> 24))).collect(), key=lambda x: x[0])  # one for each model and feature
        top: dict[tuple[int, int], tuple] = {}
        for (m, f), cuts in cuts_of:
            for node, (gain, cut, *sums) in enumerate(cuts.tolist()):
                if open_nodes[m, node] and ((m, node) not in top or gain > top[m, node][0]):
                    top[m, node] = (gain, f, int(cut), *sums)
        nxt = np.zeros((models, 2 << level), bool)
        for (m, node), (gain, f, cut, gl, hl, g, h) in top.items():
            i = base + node
            if level == 0:
                grown.value[t, m, i], grown.cover[t, m, i] = -g / (h + L2) * rate, h
            if gain <= 1e-12:
                continue
            grown.column[t, m, i], grown.cut[t, m, i] = f, cut
            for child, gg, hh in ((2 * i + 1, gl, hl), (2 * i + 2, g - gl, h - hl)):
                grown.value[t, m, child], grown.cover[t, m, child] = -gg / (hh + L2) * rate, hh
            nxt[m, [2 * node, 2 * node + 1]] = True
        open_nodes = nxt
        if not nxt.any():
            break
