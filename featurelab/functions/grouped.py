"""Deviations of many expressions within the groups of many keys: one scan, one exchange.

A task takes some rows at a time, sorts them by each key and sums all expressions up at once: a row for each group that holds
counts, means and squared deviations of all expressions as arrays. These rows are exchanged by key and group and merged there in
the order in which they were made.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of expressions that a task sums up at a time.
CHUNK = 1 << 26

_PARTIAL = "key int, g string, made bigint, n binary, mean binary, square binary"
_CV = "key int, expr int, cv double"


def group_sums(x: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(different groups, and by group and column: count, mean, squared deviations) of x [row, column]; what is not finite is missing."""
    order = np.argsort(group, kind="stable")
    group, x = group[order], x[order]
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[starts, len(group)])
    there = np.isfinite(x)
    n = np.add.reduceat(there, starts, axis=0, dtype=np.int64)
    mean = np.add.reduceat(np.where(there, x, 0), starts, axis=0) / np.maximum(n, 1)
    off = np.where(there, x - np.repeat(mean, size, axis=0), 0)
    return group[starts], n, mean, np.add.reduceat(off * off, starts, axis=0)


def merged(sums: list[np.ndarray], starts: np.ndarray) -> list[np.ndarray]:
    """Counts, means and squared deviations [row, column] of runs of rows that begin at starts, from those of the rows."""
    n, mean, square = sums
    size = np.diff(np.r_[starts, len(n)])
    if len(starts) == len(n):
        return [n.copy(), mean.copy(), square.copy()]
    base = np.repeat(mean[starts], size, axis=0)  # near the run's mean, so that little is lost in the difference
    whole = np.add.reduceat(n, starts, axis=0)
    shift = np.add.reduceat(n * (mean - base), starts, axis=0) / np.maximum(whole, 1)
    off = mean - base - np.repeat(shift, size, axis=0)
    return [whole, mean[starts] + shift, np.add.reduceat(square + n * off * off, starts, axis=0)]


def _rows_out(a: np.ndarray):
    """Arrow binaries of the rows of a."""
    import pyarrow as pa

    a = np.ascontiguousarray(a)
    kind = pa.binary(a.shape[1] * a.itemsize)
    return pa.FixedSizeBinaryArray.from_buffers(kind, len(a), [None, pa.py_buffer(a.tobytes())]).cast(pa.binary())


def _rows_in(column, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def deviations(df: DataFrame, keys: list[list[str]], expressions: list[Column], skip: set[tuple[int, int]], least: int) -> DataFrame:
    """key, expr (places in the lists), cv of each group with at least `least` values, null for mean 0; without groups that lack a part of the key
    and without the pairs in skip. cv: sample deviation over the absolute mean."""
    width = len(expressions)
    group = [_joined(key) for key in keys]
    rows = df.select(F.array(*[e.cast("double") for e in expressions]).alias("x"), *[g.alias(f"g{i}") for i, g in enumerate(group)])
    names = [f.split(" ")[0] for f in _PARTIAL.split(", ")]

    def partial(batches):
        from pyspark import TaskContext

        made, wait, rows = TaskContext.get().partitionId() << 40, [], 0
        for b in batches:
            wait.append(b)
            rows += b.num_rows
            if rows * width * 8 >= CHUNK:
                yield from summed(wait, made)
                made, wait, rows = made + 1, [], 0
        if rows:
            yield from summed(wait, made)

    def summed(batches, made: int):
        import pyarrow as pa

        x = np.concatenate([b.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, width) for b in batches])
        for k in range(len(keys)):
            column = pa.chunked_array([b.column(1 + k) for b in batches]).combine_chunks().dictionary_encode()
            at = column.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            if not (at >= 0).any():
                continue
            code, n, mean, square = group_sums(x[at >= 0], at[at >= 0])
            for lo in range(0, len(code), 4096):
                some = slice(lo, lo + 4096)
                g = column.dictionary.take(pa.array(code[some]))
                own = [pa.array(np.full(len(g), k, np.int32)), g, pa.array(np.full(len(g), made, np.int64))]
                yield pa.RecordBatch.from_arrays([*own, *[_rows_out(a[some]) for a in (n, mean, square)]], names=names)

    use = np.ones((len(keys), width), bool)
    for i, j in skip:
        use[i, j] = False

    def whole(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def given(key: np.ndarray, total: tuple):
            n, mean, square = total
            fine = (n >= least) & use[key]
            with np.errstate(divide="ignore", invalid="ignore"):
                cv = np.where(np.abs(mean) > 0, np.sqrt(square / np.maximum(n - 1, 1)) / np.abs(mean), np.nan)
            row, expr = np.nonzero(fine)
            cv = cv[row, expr]
            return pa.RecordBatch.from_arrays([pa.array(key[row].astype(np.int32)), pa.array(expr.astype(np.int32)), pa.array(cv, mask=np.isnan(cv))], names=["key", "expr", "cv"])

        last = None  # the group that the batches so far end with: key, g, sums
        for b in batches:
            if not b.num_rows:
                continue
            key, g = b.column(0).to_numpy(), b.column(1)
            new = np.r_[True, (key[1:] != key[:-1]) | pc.not_equal(g[1:], g[:-1]).to_numpy(zero_copy_only=False)]
            starts = np.flatnonzero(new)
            total = merged([_rows_in(b.column(3 + i), kind, width) for i, kind in enumerate((np.int64, float, float))], starts)
            ends = key[starts]
            if last is not None:
                if last[:2] == (int(key[0]), g[0].as_py()):
                    first = merged([np.stack([x, y[0]]) for x, y in zip(last[2], total, strict=True)], np.array([0]))
                    for x, y in zip(total, first, strict=True):
                        x[0] = y[0]
                else:
                    yield given(np.array([last[0]]), [x[None] for x in last[2]])
            yield given(ends[:-1], [x[:-1] for x in total])
            last = int(ends[-1]), g[b.num_rows - 1].as_py(), [x[-1] for x in total]
        if last is not None:
            yield given(np.array([last[0]]), [x[None] for x in last[2]])

    each = rows.mapInArrow(partial, _PARTIAL).repartition("key", "g").sortWithinPartitions("key", "g", "made")
    return each.mapInArrow(whole, _CV)


def _joined(key: list[str]) -> Column:
    """The key's values as one text, null if one is missing; values are told apart by their lengths."""
    one = [F.col(f"`{c}`").cast("string") for c in key]
    return F.concat(*[F.concat(F.length(c).cast("string"), F.lit(":"), c) for c in one])
