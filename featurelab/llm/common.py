"""Shared pieces: intermediate tables in the cluster's shared folder, global order without a single task, small sums."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a local one only in local mode, where it is unset."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        if got.isDefined():
            return got.get()
        given = tempfile.mkdtemp(prefix="featurelab-")
        atexit.register(shutil.rmtree, given, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(given)
    elif not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(given)
    return given


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, from a Parquet table in the shared folder: computed once, and safe when executors are lost."""
    spark = df.sparkSession
    path = f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def removed(df: DataFrame) -> None:
    """Deletes a table that written() made and nothing reads any more."""
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    path = jvm.org.apache.hadoop.fs.Path(df._written_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def row_key(df: DataFrame) -> Column:
    """16 bytes, equal for rows that are equal in all columns."""
    return F.unhex(F.md5(F.to_json(F.struct(*[df[c].alias(f"c{i}") for i, c in enumerate(df.columns)]), {"ignoreNullFields": "false"})))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ordered(df: DataFrame, keys: list[str | Column], name: str) -> DataFrame:
    """df in the global order of keys, written, with `_part` (ascending ranges of the order) and `_row` (from 0 in its part).

    Equal keys stay in one range: the keys must tell rows apart where a group may be large.
    """
    n = partitions(df.sparkSession)
    at = F.monotonically_increasing_id()
    out = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", at)
    return written(out.withColumns({"_part": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_at"), name)


def before(df: DataFrame, sums: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """df (of ordered()) with columns that hold the sums over all rows of earlier parts (with equal `by`).

    What is added up are sums of each part; there are as many as parts (times groups that occur in them).
    """
    by = by or []
    each = df.groupBy("_part", *by).agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    w = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select("_part", *by, *[F.coalesce(F.sum(k).over(w), F.lit(0)).alias(k) for k in sums])
    return df.join(each, ["_part", *by])


def arrow_schema(ddl: str):
    """The Arrow schema of a flat DDL string (fields parted by ", "), without a session, as workers have none."""
    import pyarrow as pa

    plain = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}

    def kind(t: str):
        return pa.list_(kind(t[6:-1])) if t.startswith("array<") else plain[t]

    return pa.schema([pa.field(n, kind(t)) for n, t in (f.split(" ", 1) for f in ddl.split(", "))])


def batch_of(ddl: str, columns: dict):
    """A record batch from lists or arrays by name."""
    import pyarrow as pa

    schema = arrow_schema(ddl)
    return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def small(batches, rows: int = 1000, size: int = 1 << 22):
    """Arrow batches in slices of at most `rows` rows and about `size` bytes of strings (one row at least), so that a Python
    worker holds few whole texts besides the batch itself."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for b in batches:
        long = np.zeros(b.num_rows, np.int64)
        for c in b.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
                long += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(long), 0
        while at < b.num_rows:
            end = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
            end = min(max(end, at + 1), at + rows, b.num_rows)
            yield b.slice(at, end - at)
            at = end


def trimmed() -> None:
    """Gives a Python process's freed memory back to the system."""
    import ctypes
    import gc

    gc.collect()
    try:
        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run):
    """run (of mapInArrow), after which the worker, which goes on to other tasks, gives its memory back."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            trimmed()

    return whole


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which nulls match nulls; the result has the columns of left, then the others of right."""
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(right[f"_r_{k}"])
    return left.join(right, on, how).drop(*[f"_r_{k}" for k in keys])


#: A key is hot if it holds more than one row in HOT; there are fewer than HOT of them.
HOT = 500


def with_hot_keys(left: DataFrame, right: DataFrame, keys: list[str], count: str) -> DataFrame:
    """left joined to right on keys (not null), where a few keys may hold a large part of left.

    right is a written table with one row for each key and, in column `count`, how many rows of left have it. Fewer than HOT
    keys can hold more than one row in HOT: these few rows of right go to all tasks and the rows of left stay where they are.
    All others are joined by an exchange. The result has the columns of left, then those of right without keys and count.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) * HOT > F.lit(total)
    hot, cold = right.filter(is_hot).drop(count), right.filter(~is_hot).drop(count)
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    out = [*left.columns, *[c for c in cold.columns if c not in keys]]
    return left.join(F.broadcast(hot), keys).select(*out).unionByName(rest.select(*out))
