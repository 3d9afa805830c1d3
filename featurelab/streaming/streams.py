"""Structured Streaming over event files and a ledger."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import shared_dir
from ..operators.ledger import SCHEMAS

LATE = "10 minutes"


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Event files as a stream; event time is `ts`."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)


def windows(events: DataFrame, length: str = "1 day", slide: str | None = None) -> DataFrame:
    """event_type, begin, n, total of tumbling (or sliding) windows."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.col("w.start").alias("begin"), "n", "total")


def sessions(events: DataFrame, gap: str = "60 minutes") -> DataFrame:
    """user_id, begin, n of sessions; a pause of exactly the gap still belongs to the session before."""
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.min("ts").alias("begin"), F.count("*").alias("n")).select("user_id", "begin", "n")


#: Tables of a ledger whose appends a dashboard follows.
FOLLOWED = ("experiment", "used_in", "derived_from", "feature_shap", "hypothesis", "resolution", "edge")


def ledger_changes(spark: SparkSession, path: str, tables: tuple[str, ...] = FOLLOWED) -> DataFrame:
    """part, rows, digest of each table of a ledger, as a stream with state: in update mode a table comes again only when rows were
    appended to it. digest: an order-free sum over the rows. Tables that don't exist yet are begun empty."""
    out = None
    for name in tables:
        folder = f"{path.rstrip('/')}/{name}"
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)
        rows = spark.readStream.schema(SCHEMAS[name]).parquet(folder)
        one = rows.select(F.lit(name).alias("part"), F.xxhash64(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).alias("h"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("part").agg(F.count("*").alias("rows"), F.bit_xor("h").alias("digest"))


def follow(spark: SparkSession, path: str, versions: str, tables: tuple[str, ...] = FOLLOWED, every: str | None = None):
    """Keeps `versions` (Parquet: version, part, rows, digest) up to date with a ledger and returns the running query.

    A version holds the tables that changed since the one before; without a change there is no new version. State and progress are kept in
    versions/_progress, so a new query goes on where the last one ended, and a batch that is repeated after a failure replaces its own
    rows. every: how often to look (for example "3 seconds"); None: once, for what is there now.
    """
    def put(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("version", F.lit(number + 1).cast("bigint")).persist()
        if rows.head(1):
            rows.coalesce(1).write.mode("overwrite").parquet(f"{versions.rstrip('/')}/batch={number}")
        rows.unpersist()

    stream = ledger_changes(spark, path, tables).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{versions.rstrip('/')}/_progress")
    return (stream.trigger(processingTime=every) if every else stream.trigger(availableNow=True)).start()


def ledger_versions(spark: SparkSession, versions: str) -> DataFrame:
    """version, part, rows, digest of all versions so far."""
    return spark.read.schema("part string, rows bigint, digest bigint, version bigint").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(versions).select("version", "part", "rows", "digest")


def with_appends(versions: DataFrame, appended: list[tuple]) -> DataFrame:
    """versions with a row too for each append (version, part) that brought no rows, which the stream doesn't report: what the table holds as
    of that version; before its first row 0, without a digest."""
    log = versions.sparkSession.createDataFrame(appended, "version bigint, part string").alias("l")
    then = log.join(versions.alias("v"), (F.col("v.part") == F.col("l.part")) & (F.col("v.version") <= F.col("l.version")), "left")
    rows, digest = (F.max_by(f"v.{c}", "v.version").alias(c) for c in ("rows", "digest"))
    then = then.groupBy("l.version", "l.part").agg(rows, digest).withColumn("rows", F.coalesce("rows", F.lit(0).cast("bigint")))
    return versions.unionByName(then.join(versions, ["version", "part"], "left_anti"))


def current(versions: DataFrame) -> DataFrame:
    """part, rows, digest as of the newest version of each table."""
    return versions.groupBy("part").agg(F.max_by("rows", "version").alias("rows"), F.max_by("digest", "version").alias("digest"))


def ledger_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMAS["experiment"]).parquet(f"{path}/experiment")


def ratchet(experiments: DataFrame, higher: bool = True) -> DataFrame:
    """One row, kept up to date: total, kept, best."""
    top = F.max if higher else F.min
    return experiments.agg(F.count("*").alias("total"), F.count_if("kept").alias("kept"), top(F.when(F.col("kept"), F.col("cv_score"))).alias("best"))


def drained(df: DataFrame, name: str) -> DataFrame:
    """What a streaming aggregation gives once all that is there now has been read, as a table in the shared folder.

    The rows go from the tasks to the table; the driver holds none. A batch gives the whole result and replaces the one before.
    """
    here = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.sparkSession.createDataFrame([], df.schema).write.parquet(f"{here}/rows")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{here}/rows")

    query = df.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{here}/_progress").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return df.sparkSession.read.schema(df.schema).parquet(f"{here}/rows")
