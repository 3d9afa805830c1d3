"""The folder that driver and executors share, and tables in it that cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, also set as its checkpoint folder. A local one only in local mode, where none is set."""
    context = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    got = context._jsc.sc().getCheckpointDir()
    if not given and got.isDefined():
        return got.get()
    if not given:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        given = tempfile.mkdtemp(prefix="featurelab-")
        atexit.register(shutil.rmtree, given, ignore_errors=True)
    if not got.isDefined():
        context.setCheckpointDir(given)
    return given


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once into the shared folder: the same after an executor is lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, from a Parquet table in the shared folder."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a table of stored() that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
