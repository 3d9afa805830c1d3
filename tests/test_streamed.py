"""Results of streams don't pass through the driver."""

from featurelab.plans import models
from featurelab.streaming import streams


def test_streamed_results_lie_in_the_shared_folder(spark, sf):
    got = models.QUERIES["stream_sessions"](spark, sf)
    assert got.inputFiles() and got.count() > 0


def test_a_stream_without_rows_gives_no_rows(spark, tmp_path):
    schema = "ts timestamp, user_id bigint"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "e"))
    events = spark.readStream.schema(schema).parquet(str(tmp_path / "e")).withWatermark("ts", "10 minutes")
    assert streams.drained(streams.sessions(events), "none").count() == 0
