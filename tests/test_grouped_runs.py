"""Sums of groups are merged by runs of rows."""

import numpy as np
from pyspark.sql import functions as F

from featurelab.functions import grouped


def test_group_sums_are_merged_in_runs():
    x = np.random.default_rng(1).normal(1e6, 1, (50, 2))
    x[3, 0] = x[20, 1] = np.nan
    parts = [grouped.group_sums(x[i : i + 5], np.zeros(5, int)) for i in range(0, 50, 5)]
    n, mean, square = grouped.merged([np.concatenate(p) for p in list(zip(*parts, strict=True))[1:]], np.array([0, 6]))
    for i, some in enumerate((x[:30], x[30:])):
        assert (n[i] == np.isfinite(some).sum(axis=0)).all()
        np.testing.assert_allclose(mean[i], np.nanmean(some, axis=0), rtol=1e-14)
        np.testing.assert_allclose(square[i], np.nanvar(some, axis=0) * n[i], rtol=1e-9)


def test_groups_go_on_over_batches(spark):
    rows = spark.range(400).select((F.col("id") % 5).alias("k"), (F.col("id") * F.col("id") % 17 + 1).cast("double").alias("v"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = sorted(r["cv"] for r in grouped.deviations(rows.repartition(9), [["k"]], [F.col("v")], set(), 10).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = sorted(r[0] for r in rows.groupBy("k").agg(F.stddev_samp("v") / F.avg("v")).select(F.col("(stddev_samp(v) / avg(v))")).collect())
    np.testing.assert_allclose(got, want, rtol=1e-12)
