"""What a dashboard shows, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .reports import Tables, diminishing, load_bearing, shap_ranking


def _all():
    return Window.partitionBy()  # a ledger has as many rows as experiments


def ratchet(L: Tables, higher: bool = True) -> DataFrame:
    """exp_id, best_so_far over kept experiments, delta to the first experiment, better (in the metric's direction)."""
    w = _all().orderBy("exp_id")
    top = F.max if higher else F.min
    base = F.first("cv_score").over(w.rowsBetween(Window.unboundedPreceding, 0))
    gain = F.col("cv_score") - base
    return L["experiment"].select("exp_id", top(F.when(F.col("kept"), F.col("cv_score"))).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("best_so_far"), gain.alias("delta"), (gain > 0 if higher else gain < 0).alias("better"))


def totals(L: Tables, higher: bool = True) -> DataFrame:
    """One row: total, kept, keep_rate, best, features_in_best."""
    kept = F.col("kept")
    score = F.when(kept, F.col("composite_score"))
    pick = F.max_by if higher else F.min_by
    top = F.max(F.when(kept, F.col("cv_score"))) if higher else F.min(F.when(kept, F.col("cv_score")))
    return L["experiment"].agg(F.count("*").alias("total"), F.count_if("kept").alias("kept"), F.round(F.avg(kept.cast("double")), 6).alias("keep_rate"), top.alias("best"), pick("n_features", score).alias("features_in_best"))


def momentum(L: Tables, min_delta: float = 0.001, higher: bool = True) -> DataFrame:
    s = F.col("stagnation")
    return diminishing(L, min_delta, higher).select(F.round(s, 6).alias("stagnation"), F.when(s < 0.35, "Active").when(s < 0.68, "Slowing").otherwise("Stalled").alias("momentum"))


def top_shap(L: Tables, n: int = 10, higher: bool = True) -> DataFrame:
    """feature, value, percent of the largest, load_bearing."""
    top = shap_ranking(L, None, higher).orderBy(F.desc("value"), "feature").limit(n)
    most = F.max("value").over(_all())
    flag = load_bearing(L).withColumn("load_bearing", F.lit(True))
    return top.withColumn("percent", F.round(F.col("value") / F.when(most != 0, most) * 100, 3)).join(flag, "feature", "left").select("feature", "value", "percent", F.coalesce("load_bearing", F.lit(False)).alias("load_bearing"))


def elements(L: Tables) -> tuple[DataFrame, DataFrame]:
    """nodes (id, type, label, status) and edges (src, dst, rel) of the whole graph."""
    from .ledger import feature_status, improved_over

    node = lambda df, id_, kind, label, state: df.select(id_.alias("id"), F.lit(kind).alias("type"), label.alias("label"), state.alias("status"))
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    status = feature_status(L["experiment"], L["used_in"])
    nodes = node(L["column"], name("col_", "column"), "Column", F.col("column"), F.lit("source"))
    nodes = nodes.unionByName(node(status, name("feat_", "feature"), "Feature", F.col("feature"), F.col("status")))
    nodes = nodes.unionByName(node(L["experiment"], name("exp_", "exp_id"), "Experiment", name("#", "exp_id"), F.when(F.col("kept"), "kept").otherwise("reverted")))
    nodes = nodes.unionByName(node(L["hypothesis"].join(L["outcome"], "hyp_id", "left"), name("hyp_", "hyp_id"), "Hypothesis", name("H", "hyp_id"), F.coalesce("rel", F.lit("pending"))))
    edge = lambda df, s, d, rel: df.select(s.alias("src"), d.alias("dst"), rel.alias("rel"))
    edges = edge(L["derived_from"], name("feat_", "feature"), name("col_", "column"), F.lit("DERIVED_FROM"))
    edges = edges.unionByName(edge(L["used_in"], name("feat_", "feature"), name("exp_", "exp_id"), F.lit("USED_IN")))
    edges = edges.unionByName(edge(improved_over(L["experiment"]), name("exp_", "exp_id"), name("exp_", "previous"), F.lit("IMPROVED_OVER")))
    edges = edges.unionByName(edge(L["outcome"].join(L["tested_by"], "hyp_id"), name("hyp_", "hyp_id"), name("exp_", "exp_id"), F.col("rel")))
    edges = edges.unionByName(edge(L["supersedes"], name("hyp_", "hyp_id"), name("hyp_", "old_hyp_id"), F.lit("SUPERSEDES")))
    return nodes, edges
