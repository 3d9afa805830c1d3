"""Reports over a ledger. `L` is a mapping of table names to DataFrames (see ledger.SCHEMAS)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import FAMILY_KEYWORDS, family, named_columns, readable

Tables = Mapping[str, DataFrame]
def _all():
    return Window.partitionBy()  # a ledger has as many rows as experiments


def history(L: Tables, n: int = 10) -> DataFrame:
    return L["experiment"].orderBy(F.desc("exp_id")).limit(n)


def timeline(L: Tables) -> DataFrame:
    return L["experiment"].select("exp_id", "composite_score", "delta", "kept", "ts")


def best(L: Tables, higher: bool = True) -> DataFrame:
    """The kept experiment with the best composite score; of equals the earliest."""
    order = F.desc("composite_score") if higher else F.asc("composite_score")
    return L["experiment"].filter("kept").orderBy(order, "exp_id").limit(1)


def active_hypotheses(L: Tables) -> DataFrame:
    """Hypotheses that none supersedes, with how they came out."""
    old = L["supersedes"].select(F.col("old_hyp_id").alias("hyp_id"))
    return L["hypothesis"].join(old, "hyp_id", "left_anti").join(L["outcome"], "hyp_id", "left").select("hyp_id", "predicted_direction", "rel")


def failed_patterns(L: Tables, n: int = 10) -> DataFrame:
    return L["experiment"].filter("not kept").orderBy(F.desc("exp_id")).limit(n).select("exp_id", "description")


def failed_distinct(L: Tables) -> DataFrame:
    return L["experiment"].filter("not kept").groupBy(F.substring("description", 1, 80).alias("pattern")).agg(F.min("exp_id").alias("first_exp"), F.count("*").alias("n"))


def saturated_columns(L: Tables, min_experiments: int = 3, threshold: float = 0.001) -> DataFrame:
    """Columns whose derived features moved the score little: column, n_experiments, mean_delta, max_delta."""
    used = L["derived_from"].join(L["used_in"], "feature").select("column", "exp_id").distinct()
    got = used.join(L["experiment"].select("exp_id", F.abs("delta").alias("d")), "exp_id").groupBy("column").agg(F.count("*").alias("n_experiments"), F.avg("d").alias("m"), F.max("d").alias("x"))
    return got.filter((F.col("n_experiments") >= min_experiments) & (F.col("m") < threshold)).select("column", "n_experiments", F.round("m", 6).alias("mean_delta"), F.round("x", 6).alias("max_delta"))


def success_rates(L: Tables) -> DataFrame:
    got = L["experiment"].groupBy(family(F.col("description")).alias("family")).agg(F.count("*").alias("total"), F.count_if("kept").alias("kept"))
    return got.withColumn("rate", F.round(F.col("kept") / F.col("total"), 3))


def load_bearing(L: Tables) -> DataFrame:
    """Features of every kept experiment that has features."""
    kept = L["used_in"].join(L["experiment"].filter("kept").select("exp_id"), "exp_id").distinct()
    n = kept.agg(F.count_distinct("exp_id").alias("n"))
    return kept.groupBy("feature").agg(F.count("*").alias("k")).join(F.broadcast(n), F.col("k") == F.col("n")).select("feature")


def untried_pairs(L: Tables) -> DataFrame:
    """column, family combinations that no description names. Columns times families: both are short lists."""
    spark = L["experiment"].sparkSession
    families = spark.createDataFrame([(f,) for f in sorted({f for _, f in FAMILY_KEYWORDS})], "family string")
    tried = L["experiment"].select(F.explode(named_columns(F.col("description"))).alias("column"), family(F.col("description")).alias("family")).distinct()
    return L["column"].crossJoin(F.broadcast(families)).join(tried, ["column", "family"], "left_anti")


def shap_ranking(L: Tables, exp_id: int | None = None, higher: bool = True) -> DataFrame:
    """feature, value: of the given experiment, else the best kept one, else the newest with attributions."""
    shap = L["feature_shap"]
    if exp_id is not None:
        return shap.filter(F.col("exp_id") == exp_id).select("feature", F.round("value", 6).alias("value"))
    pick = best(L, higher).select("exp_id").withColumn("o", F.lit(0)).unionByName(shap.agg(F.max("exp_id").alias("exp_id")).withColumn("o", F.lit(1)))
    pick = pick.join(shap.select("exp_id").distinct(), "exp_id", "left_semi").orderBy("o").limit(1)
    return shap.join(F.broadcast(pick.select("exp_id")), "exp_id").select("feature", F.round("value", 6).alias("value"))


def shap_consensus(L: Tables) -> DataFrame:
    """feature, mean_rank, mean_shap, top3: over kept experiments with attributions; an absent feature ranks last with 0."""
    shap = L["feature_shap"].join(L["experiment"].filter("kept").select("exp_id"), "exp_id")
    w = Window.partitionBy("exp_id").orderBy(F.desc("value"), "feature")
    r = shap.withColumn("rank", F.row_number().over(w))
    size = r.groupBy("exp_id").agg((F.count("*") + 1).alias("last"))
    # absent ones need no cross join: their ranks sum to the sum over all experiments less those where the feature occurs
    total = size.agg(F.sum("last").alias("all_last"), F.count("*").alias("n_exp"))
    per = r.join(size, "exp_id").groupBy("feature").agg(F.sum("rank").alias("ranks"), F.sum("last").alias("lasts"), F.sum("value").alias("values"), F.count_if(F.col("rank") <= 3).alias("top3"))
    return per.crossJoin(F.broadcast(total)).select("feature", F.round((F.col("ranks") + F.col("all_last") - F.col("lasts")) / F.col("n_exp"), 2).alias("mean_rank"), F.round(F.col("values") / F.col("n_exp"), 6).alias("mean_shap"), "top3")


def diminishing(L: Tables, min_delta: float = 0.001, higher: bool = True, window: int = 10) -> DataFrame:
    """One row: stagnation between 0 and 1, from the newest experiments."""
    newest = L["experiment"].orderBy(F.desc("exp_id")).limit(window).filter("not (delta = 0 and kept)")
    n = newest.withColumn("place", F.row_number().over(_all().orderBy(F.desc("exp_id"))))
    got = n.agg(F.count("*").alias("n"), F.avg(F.when(F.col("place") <= 5, F.abs("delta"))).alias("m"))
    got = got.crossJoin(best(L, higher).agg(F.max("composite_score").alias("best")))
    scale = F.lit(35.0) / 3 * min_delta * F.abs("best")
    return got.select(F.when(F.col("n") < 5, 0.0).when(F.col("m") == 0, 1.0).otherwise(F.least(F.lit(1.0), 1 - F.col("m") / (F.col("m") + scale))).alias("stagnation"))


def features_for_column(L: Tables) -> DataFrame:
    return L["derived_from"].groupBy("column").agg(F.array_join(F.sort_array(F.collect_set("feature")), ",").alias("features"))


def sessions(events: DataFrame, key: str, ts: str, minutes: int = 60) -> DataFrame:
    """key, session, begin, end, n: runs without a gap of more than `minutes`."""
    w = Window.partitionBy(key).orderBy(ts)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    new = F.when(gap > minutes * 60_000_000, 1).otherwise(0)
    marked = events.select(key, ts, new.alias("new")).withColumn("session", F.sum("new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "session").agg(F.min(ts).alias("begin"), F.max(ts).alias("end"), F.count("*").alias("n"))


def session_elapsed(L: Tables, now, minutes: int = 60) -> DataFrame:
    """One row: minutes since the start of the session that the newest experiment is in; 0 if that is over."""
    e = sessions(L["experiment"].select(F.lit(1).alias("k"), "ts"), "k", "ts", minutes).orderBy(F.desc("session")).limit(1)
    at = F.unix_micros(F.lit(now).cast("timestamp"))
    span = lambda c: (at - F.unix_micros(F.col(c).cast("timestamp"))) / 60_000_000
    return e.select(F.when(span("end") > minutes, 0.0).otherwise(span("begin")).alias("minutes"))


def consecutive_failures(L: Tables) -> DataFrame:
    e = L["experiment"]
    last = e.agg(F.max(F.when(F.col("kept"), F.col("exp_id"))).alias("last"))
    return e.crossJoin(F.broadcast(last)).agg(F.count_if(F.coalesce(F.col("exp_id") > F.col("last"), F.lit(True))).alias("failures"))


def should_stop(L: Tables, elapsed: float, budget: float, max_failures: int) -> DataFrame:
    f = consecutive_failures(L)
    return f.select("failures", F.when(F.lit(elapsed) >= budget, "time budget used").when(F.col("failures") >= max_failures, "too many failures").otherwise("continue").alias("verdict"))


def status(L: Tables, elapsed: float, budget: float, max_failures: int, min_delta: float = 0.001, higher: bool = True) -> DataFrame:
    total = L["experiment"].agg(F.count("*").alias("total"))
    s = should_stop(L, elapsed, budget, max_failures).crossJoin(total).crossJoin(diminishing(L, min_delta, higher))
    explore = (F.col("verdict") == "continue") & ((F.col("failures") >= 10) | (F.col("total") % 15 == 0) | (F.col("stagnation") > 0.7))
    return s.select("verdict", "failures", "total", F.round("stagnation", 6).alias("stagnation"), explore.alias("explore"))


def compressed_history(L: Tables, recent: int = 5) -> DataFrame:
    """The newest experiments in detail (with what each improved on and its lineage), older ones as counts."""
    from .ledger import improved_over

    e = L["experiment"].withColumn("age", F.row_number().over(_all().orderBy(F.desc("exp_id"))))
    line = L["used_in"].join(L["derived_from"], "feature").groupBy("exp_id").agg(F.array_join(F.slice(F.sort_array(F.collect_set(F.concat("feature", F.lit("<"), "column"))), 1, 8), ",").alias("lineage"))
    new = e.filter(F.col("age") <= recent).join(improved_over(L["experiment"]), "exp_id", "left").join(line, "exp_id", "left").select(F.concat(F.lit("exp_"), "exp_id").alias("item"), readable(F.col("description")).alias("text"), F.col("previous").alias("number"), "lineage")
    old = e.filter(F.col("age") > recent)
    counts = old.agg(F.count("*").alias("n"), F.count_if("kept").alias("k"), F.max_by("exp_id", F.when(F.col("kept"), F.col("composite_score"))).alias("b"))
    none = F.lit(None).cast("string")
    rows = F.array(F.struct(F.lit("older").alias("item"), none.alias("text"), F.col("n").alias("number"), none.alias("lineage")), F.struct(F.lit("older_kept").alias("item"), none.alias("text"), F.col("k").alias("number"), none.alias("lineage")), F.struct(F.lit("older_best").alias("item"), none.alias("text"), F.col("b").alias("number"), none.alias("lineage")))
    return new.unionByName(counts.select(F.explode(rows).alias("r")).select("r.*"))


def coverage(L: Tables) -> DataFrame:
    """column, by_lineage (a feature is derived from it), by_name (also: a feature has its name)."""
    line = L["derived_from"].select("column").distinct().withColumn("a", F.lit(True))
    name = L["used_in"].select(F.col("feature").alias("column")).distinct().withColumn("b", F.lit(True))
    return L["column"].join(line, "column", "left").join(name, "column", "left").select("column", F.coalesce("a", F.lit(False)).alias("by_lineage"), F.coalesce("a", "b", F.lit(False)).alias("by_name"))


def ablation(L: Tables) -> DataFrame:
    got = L["used_in"].distinct().join(L["experiment"].select("exp_id", "kept"), "exp_id").groupBy("feature").agg(F.count_if("kept").alias("n_kept"), F.count_if(~F.col("kept")).alias("n_reverted"))
    signal = F.when(F.col("n_reverted") == 0, "always").when(F.col("n_kept") == 0, "never").otherwise("mixed")
    return got.select("feature", "n_kept", "n_reverted", signal.alias("signal"), (F.col("n_kept") + F.col("n_reverted") < 3).alias("few"))


def shap_labels(L: Tables, exp_id: int | None = None) -> DataFrame:
    shap = L["feature_shap"] if exp_id is None else L["feature_shap"].filter(F.col("exp_id") == exp_id)
    cv = F.col("std") / F.when(F.col("value") != 0, F.col("value"))
    return shap.select("exp_id", "feature", F.when(F.col("value") == 0, "zero").when(cv < 0.2, "stable").when(cv < 0.5, "variable").otherwise("unstable").alias("label"))


def hypotheses(L: Tables) -> DataFrame:
    """One row: pending, supported, contradicted, calibration."""
    h = L["hypothesis"].join(L["outcome"], "hyp_id", "left")
    s, c = F.count_if(F.col("rel") == "SUPPORTS"), F.count_if(F.col("rel") == "CONTRADICTS")
    return h.agg(F.count_if(F.col("rel").isNull()).alias("pending"), s.alias("supported"), c.alias("contradicted"), F.round(F.when(s + c > 0, s / F.when(s + c > 0, s + c)), 6).alias("calibration"))


def edge_types(types: DataFrame, edges: DataFrame) -> DataFrame:
    n = edges.groupBy(F.col("rel").alias("rel_type")).agg(F.count("*").alias("n"))
    return types.select("rel_type", "category").join(n, "rel_type", "left").select("rel_type", "category", F.coalesce("n", F.lit(0)).alias("n"))


def summary(L: Tables) -> DataFrame:
    """One row of counts."""
    one = lambda name, t: L[t].agg(F.count("*").alias(name))
    return one("n_columns", "column").crossJoin(one("n_experiments", "experiment")).crossJoin(L["used_in"].agg(F.count_distinct("feature").alias("n_features"))).crossJoin(one("n_hypotheses", "hypothesis"))


def reach(L: Tables) -> DataFrame:
    """column, n_features, n_experiments: two hops back from each column."""
    d = L["derived_from"].distinct()
    return d.join(L["used_in"], "feature", "left").groupBy("column").agg(F.count_distinct("feature").alias("n_features"), F.count_distinct("exp_id").alias("n_experiments"))


def feature_lineage(L: Tables) -> DataFrame:
    """feature, direct, all_columns: what each feature is derived from, and all columns that lead to it (sorted, joined by a comma)."""
    from .graph import closure

    d = L["derived_from"].distinct()
    every = closure(d.selectExpr("feature as src", "column as dst"), d.select(F.col("feature").alias("node")).distinct())
    every = every.join(L["column"].select(F.col("column").alias("node")), "node", "left_semi").groupBy(F.col("start").alias("feature")).agg(F.array_join(F.sort_array(F.collect_set("node")), ",").alias("all_columns"))
    direct = d.groupBy("feature").agg(F.array_join(F.sort_array(F.collect_set("column")), ",").alias("direct"))
    return direct.join(every, "feature", "left").select("feature", "direct", F.coalesce("all_columns", F.lit("")).alias("all_columns"))


def column_dive(L: Tables, column: str, hops: int = 4) -> DataFrame:
    """node, hop: features derived from a column, experiments that use them and what they improved on, up to that many steps."""
    from .graph import within
    from .views import elements

    edges = elements(L)[1]
    down = edges.filter("rel = 'DERIVED_FROM'").selectExpr("dst as src", "src as dst").unionByName(edges.filter("rel <> 'DERIVED_FROM'").select("src", "dst"))
    return within(down, f"col_{column}", hops)


def column_profiles(column: DataFrame, extended: DataFrame) -> DataFrame:
    """The columns of the newest preparation beside their extended profile of the newest discovery (null before one), by name."""
    return column.drop("run").join(F.broadcast(extended.drop("run")), "column", "left").orderBy("column")


def correlations(edge: DataFrame) -> DataFrame:
    """src, dst, correlation of correlated features, the strongest first."""
    return edge.filter("rel = 'CORRELATED_WITH'").select("src", "dst", "correlation").orderBy(F.desc(F.abs("correlation")), "src", "dst")


def discovered_keys(keys: DataFrame) -> DataFrame:
    """Entity keys, the largest residual ICC first."""
    return keys.select("columns", "cardinality", "residual_icc").orderBy(F.desc_nulls_last("residual_icc"), F.desc("cardinality"), F.array_join("columns", "_"))


def discovered_invariants(pairs: DataFrame, derived: DataFrame, keys: DataFrame, n: int = 20) -> DataFrame:
    """expr, columns, median_cv of the n steadiest pairs."""
    both = pairs.join(derived.select(F.col("id").alias("derived_id"), "expr"), "derived_id").join(keys.select(F.col("id").alias("key_id"), "columns"), "key_id")
    return both.select("expr", "columns", "median_cv").orderBy("median_cv", "expr", F.array_join("columns", "_")).limit(n)


def experiment_dive(L: Tables, exp_id: int, paths: int = 5, cutoff: int = 5) -> DataFrame:
    """section, item, path of one experiment: what it improved on, what improved on it, its features, the columns they come from, the shortest
    paths (of at most cutoff edges) to each of these columns, and later experiments that lead back to it."""
    from .graph import closure, paths_to
    from .ledger import improved_over

    spark, none = L["experiment"].sparkSession, F.lit(None).cast("array<string>")
    improved = improved_over(L["experiment"])
    used = L["used_in"].filter(F.col("exp_id") == exp_id).select("feature").distinct()
    derived = L["derived_from"].distinct()
    reach = closure(derived.selectExpr("feature as src", "column as dst"), used.selectExpr("feature as node"))
    own = reach.select("node").distinct().join(L["column"].select(F.col("column").alias("node")), "node", "left_semi")
    columns = sorted(r["node"] for r in own.collect())  # columns of one experiment
    up = L["used_in"].select(F.concat(F.lit("exp_"), "exp_id").alias("src"), F.concat(F.lit("feat_"), "feature").alias("dst"))
    ends = L["column"].select(F.col("column").alias("c"))
    down = derived.join(ends, derived["column"] == ends["c"], "left").select(F.concat(F.lit("feat_"), "feature").alias("src"), F.concat(F.when(F.col("c").isNotNull(), "col_").otherwise("feat_"), "column").alias("dst"))
    out = improved.filter(F.col("exp_id") == exp_id).select(F.lit("improved_over").alias("section"), F.concat(F.lit("exp_"), "previous").alias("item"), none.alias("path"))
    out = out.unionByName(improved.filter(F.col("previous") == exp_id).select(F.lit("beaten_by").alias("section"), F.concat(F.lit("exp_"), "exp_id").alias("item"), none.alias("path")))
    out = out.unionByName(used.select(F.lit("feature").alias("section"), F.col("feature").alias("item"), none.alias("path")))
    out = out.unionByName(own.select(F.lit("column").alias("section"), F.col("node").alias("item"), none.alias("path")))
    found = paths_to(up.unionByName(down), f"exp_{exp_id}", [f"col_{c}" for c in columns], paths, cutoff)
    out = out.unionByName(found.select(F.lit("path").alias("section"), F.expr("substring(target, 5)").alias("item"), "path"))
    later = closure(improved.selectExpr("previous as src", "exp_id as dst"), spark.range(exp_id, exp_id + 1).selectExpr("id as node"))
    return out.unionByName(later.select(F.lit("later").alias("section"), F.concat(F.lit("exp_"), "node").alias("item"), none.alias("path")))
