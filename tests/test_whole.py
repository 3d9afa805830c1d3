from featurelab.operators import graph
from featurelab.plans import ledger


def test_betweenness_covers_every_kind_of_edge(spark, sf, monkeypatch):
    seen = []
    real = graph.betweenness
    monkeypatch.setattr(graph, "betweenness", lambda edges: seen.append(edges) or real(edges))
    got = {r["node"]: r["centrality"] for r in ledger.QUERIES["betweenness"](spark, sf).collect()}
    ends = {(r["src"].split("_")[0], r["dst"].split("_")[0]) for r in seen[0].collect()}
    assert ends == {("feat", "col"), ("feat", "exp"), ("exp", "exp"), ("hyp", "exp"), ("hyp", "hyp")}
    assert any(k.startswith("feat_") for k in got) and max(got.values()) > 0


def test_closure_goes_on_beyond_fifty_rounds(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(53)], "src int, dst int").coalesce(1)
    got = graph.closure(chain, spark.createDataFrame([(0,)], "node int")).collect()
    assert sorted((r["node"], r["depth"]) for r in got) == [(i, i) for i in range(1, 54)]


def test_model_queries_run_the_whole_operator(spark, sf, monkeypatch):
    from inspect import signature

    from featurelab.operators import model
    from featurelab.plans import models

    real, calls = signature(model.cross_validate), []

    def cross_validate(*args, **kw):
        a = real.bind(*args, **kw)
        a.apply_defaults()
        folds = a.arguments["df"].filter("split = 'train'").select("fold").distinct().count()
        calls.append((a.arguments["n_folds"], a.arguments["trees"], folds))
        return {"scores": [0.0], "shap": {"f": 0.0}, "shap_std": {"f": 0.0}}

    def residuals(df, features, target, n_classes=0, trees=50):
        calls.append(trees)
        raise StopIteration

    monkeypatch.setattr(model, "cross_validate", cross_validate)
    monkeypatch.setattr(model, "residuals", residuals)
    for name in ("gbt_cv_scores", "gbt_multiclass", "shap_by_fold"):
        models.QUERIES[name](spark, sf)
    try:
        models.QUERIES["model_residual_icc"](spark, sf)
    except StopIteration:
        pass
    assert calls == [(5, 100, 5)] * 3 + [50]
