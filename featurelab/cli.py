"""Command line: init, prepare, discover, query, train, status, inspect.

    python -m featurelab.cli COMMAND --config run.yaml --ledger DIR ...
"""

from __future__ import annotations

import argparse
import dataclasses
import datetime
import importlib.util
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.expr import compile_expression
from .functions.shared import stored
from .functions.text import tagged
from .operators import discover, graph, lineage, model, profile, query, reports, splits, views
from .operators.fitted import KINDS, FoldFeature
from .operators.ledger import Ledger, improved_over, outperforms
from .session import session
from .sources import config as cfg
from .sources import tables
from .streaming import streams


REPORTS = [
    "history", "timeline", "success", "failed", "hypotheses", "calibration", "improvements", "outperforms", "sessions", "shap", "saturated", "load-bearing",
    "untried", "coverage", "ablation", "edge-types", "lineage", "column", "correlations", "discovery", "invariants",
    "experiment", "central", "longest-path", "context", "types", "profile",
]
#: The brief that describes the columns, beside the configuration.
BRIEF = "program.md"


def prepared(spark, c: cfg.Config) -> DataFrame:
    """The data set with row_id, split and fold."""
    df = tables.read(spark, c.data_path, list(c.exclude_columns))
    for w in tables.validate(df, c.target, c.date_col, list(c.categorical_columns)):
        print(f"warning: {w}")
    # row_id is the order of the rows, kept in a table; folds are drawn by what the rows hold, so they don't depend on files or tasks
    key = F.md5(F.to_json(F.struct(*[F.col(f"`{x}`").cast("string").alias(f"c{i}") for i, x in enumerate(df.columns)]), {"ignoreNullFields": "false"}))
    df = stored(df.withColumns({"row_id": F.monotonically_increasing_id(), "row_key": key}), "prepared")
    if c.date_col:
        return splits.temporal_split(df, [F.col(c.date_col), F.col("row_key"), F.col("row_id")], c.n_folds).drop("rn", "row_key")
    return splits.stratified_split(splits.strata(df, c.target), "row_id", "stratum", c.n_folds, seed=c.random_seed, draw_by="row_key").drop("row_key")


def engineered(df: DataFrame, path: str) -> DataFrame:
    """df with the columns that a file's engineer_features adds; the rows must stay the same."""
    spec = importlib.util.spec_from_file_location("engineered_features", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    out = module.engineer_features(df)
    if not isinstance(out, DataFrame) or "row_id" not in out.columns:
        raise ValueError("engineer_features must return a DataFrame with the rows it was given")
    ids = out.select("row_id").exceptAll(df.select("row_id")).head(1) or df.select("row_id").exceptAll(out.select("row_id")).head(1)
    if ids:
        raise ValueError("engineer_features must neither add nor drop rows")
    return out


def set_up(spark, a: argparse.Namespace) -> None:
    """Writes the configuration and, unless there is one, a brief with a row for each column, which `discover` reads tags from."""
    df = tables.read(spark, a.data)
    kinds = tables.peek(df)
    for i, (name, kind) in enumerate(kinds):
        print(f"[{i}] {name} {kind}")
    target = a.target or input("column to predict: ").strip()
    if target not in df.columns and target.isdigit() and int(target) < len(kinds):
        target = kinds[int(target)][0]
    if target not in df.columns:
        raise ValueError(f"column {target!r} is not in the data: {', '.join(df.columns)}")
    metric = a.metric or tables.suggested_metric(df, target)
    c = cfg.Config(data_path=a.data, target=target, metric=metric)
    Path(a.config).write_text(cfg.dump({f.name: getattr(c, f.name) for f in dataclasses.fields(c) if f.name != "extra"}), encoding="utf-8")
    print(f"wrote {a.config}: {target} by {metric}")
    brief = Path(a.config).parent / BRIEF
    if brief.exists() and not a.overwrite_brief:
        print(f"kept {brief}")
        return
    rows = "\n".join(f"| `{name}` | {kind} | {'what is predicted' if name == target else ''} |" for name, kind in kinds)
    brief.write_text(f"# Brief\n\nPredict `{target}`, judged by {metric}.\n\nSay in a few words what each column means, with its unit:\n\n| column | type | meaning |\n|---|---|---|\n{rows}\n", encoding="utf-8")
    print(f"wrote {brief}")


def show(df: DataFrame) -> None:
    for r in df.toLocalIterator():
        print(json.dumps(r.asDict(recursive=True), default=str))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="featurelab")
    p.add_argument("--config", default="config.yaml")
    p.add_argument("--ledger", default="ledger")
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("init", help="write a configuration for a data file")
    one.add_argument("data")
    one.add_argument("target")
    new = sub.add_parser("setup", help="write a configuration and the skeleton of a brief for a data file, then prepare it")
    new.add_argument("data")
    new.add_argument("--target", help="column to predict, by name or number; asked for if not given")
    new.add_argument("--metric", choices=cfg.METRICS, help="by the first rows if not given")
    new.add_argument("--overwrite-brief", action="store_true")
    for name in ("prepare", "status"):
        sub.add_parser(name)
    d = sub.add_parser("discover")
    d.add_argument("--brief", help="a text whose lines name columns and what they are; program.md beside the configuration if not given")
    q = sub.add_parser("query")
    q.add_argument("kind", choices=["within_group_variance", "cardinality", "correlation", "conditional_distribution"])
    for a in ("--expr", "--col", "--col-a", "--col-b"):
        q.add_argument(a)
    q.add_argument("--groupby", nargs="+")
    q.add_argument("--cols", nargs="+")
    q.add_argument("--n-groups", type=int, default=5)
    t = sub.add_parser("train")
    t.add_argument("--features", nargs="+", help=f"columns, expressions, or kind:argument:... with a kind of {', '.join(KINDS)}")
    t.add_argument("--module", help="a Python file whose engineer_features(df) adds columns; their inputs are read from the plan")
    t.add_argument("--description", default="")
    t.add_argument("--trees", type=int, default=model.TREES)
    i = sub.add_parser("inspect")
    i.add_argument("report", choices=REPORTS)
    i.add_argument("--column", help="of the column deep dive")
    i.add_argument("--exp", type=int, help="of the experiment deep dive")
    w = sub.add_parser("watch", help="write a version for each change of the ledger and print it")
    w.add_argument("--every", help='look that often, for example "3 seconds"; else once')
    a = p.parse_args(argv)
    spark = session()
    if a.command == "init":
        df = tables.read(spark, a.data)
        Path(a.config).write_text(f"data_path: {a.data}\ntarget: {a.target}\nmetric: {tables.suggested_metric(df, a.target)}\n", encoding="utf-8")
        print(f"wrote {a.config}; columns: {', '.join(f'{n} {k}' for n, k in tables.peek(df))}")
        return 0
    if a.command == "setup":
        set_up(spark, a)
        return main(["--config", a.config, "--ledger", a.ledger, "prepare"])
    L = Ledger(spark, a.ledger)
    L.register_type("CORRELATED_WITH", "Feature", ["Feature"], "statistical")
    L.register_type("OUTPERFORMS", "Experiment", ["Experiment"], "improvement")
    for said in L.migrate(datetime.datetime.now()):
        print(f"migrated {said}")
    if a.command == "watch":
        done = streams.follow(spark, a.ledger, f"{a.ledger}-versions", every=a.every)
        done.awaitTermination()
        show(streams.ledger_versions(spark, f"{a.ledger}-versions").orderBy("version", "part"))
        return 0
    if a.command == "inspect":
        e, higher = L.graph_tables(), cfg.load(a.config).higher_is_better if Path(a.config).exists() else True
        made = {
            "history": lambda: reports.history(e), "timeline": lambda: reports.timeline(e), "success": lambda: reports.success_rates(e), "failed": lambda: reports.failed_patterns(e),
            "hypotheses": lambda: e["hypothesis"], "calibration": lambda: reports.hypotheses(e), "improvements": lambda: improved_over(e["experiment"]),
            "outperforms": lambda: outperforms(e["experiment"], e["used_in"], higher), "sessions": lambda: reports.sessions(e["experiment"].withColumn("k", F.lit(1)), "k", "ts"),
            "shap": lambda: reports.shap_ranking(e, higher=higher), "saturated": lambda: reports.saturated_columns(e), "load-bearing": lambda: reports.load_bearing(e), "untried": lambda: reports.untried_pairs(e),
            "coverage": lambda: reports.coverage(e), "ablation": lambda: reports.ablation(e), "edge-types": lambda: reports.edge_types(L.types(), views.elements(e)[1]),
            "lineage": lambda: reports.feature_lineage(e), "column": lambda: reports.column_dive(e, a.column), "correlations": lambda: reports.correlations(L.table("edge")),
            "discovery": lambda: reports.discovered_keys(L.last_run("entity_key")),
            "experiment": lambda: reports.experiment_dive(e, a.exp or L.next_id("experiment", "exp_id") - 1),
            "central": lambda: graph.betweenness(views.elements(e)[1].select("src", "dst")).filter(F.startswith("node", F.lit("feat_"))).orderBy(F.desc("centrality"), "node"),
            "longest-path": lambda: graph.improvement_chain(improved_over(e["experiment"])).orderBy("place"), "context": lambda: reports.compressed_history(e),
            "profile": lambda: reports.column_profiles(L.columns(), L.last_run("column_profile")),
            "types": lambda: L.types().orderBy("category", "rel_type"),
            "invariants": lambda: reports.discovered_invariants(L.last_run("invariant_within"), L.last_run("derived_column"), L.last_run("entity_key")),
        }
        show(made[a.report]())
        return 0
    c = cfg.load(a.config)
    if a.command == "status":
        e = {"experiment": L.table("experiment")}
        minutes = reports.session_elapsed(e, datetime.datetime.now()).first()
        show(reports.status(e, minutes[0] if minutes else 0.0, c.time_budget_minutes, 999, c.min_delta, c.higher_is_better))
        return 0
    df = prepared(spark, c)
    features = [x for x in df.columns if x not in (c.target, "row_id", "split", "fold", "stratum", "chunk", "rn", c.date_col)]
    if a.command == "prepare":
        part = "chunk" if c.date_col else "fold"
        show(df.groupBy("split", part).count().orderBy("split", part))
        if L.gate(tables.signature(df.select(*features, c.target), dataclasses.asdict(c), tables.files(spark, c.data_path)), datetime.datetime.now()):
            print("warning: other data than before; the old ledger is put aside")
        made = profile.profile(df.select(*features))
        L.register_columns(made, dict(df.dtypes))
        show(made)
    elif a.command == "discover":
        rows = query.scope(df).select(*features)
        L.store_profile(profile.extended(rows))
        brief = Path(a.brief) if a.brief else Path(a.config).parent / BRIEF
        tags = tagged(spark, brief.read_text(encoding="utf-8"), features) if a.brief or brief.exists() else {}
        for tag, own in tags.items():
            if own:
                print(f"{tag}: {', '.join(own)}")
        got = discover.scan(rows, list(c.categorical_columns), tags)
        keys, icc, steady = [r["columns"] for r in got.keys.collect()], {}, got.steady.persist()
        show(steady.orderBy("median_cv", "key", "expr"))
        if keys and profile.numeric_columns(rows, boolean=True):
            left = model.entity_residuals(query.scope(df).select(*features, c.target), c.target, c.metric)
            icc = {r["key"]: r["residual_icc"] for r in discover.residual_icc(left, F.col("residual"), keys).collect()}
            for key, value in icc.items():
                print(json.dumps({"key": key, "residual_icc": value}))
        alone_too = spark.createDataFrame([(x, None) for x in got.raw], "expr string, variance double")
        L.store_discovery(got.derived.select("expr", "variance").unionByName(alone_too), got.references, got.keys, icc, steady, datetime.datetime.now())
    elif a.command == "query":
        kw = {k: v for k, v in {"expr": a.expr, "groupby": a.groupby, "cols": a.cols, "col": a.col, "col_a": a.col_a, "col_b": a.col_b}.items() if v}
        if a.kind == "conditional_distribution":
            kw |= {"groupby": a.groupby[0], "n_groups": a.n_groups}
        show(query.run_query(df, a.kind, c.target, L, **kw))
    elif a.command == "train":
        made, sources, fitted, wanted = {}, {}, [], a.features or features
        if a.module:
            whole = engineered(df, a.module)
            own = [x for x in whole.columns if x not in df.columns]
            sources, df = lineage.inputs(whole, own), whole
            wanted = [*(a.features or features), *own]
        for x in wanted:
            one = None if x in df.columns else FoldFeature.parse(x)
            if one is not None:
                fitted.append(one)
                sources[x] = list(one.inputs)
                continue
            compiled = None if x in df.columns else compile_expression(x, df)
            made[x] = F.col(f"`{x}`") if compiled is None else compiled.column
            if x not in sources:
                sources[x] = [x] if compiled is None else sorted(compiled.references)
        if forbidden := [x for x, own in sources.items() if c.target in own]:
            raise ValueError(f"features that read the target: {forbidden}")
        names = {x: f"x{k}" if x not in df.columns else x for k, x in enumerate(made)}
        read = [x for x in dict.fromkeys(x for f in fitted for x in f.inputs) if x not in made]
        wide = df.select("row_id", "split", "chunk" if c.date_col else "fold", c.target, *[e.alias(names[x]) for x, e in made.items()], *[F.col(f"`{x}`") for x in read])
        ends = {**{x: [x] for x in df.columns}, **sources}  # of an expression over made columns, those of the columns
        lineage.check(wide, {names[x]: [e for c in sources[x] for e in (c, *ends.get(c, ()))] for x in made})
        r = model.cross_validate(wide, list(names.values()), c.target, c.metric, "row_id", c.n_folds, a.trees, shap=True, fitted=fitted)
        done = L.record(r["cv_score"], r["cv_std"], [*made, *[f.name for f in fitted]], a.description, c.higher_is_better, c.min_delta, datetime.datetime.now())
        L.register_features(sources)
        back = {v: k for k, v in names.items()}
        L.append("feature_shap", [(done["exp_id"], back.get(f, f), v, r["shap_std"][f]) for f, v in r["shap"].items()])
        node = lambda f: f"feat_{back.get(f, f)}"
        L.add_edges("CORRELATED_WITH", spark.createDataFrame([(node(x), node(y), v) for x, y, v in r["correlated"]], "src string, dst string, correlation double"))
        won = outperforms(L.table("experiment"), L.table("used_in"), c.higher_is_better).filter(F.col("src") == done["exp_id"])
        L.add_edges("OUTPERFORMS", won.select(F.concat(F.lit("exp_"), "src").alias("src"), F.concat(F.lit("exp_"), "dst").alias("dst"), "overlap"))
        print(json.dumps(done | {"cv_score": r["cv_score"], "cv_std": r["cv_std"]}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
