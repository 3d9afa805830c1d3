"""The ledger of experiments: append-only tables, and the rules that fill them.

Tables: experiment, used_in (exp_id, feature), derived_from (feature, column), feature_shap (exp_id, feature, value, std),
hypothesis, edge (src, dst, rel, category, seq, delta, correlation, overlap, median_cv, n_groups), relationship_type. Nothing
is overwritten; the view of a graph with one edge for each pair of nodes is computed from `seq`.
"""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCHEMAS = {
    "experiment": "exp_id bigint, cv_score double, cv_std double, delta double, n_features bigint, composite_score double, kept boolean, description string, ts timestamp",
    "used_in": "exp_id bigint, feature string",
    "derived_from": "feature string, column string",
    "feature_shap": "exp_id bigint, feature string, value double, std double",
    "hypothesis": "hyp_id bigint, text string, predicted_direction string, predicted_delta double, created_at timestamp",
    "resolution": "hyp_id bigint, exp_id bigint, actual_kept boolean, actual_delta double",
    "supersedes": "hyp_id bigint, old_hyp_id bigint",
    "edge": "src string, dst string, rel string, seq bigint, delta double, correlation double, overlap bigint, median_cv double, n_groups bigint",
    "relationship_type": "rel_type string, source_type string, target_type array<string>, category string, description string, builtin boolean",
    "query_log": "ts timestamp, query_type string",
    "column": "column string, dtype string, cardinality bigint, missingness_rate double, mean double, std double, run bigint",
    "column_profile": "run bigint, column string, p5 double, p25 double, p75 double, p95 double, skewness double, top5_values array<string>, top5_counts array<bigint>, missingness_group int",
    "discovery": "run bigint, ts timestamp",
    "derived_column": "run bigint, id string, expr string, variance double",
    "derived_from_cols": "run bigint, id string, column string",
    "entity_key": "run bigint, id string, columns array<string>, cardinality bigint, residual_icc double",
    "invariant_within": "run bigint, derived_id string, key_id string, median_cv double, n_groups bigint",
    "signature": "signature string, ts timestamp",
    "schema_version": "version bigint, ts timestamp",
}
VERSION = 3

# The relationship types that every ledger has.
BUILTIN_TYPES = [
    ("DERIVED_FROM", "Feature", ["Column", "Feature"], "lineage"),
    ("USED_IN", "Feature", ["Experiment"], "membership"),
    ("IMPROVED_OVER", "Experiment", ["Experiment"], "improvement"),
    ("SUPPORTS", "Hypothesis", ["Experiment"], "hypothesis"),
    ("CONTRADICTS", "Hypothesis", ["Experiment"], "hypothesis"),
    ("SUPERSEDES", "Hypothesis", ["Hypothesis"], "hypothesis"),
    ("INVARIANT_WITHIN", "DerivedColumn", ["EntityKey"], "discovery"),
    ("CANDIDATE_ENTITY_KEY", "EntityKey", ["Column"], "discovery"),
    ("DERIVED_FROM_COLS", "DerivedColumn", ["Column"], "discovery"),
]
# Relationship types of older ledgers that are no more.
GONE = ["MEMBER_OF", "TESTED_IN"]


class Ledger:
    """Tables under a folder that Spark reads and writes."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, name: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def table(self, name: str) -> DataFrame:
        if not self._exists(name):
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}")

    def append(self, name: str, rows: DataFrame | list[tuple]) -> None:
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, SCHEMAS[name])
        df.select(*self.table(name).columns).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")

    def version(self) -> int:
        """The schema version that the ledger was last written or migrated to; 1 for one that says nothing."""
        return self.table("schema_version").agg(F.max("version")).first()[0] or 1

    def migrate(self, ts) -> list[str]:
        """Brings an older ledger up to date, step by step, and returns what was done. Old rows are kept and get what is new as defaults.

        2: tables of runs got the column `run` (rows before are run 1). 3: relationship types that are gone (their values are listed
        below) leave the registry, duplicate types too.
        """
        done, have = [], self.version()
        if have < 2:
            for name in ("column", "derived_column", "derived_from_cols", "entity_key", "invariant_within"):
                if self._exists(name) and "run" not in self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/{name}").columns:
                    self._replace(name, self.table(name).withColumn("run", F.lit(1).cast("bigint")))
                    done.append(f"{name}: run")
        if have < 3 and self._exists("relationship_type"):
            types = self.table("relationship_type")
            good = types.filter(~F.col("rel_type").isin(GONE)).dropDuplicates(["rel_type"])
            if types.count() != good.count():
                self._replace("relationship_type", good)
                done.append("relationship_type: types that are gone or repeated")
        if have < VERSION:
            self.append("schema_version", [(VERSION, ts)])
        return done

    def _replace(self, name: str, rows: DataFrame) -> None:
        """Writes rows beside the table, then takes its place; the old one is kept under another name."""
        jvm = self.spark._jvm
        at = lambda n: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}")
        rows.write.mode("overwrite").parquet(f"{self.path}/_new_{name}")
        files = at(name).getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not (files.rename(at(name), at(f"_before_{name}_{uuid.uuid4().hex[:8]}")) and files.rename(at(f"_new_{name}"), at(name))):
            raise OSError(f"{self.path}/{name} can't be replaced")

    def next_id(self, name: str, column: str) -> int:
        return (self.table(name).agg(F.max(column)).first()[0] or 0) + 1

    def types(self) -> DataFrame:
        """Registered types besides the built-in ones, which are always there."""
        base = self.spark.createDataFrame([(r, s, t, c, "", True) for r, s, t, c in BUILTIN_TYPES], SCHEMAS["relationship_type"])
        return base.unionByName(self.table("relationship_type"))

    def register_type(self, rel: str, source: str, target: list[str], category: str = "auto", description: str = "") -> bool:
        """False if the type is known."""
        if self.types().filter(F.col("rel_type") == rel).head(1):
            return False
        self.append("relationship_type", [(rel, source, target, category, description, False)])
        return True

    def record(self, cv_score: float, cv_std: float, features: list[str], description: str, higher: bool, min_delta: float, ts) -> dict:
        """Appends an experiment by the keep rule and returns it."""
        kept = self.table("experiment").filter("kept").select(F.max("composite_score").alias("hi"), F.min("composite_score").alias("lo"), F.count("*").alias("n")).first()
        from ..functions.metrics import PENALTY

        score = cv_score - PENALTY * len(features) if higher else cv_score + PENALTY * len(features)
        best = kept["hi"] if higher else kept["lo"]
        delta = 0.0 if not kept["n"] else (score - best if higher else best - score)
        keep = not kept["n"] or delta > min_delta * abs(best)
        exp_id = self.next_id("experiment", "exp_id")
        self.append("experiment", [(exp_id, cv_score, cv_std, delta, len(features), score, keep, description, ts)])
        self.append("used_in", [(exp_id, f) for f in features])
        return {"exp_id": exp_id, "composite_score": score, "delta": delta, "kept": keep}

    def register_columns(self, profiled: DataFrame, dtypes: dict[str, str]) -> None:
        """The columns of the data set and their profile (column, cardinality, missingness_rate, mean, std); the last ones count."""
        run = self.next_id("column", "run")
        kind = F.create_map(*[F.lit(x) for pair in dtypes.items() for x in pair])
        self.append("column", profiled.withColumns({"dtype": F.try_element_at(kind, F.col("column")), "run": F.lit(run).cast("bigint")}))

    def store_profile(self, extended: DataFrame) -> int:
        """The extended profile (profile.extended) of columns that the ledger knows, as a run of its own; returns how many they are."""
        run = self.next_id("column_profile", "run")
        known = extended.join(F.broadcast(self.columns().select("column")), "column", "left_semi").withColumn("run", F.lit(run).cast("bigint"))
        self.append("column_profile", known)
        return known.count()

    def columns(self) -> DataFrame:
        return self.last_run("column")

    def last_run(self, name: str) -> DataFrame:
        """The rows of the newest run of a table that is written by runs."""
        t = self.table(name)
        return t.join(F.broadcast(t.agg(F.max("run").alias("run"))), "run", "left_semi")

    def register_features(self, sources: dict[str, list[str]]) -> int:
        """Lineage of features: a source is a known column, else another known feature; others are left out. New pairs are counted."""
        columns = {r["column"] for r in self.columns().select("column").collect()}  # one row for each column
        known = self.table("derived_from")
        features = {r["feature"] for r in known.select("feature").distinct().collect()} | set(sources)
        have = {tuple(r) for r in known.collect()}
        rows = [(f, c) for f, own in sources.items() for c in dict.fromkeys(own) if (c in columns or (c in features and c != f)) and (f, c) not in have]
        if rows:
            self.append("derived_from", rows)
        return len(rows)

    def store_discovery(self, derived: DataFrame, references: dict[str, list[str]], keys: DataFrame, icc: dict[str, float], invariants: DataFrame, ts) -> int:
        """What a discovery found, as a run of its own: derived columns (expr, variance), entity keys (columns, cardinality) and
        near-constant pairs (key, expr, median_cv, n_groups) whose two ends are among them. The newest run is what readers see."""
        from .discover import entity_id, expression_id

        run = self.next_id("discovery", "run")
        found = derived.collect()  # at most MAX_DERIVED
        known = {r["column"] for r in self.columns().select("column").collect()}
        got = keys.collect()  # at most MAX_KEYS
        named = {"_".join(r["columns"]): entity_id(list(r["columns"])) for r in got}
        self.append("derived_column", [(run, expression_id(r["expr"]), r["expr"], r["variance"]) for r in found])
        self.append("derived_from_cols", [(run, expression_id(r["expr"]), c) for r in found for c in sorted(set(references.get(r["expr"], []))) if c in known])
        self.append("entity_key", [(run, named["_".join(r["columns"])], list(r["columns"]), r["cardinality"], icc.get("_".join(r["columns"]))) for r in got])
        ids = {r["expr"]: expression_id(r["expr"]) for r in found}
        pairs = [(run, ids[r["expr"]], named[r["key"]], r["median_cv"], r["n_groups"]) for r in invariants.collect() if r["expr"] in ids and r["key"] in named]
        self.append("invariant_within", pairs)
        self.append("discovery", [(run, ts)])
        return run

    def queries_asked(self) -> int:
        """Queries since the last discovery."""
        last = self.table("discovery").agg(F.max("ts")).first()[0]
        log = self.table("query_log")
        return (log if last is None else log.filter(F.col("ts") > F.lit(last))).count()

    def gate(self, signature: str, ts) -> bool:
        """Whether the data differ from those that the ledger was begun for. Then the old tables are put aside and it begins anew."""
        have = self.table("signature").select("signature").head()
        if have and have[0] == signature:
            return False
        if have:
            jvm = self.spark._jvm
            here = jvm.org.apache.hadoop.fs.Path(self.path)
            files = here.getFileSystem(self.spark._jsc.hadoopConfiguration())
            aside = jvm.org.apache.hadoop.fs.Path(f"{self.path}-before-{ts:%Y%m%d%H%M%S%f}")
            if not files.rename(here, aside):
                raise OSError(f"{self.path} can't be put aside")
        self.append("signature", [(signature, ts)])
        return bool(have)

    def graph_tables(self) -> dict[str, DataFrame]:
        """The tables as the reports read them."""
        outcome = resolved(self.table("hypothesis"), self.table("resolution"))
        return {n: self.table(n) for n in ("experiment", "used_in", "derived_from", "feature_shap", "hypothesis", "supersedes")} | {"column": self.columns(), "outcome": outcome, "tested_by": self.table("resolution").select("hyp_id", "exp_id")}

    def nodes(self) -> DataFrame:
        """node: the names of all nodes of the graph (col_, feat_, exp_, hyp_, derived and key ids)."""
        def named(prefix: str, t: DataFrame, c: str) -> DataFrame:
            return t.select(F.concat(F.lit(prefix), F.col(c).cast("string")).alias("node"))

        used, derived = self.table("used_in"), self.table("derived_from")
        out = named("col_", self.columns(), "column")
        for part in (named("feat_", used, "feature"), named("feat_", derived, "feature"), named("exp_", self.table("experiment"), "exp_id"), named("hyp_", self.table("hypothesis"), "hyp_id"), named("", self.last_run("derived_column"), "id"), named("", self.last_run("entity_key"), "id")):
            out = out.unionByName(part)
        return out.distinct()

    def next_seq(self) -> int:
        """A number that no other writer has or gets, larger than all that were given before: a file of that name is made, which succeeds once."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_seq")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        n = max((int(s.getPath().getName()) for s in files.listStatus(folder)), default=0) + 1
        while not self._made(files, jvm.org.apache.hadoop.fs.Path(folder, f"{n:012d}")):
            n += 1
        return n

    def _made(self, files, path) -> bool:
        """Whether this call made the file. A local file system needs its own exclusive way, as Hadoop looks first and creates then."""
        if files.getScheme() == "file":
            try:
                os.close(os.open(files.makeQualified(path).toUri().getPath(), os.O_CREAT | os.O_EXCL))
            except FileExistsError:
                return False
            return True
        try:
            return files.createNewFile(path)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise

    def add_edges(self, rel: str, edges: DataFrame) -> int:
        """Appends typed edges (src, dst and any of the edge table's attributes) and returns how many. An unknown type is registered; an edge with an end that
        is no node is an error. seq: one number for each call, in the order of the calls, whoever makes them."""
        rows = edges.select("src", "dst", *[c for c in edges.columns if c not in ("src", "dst", "rel", "seq")]).persist()
        ends = rows.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        missing = [r["node"] for r in ends.join(self.nodes(), "node", "left_anti").limit(10).collect()]
        if missing or rows.filter("src is null or dst is null").head(1):
            raise ValueError(f"edges need two nodes of the graph; unknown: {missing}")
        n = rows.count()
        if n:
            first = rows.head()
            kind = {"col": "Column", "feat": "Feature", "exp": "Experiment", "hyp": "Hypothesis", "derived": "DerivedColumn", "entity": "EntityKey"}
            self.register_type(rel, kind[first["src"].split("_")[0]], [kind[first["dst"].split("_")[0]]])
            here = [c for c in self.table("edge").columns if c in rows.columns]
            whole = rows.select(*here, F.lit(rel).alias("rel"), F.lit(self.next_seq()).cast("bigint").alias("seq"))
            rest = [f for f in self.table("edge").schema.fields if f.name not in whole.columns]
            self.append("edge", whole.withColumns({f.name: F.lit(None).cast(f.dataType) for f in rest}) if rest else whole)
        rows.unpersist()
        return n

    def add_hypothesis(self, text: str, ts, direction: str = "+", delta: float | None = None) -> int:
        hyp_id = self.next_id("hypothesis", "hyp_id")
        self.append("hypothesis", [(hyp_id, text, direction, delta, ts)])
        return hyp_id

    def resolve(self, hyp_id: int, exp_id: int, kept: bool, delta: float) -> None:
        self.append("resolution", [(hyp_id, exp_id, kept, delta)])

    def supersede(self, hyp_id: int, old: int) -> None:
        self.append("supersedes", [(hyp_id, old)])


def replay(scores: DataFrame, min_delta: float, higher: bool = True) -> DataFrame:
    """exp_id, delta, kept of a run of scores (exp_id, score) by the keep rule.

    Whether an experiment is kept depends on the best one kept before, so the fold is over one ordered array: a ledger has as
    many rows as experiments were run.
    """
    e = F.struct(F.col("exp_id"), F.col("score").cast("double").alias("score"))
    sign = 1.0 if higher else -1.0
    start = F.struct(F.lit(None).cast("double").alias("best"), F.array().cast("array<struct<exp_id:bigint,delta:double,kept:boolean>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        first = acc["best"].isNull()
        delta = F.when(first, 0.0).otherwise((x["score"] - acc["best"]) * sign)
        kept = first | (delta > F.abs(acc["best"]) * min_delta)
        return F.struct(F.when(kept, x["score"]).otherwise(acc["best"]).alias("best"), F.concat(acc["out"], F.array(F.struct(x["exp_id"].cast("bigint").alias("exp_id"), delta.alias("delta"), kept.alias("kept")))).alias("out"))

    folded = scores.agg(F.sort_array(F.collect_list(e)).alias("a")).select(F.aggregate("a", start, step)["out"].alias("o"))
    return folded.select(F.explode("o").alias("x")).select("x.*")


def improved_over(experiment: DataFrame) -> DataFrame:
    """exp_id, previous: the most recent earlier kept experiment of each kept one."""
    w = Window.partitionBy().orderBy("exp_id")
    return experiment.filter("kept").select("exp_id", F.lag("exp_id").over(w).alias("previous")).filter("previous is not null")


def outperforms(experiment: DataFrame, used_in: DataFrame, higher: bool = True) -> DataFrame:
    """src, dst, overlap: kept experiments that share features, the better one first. Joined by feature, counted by pair."""
    kept = experiment.filter("kept").select("exp_id", "composite_score")
    use = used_in.join(kept, "exp_id").distinct()
    a, b = use.selectExpr("exp_id as src", "feature", "composite_score as s"), use.selectExpr("exp_id as dst", "feature", "composite_score as d")
    better = F.col("s") > F.col("d") if higher else F.col("s") < F.col("d")
    return a.join(b, "feature").filter(better).groupBy("src", "dst").agg(F.count("*").alias("overlap"))


def resolved(hypothesis: DataFrame, outcome: DataFrame) -> DataFrame:
    """hyp_id, rel: SUPPORTS or CONTRADICTS."""
    good = (F.col("predicted_direction") == "?") | ((F.col("predicted_direction") == "+") & F.col("actual_kept")) | ((F.col("predicted_direction") == "-") & ~F.col("actual_kept"))
    return hypothesis.join(outcome, "hyp_id").select("hyp_id", F.when(good, "SUPPORTS").otherwise("CONTRADICTS").alias("rel"))


def collapsed(edge: DataFrame, attributes: list[str] | None = None) -> DataFrame:
    """One edge for each (src, dst): the last rel wins, attributes are merged (the last value that is there)."""
    names = attributes or [c for c in edge.columns if c not in ("src", "dst", "rel", "seq")]
    return edge.groupBy("src", "dst").agg(F.max_by("rel", "seq").alias("rel"), *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in names])


def feature_status(experiment: DataFrame, used_in: DataFrame) -> DataFrame:
    """feature, status: active if the last kept experiment uses it."""
    last = experiment.filter("kept").agg(F.max("exp_id").alias("exp_id"))
    now = used_in.join(F.broadcast(last), "exp_id").select("feature").distinct().withColumn("active", F.lit(True))
    return used_in.select("feature").distinct().join(now, "feature", "left").select("feature", F.when(F.col("active"), "active").otherwise("inactive").alias("status"))
