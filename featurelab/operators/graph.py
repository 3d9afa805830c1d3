"""Traversals of the ledger's graph: joins repeated to a fixed point, each round an aggregation of what is new."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shared import cut as _cut

MAX_ROUNDS = 50


def closure(edges: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """start, node, depth: what can be reached from each start (column node) along edges (src, dst), with the least depth.

    Goes on until nothing new is found; more than max_depth rounds, if given, are an error.
    """
    e = edges.select("src", "dst").distinct()
    found = _cut(starts.select(F.col("node").alias("start"), F.col("node"), F.lit(0).alias("depth")).distinct())
    new = found
    for depth in count(1):
        step = new.join(e, new["node"] == e["src"]).select("start", F.col("dst").alias("node")).distinct()
        new = _cut(step.join(found, ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if not new.head(1):
            break
        if max_depth is not None and depth > max_depth:
            raise RuntimeError("the closure is deeper than max_depth")
        found = _cut(found.unionByName(new))
    return found.filter("depth > 0")


def with_jumps(chain: DataFrame) -> DataFrame:
    """Edges (src, dst) of a chain, where a node leads to at most one other, and jumps of 2, 4, 8, ... steps along it: what can be
    reached stays the same, in as many rounds as the logarithm of the chain's length."""
    out = jump = _cut(chain.select("src", "dst").distinct())
    while True:
        a, b = jump.alias("a"), jump.alias("b")
        jump = _cut(a.join(b, F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst")))
        if not jump.head(1):
            return out
        out = _cut(out.unionByName(jump))


def within(edges: DataFrame, start: str, hops: int = 4) -> DataFrame:
    """node, hop: what is reached from a node along edges (src, dst) in at most that many steps, with the least number."""
    found = _cut(edges.sparkSession.createDataFrame([(start, 0)], "node string, hop int"))
    new = found
    for hop in range(1, hops + 1):
        step = new.join(edges, new["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        new = _cut(step.join(found, "node", "left_anti").withColumn("hop", F.lit(hop)))
        found = found.unionByName(new)
    return found.filter("hop > 0")


def longest_path(edges: DataFrame, small: int = 200_000) -> int:
    """Edges of the longest directed path; an error if there is a cycle.

    Up to `small` edges are ordered on the driver; beyond that nodes without a way in are peeled off, round by round.
    """
    e = edges.select("src", "dst").distinct()
    rows = e.limit(small + 1).collect()
    if len(rows) <= small:
        after, waits, far = {}, {}, {}
        for s, d in rows:
            after.setdefault(s, []).append(d)
            waits[d] = waits.get(d, 0) + 1
        ready = [s for s in after if s not in waits]
        for s in ready:
            for d in after.get(s, []):
                far[d] = max(far.get(d, 0), far.get(s, 0) + 1)
                waits[d] -= 1
                if not waits[d]:
                    ready.append(d)
        if any(waits.values()):
            raise ValueError("the graph has a cycle")
        return max(far.values(), default=0)
    e, n = _cut(e), 0
    while e.head(1):
        rest = _cut(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"))
        if rest.count() == e.count():
            raise ValueError("the graph has a cycle")
        e, n = rest, n + 1
    return n


def improvement_chain(improved: DataFrame, start: int | None = None) -> DataFrame:
    """place, exp_id: from the newest experiment that improved on another, always to what it improved on.

    ``improved`` (exp_id, previous) has at most one row for each kept experiment.
    """
    one = improved.groupBy("exp_id").agg(F.min("previous").alias("previous"))
    first = F.lit(start) if start is not None else one.agg(F.max("exp_id")).first()[0]
    if first is None:
        return improved.sparkSession.createDataFrame([], "place int, exp_id bigint")
    edges = one.selectExpr("exp_id as src", "previous as dst")
    begin = improved.sparkSession.range(1).select(F.lit(first).cast("bigint").alias("node"))
    # distances double each round: what is reached after k steps is joined with itself
    jump, line = _cut(edges.withColumn("len", F.lit(1))), _cut(begin.select("node", F.lit(0).alias("place")))
    for _ in range(MAX_ROUNDS):
        more = line.join(jump, line["node"] == jump["src"]).select(F.col("dst").alias("node"), (F.col("place") + F.col("len")).alias("place"))
        line = _cut(line.unionByName(more).distinct())
        a, b = jump.alias("a"), jump.alias("b")
        jump = _cut(a.join(b, F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"), (F.col("a.len") + F.col("b.len")).alias("len")))
        if not jump.head(1):
            break
    return line.select("place", F.col("node").alias("exp_id"))


def distances_to(edges: DataFrame, targets: list[str], cutoff: int | None = None) -> DataFrame:
    """target, node, far: the least number of edges from each node that reaches a target, 0 for itself, up to cutoff."""
    e = edges.select("src", "dst").distinct()
    found = new = _cut(edges.sparkSession.createDataFrame([(t, t, 0) for t in targets], "target string, node string, far int"))
    for far in count(1):
        if cutoff is not None and far > cutoff:
            return found
        step = new.join(e, new["node"] == e["dst"]).select("target", F.col("src").alias("node")).distinct()
        new = _cut(step.join(found, ["target", "node"], "left_anti").withColumn("far", F.lit(far)))
        if not new.head(1):
            return found
        found = _cut(found.unionByName(new))


def simple_paths(edges: DataFrame, source: str, target: str, limit: int = 5, cutoff: int | None = None) -> DataFrame:
    """path (array): the `limit` shortest paths without repeated nodes, shortest first, then in order of their nodes; of at most cutoff edges, if given."""
    return paths_to(edges, source, [target], limit, cutoff).select("path").orderBy(F.size("path"), "path")


def paths_to(edges: DataFrame, source: str, targets: list[str], limit: int = 5, cutoff: int | None = None) -> DataFrame:
    """target, path: the `limit` shortest paths without repeated nodes from source to each target (Yen 1971).

    A path that is found gives a search for each of its nodes: the path up to it stays, the edges that found paths take from there
    are barred. The searches of all targets run together, a join for each step. They keep the first path to each node, leave out
    nodes that can't reach the target (or not within cutoff, by the distances of a search from the targets backwards), and so need no
    more rows than nodes for each search. The driver holds limit paths for each target.
    """
    spark = edges.sparkSession
    e = _cut(edges.select("src", "dst").distinct())
    far = _cut(distances_to(e, targets, cutoff))

    def search(asked: list[tuple[int, str, list[str], list[str]]]) -> dict[int, list[str]]:
        """number, target, path so far, nodes that may not follow it -> the first shortest whole path, if there is one."""
        front = _cut(spark.createDataFrame(asked, "n int, target string, path array<string>, barred array<string>"))
        roots = front.select("n", F.explode("path").alias("node"))
        seen, got = _cut(roots), {}
        while True:
            step = front.join(e, F.element_at("path", -1) == e["src"]).filter(~F.array_contains("barred", F.col("dst")))
            step = step.select("n", "target", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path")).join(far, ["target", "node"])
            if cutoff is not None:
                step = step.filter(F.size("path") - 1 + F.col("far") <= cutoff)
            step = _cut(step.join(seen, ["n", "node"], "left_anti").groupBy("n", "target", "node").agg(F.min("path").alias("path")))
            got |= {r["n"]: list(r["path"]) for r in step.filter("node = target").collect()}  # one for each search at most
            rest = step.filter(~F.col("n").isin(list(got))) if got else step
            if not rest.head(1):
                return got
            seen = _cut(seen.unionByName(step.select("n", "node")))
            front = rest.select("n", "target", "path", F.array().cast("array<string>").alias("barred"))

    first = search([(n, t, [source], []) for n, t in enumerate(targets) if t != source])
    found, waiting = {n: [p] for n, p in first.items()}, {n: set() for n in first}
    for _ in range(limit - 1):
        asked = []
        for n, paths in found.items():
            last = paths[-1] if len(paths) > 0 else []
            for j in range(len(last) - 1):
                root = last[: j + 1]
                asked.append((n, root, sorted({p[j + 1] for p in paths if p[: j + 1] == root and len(p) > j + 1})))
        if not asked:
            break
        for k, p in search([(k, targets[n], root, barred) for k, (n, root, barred) in enumerate(asked)]).items():
            waiting[asked[k][0]].add(tuple(p))
        grown = False
        for n, more in waiting.items():
            if best := min(more - {tuple(p) for p in found[n]}, key=lambda p: (len(p), p), default=None):
                found[n].append(list(best))
                more.discard(best)
                grown = True
        if not grown:
            break
    return spark.createDataFrame([(targets[n], p) for n, paths in found.items() for p in paths], "target string, path array<string>")


def betweenness(edges: DataFrame, max_edges: int = 200_000) -> DataFrame:
    """node, centrality: exact, directed, normalised (Brandes 2001).

    A graph of at most max_edges edges is sent to every task, and the sources are spread over the tasks; a larger one goes through
    joins, level by level.
    """
    e = edges.select("src", "dst").distinct()
    rows = e.limit(max_edges + 1).collect()
    if len(rows) > max_edges:
        return betweenness_by_levels(e)
    out: dict[str, list[str]] = {}
    for s, d in rows:
        out.setdefault(s, []).append(d)
        out.setdefault(d, [])
    n = len(out)
    sent = edges.sparkSession.sparkContext.broadcast(out)

    def run(batches):
        import pandas as pd

        graph = sent.value
        for pdf in batches:
            total: dict[str, float] = {}
            for s in pdf["node"]:
                order, ways, far, back = [], {s: 1.0}, {s: 0}, {s: []}
                queue = [s]
                for v in queue:
                    order.append(v)
                    for w in graph[v]:
                        if w not in far:
                            far[w], ways[w], back[w] = far[v] + 1, 0.0, []
                            queue.append(w)
                        if far[w] == far[v] + 1:
                            ways[w] += ways[v]
                            back[w].append(v)
                share = dict.fromkeys(order, 0.0)
                for w in reversed(order):
                    for v in back[w]:
                        share[v] += ways[v] / ways[w] * (1 + share[w])
                    if w != s:
                        total[w] = total.get(w, 0.0) + share[w]
            yield pd.DataFrame({"node": list(total), "c": list(total.values())})

    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    part = nodes.mapInPandas(run, T.StructType([T.StructField("node", T.StringType()), T.StructField("c", T.DoubleType())]))
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return nodes.join(part.groupBy("node").agg(F.sum("c").alias("c")), "node", "left").select("node", (F.coalesce("c", F.lit(0.0)) * scale).alias("centrality"))


def betweenness_by_levels(edges: DataFrame, batches: int | None = None) -> DataFrame:
    """As betweenness, for graphs that no task could hold: numbers of shortest paths go out from a batch of sources level by level,
    dependencies come back the same way; every step is a join and a sum by (source, node)."""
    e = _cut(edges.select("src", "dst").distinct())
    nodes = _cut(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    n = nodes.count()
    batches = batches or max(1, n * n // 1_000_000_000)
    total = nodes.select("node", F.lit(0.0).alias("c"))
    for b in range(batches):
        new = _cut(nodes.filter(F.pmod(F.xxhash64("node"), F.lit(batches)) == b).select(F.col("node").alias("s"), "node", F.lit(1.0).alias("ways")))
        levels, seen = [new], new.select("s", "node")
        while True:
            step = new.join(e, new["node"] == e["src"]).groupBy("s", F.col("dst").alias("node")).agg(F.sum("ways").alias("ways"))
            new = _cut(step.join(seen, ["s", "node"], "left_anti"))
            if not new.head(1):
                break
            levels.append(new)
            seen = _cut(seen.unionByName(new.select("s", "node")))
        below = levels[-1].select("s", "node", "ways", F.lit(0.0).alias("share"))
        for level in reversed(levels[:-1]):
            total = _cut(total.unionByName(below.select("node", F.col("share").alias("c"))).groupBy("node").agg(F.sum("c").alias("c")))
            back = below.select("s", F.col("node").alias("w"), ((1 + F.col("share")) / F.col("ways")).alias("each")).join(e, F.col("w") == e["dst"]).groupBy("s", F.col("src").alias("node")).agg(F.sum("each").alias("each"))
            below = _cut(level.join(back, ["s", "node"], "left").select("s", "node", "ways", (F.col("ways") * F.coalesce("each", F.lit(0.0))).alias("share")))
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return total.select("node", (F.col("c") * scale).alias("centrality"))


def induced(nodes: DataFrame, edges: DataFrame, types: list[str], search: str = "") -> DataFrame:
    """Edges whose two ends have one of the types and the search text in their label or id."""
    text = search.lower()
    seen = nodes.filter(F.col("type").isin(types) & (F.contains(F.lower("label"), F.lit(text)) | F.contains(F.lower("id"), F.lit(text)))).select("id")
    return edges.join(seen.withColumnRenamed("id", "src"), "src", "left_semi").join(seen.withColumnRenamed("id", "dst"), "dst", "left_semi")
