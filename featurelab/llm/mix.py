"""Mixing sources to target weights by Pareto order sampling. DataFrame operations only.

Sources take shares of all words by weight; no target exceeds ``most`` times its source's words, and what exceeds is
shared again. Every document of a source is first taken floor(target / words) times. The rest of the target is a sample
without replacement of fixed size: a document is included with a probability pi in proportion to its size (1 at most),
and documents are ranked by random odds over inclusion odds, (u / (1 - u)) / (pi / (1 - pi)). The first ones in that order
are taken up to the target; the last one only if at least half of it fits. u is a hash of doc_id and seed.

Null text counts as empty (size 0, taken 0), null source is a source of its own, after all others. Rows that repeat a
doc_id share its u and rank next to each other; equal rows are interchangeable. An empty table gives an empty result. Texts of
any length only count with their number of words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, before, matched, ordered, table, written

SEED = 42


def _u(doc_id: Column, seed: int) -> Column:
    """Uniform in (0, 1), from 52 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f"|{seed}")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weight: Column | None = None, most: int = 3) -> DataFrame:
    """source, source_size, n_docs, target. ``sizes``: source, size. ``weight`` may use ``place``, the source's rank from 1."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    # as many rows as sources from here on
    per = per.withColumn("place", F.row_number().over(Window.partitionBy().orderBy(F.col("source").asc_nulls_last())))
    per = per.withColumn("weight", (weight if weight is not None else (F.col("place") - 1) % 3 + 1).cast("double"))
    per = per.withColumns({"total": F.sum("source_size").over(Window.partitionBy()).cast("double"), "cap": (F.col("source_size") * most).cast("double")})
    by = Window.partitionBy().orderBy(F.col("cap") / F.col("weight"), "place")
    per = per.withColumns({
        "capped": F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "open": F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)),
        "nth": F.row_number().over(by),
    })
    # the level at which all sources before this one (in order of cap / weight) stand at their cap
    per = per.withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("nth", "level"))
    per = per.withColumn("found", F.min(fits).over(Window.partitionBy())["level"])
    return per.select("source", "source_size", "n_docs", F.when(F.col("found").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("found") * F.col("weight"))).alias("target"))


def inclusion(sizes: DataFrame, per_source: DataFrame) -> DataFrame:
    """For each source: copies (whole), rest (words to sample), surely (sizes from here on have pi 1), factor (pi = factor * size)."""
    hist = sizes.groupBy("source", "size").agg(F.count("*").alias("n"))
    goal = per_source.select("source", "source_size", "target", F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).alias("copies"))
    goal = goal.withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    h = matched(hist, goal, ["source"]).select("source", "size", "n", "rest", "copies")
    by = Window.partitionBy("source").orderBy(F.col("size").desc())
    words, squares = (F.col("n") * F.col("size")).cast("double"), F.col("n") * F.col("size").cast("double") * F.col("size").cast("double")
    h = h.withColumns({"sure": F.coalesce(F.sum(words).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "left": F.sum(squares).over(by.rowsBetween(0, Window.unboundedFollowing))})
    h = h.withColumn("factor", F.when(F.col("left") > 0, F.greatest(F.lit(0.0), F.col("rest") - F.col("sure")) / F.col("left")).otherwise(0.0))
    # the first size, from the largest down, whose pi is at most 1 when all larger ones are certain
    fits = F.when(F.col("factor") * F.col("size") <= 1, F.struct((-F.col("size")).alias("k"), "factor", "size"))
    got = h.groupBy("source").agg(F.min(fits).alias("fit"))
    return matched(goal, got, ["source"], "left").select("source", "source_size", "target", "copies", "rest", F.col("fit.size").alias("surely"), F.coalesce("fit.factor", F.lit(0.0)).alias("factor"))


def _odds(seed: int) -> dict[str, Column]:
    """pi and q (random odds over inclusion odds) of rows with doc_id, size and their source's plan."""
    pi = F.when(F.col("rest") <= 0, 0.0).when(F.col("size") > F.col("surely"), 1.0).otherwise(F.least(F.lit(1.0), F.col("factor") * F.col("size")))
    u, odds = _u(F.col("doc_id"), seed), pi / (F.lit(1.0) - pi)
    return {"q": F.when(pi >= 1, 0.0).when(pi <= 0, F.lit(float("inf"))).otherwise(u / (1 - u) / odds)}


def _words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def draw(docs: DataFrame, weight: Column | None = None, most: int = 3, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The plan (inclusion()) and, for every row, doc_id, source, size, q, extra (1 if the sample takes it), both written."""
    light = written(docs.select("doc_id", "source", _words(F.col("text")).alias("size")), "mix-sizes")
    per = written(targets(light.select("source", "size"), weight, most), "mix-targets")
    plan = written(inclusion(light, per), "mix-plan")
    rows = matched(light, plan, ["source"]).withColumns(_odds(seed)).select("doc_id", "source", "size", "q", "rest")
    order = [F.col("source").asc_nulls_last(), F.col("q"), F.col("doc_id"), F.col("size")]
    line = ordered(written(rows, "mix-odds"), order, "mix-order")
    line = line.withColumn("key", F.struct("source"))
    line = before(line, {"earlier": F.col("size")}, ["key"])
    here = Window.partitionBy("_part", "key").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    sofar = F.col("earlier") + F.coalesce(F.sum("size").over(here), F.lit(0))
    extra = F.when((F.col("rest") > 0) & (sofar + F.col("size") / 2 <= F.col("rest")), 1).otherwise(0)
    return plan, written(line.select("doc_id", "source", "size", "q", extra.alias("extra")), "mix-drawn")


def mix(docs: DataFrame, weight: Column | None = None, most: int = 3, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (how often the document is taken), taken (words)."""
    plan, drawn = draw(docs, weight, most, seed)
    out = matched(drawn, plan, ["source"]).withColumn("times", (F.col("copies") + F.col("extra")).cast("bigint"))
    return out.select("doc_id", "source", "size", "source_size", "target", F.col("times").alias("copies"), (F.col("times") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weight: Column | None = None, most: int = 3, seed: int = SEED) -> DataFrame:
    """The rows of docs, each as often as the mix takes it (its columns unchanged, whatever their names).

    What the sample takes of a source is a prefix of its order, so a row needs the last place of that prefix only, one for
    each source: rows stay where they are and texts are not exchanged. Rows that tie with that place (equal doc_id and size)
    and are taken in part are ranked by a hash of their text, then of all columns.
    """
    plan, drawn = draw(docs, weight, most, seed)
    place = F.struct("q", "doc_id", "size")
    last = drawn.filter("extra = 1").groupBy("source").agg(F.max(place).alias("last"))
    tied = matched(drawn, last, ["source"]).filter(place == F.col("last")).groupBy("source").agg(F.sum("extra").alias("tied_in"), F.count("*").alias("tied"))
    plan = written(matched(matched(plan, last, ["source"], "left"), tied, ["source"], "left"), "mix-cuts")
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = {c: F.col(names[docs.columns.index(c)]) for c in ("doc_id", "source", "text")}
    rows = docs.toDF(*names).withColumns({"doc_id": own["doc_id"], "source": own["source"], "size": _words(own["text"])})
    rows = matched(rows, plan, ["source"]).withColumns(_odds(seed))
    extra = F.when(F.col("last").isNull() | (place > F.col("last")), 0).when((place < F.col("last")) | (F.col("tied_in") == F.col("tied")), 1)
    rows = rows.withColumn("extra", extra)
    part = rows.filter("extra is null")
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.xxhash64(own["text"]), F.xxhash64(*names)))
    part = part.withColumn("extra", F.when(rank <= F.col("tied_in"), 1).otherwise(0))
    both = rows.filter("extra is not null").unionByName(part).withColumn("times", F.col("copies") + F.col("extra")).filter("times > 0")
    out = both.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def op9(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
per0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
per1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM per0),
per2 AS (SELECT *, CAST((place - 1) % 3 + 1 AS DOUBLE) AS weight, CAST(sum(source_size) OVER () AS DOUBLE) AS total,
                CAST(source_size * 3 AS DOUBLE) AS cap FROM per1),
per3 AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
                sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
                row_number() OVER (ORDER BY cap / weight, place) AS nth FROM per2),
per4 AS (SELECT *, (total - capped) / open AS level FROM per3),
lvl AS (SELECT arg_min(level, nth) AS found FROM per4 WHERE level * weight <= cap),
per AS (SELECT source, source_size, CASE WHEN found IS NULL THEN cap ELSE least(cap, found * weight) END AS target FROM per4 LEFT JOIN lvl ON true),
goal AS (SELECT *, CAST(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS BIGINT) AS copies FROM per),
goal2 AS (SELECT *, target - copies * source_size AS rest FROM goal),
hist AS (SELECT source, size, count(*) AS n FROM d GROUP BY source, size),
h AS (SELECT g.source, size, rest,
        coalesce(sum(CAST(n * size AS DOUBLE)) OVER (PARTITION BY g.source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sure,
        sum(n * CAST(size AS DOUBLE) * CAST(size AS DOUBLE)) OVER (PARTITION BY g.source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lft
      FROM hist JOIN goal2 g ON hist.source IS NOT DISTINCT FROM g.source),
h2 AS (SELECT *, CASE WHEN lft > 0 THEN greatest(0.0, rest - sure) / lft ELSE 0 END AS factor FROM h),
fit AS (SELECT source, max(size) AS surely, arg_max(factor, size) AS factor FROM h2 WHERE factor * size <= 1 GROUP BY source),
r AS (SELECT d.doc_id, d.source, d.size, g.source_size, g.target, g.copies, g.rest,
        CASE WHEN rest <= 0 THEN 0.0 WHEN size > surely THEN 1.0 ELSE least(1.0, coalesce(factor, 0) * size) END AS pi,
        (CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|42'), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN goal2 g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN fit f ON d.source IS NOT DISTINCT FROM f.source),
r2 AS (SELECT *, CASE WHEN pi >= 1 THEN 0.0 WHEN pi <= 0 THEN 'inf'::DOUBLE ELSE u / (1 - u) / (pi / (1.0 - pi)) END AS q FROM r),
r3 AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sofar FROM r2),
r4 AS (SELECT *, copies + CASE WHEN rest > 0 AND sofar + CAST(size AS DOUBLE) / 2 <= rest THEN 1 ELSE 0 END AS times FROM r3)
SELECT doc_id, size, source_size, target, CAST(times * size AS BIGINT) AS taken, source, CAST(times AS BIGINT) AS copies FROM r4
"""
