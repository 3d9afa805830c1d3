"""Filter interaction audit: what each filter removes at each step of every order of the filters, within parts of a table.

A document's failures are bits of a mask. Documents are counted by part and mask (cells), cells are unpivoted against the steps of
all orders, and a running bit-or over the steps before says which filters have met the cell. Everything else is a conditional sum
over cells or a total over a window of one filter.

Null text is empty: no words (A fails), no characters. Null lang and the empty string are one part. Copies are told apart by
SHA-256 of the text; rows with equal doc_id don't make each other copies, and a null doc_id is neither smaller than another nor
larger, so such rows never fail E. A document with several labels is good or toxic if any of them says so; rows without doc_id have
none. A text is split in one task, whatever its length. Rows that repeat count as often as they occur. An empty table gives an
empty result. Only doc_id, text and lang are read, so other columns may have any name. DataFrame operations only.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import GAP, table, with_hot_keys, written

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
SYMBOLS = "[#$%&*|]"


def own_failures(text: Column) -> Column:
    """The mask (int) of filters A to D, that a text fails by itself; A is the lowest bit."""
    words = F.array_remove(F.split(text, GAP), "")
    few = F.size(words) < LEAST_WORDS
    repeated = F.size(F.array_distinct(words)) * 100 < F.size(words) * LEAST_DISTINCT
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("bigint") * 100 > F.char_length(text) * F.lit(MOST_CAPITALS).cast("bigint")
    fails = [few, repeated, capitals, text.rlike(SYMBOLS)]
    bits = [F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(fails)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask (all failures) of every row. Texts stay where they are: digests are exchanged."""
    text = F.coalesce("text", F.lit(""))
    seen = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), own_failures(text).alias("own"), F.unhex(F.sha2(text, 256)).alias("digest"))
    seen = written(seen, "audit-own")
    first = written(seen.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "audit-first")
    both = with_hot_keys(seen, first, ["digest"], "n")
    copy = F.when(F.col("doc_id") > F.col("first"), F.lit(1 << FILTERS.index("E"))).otherwise(F.lit(0))
    return both.select("doc_id", "part", (F.col("own") + copy).alias("mask"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of each part that fail exactly the filters of a mask, at most 32 rows a part."""
    said = {c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c) for c in ("quality", "toxic")}
    known = labels.filter("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id").agg(*said.values())
    each = masks(docs).join(written(known, "audit-labels"), "doc_id", "left")
    return each.groupBy("part", "mask").agg(F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(k) for c, k in (("quality", "good"), ("toxic", "toxic"))])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    orders = F.array(*[F.lit("".join(o)) for o in permutations(FILTERS)])
    long = written(cells(docs, labels), "audit-cells").withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    long = long.withColumn("filter", F.substring(F.col("filter_order"), F.col("step"), F.lit(1)))
    long = long.withColumn("bit", F.element_at(F.create_map(*[F.lit(x) for k, f in enumerate(FILTERS) for x in (f, 1 << k)]), F.col("filter")))
    met = F.bit_or("bit").over(Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1))
    long = long.withColumn("earlier", F.coalesce(met, F.lit(0)).bitwiseAND(F.col("mask")))
    here = F.col("mask").bitwiseAND(F.col("bit")) > 0
    gone = here & (F.col("earlier") == 0)

    def total(when: Column, what: str = "n") -> Column:
        return F.sum(F.when(when, F.col(what)).otherwise(F.lit(0).cast("bigint")))

    steps = long.groupBy("part", "filter_order", "step", "filter").agg(
        total((F.col("earlier") == 0) & ~here).alias("kept"), total(gone).alias("removed"), total(here & (F.col("earlier") != 0)).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"), total(gone, "good").alias("good_lost"), total(gone, "toxic").alias("toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), said AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), docs AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM texts LEFT JOIN said USING (doc_id)
), cells AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM docs GROUP BY part, mask
), f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, k::INT AS step, 1 << (ascii(filter_order[k]) - 65) AS bit,
    coalesce(list_sum([1 << (ascii(x) - 65) FOR x IN string_split(filter_order[1:k - 1], '') IF x <> '']), 0)::INT AS met
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS k)
), long AS (
  SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (met | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & bit > 0 AND mask & met = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & bit > 0 AND mask & met > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & bit > 0 AND mask & met = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & bit > 0 AND mask & met = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM long
"""
