"""Labelled rows for training: a bounded sample, never from the held-out fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch_of, small, tidy, trimmed

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the doc_id's text leaves no remainder by FOLDS; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[list[str], list[int]]:
    """Texts and labels of at most per_class documents of either class, taken in the order of a hash of doc_id.

    A doc_id with several labels takes the largest; one with several texts takes the least (null is empty). Null labels and
    labels without a document don't count. Both lists are empty if there is nothing to learn from.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    place = F.xxhash64(F.col("doc_id").cast("string"))
    rows: dict = {}
    for y in (0, 1):
        chosen = known.filter(F.col("y") == y).orderBy(place, "doc_id").limit(per_class)
        first = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
        rows |= {(doc_id, y): text for doc_id, text in first.collect()}
    keys = sorted(rows)
    return [rows[k] for k in keys], [y for _, y in keys]


def released(train, texts: list[str], labels: list[int]):
    """train(texts, labels), after which the driver's Python gives the memory of training back to the system."""
    model = train(texts, labels)
    del texts, labels
    trimmed()
    return model


def score_table(docs: DataFrame, scorer, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted, by scorer(texts) -> scores, made once in each Python process from what is sent."""
    schema = "doc_id bigint, score double"
    sent = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        model = sent.value
        for b in small(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            yield batch_of(schema, {"doc_id": b.column(0), "score": model.scores(texts)})

    got = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(tidy(run), schema)
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept(docs: DataFrame, scorer, threshold: float, keep: int) -> DataFrame:
    """The rows of docs whose prediction is `keep`, columns and order of columns unchanged. Filtered where the rows are."""
    schema = T.StructType(docs.schema.fields)
    at = docs.columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        import pyarrow as pa

        model = sent.value
        for b in small(batches):
            score = model.scores([t or "" for t in b.column(at).to_pylist()])
            yield b.filter(pa.array((score >= threshold) == bool(keep)))

    return docs.mapInArrow(tidy(run), schema)
