"""The pipeline against a brute-force version on a small table."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from featurelab.llm import mix, quality, toxicity

from .test_copies import slow_kept


def test_stages(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "mixing", "packing"]
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = corpus_pipeline.run(spark, sf).toPandas()

    left = docs.toPandas()
    model = toxicity.fit(docs, labels)
    left = left[model.scores(left["text"].tolist()) < 0.5]
    model = quality.fit(spark.createDataFrame(left), labels)
    left = left[model.scores(left["text"].tolist()) >= 0.3]
    documents = left[left["doc_id"].isin({r[0] for r in slow_kept(list(zip(left["doc_id"], left["text"], strict=True)))})]
    taken = _mixed(documents)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text, want = dict(zip(documents["doc_id"], documents["text"], strict=True)), Counter()
    for i, copies in taken:
        ids = np.array([*tok.encode(text[i], add_special_tokens=False).ids, 1], "<u4")
        for s in range(0, len(ids), 2048):
            want[i, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())] += copies
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in got.itertuples()) == +want
    room = got.groupby("sequence_id")["length"].sum()
    assert room.max() <= 2048 and len(documents) < len(docs.toPandas())


def _mixed(documents: pd.DataFrame) -> list[tuple[int, int]]:
    con = duckdb.connect()
    con.register("documents", documents)
    out = con.execute(mix.OP9_SQL).df()
    return list(zip(out["doc_id"], out["copies"], strict=True))


def test_kept_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_odd_rows_and_empty_tables(spark, edge, sf):
    """Nulls in any column, empty and long texts, repeated rows and ids, extra columns named as operators name theirs."""
    for docs in (edge, edge.limit(0)):
        have = Counter(map(tuple, docs.collect()))
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == edge.columns
            rows_ = Counter(map(tuple, docs.collect()))
            assert set(rows_) <= set(have)
            if name != "mixing":
                assert not rows_ - have
            have = rows_
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
        assert Counter(r["doc_id"] for r in packed.filter("start = 0").collect()) == Counter(r["doc_id"] for r in docs.collect())
