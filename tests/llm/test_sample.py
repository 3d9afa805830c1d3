from featurelab.llm import quality


def test_quality_trains_on_1500_documents_a_class(spark, monkeypatch):
    docs, labels = spark.range(4200).selectExpr("id as doc_id", "concat('text ', id) as text"), spark.range(4200).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    monkeypatch.setattr(quality, "train", lambda texts, y: (y.count(0), y.count(1)))
    assert quality.fit(docs, labels) == (1500, 1500)
