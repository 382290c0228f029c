"""No labelled document is left out of the models."""

from corvane.llm import subjects


def test_all_labelled_documents_take_part(spark, monkeypatch):
    """One more than the 20,000 that were once chosen by a hash."""
    docs = spark.range(20_001).selectExpr("id AS doc_id", "'A goal was late.' AS text")
    labels = spark.range(20_001).selectExpr("id AS doc_id", "'sport' AS area")
    seen = []
    train = subjects.train
    monkeypatch.setattr(subjects, "train", lambda known, areas: (seen.append(known.count()), train(known, areas))[1])
    subjects.subject_areas(docs, labels, spark.sql("SELECT 'sport' AS area"))
    assert seen == [20_001]
