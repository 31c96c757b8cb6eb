"""What the review of round 3 found in the operators."""

from corpusloom.llm import resampling


def test_postings_are_read_few_at_once(spark, monkeypatch):
    """A row of postings has some 150 KB, so what a task holds must not grow with the rows that a split happens to have."""
    seen, plain = {}, resampling.written

    def noting(df, label="step", *args):
        seen[label] = [int(spark.conf.get(c)) for c in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")]
        return plain(df, label, *args)

    monkeypatch.setattr(resampling, "written", noting)
    before = [spark.conf.get(c) for c in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")]
    docs = spark.createDataFrame([(k, f"word{k % 7} and more") for k in range(50)], "doc_id long, text string")
    got = resampling.weighed(docs, docs.where("doc_id % 7 = 3"))
    assert got.count() == 50 and got.where("n_features = 5").count() == 50
    assert all(n <= 64 for label in ("totals", "weights") for n in seen[label]), seen
    assert [spark.conf.get(c) for c in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")] == before
