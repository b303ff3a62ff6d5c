import pytest

import corpus_pipeline

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXT_STAGES = ("toxicity", "near_dedup", "personal_data")


@pytest.mark.parametrize("name", TEXT_STAGES)
def test_whole_texts_go_to_workers_in_small_batches(spark, tmp_path, name):
    docs = spark.range(0, 3000, numPartitions=1).selectExpr(
        "id AS doc_id", "concat('word ', id, ' jane', id, '@example.com') AS text", "length('x') AS n_chars"
    )
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    before = spark.conf.get(BATCH)

    def sizes(batches):
        for batch in batches:
            yield batch.assign(n=len(batch))[["n"]]

    try:
        for given, most in ((10_000, corpus_pipeline.BATCH_ROWS), (0, corpus_pipeline.BATCH_ROWS), (7, 7)):
            spark.conf.set(BATCH, given)
            out = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
            assert out.columns == docs.columns
            largest = docs.mapInPandas(sizes, "n long").agg({"n": "max"}).first()[0]
            assert largest == most  # what a stage's lazy result is written with
        assert name == "toxicity" or out.count() == 3000
    finally:
        spark.conf.set(BATCH, before)
