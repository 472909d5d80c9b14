"""The pipeline on a small table, and its stages on odd and empty ones."""

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_run(spark):
    out = corpus_pipeline.run(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 0 < out.doc_id.nunique() < docs.count()
    assert (out.groupby("sequence_id").length.sum() <= 2048).all()


def test_stages_keep_columns_and_bear_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (None, "", None, None, None), (2, "a password=abcdef123 b", "en", "s", 22), (2, "a password=abcdef123 b", "en", "s", 22)], "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, table, SF).columns == docs.columns
        assert corpus_pipeline.pack(spark, table, SF).count() == table.count()
    masked = corpus_pipeline.mask_secrets(spark, docs, SF).where("doc_id = 2").first()
    assert masked["text"] == "a [secret] b" and masked["n_chars"] == 12
    assert corpus_pipeline.drop_near_duplicates(spark, docs, SF).count() == 2
