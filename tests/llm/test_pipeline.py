"""The pipeline's stages take effect, keep the columns of documents and run on what the one before kept."""

from latticework.llm.common import table


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = table(spark, d, "documents")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.dtypes == docs.dtypes, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert 0 < docs.count() <= before
        before = docs.count()
    assert docs.filter("text LIKE '%[EMAIL]%'").count() > 0
    mix = corpus_pipeline.run(spark, d)
    assert mix.count() == before


def test_queries_run_on_the_smallest_tables(spark):
    from latticework.llm.queries import ORACLES, QUERIES

    from .. import oracle

    d = "/root/testdata/sf0.001"
    con = oracle.views(d)
    for name, f in QUERIES.items():
        df = f(spark, d)
        assert df.count() == 200, name
        if name in ORACLES:
            assert oracle.differences(df, ORACLES[name], con) == []
