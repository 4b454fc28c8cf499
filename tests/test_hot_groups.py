"""Statistics of few groups meet their rows without a shuffle by group."""

from pyspark.sql import functions as F

from latticework.operators import selection


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_stay_where_they_are(spark):
    df = spark.range(2_000).select("id", (F.col("id") % 2).alias("g"), (F.col("id") % 37).cast("double").alias("a"))
    for out in (selection.centre_scores(df, "g", ["a"], "id"), selection.quartile_gate(df, "a", "g")):
        join = plan(out).split("Join Inner", 1)[1].splitlines()[0]
        assert "strategy=broadcast" in join
    best = {r.g: (r.id, r.score) for r in selection.medoids(df, "g", ["a"], "id").collect()}
    assert set(best) == {0, 1} and all(score == 0.0 for _, score in best.values())
