"""Rows are numbered range by range: no task sorts more than a few ranges, whatever the number of rows."""

from pyspark.sql import functions as F

from latticework.operators import ranking


def test_numbering_sorts_bounded_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranking, "RANGE_ROWS", 500, raising=False)
    rows = spark.range(0, 20_000, 1, 3).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 101).alias("x"), F.col("id").alias("o"))
    seen = []
    real = ranking.cut
    monkeypatch.setattr(ranking, "cut", lambda df: seen.append(real(df)) or seen[-1])
    out = ranking.row_numbers(rows.withColumn("g", F.when(F.col("g") > 0, F.col("g"))), ["x", F.col("o").desc()], ["g"], "n")
    ranges = [r["count"] for r in seen[0].groupBy(F.spark_partition_id()).count().collect()]
    assert len(ranges) > 30 and max(ranges) < 2_000
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    found = sorted(out.collect(), key=lambda r: (r.g or 0, r.x, -r.o))
    for g in (None, 1, 2):
        own = [r for r in found if r.g == g]
        assert [r.n for r in own] == list(range(1, len(own) + 1)) and {r.n_of for r in own} == {len(own)}
    assert ranking.row_numbers(rows.limit(0), ["x"], ["g"], "n").count() == 0
