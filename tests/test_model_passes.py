"""Models read what they are fitted on once, however many passes they make."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.operators import modeling


def test_rows_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def value(k):
        made.add(1)
        return float(k % 7)

    cells = spark.range(60).select((F.col("id") % 10).alias("col_id"), F.floor(F.col("id") / 10).alias("row_id"), F.udf(value, T.DoubleType())("id").alias("a"), F.when(F.col("id") % 7 < 3, "x").otherwise("y").alias("label"))
    rows = modeling.block_folds(cells, "label", 2)
    gains = {(r["fold"], r["feature"]): r["importance"] for r in modeling.gain_importances(rows.select("label", "fold", "a"), ["a"], "label", "fold", trees=1, depth=1).collect()}
    assert gains == {(0, "a"): 1.0, (1, "a"): 1.0}
    assert made.value == 60
