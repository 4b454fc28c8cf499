"""Polygons dealt to squares are not broadcast: their table is small on disk and large once it is exploded."""

from latticework.operators import geometry


def test_polygons_are_not_broadcast(spark, tmp_path, monkeypatch):
    spark.range(900).selectExpr("0L AS row_id", "id % 3 AS col_id", "id % 3 * 250 + id % 7 * 20.0 AS x0", "id % 11 * 10.0 AS y0").selectExpr("*", "x0 + 30 AS x1", "y0 + 20 AS y1").write.parquet(str(tmp_path / "p"))
    plans = []
    cut = geometry.cut
    monkeypatch.setattr(geometry, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    out = geometry.open_space(spark.read.parquet(str(tmp_path / "p")), 250)
    assert sorted((r.col_id, r.open_patches, r.union_area + r.open_area) for r in out.collect()) == [(c, 1, 62500.0) for c in range(3)]
    dealt = [p for p in plans if "rings" in p]
    assert dealt
    for plan in dealt:
        lines = plan.split("\n")
        assert not [b for a, b in zip(lines, lines[1:]) if "BroadcastExchange" in a and "rings" in b]
