"""Rings out of directed lines: next-edge pointers at shared points, pointer doubling along them, holes put into shells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import cut, written

#: Doublings, at most: no ring has more lines than 2^60.
ROUNDS = 60


def bearing(a: Column, b: Column) -> Column:
    return F.atan2(b["y"] - a["y"], b["x"] - a["x"])


def next_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """id and next of directed lines: id and points (x, y) s, the start, s1, the point after it, e, the end, and e1, the point before it.

    Next is the first line clockwise from the way back, so the area on the left is followed around.  Bearings are ordered per point; of
    equal bearings a line's way back comes before the line itself.
    """
    at = [*keys, "p"]
    nothing = F.lit(None).cast("long")
    starts = lines.select(*keys, F.col("s").alias("p"), bearing(F.col("s"), F.col("s1")).alias("bearing"), F.col("s1").alias("far"), F.col("id").alias("leaves"), nothing.alias("comes"))
    ends = lines.select(*keys, F.col("e").alias("p"), bearing(F.col("e"), F.col("e1")).alias("bearing"), F.col("e1").alias("far"), nothing.alias("leaves"), F.col("id").alias("comes"))
    around = Window.partitionBy(*at).orderBy("bearing", "far", F.col("leaves").isNotNull(), "leaves")
    before = F.last("leaves", ignorenulls=True).over(around.rowsBetween(Window.unboundedPreceding, -1))
    highest = F.last("leaves", ignorenulls=True).over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    both = starts.unionByName(ends).withColumn("next", F.coalesce(before, highest))
    return both.filter("comes IS NOT NULL").select(F.col("comes").alias("id"), "next")


def ring_order(links: DataFrame) -> DataFrame:
    """id, ring (the smallest id of its cycle) and place (from 0 at that id) of id and next, every id being next of one other.

    Each round doubles how far pointers reach: first for the smallest id seen, until none changes, then from the place before it.
    """
    links = written(links)
    n, ends = links.agg(F.count(F.lit(1)), F.count_distinct("next")).first()
    if n != ends:
        raise ValueError(f"lines don't form rings: {n} lines lead to {ends} others")
    state = written(links.select("id", F.col("next").alias("to"), F.least("id", "next").alias("ring")))
    for _ in range(ROUNDS):
        ahead = state.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("ring").alias("_ring"))
        moved = written(state.join(ahead, "to").select("id", F.col("_to").alias("to"), F.least("ring", "_ring").alias("ring"), (F.col("_ring") < F.col("ring")).alias("_new")))
        settled = moved.filter("_new").isEmpty()
        state = moved.drop("_new")
        if settled:
            break
    named = links.join(state.select("id", "ring"), "id")
    left = written(named.select("id", "ring", F.when(F.col("next") != F.col("ring"), F.col("next")).alias("to"), F.lit(1).cast("long").alias("n")))
    for _ in range(ROUNDS):
        if left.filter("to IS NOT NULL").isEmpty():
            break
        ahead = left.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("n").alias("_n"))
        left = written(left.join(ahead, "to", "left").select("id", "ring", F.col("_to").alias("to"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n")))
    size = F.max("n").over(Window.partitionBy("ring"))
    return left.select("id", "ring", (size - F.col("n")).alias("place"))


def signed_area(points: Column) -> Column:
    """Area of a ring of points with x and y (open), positive if it is drawn counter-clockwise."""
    base = points[0]
    after = F.concat(F.slice(points, F.lit(2), F.size(points) - 1), F.slice(points, 1, 1))
    pairs = F.arrays_zip(points.alias("a"), after.alias("b"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, e: s + (e["a"]["x"] - base["x"]) * (e["b"]["y"] - base["y"]) - (e["b"]["x"] - base["x"]) * (e["a"]["y"] - base["y"])) / 2


def without_waypoints(points: Column) -> Column:
    """Points of a ring where one edge ends and another begins."""
    before = F.concat(F.slice(points, -1, 1), F.slice(points, F.lit(1), F.size(points) - 1))
    pairs = F.arrays_zip(points.alias("p"), before.alias("q"))
    return F.transform(F.filter(pairs, lambda e: e["p"]["edge"] != e["q"]["edge"]), lambda e: F.struct(e["p"]["x"].alias("x"), e["p"]["y"].alias("y")))


def traced(paths: DataFrame, keys: list[str]) -> DataFrame:
    """Closed lists of points (keys, points, the first one not repeated) that paths (keys, points) form end to start."""
    p = F.col("points")
    named = cut(paths.withColumn("id", F.monotonically_increasing_id()))
    place = lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))
    lines = named.select(*keys, "id", place(p[0]).alias("s"), place(p[1]).alias("s1"), place(F.element_at(p, -1)).alias("e"), place(F.element_at(p, -2)).alias("e1"))
    order = ring_order(next_lines(lines, keys))
    joined = named.join(order, "id").groupBy(*keys, "ring").agg(F.sort_array(F.collect_list(F.struct("place", F.slice(p, F.lit(1), F.size(p) - 1).alias("points")))).alias("s"))
    return joined.select(*keys, F.flatten(F.transform("s", lambda s: s["points"])).alias("points"))


def rings_of(paths: DataFrame, closed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ring, points and signed area of the rings that paths form, and of those already closed (their first point repeated at the end)."""
    own = closed.select(*keys, F.slice("points", F.lit(1), F.size("points") - 1).alias("points"))
    both = traced(paths, keys).unionByName(own).select(*keys, without_waypoints(F.col("points")).alias("points")).filter(F.size("points") >= 3)
    return cut(both.withColumn("area", signed_area(F.col("points"))).filter("area != 0").withColumn("ring", F.monotonically_increasing_id()))
