"""A lattice laid over a boundary, and points and cells in regions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lattice import cell_name
from .overlay import covered_area
from .polygons import RINGS
from .ranking import cut, row_numbers
from .squares import points_in_regions


def boundary_grid(boundary: DataFrame, size: int, min_ratio: float = 0.0, core_ratio: float = 0.5, rings: str = "rings") -> DataFrame:
    """Cells of multiples of size that a boundary covers by more than ``min_ratio``: grid_id, row_id, col_id, x0, y0, x1, y1, cell_area_m2,
    fua_area_m2, fua_ratio and eligible_core (covered by ``core_ratio`` or more).

    boundary: one polygon per row (shell, then holes); where they overlap, they count once.  Rows and columns count from the boundary's
    lower left cell.
    """
    corners = boundary.select(F.explode(F.col(rings).cast(RINGS)[0]).alias("p"))
    box = corners.agg(F.min("p.x").alias("x0"), F.min("p.y").alias("y0")).first()
    if box["x0"] is None:
        raise ValueError("the boundary has no polygon")
    left, low = math.floor(box["x0"] / size), math.floor(box["y0"] / size)
    parts = covered_area(boundary, float(size), [], rings)
    area = parts.select((F.col("row_id") - low).alias("row_id"), (F.col("col_id") - left).alias("col_id"), F.col("area").alias("fua_area_m2"))
    ratio = F.col("fua_area_m2") / float(size * size)
    x, y = (F.col("col_id") + left) * float(size), (F.col("row_id") + low) * float(size)
    out = area.select(
        cell_name(F.col("row_id"), F.col("col_id"), size).alias("grid_id"), "row_id", "col_id", x.alias("x0"), y.alias("y0"), (x + size).alias("x1"), (y + size).alias("y1"),
        F.lit(float(size * size)).alias("cell_area_m2"), "fua_area_m2", ratio.alias("fua_ratio"), (ratio >= core_ratio).cast("int").alias("eligible_core"),
    )
    return out.filter(F.col("fua_ratio") > min_ratio)


def core_cells(cells: DataFrame) -> DataFrame:
    return cells.filter(F.col("eligible_core") == 1)


def region_areas(regions: DataFrame, region: str, rings: str = "rings") -> DataFrame:
    """region, area, perimeter, centroid (cx, cy) and bounds of polygons; holes count negative."""
    each = regions.select(F.col(region).alias("_region"), F.posexplode(F.col(rings).cast(RINGS)).alias("k", "r"))
    after = F.concat(F.slice("r", F.lit(2), F.size("r") - 1), F.slice("r", 1, 1))
    e = each.select("_region", "k", F.explode(F.arrays_zip(F.col("r").alias("a"), after.alias("b"))).alias("e"))
    cross = F.col("e.a.x") * F.col("e.b.y") - F.col("e.b.x") * F.col("e.a.y")
    ring = e.groupBy("_region", "k").agg(
        F.sum(cross).alias("s"), F.sum((F.col("e.a.x") + F.col("e.b.x")) * cross).alias("mx"), F.sum((F.col("e.a.y") + F.col("e.b.y")) * cross).alias("my"), F.sum(F.hypot(F.col("e.b.x") - F.col("e.a.x"), F.col("e.b.y") - F.col("e.a.y"))).alias("length"),
        F.min("e.a.x").alias("x0"), F.max("e.a.x").alias("x1"), F.min("e.a.y").alias("y0"), F.max("e.a.y").alias("y1"),
    )
    sign = F.when(F.col("k") == 0, 1.0).otherwise(-1.0) * F.signum("s")
    area = F.sum(sign * F.col("s")) / 2
    return ring.groupBy(F.col("_region").alias(region)).agg(
        area.alias("area"), F.sum("length").alias("perimeter"), (F.sum(sign * F.col("mx")) / (6 * area)).alias("cx"), (F.sum(sign * F.col("my")) / (6 * area)).alias("cy"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )


def point_on_surface(rings: Column) -> Column:
    """A point (x, y) inside a polygon, holes minded: the middle of the widest stretch inside on a scan line at half height, which is moved
    halfway between the corners next to it so that it passes none.  Null for a polygon without height.
    """
    own = rings.cast(RINGS)
    edges = F.flatten(F.transform(own, lambda r: F.zip_with(r, F.concat(F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))))
    ys = F.transform(F.flatten(own), lambda p: p["y"])
    half = (F.array_min(ys) + F.array_max(ys)) / 2
    y = (F.array_max(F.filter(ys, lambda v: v <= half)) + F.array_min(F.filter(ys, lambda v: v > half))) / 2
    crossed = F.filter(edges, lambda e: (e["a"]["y"] <= y) != (e["b"]["y"] <= y))
    xs = F.array_sort(F.transform(crossed, lambda e: e["a"]["x"] + (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"])))
    pairs = F.sequence(F.lit(0), F.floor(F.size(xs) / 2).cast("int") - 1)
    spans = F.when(F.size(xs) >= 2, F.transform(pairs, lambda k: F.struct((F.get(xs, 2 * k + 1) - F.get(xs, 2 * k)).alias("w"), (-k).alias("k"), ((F.get(xs, 2 * k) + F.get(xs, 2 * k + 1)) / 2).alias("x"))))
    return F.when(F.size(xs) >= 2, F.struct(F.array_max(spans)["x"].alias("x"), y.alias("y")))


def smallest_polygon(points: DataFrame, key: str, regions: DataFrame, region: str, size: float, rings: str = "rings") -> DataFrame:
    """The region of each point: of those that hold it inside, else of those whose outline it is on, the smallest, then the first by name; null if none."""
    held = points_in_regions(points, key, regions, region, size, rings).join(region_areas(regions, region, rings).select(region, "area"), region)
    best = held.groupBy(key).agg(F.min(F.struct((1 - F.col("within")).alias("o"), "area", region)).alias("m"))
    return points.select(key).join(best, key, "left").select(key, F.col(f"m.{region}").alias(region), (1 - F.col("m.o")).alias("within"))


def first_region(points: DataFrame, key: str, regions: DataFrame, region: str, order: str, size: float, rings: str = "rings") -> DataFrame:
    """The first region by ``order`` that holds each point inside; "unknown" if none does."""
    held = points_in_regions(points, key, regions, region, size, rings).filter("within = 1").join(regions.select(region, order), region)
    best = held.groupBy(key).agg(F.min_by(region, F.struct(order, region)).alias(region))
    return points.select(key).join(best, key, "left").select(key, F.coalesce(F.col(region).cast("string"), F.lit("unknown")).alias(region))


def first_per_place(points: DataFrame, columns: list[str], order: str) -> DataFrame:
    """One point per (x, y): the first by ``order``."""
    return points.groupBy("x", "y").agg(*[F.min_by(c, order).alias(c) for c in columns])


def reliable_regions(regions: DataFrame, stats: DataFrame, region: str, least: int = 5) -> DataFrame:
    """All regions with their n and accuracy from stats (n 0 where there is none) and reliable, n >= ``least``."""
    joined = regions.join(stats, region, "left")
    return joined.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("reliable", (F.col("n") >= least).cast("int"))


def separated(points: DataFrame, key: str, score: Column, n: int, distance: float) -> DataFrame:
    """Up to n points of the highest score, each at least ``distance`` from those taken before (the n is the operator's limit).

    Taken one by one: what stands near a taken point goes, and the best of the rest is next.  n small jobs; no list reaches the driver but the
    taken points.
    """
    left, taken = points.withColumn("_score", score).filter("_score IS NOT NULL"), []
    for _ in range(n):
        best = left.orderBy(F.col("_score").desc(), key).select(key, "x", "y", "_score").first()
        if best is None:
            break
        taken.append((best[key], float(best["x"]), float(best["y"]), float(best["_score"]), len(taken) + 1))
        left = left.filter(F.hypot(F.col("x") - float(best["x"]), F.col("y") - float(best["y"])) >= distance)
    kind = points.schema[key].dataType.simpleString()
    return points.sparkSession.createDataFrame(taken, f"{key} {kind}, x double, y double, score double, position long")


def rows_apart(own: DataFrame, distance: float) -> DataFrame:
    """key of the rows (key, stratum, x, y, o) that have no taken row of their stratum before them (by o) within the distance.

    Settled in rounds over the pairs of near rows: rows without an undecided earlier neighbour are taken, their later neighbours are left
    out, and so on; each round is a join on bins.
    """

    def bins(pad: int) -> Column:
        steps = F.sequence(F.lit(-pad), F.lit(pad))
        return F.explode(F.flatten(F.transform(steps, lambda i: F.transform(steps, lambda j: F.struct((F.floor(F.col("x") / distance) + i).cast("long").alias("c"), (F.floor(F.col("y") / distance) + j).cast("long").alias("r"))))))

    a = own.select("key", "stratum", "x", "y", "o", bins(1).alias("b"))
    b = own.select(F.col("key").alias("early"), "stratum", F.col("x").alias("ex"), F.col("y").alias("ey"), F.col("o").alias("eo"), bins(0).alias("b"))
    near = cut(a.join(b, ["stratum", "b"]).filter((F.col("eo") < F.col("o")) & (F.hypot(F.col("x") - F.col("ex"), F.col("y") - F.col("ey")) < distance)).select("key", "early"))
    open_, taken = own.select("key"), []
    while True:
        blocked = near.join(open_.withColumnRenamed("key", "early"), "early", "left_semi").select("key").distinct()
        free = cut(open_.join(blocked, "key", "left_anti"))
        if free.isEmpty():
            break
        taken.append(free)
        out = near.join(free.withColumnRenamed("key", "early"), "early", "left_semi").select("key").distinct()
        open_ = cut(open_.join(free, "key", "left_anti").join(out, "key", "left_anti"))
        near = cut(near.join(open_, "key", "left_semi").join(open_.withColumnRenamed("key", "early"), "early", "left_semi"))
    return reduce(DataFrame.unionByName, taken, own.select("key").limit(0))


def spaced_sample(points: DataFrame, stratum: str, key: str, target: int, distance: float) -> DataFrame:
    """Per stratum ``target`` rows in order of the MD5 of the key, each at least ``distance`` from those taken before; where too few are
    left, the first of the others fill up.

    Whether a row is taken depends on earlier rows only, so a stratum's first rows are settled alone, and eight times as many where
    these don't give ``target``: a large stratum costs a few rows, not its pairs.  Ranks come from range partitions.
    """
    own = points.select(F.col(key).alias("key"), F.col(stratum).alias("stratum"), "x", "y", F.struct(F.md5(F.col(key).cast("string")).alias("h"), F.col(key).alias("k")).alias("o"))
    own = cut(row_numbers(own, ["o"], ["stratum"], "number"))
    pending, size, found = own, 4 * target, []
    while not pending.isEmpty():
        first = cut(pending.filter(F.col("number") <= size))
        apart = cut(first.join(rows_apart(first, distance), "key", "left_semi"))
        counts = first.groupBy("stratum").agg(F.max("number_of").alias("rows")).alias("l").join(apart.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).alias("r"), F.expr("l.stratum <=> r.stratum"), "left").select("l.stratum", "rows", F.coalesce("n", F.lit(0)).alias("n"))
        done = cut(counts.filter((F.col("n") >= target) | (F.col("rows") <= size)).select(F.col("stratum").alias("_s")))
        of_done = F.col("stratum").eqNullSafe(F.col("_s"))
        found.append(apart.join(done, of_done, "left_semi"))
        pending, size = cut(pending.join(done, of_done, "left_anti")), 8 * size
    kept = reduce(DataFrame.unionByName, found, own.limit(0)).select("key", F.lit(1).alias("apart"))
    # Fewer than target rows stand apart where others fill up, so these are among the first 2 * target.
    marked = own.join(kept, "key", "left").withColumn("apart", F.coalesce("apart", F.lit(0))).filter(f"apart = 1 OR number <= {2 * target}")
    order = Window.partitionBy("stratum").orderBy(F.col("apart").desc(), "o")
    return marked.withColumn("position", F.row_number().over(order).cast("long")).filter(F.col("position") <= target).select(F.col("stratum").alias(stratum), F.col("key").alias(key), "position", "apart")
