"""Polygons on a lattice of squares: edges dealt to the squares they pass, winding numbers at the squares' corners, points in polygons.

No polygon travels whole: a square gets the parts of edges inside it, and what stands around it is one number, a running sum along its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lattice import segment_pieces
from .polygons import RINGS

#: Coordinates are rounded to multiples of this, so equal points are equal numbers in all squares.
GRAIN = 2.0**-20


def oriented_edges(polygons: DataFrame, keys: list[str], rings: str, grain: float, as_drawn: bool = False) -> DataFrame:
    """keys, edge (a name) and x0, y0, x1, y1 of all edges, shells counter-clockwise and holes clockwise (or as they are drawn), on the grain."""
    def snapped(p: Column) -> Column:
        return F.struct(*[(F.rint(p[c] / grain) * grain).alias(c) for c in "xy"])

    named = polygons.select(*keys, F.monotonically_increasing_id().alias("_p"), F.posexplode(F.col(rings).cast(RINGS)).alias("_k", "_r")).filter(F.size("_r") >= 3)
    own = named.withColumn("_r", F.transform("_r", snapped))
    after = F.concat(F.slice("_r", F.lit(2), F.size("_r") - 1), F.slice("_r", 1, 1))
    own = own.withColumn("_e", F.arrays_zip(F.col("_r").alias("a"), after.alias("b")))
    base = F.col("_r")[0]
    twice = F.aggregate("_e", F.lit(0.0), lambda s, e: s + (e["a"]["x"] - base["x"]) * (e["b"]["y"] - base["y"]) - (e["b"]["x"] - base["x"]) * (e["a"]["y"] - base["y"]))
    turned = F.lit(False) if as_drawn else (twice > 0) != (F.col("_k") == 0)
    each = own.withColumn("_t", turned).select(*keys, "_p", "_k", "_t", F.posexplode("_e").alias("_i", "_e"))
    a, b = (F.when(F.col("_t"), F.col(f"_e.{p}")).otherwise(F.col(f"_e.{q}")) for p, q in (("b", "a"), ("a", "b")))
    out = each.select(*keys, F.xxhash64("_p", "_k", "_i").alias("edge"), a.alias("_a"), b.alias("_b"))
    return out.select(*keys, "edge", F.col("_a.x").alias("x0"), F.col("_a.y").alias("y0"), F.col("_b.x").alias("x1"), F.col("_b.y").alias("y1")).filter("x0 != x1 OR y0 != y1")


def square_edges(edges: DataFrame, size: float, grain: float) -> DataFrame:
    """Edges cut at the lattice lines: row_id, col_id, up (drawn upwards, or level to the right), the lower or left end px0, py0 and the other
    px1, py1, on_line where the part runs along a lattice line, and the whole edge (x0, y0, x1, y1, lower end first).

    The lower end comes first in all arithmetic, so equal edges of two polygons are cut at equal points, whichever way they are drawn.
    """
    up = (F.col("y1") > F.col("y0")) | ((F.col("y1") == F.col("y0")) & (F.col("x1") > F.col("x0")))
    low = edges.withColumn("up", up)
    for c in "xy":
        a, b = F.col(f"{c}0"), F.col(f"{c}1")
        low = low.withColumn(f"_{c}", F.when(F.col("up"), a).otherwise(b)).withColumn(f"{c}1", F.when(F.col("up"), b).otherwise(a)).withColumn(f"{c}0", F.col(f"_{c}")).drop(f"_{c}")
    parts = segment_pieces(low, size)
    for c in ("px0", "py0", "px1", "py1"):
        parts = parts.withColumn(c, F.rint(F.col(c) / grain) * grain)
    upright = (F.col("px0") == F.col("px1")) & (F.col("px0") == F.col("col_id") * size)
    level = (F.col("py0") == F.col("py1")) & (F.col("py0") == F.col("row_id") * size)
    return parts.withColumn("on_line", upright | level).filter("px0 != px1 OR py0 != py1").drop("length")


def corner_windings(parts: DataFrame, keys: list[str], size: float) -> DataFrame:
    """keys, row_id, col_id and wind: the winding number just inside a square's lower left corner, where it isn't 0.

    A part that starts at the bottom line of its row is passed by a walk along that line; what is passed is added up per square first, so
    the running sum is over at most one row per square of a lattice row.
    """
    passed = parts.filter((F.col("py0") == F.col("row_id") * size) & (F.col("py1") > F.col("py0")))
    at = F.when(F.col("on_line"), F.col("col_id") - 1).otherwise(F.col("col_id"))
    sums = passed.groupBy(*keys, "row_id", at.alias("_c")).agg(F.sum(F.when(F.col("up"), -1).otherwise(1)).alias("_n")).filter("_n != 0")
    along = Window.partitionBy(*keys, "row_id").orderBy("_c")
    runs = sums.withColumn("wind", F.sum("_n").over(along)).withColumn("_to", F.lead("_c").over(along)).filter("wind != 0 AND _to IS NOT NULL")
    return runs.select(*keys, "row_id", F.explode(F.sequence(F.col("_c") + 1, F.col("_to"))).alias("col_id"), "wind")


def point_meetings(points: DataFrame, parts: DataFrame, size: float) -> DataFrame:
    """Each point (_key, px, py, row_id, col_id) with the parts of its own square: _key, _region, on (it is on the edge) and n, what the
    part adds to the winding number on the way from the square's corner up its left side and then right to the point."""
    met = points.join(parts, ["row_id", "col_id"])
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    turn = dx * (F.col("py") - F.col("y0")) - dy * (F.col("px") - F.col("x0"))
    on = (turn == 0) & F.col("px").between(F.least("x0", "x1"), F.greatest("x0", "x1")) & F.col("py").between(F.col("y0"), F.col("y1"))
    west, south = F.col("col_id") * size, F.col("row_id") * size
    sign = F.when(F.col("up"), 1).otherwise(-1)

    def passed(x: str, y: str) -> Column:
        return ((F.col(x) == west) & (F.col(y) > south) & (F.col(y) <= F.col("py"))).cast("int")

    crossed = ((F.col("py0") <= F.col("py")) & (F.col("py1") > F.col("py")) & (turn < 0)).cast("int")
    n = F.when(F.col("on_line"), 0).otherwise(sign * (passed("px0", "py0") - passed("px1", "py1") - crossed))
    return met.select("_key", "_region", on.cast("int").alias("on"), n.alias("n"))


def points_in_regions(points: DataFrame, key: str, regions: DataFrame, region: str, size: float, rings: str = "rings") -> DataFrame:
    """Pairs of points (x, y) and polygons that hold them: key, region, within (1 inside, 0 on the outline).

    A point is inside if the winding number around it is odd.  That is the number at the corner of its square, and what the square's own
    edges change on the way to the point; edges of other squares take no part, however wide the region is.
    """
    edges = oriented_edges(regions.select(F.col(region).alias("_region"), F.col(rings).alias("_rings")), ["_region"], "_rings", GRAIN, as_drawn=True)
    parts = square_edges(edges, size, GRAIN)
    corners = corner_windings(parts, ["_region"], size)
    # A part that ends on the right or upper line of its square is met by points of the next square that stand on that end.
    ends = F.explode(F.array(F.struct(F.col("px0").alias("x"), F.col("py0").alias("y")), F.struct(F.col("px1").alias("x"), F.col("py1").alias("y"))))
    tips = parts.select("_region", "row_id", "col_id", ends.alias("e")).select("_region", F.floor(F.col("e.y") / size).cast("long").alias("r"), F.floor(F.col("e.x") / size).cast("long").alias("c"), "e", "row_id", "col_id").filter("r != row_id OR c != col_id")
    tips = tips.select("_region", F.col("r").alias("row_id"), F.col("c").alias("col_id"), F.lit(True).alias("up"), F.lit(True).alias("on_line"), *[F.col(f"e.{v[0]}").alias(w) for v, w in (("x", "px0"), ("y", "py0"), ("x", "px1"), ("y", "py1"), ("x", "x0"), ("y", "y0"), ("x", "x1"), ("y", "y1"))]).distinct()
    own = points.select(F.col(key).alias("_key"), F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py")).withColumn("row_id", F.floor(F.col("py") / size).cast("long")).withColumn("col_id", F.floor(F.col("px") / size).cast("long"))
    met = point_meetings(own, parts.select(*tips.columns).unionByName(tips), size)
    around = own.join(corners, ["row_id", "col_id"]).select("_key", "_region", F.lit(0).alias("on"), F.col("wind").alias("n"))
    sums = met.unionByName(around).groupBy("_key", "_region").agg(F.max("on").alias("on"), F.sum("n").alias("n"))
    held = sums.filter((F.col("on") == 1) | (F.col("n") % 2 != 0))
    return held.select(F.col("_key").alias(key), F.col("_region").alias(region), (1 - F.col("on")).alias("within"))
