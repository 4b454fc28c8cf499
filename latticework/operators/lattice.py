"""The regular lattice: cells, points in cells, and exact overlays of rectangles and segments.

Features find their cells by arithmetic on their bounds (floor of the coordinate over the cell size), so every overlay is a row
generator and a projection without any join; a range condition between features and cells would be a cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def cell_name(row: Column, col: Column, size: int, prefix: str = "g") -> Column:
    return F.format_string(f"{prefix}{size}_%05d_%05d", row, col)


def grid_cells(spark: SparkSession, rows: int, cols: int, size: int = 250, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """grid_id, row_id, col_id, x0, y0, x1, y1, cell_area_m2 of every cell."""
    at = spark.range(rows * cols).select(F.floor(F.col("id") / cols).alias("row_id"), (F.col("id") % cols).alias("col_id"))
    x, y = F.lit(x0) + F.col("col_id") * float(size), F.lit(y0) + F.col("row_id") * float(size)
    return at.select(cell_name(F.col("row_id"), F.col("col_id"), size).alias("grid_id"), "row_id", "col_id", x.alias("x0"), y.alias("y0"), (x + size).alias("x1"), (y + size).alias("y1"), F.lit(float(size * size)).alias("cell_area_m2"))


def point_cell(df: DataFrame, x: str, y: str, size: int, rows: int, cols: int) -> DataFrame:
    """Adds row_id and col_id (half-open cells); points off the lattice leave."""
    out = df.withColumn("row_id", F.floor(F.col(y) / size).cast("long")).withColumn("col_id", F.floor(F.col(x) / size).cast("long"))
    return out.filter(F.col("row_id").between(0, rows - 1) & F.col("col_id").between(0, cols - 1))


def _cells_of(df: DataFrame, low_x: Column, low_y: Column, high_x: Column, high_y: Column, size: int, rows: int, cols: int) -> DataFrame:
    def span(low: Column, high: Column, n: int) -> Column:
        first, last = F.greatest(F.floor(low / size), F.lit(0)).cast("long"), F.least(F.floor(high / size), F.lit(n - 1)).cast("long")
        return F.when(first <= last, F.sequence(first, last))

    out = df.withColumn("row_id", F.explode(span(low_y, high_y, rows)))
    return out.withColumn("col_id", F.explode(span(low_x, high_x, cols)))


def rectangle_overlay(df: DataFrame, size: int, rows: int, cols: int) -> DataFrame:
    """A row per rectangle (x0, y0, x1, y1) and cell that share an area, with that area and the cell's share of the outline."""
    out = _cells_of(df, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), size, rows, cols)
    width = F.least("x1", (F.col("col_id") + 1) * float(size)) - F.greatest("x0", F.col("col_id") * float(size))
    height = F.least("y1", (F.col("row_id") + 1) * float(size)) - F.greatest("y0", F.col("row_id") * float(size))
    return out.withColumn("piece_w", width).withColumn("piece_h", height).filter("piece_w > 0 AND piece_h > 0").withColumn("area", F.col("piece_w") * F.col("piece_h"))


def segment_overlay(df: DataFrame, size: int, rows: int, cols: int) -> DataFrame:
    """A row per segment (x0, y0, x1, y1) and cell that share a length, with that length (Liang-Barsky, in closed form)."""
    low, high = F.least, F.greatest
    out = _cells_of(df, low("x0", "x1"), low("y0", "y1"), high("x0", "x1"), high("y0", "y1"), size, rows, cols)
    out = out.withColumn("dx", F.col("x1") - F.col("x0")).withColumn("dy", F.col("y1") - F.col("y0"))

    def window(start: str, delta: str, cell: str) -> tuple[Column, Column]:
        a, b = F.col(cell) * float(size), (F.col(cell) + 1) * float(size)
        p, q = (a - F.col(start)) / F.col(delta), (b - F.col(start)) / F.col(delta)
        still = F.col(delta) == 0
        inside = (F.col(start) >= a) & (F.col(start) < b)
        return F.when(still, F.when(inside, 0.0).otherwise(2.0)).otherwise(low(p, q)), F.when(still, F.when(inside, 1.0).otherwise(-1.0)).otherwise(high(p, q))

    (ax, bx), (ay, by) = window("x0", "dx", "col_id"), window("y0", "dy", "row_id")
    share = low(F.lit(1.0), bx, by) - high(F.lit(0.0), ax, ay)
    return out.withColumn("length", F.hypot("dx", "dy") * share).filter("length > 1e-9")


def segment_pieces(df: DataFrame, size: int) -> DataFrame:
    """Segments (x0, y0, x1, y1) cut at the lines of an unbounded lattice: row_id, col_id, length and the piece's ends px0, py0, px1, py1."""
    def cells(a: str, b: str) -> Column:
        return F.explode(F.sequence(F.floor(F.least(a, b) / size).cast("long"), F.floor(F.greatest(a, b) / size).cast("long")))

    out = df.withColumn("row_id", cells("y0", "y1")).withColumn("col_id", cells("x0", "x1")).withColumn("dx", F.col("x1") - F.col("x0")).withColumn("dy", F.col("y1") - F.col("y0"))

    def window(start: str, delta: str, cell: str) -> tuple[Column, Column]:
        p, q = (F.try_divide((F.col(cell) + k) * float(size) - F.col(start), F.col(delta)) for k in (0, 1))
        inside = F.floor(F.col(start) / size) == F.col(cell)
        return F.when(F.col(delta) == 0, F.when(inside, 0.0).otherwise(2.0)).otherwise(F.least(p, q)), F.when(F.col(delta) == 0, F.when(inside, 1.0).otherwise(-1.0)).otherwise(F.greatest(p, q))

    (ax, bx), (ay, by) = window("x0", "dx", "col_id"), window("y0", "dy", "row_id")
    out = out.withColumn("_a", F.greatest(F.lit(0.0), ax, ay)).withColumn("_b", F.least(F.lit(1.0), bx, by)).withColumn("length", F.hypot("dx", "dy") * (F.col("_b") - F.col("_a"))).filter("length > 1e-9")
    ends = [(F.col(f"{c}0") + F.col(t) * F.col(f"d{c}")).alias(f"p{c}{k}") for k, t in ((0, "_a"), (1, "_b")) for c in "xy"]
    return out.select("*", *ends).drop("_a", "_b", "dx", "dy")


def point_segment_distance(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    dx, dy = x1 - x0, y1 - y0
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.least(F.greatest(((px - x0) * dx + (py - y0) * dy) / square, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    return F.hypot(px - x0 - t * dx, py - y0 - t * dy)


def square_segment_distance(low_x: Column, low_y: Column, size: float, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance of a square and a segment: 0 if they meet, else the least of its corners to the segment and of the ends to the square."""
    corners = [point_segment_distance(low_x + i * size, low_y + j * size, x0, y0, x1, y1) for i in (0, 1) for j in (0, 1)]
    ends = [F.hypot(F.greatest(low_x - x, F.lit(0.0), x - low_x - size), F.greatest(low_y - y, F.lit(0.0), y - low_y - size)) for x, y in ((x0, y0), (x1, y1))]

    def window(start: Column, end: Column, low: Column) -> tuple[Column, Column]:
        delta = end - start
        p, q = F.try_divide(low - start, delta), F.try_divide(low + size - start, delta)
        still = start.between(low, low + size)
        return F.when(delta == 0, F.when(still, 0.0).otherwise(2.0)).otherwise(F.least(p, q)), F.when(delta == 0, F.when(still, 1.0).otherwise(-1.0)).otherwise(F.greatest(p, q))

    (ax, bx), (ay, by) = window(x0, x1, low_x), window(y0, y1, low_y)
    meets = F.greatest(F.lit(0.0), ax, ay) <= F.least(F.lit(1.0), bx, by)
    return F.when(meets, F.lit(0.0)).otherwise(F.least(*corners, *ends))


def near_pairs(left: DataFrame, right: DataFrame, reach: float, left_keys: list[str], right_keys: list[str]) -> DataFrame:
    """Pairs of points (x, y) within ``reach`` of each other, with their distance: an equi-join on bins of that width.

    The left side is held in its bin's nine neighbours; the right side's columns are prefixed with r_.
    """
    steps = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    a = left.select(*left_keys, F.col("x").alias("l_x"), F.col("y").alias("l_y")).withColumn("sx", F.explode(steps)).withColumn("sy", F.explode(steps))
    a = a.withColumn("bx", (F.floor(F.col("l_x") / reach) + F.col("sx")).cast("long")).withColumn("by", (F.floor(F.col("l_y") / reach) + F.col("sy")).cast("long")).drop("sx", "sy")
    b = right.select(*[F.col(k).alias(f"r_{k}") for k in right_keys], F.col("x").alias("r_x"), F.col("y").alias("r_y"))
    b = b.withColumn("bx", F.floor(F.col("r_x") / reach).cast("long")).withColumn("by", F.floor(F.col("r_y") / reach).cast("long"))
    pairs = a.join(b, ["bx", "by"]).drop("bx", "by").withColumn("distance", F.hypot(F.col("l_x") - F.col("r_x"), F.col("l_y") - F.col("r_y")))
    return pairs.filter(F.col("distance") <= reach)
