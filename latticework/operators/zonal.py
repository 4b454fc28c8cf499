"""Zonal statistics of pixels by cell (columns cell keys, value or label, and the pixel's place in raster order)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import join_group, wide_quantiles


def valid(value: Column, low: float | None = None, below: float | None = None, nodata: float | None = None) -> Column:
    """Finite, in range and not the nodata value."""
    out = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    if low is not None:
        out = out & (value >= low)
    if below is not None:
        out = out & (value < below)
    if nodata is not None:
        out = out & (value != nodata)
    return out


def continuous(pixels: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Count, mean, population deviation, minimum, maximum and range per cell."""
    v = F.col(value)
    out = pixels.filter(valid(v)).groupBy(*keys).agg(F.count(v).alias("valid_px"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    return out.withColumn("range", F.col("max") - F.col("min"))


def height_cover(pixels: DataFrame, keys: list[str], value: str = "value", pixel_area: float = 1.0, cell_area: float = 62_500.0, steps: tuple[int, ...] = (2, 5, 10)) -> DataFrame:
    """Heights in [0, 255): moments, exact 95th percentile, cover shares above each step, and area and volume above the first.

    The percentile is read off running sums over range partitions, so no task holds a cell's values.
    """
    v = F.col(value)
    shares = [(F.sum((v >= s).cast("int")) / F.count(v)).alias(f"cover_gt{s}m_share") for s in steps]
    above = v >= steps[0]
    own = pixels.filter(valid(v, 0, 255))
    out = own.groupBy(*keys).agg(
        F.count(v).alias("valid_px"), F.avg(v).alias("mean_m"), F.stddev_pop(v).alias("std_m"), F.max(v).alias("max_m"), *shares,
        (F.sum(above.cast("int")) * pixel_area).alias("area_m2"), F.sum(F.when(above, v * pixel_area).otherwise(0.0)).alias("volume_m3"),
    )
    q = wide_quantiles(own, [value], keys, [0.95]).withColumn("p95_m", F.col(f"q_{value}")[0]).drop(f"q_{value}")
    return join_group(out, q, keys).withColumn("volume_m3_per_ha", F.col("volume_m3") / (cell_area / 10_000.0))


def mode_label(cells: DataFrame, pixels: DataFrame, keys: list[str], label: str, order: str, mixed_below: float = 0.7) -> DataFrame:
    """Commonest label of each cell with its share; of equal counts the label seen first in raster order; empty cells are mixed."""
    counted = pixels.filter(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    best = counted.groupBy(*keys).agg(F.max_by(label, F.struct(F.col("n"), -F.col("first"))).alias("label"), (F.max("n") / F.sum("n")).alias("confidence"))
    out = cells.select(*keys).join(best, keys, "left")
    confidence = F.coalesce("confidence", F.lit(0.0))
    return out.select(*keys, "label", confidence.alias("confidence"), (confidence < mixed_below).cast("int").alias("mixed_flag"))


def majority_share(pixels: DataFrame, keys: list[str], code: str, known: list[int]) -> DataFrame:
    """Commonest known code (the lowest of equals, 0 if none) and each known code's share of all pixels."""
    totals = pixels.groupBy(*keys, code).agg(F.count(F.lit(1)).alias("n"))
    is_known = F.col(code).isin(known)
    best = F.max_by(F.when(is_known, F.col(code)), F.when(is_known, F.struct(F.col("n"), -F.col(code))))
    shares = [(F.sum(F.when(F.col(code) == k, F.col("n")).otherwise(0)) / F.sum("n")).alias(f"share_{k}") for k in known]
    return totals.groupBy(*keys).agg(F.coalesce(best, F.lit(0)).cast("long").alias("majority"), *shares)


def context_measures(cells: DataFrame, areas: DataFrame, lengths: DataFrame, points: DataFrame, keys: list[str], kinds: list[str], cell_area: float) -> DataFrame:
    """Per cell and class: area, share of the cell (1 at most), flag (1 with any area), line length and points, 0 where there is none.

    areas, lengths and points: keys, kind, and area or length of the pieces in each cell.
    """
    parts = [
        areas.groupBy(*keys, "kind").agg(F.sum("area").alias("v")).withColumn("what", F.concat(F.lit("area_"), "kind")),
        lengths.groupBy(*keys, "kind").agg(F.sum("length").alias("v")).withColumn("what", F.concat(F.lit("length_"), "kind")),
        points.groupBy(*keys, "kind").agg(F.count(F.lit(1)).cast("double").alias("v")).withColumn("what", F.concat(F.lit("points_"), "kind")),
    ]
    names = [f"{what}_{k}" for k in kinds for what in ("area", "length", "points")]
    wide = reduce(DataFrame.unionByName, parts).groupBy(*keys).pivot("what", names).agg(F.sum("v"))
    out = cells.select(*keys).join(wide, keys, "left").fillna(0.0, names)
    for k in kinds:
        out = out.withColumn(f"share_{k}", F.least(F.col(f"area_{k}") / cell_area, F.lit(1.0))).withColumn(f"flag_{k}", (F.col(f"area_{k}") > 0).cast("int")).withColumn(f"points_{k}", F.col(f"points_{k}").cast("long"))
    return out


def local_window(points: DataFrame, keys: list[str], value: str, half: int, least: int = 0) -> DataFrame:
    """Mean, population deviation and count over the square of ``half`` cells around each cell (row_id, col_id); null under ``least`` cells."""
    steps = F.sequence(F.lit(-half), F.lit(half))
    spread = points.select(F.explode(steps).alias("a"), "row_id", "col_id", value).select(F.explode(steps).alias("b"), "a", "row_id", "col_id", value)
    sums = spread.groupBy((F.col("row_id") + F.col("a")).alias("row_id"), (F.col("col_id") + F.col("b")).alias("col_id")).agg(F.count(value).alias("n"), F.avg(value).alias("local_mean"), F.stddev_pop(value).alias("local_std"))
    enough = F.col("n") >= least
    sums = sums.select("row_id", "col_id", "n", *[F.when(enough, F.col(c)).alias(c) for c in ("local_mean", "local_std")]) if least else sums
    return points.select(*keys, value).join(sums, ["row_id", "col_id"])


def shares_within(df: DataFrame, group: list[str], value: str, name: str = "share") -> DataFrame:
    return df.withColumn(name, F.col(value) / F.sum(value).over(Window.partitionBy(*group)))
