"""Building stock by cell, from the pieces of an exact overlay (columns area, floors, type and the cell's keys)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import join_group, value_counts, wide_quantiles


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def floor_stats(pieces: DataFrame, keys: list[str], cell_area: float, floor_height: float = 3.2, max_floors: int = 60) -> DataFrame:
    """Counts, area-weighted floors, floor-band shares, floor area ratio and volume; ratios are null without valid floors.

    Floors count as valid in (0, max_floors]; null and zero are missing, more are outliers.
    """
    f, a = F.col("floors").cast("double"), F.col("area")
    missing = f.isNull() | (f <= 0)
    outlier = ~missing & (f > max_floors)
    ok = ~missing & ~outlier

    def over(cond: Column, x: Column) -> Column:
        return F.sum(F.when(cond, x).otherwise(0.0))

    below = F.coalesce(F.col("below").cast("double"), F.lit(0.0)) if "below" in pieces.columns else F.lit(0.0)
    bands = {"low_area": ok & (f <= 2), "mid_area": ok & (f > 2) & (f <= 5), "upper_area": ok & (f > 5) & (f <= 10), "high_area": ok & (f > 10)}
    sums = pieces.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("building_count"), F.sum(a).alias("building_area"), F.sum(missing.cast("long")).alias("missing_floors"), F.sum(outlier.cast("long")).alias("outlier_floors"),
        F.sum(ok.cast("long")).alias("valid_buildings"), F.max(f).alias("max_raw"), F.max(F.when(ok, f)).alias("max_valid"), over(ok, a).alias("v"), over(ok, a * f).alias("s1"), over(ok, a * f * f).alias("s2"), over(ok, a * below).alias("s0"),
        *[over(c, a).alias(k) for k, c in bands.items()],
    )
    mean = _share(F.col("s1"), F.col("v"))
    spread = F.sqrt(F.greatest(_share(F.col("s2"), F.col("v")) - mean * mean, F.lit(0.0)))
    return sums.select(
        *keys, "building_count", "building_area", (F.col("building_area") / cell_area).alias("coverage"), "missing_floors", "outlier_floors", "valid_buildings", "max_raw", "max_valid",
        mean.alias("floors_mean"), F.when(F.col("v") > 0, spread).alias("floors_std"), (mean * floor_height).alias("height_mean_m"),
        F.when(F.col("v") > 0, F.col("s1") / cell_area).alias("floor_area_ratio"), F.when(F.col("v") > 0, F.col("s1") * floor_height).alias("volume_m3"),
        *[_share(F.col(k), F.col("v")).alias(f"{k}_share") for k in bands], *([_share(F.col("s0"), F.col("v")).alias("below_mean")] if "below" in pieces.columns else []),
    )


def type_shares(pieces: DataFrame, keys: list[str], types: list[str], type_col: str = "type") -> DataFrame:
    """Area share of each type over all building area, and the dominant one (of equals the first listed; empty if none has area)."""
    sums = pieces.groupBy(*keys).agg(F.sum("area").alias("whole"), *[F.sum(F.when(F.col(type_col) == t, F.col("area")).otherwise(0.0)).alias(f"a_{t}") for t in types])
    most = F.greatest(*[F.col(f"a_{t}") for t in types])
    name = F.when(most <= 0, "")
    for t in types:
        name = name.when(F.col(f"a_{t}") == most, t)
    return sums.select(*keys, *[(F.col(f"a_{t}") / F.col("whole")).alias(f"share_{t}") for t in types], name.alias("dominant"))


def footprint_stats(pieces: DataFrame, keys: list[str], cell_area: float) -> DataFrame:
    """Area and perimeter sums, exact median, variation and Gini of piece areas, and area-weighted compactness 4 pi A / P^2.

    Median and ranks come from counts per distinct area and their running sums over range partitions, so no task holds a cell's pieces.
    """
    own = pieces.withColumn("perimeter", 2 * (F.col("piece_w") + F.col("piece_h"))).withColumn("comp", 4 * F.pi() * F.col("area") / (F.col("perimeter") * F.col("perimeter")))
    n, total = F.count(F.lit(1)), F.sum("area")
    # Pieces of one area have the ranks before_n + 1 to before_n + n.
    ranks = value_counts(own, "area", keys).groupBy(*keys).agg(F.sum(F.col("area") * (F.col("before_n") * F.col("n") + F.col("n") * (F.col("n") + 1) / 2)).alias("ranked"))
    q = wide_quantiles(own, ["area"], keys, [0.5]).withColumn("median_area", F.col("q_area")[0]).drop("q_area")
    out = own.groupBy(*keys).agg(
        n.alias("building_count"), total.alias("building_area"), F.sum("perimeter").alias("perimeter"), F.avg("area").alias("mean_area"), F.when(n > 1, F.stddev_pop("area") / F.avg("area")).alias("area_cv"),
        (F.sum(F.col("comp") * F.col("area")) / total).alias("comp_mean"), (F.sum(F.col("comp") * F.col("comp") * F.col("area")) / total).alias("comp_square"),
    )
    spread = F.sqrt(F.greatest(F.col("comp_square") - F.col("comp_mean") * F.col("comp_mean"), F.lit(0.0)))
    whole = F.col("building_count")
    out = join_group(join_group(out, q, keys), ranks, keys).withColumn("area_gini", 2 * F.col("ranked") / (whole * F.col("building_area")) - (whole + 1) / whole).drop("ranked")
    return out.withColumn("comp_std", spread).withColumn("perimeter_per_ha", F.col("perimeter") / (cell_area / 10_000.0)).drop("comp_square")


def frontage(df: DataFrame, cell_area: float) -> DataFrame:
    """Street frontage ratios from road_length, buffer_area, building_count, building_area and edge_length of a cell."""
    share = F.when(F.col("buffer_area") > 0, F.least(F.greatest(F.col("building_area") / F.col("buffer_area"), F.lit(0.0)), F.lit(1.0)))
    continuity = F.when(F.col("road_length") > 0, F.least(F.greatest(F.col("edge_length") / (2 * F.col("road_length")), F.lit(0.0)), F.lit(1.0)))
    return df.select(
        "*", (F.col("buffer_area") / cell_area).alias("buffer_coverage"), share.alias("building_share"), F.when(share.isNotNull(), F.greatest(1 - share, F.lit(0.0))).alias("open_share"),
        F.when(F.col("buffer_area") > 0, F.col("building_count") / (F.col("buffer_area") / 10_000.0)).alias("building_density"), F.when(F.col("road_length") > 0, F.col("edge_length") / (F.col("road_length") / 1000.0)).alias("edge_per_km"),
        continuity.alias("continuity"), (1 - continuity).alias("gap"),
    )
