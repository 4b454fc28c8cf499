"""Access to supply: nearest points, population allocation and the two-step floating catchment over a network."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions import scalar as S

from . import lattice, network, ranking
from .squares import GRAIN, oriented_edges, points_in_regions


def grow(left: DataFrame, key: str, right: DataFrame, distance: Column, answer: list[str], step: float, rounds: int = 40, keep: list[str] | None = None, fine: float | None = None) -> DataFrame:
    """For each box of left (key, x0, y0, x1, y1) the least struct (distance, answer columns) over the boxes of right (_x0, _y0, _x1, _y1
    and more), as column m; ``distance`` must not be less than that of the boxes.  A key may have several boxes; ``keep`` names more columns
    of theirs.

    Boxes meet in bins.  The first bins are ``step`` wide and answer what is within a step; then bins twice as wide serve those without
    an answer, and so on, so crowded places form few pairs and remote ones are still answered.

    With ``fine``, boxes of right are first dealt by their lower left corners to spots of that width, and only the spots meet in bins: a
    spot farther than the far corner of another can't hold the nearest box, so few spots are looked into.  ``distance`` must then be that of
    sets inside both boxes, the left one filling its box.
    """
    if right.isEmpty():
        kinds = ", ".join(f"{c}: {right.schema[c].dataType.simpleString()}" for c in answer)
        return left.select(key, F.lit(None).cast(f"struct<_d: double, {kinds}>").alias("m")).distinct()
    pending, found = ranking.cut(left.select(key, "x0", "y0", "x1", "y1", *(keep or []))), []
    if fine:
        right = right.withColumn("_fr", F.floor(F.col("_y0") / fine)).withColumn("_fc", F.floor(F.col("_x0") / fine))
        spots = ranking.cut(right.groupBy("_fr", "_fc").agg(*[f(c).alias(c) for f, c in ((F.min, "_x0"), (F.min, "_y0"), (F.max, "_x1"), (F.max, "_y1"))]))
    for _ in range(rounds):

        def bins(low: str, high: str, pad: int, width: float = step) -> Column:
            return F.explode(F.sequence(F.floor(F.col(low) / width - pad).cast("long"), F.floor(F.col(high) / width + pad).cast("long")))

        a = pending.withColumn("_r", bins("y0", "y1", 1)).withColumn("_c", bins("x0", "x1", 1))
        b = (spots if fine else right).withColumn("_r", bins("_y0", "_y1", 0)).withColumn("_c", bins("_x0", "_x1", 0))
        near = a.join(b, ["_r", "_c"])
        near = (nearest_spots(near, key, pending.columns, step).join(right, ["_fr", "_fc"]) if fine else near).withColumn("_d", distance).filter(F.col("_d") <= step)
        sure = ranking.cut(near.groupBy(key).agg(F.min(F.struct("_d", *answer)).alias("m")))
        found.append(sure)
        pending = ranking.cut(pending.join(sure, key, "left_anti"))
        if pending.isEmpty():
            return reduce(DataFrame.unionByName, found)
        step *= 2
    raise RuntimeError(f"not all boxes have an answer after {rounds} rounds")


def _gap(low: str, high: str, other_low: str, other_high: str) -> Column:
    return F.greatest(F.col(low) - F.col(other_high), F.lit(0.0), F.col(other_low) - F.col(high))


def nearest_spots(pairs: DataFrame, key: str, columns: list[str], step: float) -> DataFrame:
    """Of pairs of a box and a spot (its bounds _x0, _y0, _x1, _y1) within ``step``, those that may hold the nearest thing of the key: the spot
    is no farther than the far corner of every other (with room for rounding)."""
    gap = F.hypot(_gap("x0", "x1", "_x0", "_x1"), _gap("y0", "y1", "_y0", "_y1"))
    beyond = [F.greatest(F.col(f"{c}0") - F.col(f"_{c}0"), F.lit(0.0), F.col(f"_{c}1") - F.col(f"{c}1")) for c in "xy"]
    near = ranking.cut(pairs.select(*columns, "_fr", "_fc", gap.alias("_gap"), F.hypot(*beyond).alias("_far")).filter(F.col("_gap") <= step).distinct())
    least = near.groupBy(key).agg(F.min("_far").alias("_least"))
    return near.join(least, key).filter(F.col("_gap") <= F.col("_least") * (1 + 1e-9)).select(*columns, "_fr", "_fc")


def nearest(left: DataFrame, key: str, right: DataFrame, target: str, max_distance: float) -> DataFrame:
    """Nearest point (x, y) of right for each point (x, y) or box (x0, y0, x1, y1) of left: key, target (of equals the smallest), distance.

    The distance is always kept; the target is null beyond ``max_distance``, and both are null where right is empty.
    """
    bounds = ("x0", "y0", "x1", "y1") if "x0" in left.columns else ("x", "y", "x", "y")
    own = left.select(key, *[F.col(c).cast("double").alias(n) for n, c in zip(("x0", "y0", "x1", "y1"), bounds, strict=True)])
    points = right.select(F.col(target).alias("_target"), *[F.col(c).cast("double").alias(n) for n, c in (("_x0", "x"), ("_y0", "y"), ("_x1", "x"), ("_y1", "y"))])
    box = points.agg(F.count(F.lit(1)).alias("n"), (F.max("_x0") - F.min("_x0")).alias("w"), (F.max("_y0") - F.min("_y0")).alias("h")).first()
    step = max((box["w"] * box["h"] / box["n"]) ** 0.5, (box["w"] + box["h"]) / box["n"], 1e-9) if box["n"] else 1.0
    found = grow(own, key, points, F.hypot(_gap("x0", "x1", "_x0", "_x1"), _gap("y0", "y1", "_y0", "_y1")), ["_target"], step)
    return found.select(key, F.when(F.col("m._d") <= max_distance, F.col("m._target")).alias(target), F.col("m._d").alias("distance"))


def nearest_to_polygons(polygons: DataFrame, key: str, nodes: DataFrame, target: str, max_distance: float, size: float, rings: str = "rings") -> DataFrame:
    """Nearest node (x, y) of each polygon: key, target (of equals the smallest), distance; a node inside or on the outline is at 0.

    Nodes inside come from winding numbers on squares of ``size``; for the other polygons bins grow around their edges until they meet a
    node.  The distance is always kept; the target is null beyond ``max_distance``, and both are null where there is no node.
    """
    inside = points_in_regions(nodes, target, polygons, key, size, rings).groupBy(key).agg(F.min(target).alias("_target"))
    inside = ranking.cut(inside)
    far = polygons.join(inside, key, "left_anti")
    edges = oriented_edges(far, [key], rings, GRAIN, as_drawn=True)
    low, high = F.least, F.greatest
    boxes = edges.select(key, *[F.col(c).alias(f"e_{c}") for c in ("x0", "y0", "x1", "y1")], low("x0", "x1").alias("x0"), low("y0", "y1").alias("y0"), high("x0", "x1").alias("x1"), high("y0", "y1").alias("y1"))
    points = nodes.select(F.col(target).alias("_target"), *[F.col(c).cast("double").alias(n) for n, c in (("_x0", "x"), ("_y0", "y"), ("_x1", "x"), ("_y1", "y"))])
    ends = ["e_x0", "e_y0", "e_x1", "e_y1"]
    away = lattice.point_segment_distance(F.col("_x0"), F.col("_y0"), *[F.col(c) for c in ends])
    found = grow(boxes, key, points, away, ["_target"], float(size), keep=ends).select(key, F.col("m._d").alias("distance"), F.col("m._target").alias("_target"))
    both = found.unionByName(inside.select(key, F.lit(0.0).alias("distance"), "_target"))
    return both.select(key, F.when(F.col("distance") <= max_distance, F.col("_target")).alias(target), "distance")


def shore_distance(cells: DataFrame, shore: DataFrame, size: float, key: str = "grid_id") -> DataFrame:
    """cells with the distance to the nearest segment (x0, y0, x1, y1) of the shore, 0 where one crosses the cell, and its band."""
    lines = shore.select(*[F.col(c).alias(f"s_{c}") for c in ("x0", "y0", "x1", "y1")])
    lines = lines.select("*", F.least("s_x0", "s_x1").alias("_x0"), F.least("s_y0", "s_y1").alias("_y0"), F.greatest("s_x0", "s_x1").alias("_x1"), F.greatest("s_y0", "s_y1").alias("_y1"))
    d = lattice.square_segment_distance(F.col("x0"), F.col("y0"), float(size), *[F.col(f"s_{c}") for c in ("x0", "y0", "x1", "y1")])
    found = grow(cells, key, lines, d, ["_x0"], float(size), fine=size / 4).select(key, F.col("m._d").alias("distance"))
    return cells.join(found, key).withColumn("band", S.coastal_band(F.col("distance")))


def allocate(cells: DataFrame, zone: str, total: str, weight: str, name: str = "allocated") -> DataFrame:
    """A zone's total dealt to its cells by weight, in equal shares where the weights sum to nothing."""
    by_zone = Window.partitionBy(zone)
    w = F.greatest(F.coalesce(F.col(weight), F.lit(0.0)), F.lit(0.0))
    whole = F.sum(w).over(by_zone)
    return cells.withColumn(name, F.when(whole > 0, F.col(total) * w / whole).otherwise(F.col(total) / F.count(F.lit(1)).over(by_zone)))


def places(points: DataFrame, key: str, at: list[str], total: str, count: str | None = None) -> DataFrame:
    """One row per place (columns ``at``): the smallest key there, the sum of ``total`` and, as ``count``, the number of points.

    Points of one place reach and are reached alike, so pairs are formed between places and not between points.
    """
    own = points.groupBy(*at).agg(F.min(key).alias(key), F.sum(total).alias(total), *([F.count(F.lit(1)).alias(count)] if count else []))
    return own.select(key, *at, total, *([count] if count else []))


def point_catchment(origins: DataFrame, supplies: DataFrame, costs: list[float], origin: str = "origin_id", supply: str = "supply_id") -> DataFrame:
    """Two-step access of origins (x, y, population) to supplies (x, y, capacity) in a straight line, by places."""
    o = ranking.cut(places(origins, origin, ["x", "y"], "population"))
    s = places(supplies, supply, ["x", "y"], "capacity", "supplies")
    pairs = lattice.near_pairs(o, s, max(costs), [origin, "population"], [supply, "capacity", "supplies"]).withColumnsRenamed({f"r_{c}": c for c in (supply, "capacity", "supplies")})
    by_place = two_step_catchment(pairs, o, costs, origin, supply).join(o.select(origin, "x", "y"), origin).drop(origin, "population")
    out = ranking.join_group(origins.select(origin, "population", "x", "y"), by_place, ["x", "y"])
    return out.select(origin, "cost", "population", "access", "supplies", "supply_area", "access_log1p")


def two_step_catchment(pairs: DataFrame, origins: DataFrame, costs: list[float], origin: str = "origin_id", supply: str = "supply_id", available: str | None = None) -> DataFrame:
    """Access of every origin per cost, from pairs (origin, supply, distance, population, capacity, and supplies where one stands for several).

    Step one: a supply's ratio is its capacity over the population within the cost (none where that is 0).  Step two: an origin's
    access is the sum of the ratios it reaches.  Origins that reach nothing have 0; those whose column ``available`` is false have null.
    """
    limit = F.explode(F.array(*[F.lit(float(c)) for c in costs])).alias("cost")
    number = F.col("supplies") if "supplies" in pairs.columns else F.lit(1).cast("long")
    near = pairs.select(origin, supply, "distance", "population", "capacity", number.alias("_n"), limit).filter("distance <= cost")
    ratio = near.groupBy("cost", supply).agg(F.sum("population").alias("demand"), F.first("capacity").alias("cap")).filter("demand > 0").select("cost", supply, (F.col("cap") / F.col("demand")).alias("ratio"))
    access = near.join(ratio, ["cost", supply]).groupBy(origin, "cost").agg(F.sum("ratio").alias("access"), F.sum("_n").alias("supplies"), F.sum("capacity").alias("supply_area"))
    open_ = F.col(available) if available else F.lit(True)
    every = origins.select(origin, "population", open_.alias("_open"), limit)
    none = {"access": F.lit(0.0), "supplies": F.lit(0).cast("long"), "supply_area": F.lit(0.0)}
    out = every.join(access, [origin, "cost"], "left").select(origin, "cost", "population", *[F.when(F.col("_open"), F.coalesce(c, z)).alias(c) for c, z in none.items()])
    return out.withColumn("access_log1p", F.log1p("access"))


def snap_to_network(places: DataFrame, key: str, nodes: DataFrame, max_snap: float) -> DataFrame:
    """places with node (null beyond ``max_snap``) and snap (the distance to the nearest node, always kept)."""
    found = nearest(places, key, nodes, "node", max_snap).withColumnRenamed("distance", "snap")
    return places.join(found, key)


def network_pairs(edges: DataFrame, origins: DataFrame, supplies: DataFrame, most: float, origin: str = "origin_id", supply: str = "supply_id") -> DataFrame:
    """Pairs of snapped origins and supplies whose way over the network, both snaps included, is ``most`` at most.

    Paths start from the nodes of supplies with the smallest snap there as their cost so far, so a node's paths are found once.
    """
    starts = supplies.filter("node IS NOT NULL").groupBy("node").agg(F.min("snap").alias("cost")).select(F.col("node").alias("source"), "cost")
    reached = network.reach(edges, starts, most)
    first = starts.select("source", F.col("cost").alias("first"))
    ways = reached.join(first, "source").select("source", "node", (F.col("cost") - F.col("first")).alias("way"))
    more = [c for c in ("supplies",) if c in supplies.columns]
    own = supplies.filter("node IS NOT NULL").select(supply, "capacity", *more, F.col("node").alias("source"), F.col("snap").alias("supply_snap"))
    ends = origins.filter("node IS NOT NULL").select(origin, "population", "node", F.col("snap").alias("origin_snap"))
    pairs = ways.join(own, "source").join(ends, "node").withColumn("distance", F.col("supply_snap") + F.col("way") + F.col("origin_snap"))
    return pairs.filter(F.col("distance") <= most).select(origin, supply, "distance", "population", "capacity", *more)


def supply_ratios(pairs: DataFrame, supplies: DataFrame, costs: list[float], supply: str = "supply_id") -> DataFrame:
    """supplies (with node) per cost with demand (the population within it) and ratio; null off the network, no ratio without demand."""
    limit = F.explode(F.array(*[F.lit(float(c)) for c in costs])).alias("cost")
    near = pairs.select(supply, "distance", "population", limit).filter("distance <= cost").groupBy(supply, "cost").agg(F.sum("population").alias("demand"))
    out = supplies.select("*", limit).join(near, [supply, "cost"], "left").withColumn("demand", F.when(F.col("node").isNotNull(), F.coalesce("demand", F.lit(0.0))))
    return out.withColumn("ratio", F.when(F.col("demand") > 0, F.col("capacity") / F.col("demand")))


BOX = ["x0", "y0", "x1", "y1"]


def _snapped_places(edges: DataFrame, nodes: DataFrame, origins: DataFrame, supplies: DataFrame, max_snap: float) -> tuple[DataFrame, DataFrame]:
    """Places of origins (x, y) and of supplies (boxes) with node and snap."""
    o = snap_to_network(places(origins, "origin_id", ["x", "y"], "population"), "origin_id", nodes, max_snap)
    s = snap_to_network(places(supplies, "supply_id", BOX, "capacity", "supplies"), "supply_id", nodes, max_snap)
    return ranking.cut(o.withColumn("available", F.col("node").isNotNull())), ranking.cut(s)


def network_catchment(edges: DataFrame, nodes: DataFrame, origins: DataFrame, supplies: DataFrame, costs: list[float], max_snap: float) -> DataFrame:
    """Two-step access over a network: origin_id, cost, population, snap, available, access, supplies, supply_area, access_log1p."""
    o, s = _snapped_places(edges, nodes, origins, supplies, max_snap)
    found = two_step_catchment(network_pairs(edges, o, s, max(costs)), o, costs, available="available")
    by_place = found.join(o.select("origin_id", "x", "y", "snap", "available"), "origin_id").drop("origin_id", "population")
    out = ranking.join_group(origins.select("origin_id", "population", "x", "y"), by_place, ["x", "y"])
    return out.select("origin_id", "cost", "population", "access", "supplies", "supply_area", "access_log1p", "snap", "available")


def network_supplies(edges: DataFrame, nodes: DataFrame, origins: DataFrame, supplies: DataFrame, costs: list[float], max_snap: float) -> DataFrame:
    """Supplies per cost with node, snap, demand and ratio (see ``supply_ratios``) over a network."""
    o, s = _snapped_places(edges, nodes, origins, supplies, max_snap)
    by_place = supply_ratios(network_pairs(edges, o, s, max(costs)), s, costs).select(*BOX, "cost", "node", "snap", "demand")
    out = ranking.join_group(supplies.select("supply_id", "capacity", *BOX), by_place, BOX)
    return out.withColumn("ratio", F.when(F.col("demand") > 0, F.col("capacity") / F.col("demand")))


def green_supplies(features: DataFrame, values: list[str], most: int | None = None) -> DataFrame:
    """Open leisure areas of the given kinds, the first feature of each (osm_type, osm_id) in order of column seq; features: also
    matched_key, matched_value, tags (a map) and area.

    ``most`` keeps the first so many (the operator's limit).
    """

    def low(c: Column) -> Column:
        return F.lower(F.coalesce(c, F.lit("")))

    open_ = ~low(F.element_at("tags", F.lit("access"))).isin("private", "no")
    own = features.filter((low(F.col("matched_key")) == "leisure") & low(F.col("matched_value")).isin(values) & open_ & (F.col("area") > 0))
    first = own.groupBy("osm_type", "osm_id").agg(F.min("seq").alias("seq"), F.min_by(low(F.col("matched_value")), "seq").alias("green_type"), F.min_by("area", "seq").alias("capacity"))
    out = first.select(F.concat_ws("/", F.col("osm_type"), F.col("osm_id").cast("string")).alias("supply_id"), "green_type", "capacity", "seq")
    return out.orderBy("seq").limit(most) if most is not None else out


def threshold_summary(access: DataFrame) -> DataFrame:
    """Per cost: origins, those with access, exact median, 95th percentile, maximum, and the population share with access."""
    pos = F.coalesce(F.col("access") > 0, F.lit(False))
    sums = access.groupBy("cost").agg(
        F.count(F.lit(1)).alias("origins"), F.sum(pos.cast("long")).alias("positive"), F.max("access").alias("max"),
        (F.sum(F.when(pos, F.col("population")).otherwise(0.0)) / F.sum("population")).alias("population_share"),
    )
    found = ranking.quantiles(access, ["access"], ["cost"], [0.5, 0.95]).select("cost", F.col("q")[0].alias("median"), F.col("q")[1].alias("p95"))
    return ranking.join_group(sums, found, ["cost"]).select("cost", "origins", "positive", "median", "p95", "max", "population_share")
