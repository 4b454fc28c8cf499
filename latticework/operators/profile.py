"""Column profiles, value counts, correlations, collinearity groups and screens.

A wide table is profiled in long form: one unpivot, then aggregation per (column, value), so that the number of columns changes
the data volume and not the number of jobs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions import scalar as S

from .network import components
from .ranking import join_group, quantiles


def long_form(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: family, role, rows, nulls, distinct values, top and zero shares, exact quantiles, constant flags."""
    values = long_form(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    number = S.parse_number(F.col("value"))
    own = values.withColumn("number", number)
    seen = F.col("value").isNotNull()
    out = own.groupBy("column").agg(
        F.sum("n").alias("rows"), F.sum(F.when(seen, F.col("n")).otherwise(0)).alias("non_null"), F.count("value").alias("unique_count"), F.max(F.when(seen, F.col("n"))).alias("top"),
        F.sum(F.when(F.col("number").isNotNull(), F.col("n")).otherwise(0)).alias("numeric"), F.sum(F.when(F.col("number") == 0, F.col("n")).otherwise(0)).alias("zeros"),
        F.min("number").alias("min"), F.max("number").alias("max"), (F.sum(F.col("number") * F.col("n")) / F.sum(F.when(F.col("number").isNotNull(), F.col("n")))).alias("mean"),
    )
    numbers = df.select(*[S.parse_number(F.col(c)).alias(c) for c in columns])
    out = join_group(out, quantiles(numbers, columns, [], [0.05, 0.5, 0.95]).select("column", "q"), ["column"])
    share = F.when(F.col("non_null") > 0, F.col("top") / F.col("non_null"))
    return out.select(
        "column", S.column_family(F.col("column")).alias("family"), S.column_role(F.col("column")).alias("role"), "rows", "non_null", (F.col("rows") - F.col("non_null")).alias("missing"), "unique_count",
        share.alias("top_share"), F.when(F.col("numeric") > 0, F.col("zeros") / F.col("numeric")).alias("zero_share"), "min", F.col("q")[0].alias("p05"), F.col("q")[1].alias("median"), "mean", F.col("q")[2].alias("p95"), "max",
        (F.col("unique_count") <= 1).cast("int").alias("constant_flag"), ((F.col("unique_count") <= 1) | F.coalesce(share >= 0.99, F.lit(False))).cast("int").alias("near_constant_flag"),
    )


def value_counts(df: DataFrame, columns: list[str], top: int = 30) -> DataFrame:
    """The ``top`` commonest values of each column, null among them."""
    counts = long_form(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value").asc_nulls_last())
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def family_missingness(profile: DataFrame) -> DataFrame:
    return profile.groupBy("family").agg(F.count(F.lit(1)).alias("columns"), F.avg(F.col("missing") / F.col("rows")).alias("mean_missing"), F.max(F.col("missing") / F.col("rows")).alias("max_missing"))


def _pair_sums(shift: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A partition's sums over rows that have both of two columns, as matrix products: for each first column i the vectors of n, x, y, xx,
    yy, xy and of rows in which one of both is no number, around the columns' means."""
    k = len(shift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((7, k, k))
        for batch in batches:
            for at in range(0, batch.num_rows, 65536):
                part = batch.slice(at, 65536)
                have = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in part.columns], axis=1).astype(float)
                z = np.stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in part.columns], axis=1)
                odd = (~np.isfinite(z)).astype(float) * have
                z = np.where((have > 0) & (odd == 0), z - shift, 0.0)
                total += [have.T @ have, z.T @ have, have.T @ z, (z * z).T @ have, have.T @ (z * z), z.T @ z, odd.T @ have + have.T @ odd]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array([total[:, i].tobytes() for i in range(k)], pa.binary())], names=["i", "sums"])

    return run


def _add_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[i] = total.get(i, 0.0) + np.frombuffer(raw)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["i", "sums"])


def correlation_pairs(df: DataFrame, columns: list[str], min_rows: int = 200) -> DataFrame:
    """Pearson correlation of each pair of columns over rows that have both, of ``min_rows`` or more: a, b, r, n.

    One pass for the columns' means, one for the sums of products around them: a partition gives a vector of sums per column, however many
    rows it has, and vectors of a column are added where they meet.  A pair with a constant column, or with infinite values or values
    that are no number in rows that have both, has no correlation.
    """
    k = len(columns)
    own = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    real = [F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)) for c in own.columns]
    seen = own.agg(*[F.avg(c) for c in real], *[F.max(F.abs(c)) for c in real]).first()
    shift, scale = (np.array([x or 0.0 for x in seen[a : a + k]], float) for a in (0, k))
    sums = own.mapInArrow(_pair_sums(shift), "i long, sums binary")
    # Vectors of a column are added in sixteen parts first, so that no task gets one from every partition.
    sums = sums.repartition("i", F.pmod(F.spark_partition_id(), F.lit(16))).mapInArrow(_add_sums, "i long, sums binary")
    sums = sums.repartition("i").mapInArrow(_add_sums, "i long, sums binary")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, x, y, xx, yy, xy, odd = np.frombuffer(raw).reshape(7, k)
                with np.errstate(divide="ignore", invalid="ignore"):
                    vx, vy, c = xx - x * x / n, yy - y * y / n, xy - x * y / n
                    # What is left of a constant column's variance is the rounding of its values.
                    still = (vx <= n * (1e-13 * scale[i]) ** 2) | (vy <= n * (1e-13 * scale) ** 2)
                    r = c / np.sqrt(vx * vy)
                keep = np.flatnonzero((np.arange(k) > i) & (n >= max(min_rows, 1)) & ~still & (odd == 0) & np.isfinite(r))
                yield pa.RecordBatch.from_arrays([pa.array([columns[i]] * len(keep), pa.string()), pa.array([columns[j] for j in keep], pa.string()), pa.array(r[keep], pa.float64()), pa.array(n[keep].astype(np.int64))], names=["a", "b", "r", "n"])

    return sums.mapInArrow(pairs, "a string, b string, r double, n long")


def collinear_groups(pairs: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Groups of columns linked by |r| at or above the threshold, named by their smallest column."""
    linked = pairs.filter(F.abs("r") >= threshold).select("a", "b")
    names = linked.select(F.explode(F.array("a", "b")).alias("name")).distinct().withColumn("id", F.row_number().over(Window.orderBy("name")).cast("long"))
    edges = linked.join(names.select(F.col("name").alias("a"), F.col("id").alias("i")), "a").join(names.select(F.col("name").alias("b"), F.col("id").alias("j")), "b").select(F.col("i").alias("a"), F.col("j").alias("b"))
    roots = components(edges).join(names, F.col("node") == F.col("id"))
    return roots.groupBy("root").agg(F.min("name").alias("group"), F.count(F.lit(1)).alias("feature_count"), F.array_join(F.array_sort(F.collect_list("name")), "; ").alias("features")).drop("root")


def leakage_screen(profile: DataFrame) -> DataFrame:
    """Columns whose role or family calls for care, with the reason."""
    issue = F.when(F.col("role") == "label_or_label_quality", "label or its quality").when(F.col("role") == "climate_outcome", "outcome").when(F.col("role") == "coverage_or_quality_control", "quality control")
    issue = issue.when(F.col("role") == "spatial_index", "encodes location").when(F.col("role") == "admin_context", "district identity")
    issue = issue.when(F.col("family").isin("dynamic_world", "worldcover", "sentinel2"), "overlaps label source").when(F.col("family") == "osm_proxy_context", "proxy context")
    return profile.select("column", "family", "role", issue.alias("issue")).filter("issue IS NOT NULL")
