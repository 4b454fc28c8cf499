"""Ranks and exact quantiles of groups of any size.

Rows are counted per distinct value first, with map-side sums; the counts are range-partitioned by group and value, and a value's place is
its partition's offset plus a running sum inside the partition.  No group is ordered in one task, however many rows it has: what a
window sees is one range partition, or one row per range partition.  The ranged counts are checkpointed, as a partition's number must not change between its two uses.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range that one task sorts: the first number or more while there are RANGES of them, then up to the second.
RANGE_ROWS, MOST_RANGE_ROWS = 1 << 17, 1 << 21
#: Into so many ranges Spark writes rows without sorting them first, by spark.shuffle.sort.bypassMergeThreshold.
RANGES = 200
#: Ranges (one more for each further group in it) up to which their offsets are broadcast.
BROADCAST_RANGES = 100_000


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() into the folder in spark.checkpoint.dir; a temporary one only where none is set."""
    context = df.sparkSession.sparkContext
    if df.sparkSession.conf.get("spark.checkpoint.dir", None) is None and context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Like ``cut``, by a table in that folder.  A checkpoint keeps what the optimiser knew of the columns, and over rounds of one join that
    grows threefold a round; a table starts with nothing known."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    path = f"{folder}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def same(a: str, b: str, keys: list[str]) -> Column:
    """a.k <=> b.k for all keys; true without keys."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def running_sums(ranged: DataFrame, order: list[str], group: list[str], sums: list[str]) -> DataFrame:
    """Adds before_<s> (the sum of s over the group's earlier rows) and total_<s>; ranged has a column _part of ranges by group and order."""
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy(*group, "_part").agg(*[F.sum(s).alias(s) for s in sums])
    offsets = parts.select(*group, "_part", *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"base_{s}") for s in sums], *[F.sum(s).over(Window.partitionBy(*group)).alias(f"total_{s}") for s in sums])
    inside = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.select("*", *[F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(f"own_{s}") for s in sums])
    joined = own.alias("l").join(offsets.alias("o"), same("l", "o", [*group, "_part"]))
    keep = [c for c in ranged.columns if c != "_part"]
    return joined.select(*[F.col(f"l.{c}") for c in keep], *[(F.col(f"o.base_{s}") + F.col(f"l.own_{s}")).alias(f"before_{s}") for s in sums], *[F.col(f"o.total_{s}") for s in sums])


def ranged(df: DataFrame, order: list[str], group: list[str]) -> DataFrame:
    """df in range partitions by group and order, numbered by _part."""
    return cut(df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()))


def value_counts(df: DataFrame, value: str, group: list[str], sums: dict[str, Column] | None = None) -> DataFrame:
    """Per group the distinct values that aren't null with n (rows), before_n (rows of smaller values) and total_n; and so for each of sums."""
    sums = {"n": F.count(F.lit(1))} | (sums or {})
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(*[v.alias(k) for k, v in sums.items()])
    return running_sums(ranged(counts, [value], group), [value], group, list(sums))


def long_form(df: DataFrame, columns: list[str], group: list[str]) -> DataFrame:
    """A row per group, column name and value (double)."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("e")
    return df.select(*group, each).select(*group, "e.column", "e.value")


def quantiles(df: DataFrame, columns: list[str], group: list[str], probabilities: list[float]) -> DataFrame:
    """Per group and column an array of exact quantiles, linear between neighbours, in the order of probabilities: group, column, q, n."""
    counts = value_counts(long_form(df, columns, group), "value", [*group, "column"])
    upto = F.col("before_n") + F.col("n")

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("before_n") <= place) & (place < upto), F.col("value")))

    def quantile(p: float) -> Column:
        place = F.lit(float(p)) * (F.col("total_n") - 1)
        low, high = at(F.floor(place)), at(F.ceil(place))
        return F.when(low == high, low).otherwise((F.max(F.ceil(place)) - F.max(place)) * low + (F.max(place) - F.max(F.floor(place))) * high)

    return counts.groupBy(*group, "column").agg(F.array(*[quantile(p) for p in probabilities]).alias("q"), F.max("total_n").alias("n"))


def wide_quantiles(df: DataFrame, columns: list[str], group: list[str], probabilities: list[float]) -> DataFrame:
    """A row per group with a column ``q_<column>``, the array of its quantiles."""
    found = quantiles(df, columns, group, probabilities)
    return found.groupBy(*group).agg(*[F.first(F.when(F.col("column") == c, F.col("q")), ignorenulls=True).alias(f"q_{c}") for c in columns])


def join_group(df: DataFrame, side: DataFrame, group: list[str]) -> DataFrame:
    """df with the columns of side (a row per group, null groups included)."""
    columns = [c for c in side.columns if c not in group]
    if not group:
        return df.crossJoin(F.broadcast(side))
    return df.alias("l").join(side.alias("r"), same("l", "r", group), "left").select("l.*", *[F.col(f"r.{c}") for c in columns])


def join_few(df: DataFrame, side: DataFrame, group: list[str], most: int = 100_000) -> DataFrame:
    """df joined with side, a row per group.  Up to ``most`` groups travel as a broadcast and df's rows stay where they are, so no task reads a
    whole group; beyond that both are shuffled, and a group is small beside the table unless the rows are very uneven."""
    return df.join(few(side, most), group)


def few(side: DataFrame, most: int = 100_000) -> DataFrame:
    """side, checkpointed, to be broadcast in joins if it has ``most`` rows or less; if not, neither side is, whatever Spark takes its size to be."""
    side = cut(side)
    return F.broadcast(side) if side.count() <= most else side.hint("merge")


def average_ranks(df: DataFrame, value: str, group: list[str], name: str) -> DataFrame:
    """df with the rank of each value in its group, from 1, ties sharing their mean; null values have none."""
    counts = value_counts(df, value, group).select(*group, value, (F.col("before_n") + (F.col("n") + 1) / 2.0).alias(name))
    return df.alias("l").join(counts.alias("r"), same("l", "r", [*group, value]), "left").select("l.*", F.col(f"r.{name}"))


def row_numbers(df: DataFrame, order: list, group: list[str], name: str) -> DataFrame:
    """df with its rows numbered from 1 in each group by order (columns or sort expressions), and ``<name>_of``, the group's rows.

    A task sorts one range, of MOST_RANGE_ROWS at most (about, as bounds are sampled): a range asked for by number isn't merged with others,
    and a row's place in it is where it stands, so no window gathers ranges again.
    """
    rows = df.count()
    parts = max(min(RANGES, rows // RANGE_ROWS + 1), rows // MOST_RANGE_ROWS + 1)
    sorted_ = df.repartitionByRange(parts, *group, *order).sortWithinPartitions(*group, *order)
    whole = cut(sorted_.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = whole.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    offsets = cut(ranges.select(*group, "_part", (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) + 1 - F.col("_first")).alias("_shift"), F.sum("_rows").over(Window.partitionBy(*group)).alias("_of")))
    side = F.broadcast(offsets) if offsets.count() <= BROADCAST_RANGES else offsets
    joined = whole.alias("l").join(side.alias("o"), same("l", "o", [*group, "_part"]))
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], (F.col("l._at") + F.col("o._shift")).cast("long").alias(name), F.col("o._of").cast("long").alias(f"{name}_of"))
