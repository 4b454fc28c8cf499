"""Mixing sources to target weights with a low-discrepancy schedule; DataFrame functions only.

The mix is a row of equal slots.  Slot i takes the golden-ratio point frac((i + 1) * phi) (in integer arithmetic, so reruns agree)
through the cumulative target shares, which names its source; slots are then ranked within their source, and the slot of rank
r takes the r-th equal-token block of that source's shuffled documents, laid end to end once per epoch.  Any stretch of the
schedule holds each source nearly in proportion to its target.

Running sums and ranks are two-level: sums per chunk, a running sum over the few chunk rows, then a window inside each chunk, so
that no source, however large, is ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Golden ratio of 2**32 points, and the points' number.
STEP, POINTS = 2654435769, 1 << 32
#: Slots at least, where there are as many words, and words of a block at most (more only where slots would pass 2**31).
MIN_SLOTS, BLOCK_WORDS = 1 << 16, 4096
#: Sources up to which the table of sources (a row each, some 100 bytes) is broadcast.
BROADCAST_ROWS = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def block_words(total: int) -> int:
    """Words of a block: many blocks even for a small table, and at most 2**31 slots."""
    return max(1, min(-(-total // MIN_SLOTS), BLOCK_WORDS), -(-total // (1 << 31)))


def target_words(sources: DataFrame, total: int, weights: tuple[float, ...], max_epochs: int) -> DataFrame:
    """Adds rank sid and target to a table of source, source_size.

    Sources in code point order, null last, have the weights in turn.  A target stops at max_epochs times the source's size and the
    excess goes to the others by weight: with sources in order of that cap over weight, the first whose cap isn't below its
    share of what the earlier ones leave fixes the words per weight for itself and all later ones.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("sid", F.row_number().over(place) - 1)
    ranked = ranked.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("sid") % len(weights) + 1).cast("int"))).withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    share = (F.lit(float(total)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    levels = ranked.withColumn("level", share).withColumn("open", F.col("cap") >= F.col("level") * F.col("w"))
    level = F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.col("cap") / F.col("w"))).over(Window.partitionBy())
    return levels.withColumn("target", F.coalesce(F.least("cap", level * F.col("w")), F.col("cap"))).select("source", "source_size", "sid", "target")


def schedule(targets: DataFrame, total: int, few_sources: bool) -> DataFrame:
    """Slots of the mix: slot, sid, rank (from 0, within the source)."""
    spark = targets.sparkSession
    block = block_words(total)
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    cumulated = targets.withColumn("upto", F.sum("target").over(upto)).withColumn("all", F.sum("target").over(Window.partitionBy()))
    edges = cumulated.withColumn("high", F.when(F.col("upto") >= F.col("all"), F.lit(POINTS)).otherwise(F.floor(F.col("upto") / F.col("all") * POINTS)).cast("long"))
    edges = edges.withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("sid")), F.lit(0).cast("long"))).filter(F.col("low") < F.col("high"))
    width = POINTS >> 10
    bins = edges.select("sid", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))).alias("bin"))
    bins = F.broadcast(bins) if few_sources else bins
    slots = spark.range(total // block).select(F.col("id").alias("slot"), F.pmod((F.col("id") + 1) * F.lit(STEP).cast("long"), F.lit(POINTS)).alias("point"))
    slots = slots.withColumn("bin", F.floor(F.col("point") / width))
    named = slots.join(bins, (slots["bin"] == bins["bin"]) & (F.col("point") >= F.col("low")) & (F.col("point") < F.col("high"))).select("slot", "sid", F.shiftright("slot", 10).alias("chunk"))
    sums = named.groupBy("sid", "chunk").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("sid", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot"))
    return named.join(base, ["sid", "chunk"]).select("slot", "sid", (F.col("base") + own - 1).alias("rank"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_epochs: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Words that the mix takes of every document: id, source, size, source_size, target (the source's), taken.

    Size is the number of words (null text: 0).  A null source is a source of its own, last in order.  No document is taken more
    than ``max_epochs`` times its size.  Documents are shuffled by the MD5 of their id; repeated rows each have their own place.
    A table without words takes nothing; an empty table gives an empty result.  Words of a very long text are counted in place and
    spread over as many blocks as it fills.
    """
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    sized = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("key")))
    by_source = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    n_sources, total = by_source.agg(F.count(F.lit(1)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    few = n_sources <= BROADCAST_ROWS
    targets = cut(target_words(by_source, total, weights, max_epochs))
    block = block_words(total)
    slots = schedule(targets, total, few)

    source = targets.withColumnRenamed("source", "named")
    placed = sized.join(F.broadcast(source) if few else source, F.col("source").eqNullSafe(F.col("named"))).drop("named").withColumn("chunk", F.substring("key", 1, 3))
    sums = placed.groupBy("sid", "chunk").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("sid", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("sid", "chunk").orderBy("key", "id", "size")
    laid = placed.join(base, ["sid", "chunk"]).withColumn("row", F.row_number().over(inside))
    laid = laid.withColumn("start", F.col("base") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))

    epochs = F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.lit(0), F.lit(max_epochs - 1)))).alias("epoch")
    copies = laid.select("id", "source", "size", "source_size", "target", "sid", "chunk", "row", "start", epochs).withColumn("from", F.col("start") + F.col("epoch") * F.col("source_size")).withColumn("to", F.col("from") + F.col("size"))
    pieces = copies.withColumn("rank", F.explode_outer(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block))))
    overlap = F.least(F.col("to"), (F.col("rank") + 1) * block) - F.greatest(F.col("from"), F.col("rank") * block)
    used = pieces.join(slots.select("sid", "rank", F.lit(True).alias("used")), ["sid", "rank"], "left")
    keys = ["sid", "chunk", "row", "id", "source", "size", "source_size", "target"]
    out = used.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("used"), overlap)), F.lit(0)).cast("long").alias("taken"))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "taken")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The same mix, with the taken words in closed form: a source's slots cover the first slots * block words of its epochs.
OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
t AS (SELECT CAST(sum(source_size) AS BIGINT) AS total FROM s),
b AS (SELECT total, greatest(1, least((total + 65535) // 65536, 4096), (total + 2147483647) // 2147483648) AS block FROM t),
r AS (SELECT source, source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS sid FROM s),
w AS (SELECT *, CASE sid % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, CAST(source_size * 3 AS DOUBLE) AS cap FROM r),
l AS (
  SELECT *, (CAST(total AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w, t),
g AS (
  SELECT source, source_size, sid,
         coalesce(least(cap, (SELECT min_by(level, cap / w) FROM l WHERE cap >= level * w) * w), cap) AS target
  FROM l),
e AS (SELECT *, sum(target) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(target) OVER () AS every FROM g),
h AS (SELECT *, CASE WHEN upto >= every THEN 4294967296 ELSE CAST(floor(upto / every * 4294967296) AS BIGINT) END AS high FROM e),
i AS (SELECT *, coalesce(lag(high) OVER (ORDER BY sid), 0) AS low FROM h),
p AS (SELECT ((range + 1) * 2654435769) % 4294967296 AS point FROM range((SELECT total // block FROM b))),
n AS (SELECT sid, count(*) AS slots FROM p JOIN i ON point >= low AND point < high GROUP BY sid),
c AS (
  SELECT d.doc_id, d.size, i.source_size, i.target, coalesce(n.slots, 0) * b.block AS served,
         sum(d.size) OVER (PARTITION BY i.sid ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS start
  FROM d JOIN i ON d.source IS NOT DISTINCT FROM i.source LEFT JOIN n ON n.sid = i.sid CROSS JOIN b)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(start + size, served) - start)
          + greatest(0, least(start + size + source_size, served) - start - source_size)
          + greatest(0, least(start + size + 2 * source_size, served) - start - 2 * source_size) AS BIGINT) AS taken
FROM c
"""
