"""Small helpers of the corpus operators: tables, checkpoints, free column names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table of hot keys, at most: a key is hot if it holds more than this share of all rows.
HOT_KEYS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset (tests on one machine), a temporary one."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    made = tempfile.mkdtemp(prefix="spark-checkpoint-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder: lineage ends there and a lost executor costs nothing already done."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = f"_{name}"
    return name


def join_hot(rows: DataFrame, side: DataFrame, keys: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined (inner or left_semi) with side, a row per key whose ``weight`` tells how many of the ``total`` rows have it.

    Fewer than HOT_KEYS keys can have more than total / HOT_KEYS rows each, so these travel as a broadcast of bounded size and their
    rows stay where they are; all other keys meet in a shuffle in which none is hot.
    """
    hot = side.filter(F.col(weight) * HOT_KEYS > total)
    if how == "left_semi":
        hot, side = hot.select(*keys), side.select(*keys, weight)
    light = side.filter(F.col(weight) * HOT_KEYS <= total)
    if how == "left_semi":
        light = light.select(*keys)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(light, keys, how)
    return rows.join(F.broadcast(hot), keys, how).unionByName(cold)
