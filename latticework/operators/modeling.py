"""Spatially blocked evaluation: folds of whole blocks, forests and boosted trees per fold, and held-out groups."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.functions.scalar import block_key

from .ranking import cut, wide_quantiles
from .trees import Boosting, ExtraTrees, with_probabilities

#: Blocks up to which folds are dealt on the driver: a row per block and label.
MAX_BLOCKS = 100_000


def block_folds(cells: DataFrame, label: str, folds: int = 5, block: int = 5, seed: int = 42) -> DataFrame:
    """Adds block and fold: blocks of cells are never split, and each in turn (large and hash order) goes where labels stay most even."""
    own = cut(cells.withColumn("block", block_key(F.col("row_id"), F.col("col_id"), block)))
    counts = own.groupBy("block", label).agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.xxhash64("block", F.lit(seed))).limit(MAX_BLOCKS + 1).collect()
    if len(counts) > MAX_BLOCKS:
        raise ValueError("too many blocks: use larger ones")
    blocks: dict = {}
    for r in counts:
        blocks.setdefault((r["h"], r["block"]), {})[r[label]] = r["n"]
    held: list[dict] = [{} for _ in range(folds)]
    rows = []
    for (_, name), labels in sorted(blocks.items(), key=lambda x: (-sum(x[1].values()), x[0])):
        best = min(range(folds), key=lambda f: (sum((held[f].get(k, 0) + n) ** 2 - held[f].get(k, 0) ** 2 for k, n in labels.items()), sum(held[f].values()), f))
        for k, n in labels.items():
            held[best][k] = held[best].get(k, 0) + n
        rows.append((name, best))
    return own.join(cells.sparkSession.createDataFrame(rows, "block string, fold int"), "block")


def forest(trees: int, depth: int, seed: int) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol="features", labelCol="y", weightCol="w", numTrees=trees, maxDepth=depth, minInstancesPerNode=2, featureSubsetStrategy="sqrt", seed=seed)


def grown(kind: str, trees: int, depth: int, seed: int) -> ExtraTrees | Boosting:
    """extra_trees, boosted (whole levels to a depth) or boosted_leaves (the best leaf first, 31 leaves)."""
    if kind == "extra_trees":
        return ExtraTrees(trees, depth, seed)
    if kind == "boosted":
        return Boosting(trees, depth)
    if kind == "boosted_leaves":
        return Boosting(trees, depth, leaves=31, ridge=0.0, min_weight=1e-3)
    raise ValueError(f"no model {kind!r}")


#: Groups that a model is fitted for, at most.
MAX_GROUPS = 1_000
#: Models that are grown at the same time.
MODELS_AT_ONCE = 4


def held_out_predictions(df: DataFrame, features: list[str], label: str, group: str, kind: str = "random_forest", key: str = "grid_id", trees: int = 50, depth: int = 10, seed: int = 42, least_rows: int = 1) -> DataFrame:
    """Predictions of each group (fold, district) by a model of all others: key, group, true and predicted label, and a probability per
    label (an array in the order of the sorted labels).  ``kind``: random_forest, extra_trees, boosted or boosted_leaves.

    Groups of ``least_rows`` or more are held out, the most frequent first.  Nulls become medians of the training rows, and classes weigh
    n / (k * n_c) there.  A model is fitted for each group; more than MAX_GROUPS are an error.
    """
    df = cut(df)  # every group makes several passes
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_rows).orderBy(F.col("n").desc(), group)
    groups = [r[0] for r in counts.limit(MAX_GROUPS + 1).collect()]
    if len(groups) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups")
    labels = [r[0] for r in df.select(label).distinct().orderBy(label).collect()]
    number = F.element_at(F.create_map(*[F.lit(x) for i, v in enumerate(labels) for x in (v, float(i))]), F.col(label))
    name = F.element_at(F.array(*[F.lit(v) for v in labels]), (F.col("prediction") + 1).cast("int"))
    parts = []
    for g in groups:
        train, test = df.filter(F.col(group) != g), df.filter(F.col(group) == g)
        row = wide_quantiles(train, features, [], [0.5]).first()
        fill = {c: float(row[f"q_{c}"][0] if row[f"q_{c}"] is not None else 0.0) for c in features}
        n = {r[label]: r["n"] for r in train.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
        weight = F.element_at(F.create_map(*[F.lit(x) for v, c in n.items() for x in (v, sum(n.values()) / (len(n) * c))]), F.col(label))
        ready = train.fillna(fill, features).withColumn("y", number).withColumn("w", weight)
        filled = test.fillna(fill, features)
        if kind == "random_forest":
            assemble = VectorAssembler(inputCols=features, outputCol="features")
            model = forest(trees, depth, seed).fit(assemble.transform(ready))
            out = model.transform(assemble.transform(filled)).withColumn("probabilities", vector_to_array("probability"))
            names = name
        else:
            fitted = grown(kind, trees, depth, seed).fit(ready, features, "y", "w", len(labels))
            out = with_probabilities(filled, fitted, features, [key, group, label])
            names = F.element_at(F.array(*[F.lit(v) for v in labels]), F.array_position("probabilities", F.array_max("probabilities")).cast("int"))
        parts.append(out.select(key, group, F.col(label).alias("true_label"), names.alias("predicted_label"), "probabilities"))
    return reduce(DataFrame.unionByName, parts)


def gain_importances(df: DataFrame, features: list[str], label: str, group: str, trees: int = 50, depth: int = 6, leaves: int | None = None) -> DataFrame:
    """group, feature and importance: the sum of the gains of its splits in boosted trees of all rows but the group's, as a share of all gains.

    One model per group, at most MAX_GROUPS; medians fill nulls and classes are balanced as in ``held_out_predictions``.
    """
    df = cut(df)  # every group makes several passes
    groups = [r[0] for r in df.select(group).distinct().orderBy(group).limit(MAX_GROUPS + 1).collect()]
    if len(groups) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups")
    labels = [r[0] for r in df.select(label).distinct().orderBy(label).collect()]
    number = F.element_at(F.create_map(*[F.lit(x) for i, v in enumerate(labels) for x in (v, i)]), F.col(label))

    def shares(g) -> list[tuple]:
        train = df.filter(F.col(group) != g)
        q = wide_quantiles(train, features, [], [0.5]).first()
        fill = {c: float(q[f"q_{c}"][0] if q[f"q_{c}"] is not None else 0.0) for c in features}
        n = {r[label]: r["n"] for r in train.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
        weight = F.element_at(F.create_map(*[F.lit(x) for v, c in n.items() for x in (v, sum(n.values()) / (len(n) * c))]), F.col(label))
        model = Boosting(trees, depth, leaves=leaves).fit(train.fillna(fill, features).withColumn("y", number).withColumn("w", weight), features, "y", "w", len(labels))
        total = float(model.gains.sum()) or 1.0
        return [(g, c, float(v) / total) for c, v in zip(features, model.gains, strict=True)]

    # A level of a model is a short job that waits for the one before; models of other groups fill the gaps.
    with ThreadPoolExecutor(MODELS_AT_ONCE) as pool:
        rows = [r for own in pool.map(shares, groups) for r in own]
    kind = df.schema[group].dataType.simpleString()
    return df.sparkSession.createDataFrame(rows, f"`{group}` {kind}, feature string, importance double")
