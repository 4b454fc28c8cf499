"""Evaluation of predictions in long form (model, fold, true_label, predicted_label, probability)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import wide_quantiles


def confusion(pred: DataFrame, labels: list, keys: list[str]) -> DataFrame:
    """Counts of every (true, predicted) pair of the label list per key, zero where none."""
    counts = pred.groupBy(*keys, "true_label", "predicted_label").agg(F.count(F.lit(1)).alias("n"))
    each = F.array(*[F.lit(x) for x in labels])
    grid = pred.select(*keys).distinct().withColumn("true_label", F.explode(each)).withColumn("predicted_label", F.explode(each))
    return grid.join(counts, [*keys, "true_label", "predicted_label"], "left").fillna(0, ["n"])


def class_scores(pred: DataFrame, labels: list, keys: list[str]) -> DataFrame:
    """Precision, recall, F1 and support of each label; 0 where undefined."""
    c = confusion(pred, labels, keys)
    hit = F.col("true_label") == F.col("predicted_label")
    rows = c.groupBy(*keys, F.col("true_label").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("tp"))
    cols = c.groupBy(*keys, F.col("predicted_label").alias("label")).agg(F.sum("n").alias("named"))
    both = rows.join(cols, [*keys, "label"])
    precision = F.when(F.col("named") > 0, F.col("tp") / F.col("named")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(F.col("named") + F.col("support") > 0, 2 * F.col("tp") / (F.col("named") + F.col("support"))).otherwise(0.0)
    return both.select(*keys, "label", "support", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def fold_metrics(pred: DataFrame, labels: list, keys: list[str]) -> DataFrame:
    """Accuracy, balanced accuracy (over labels present in truth), macro F1 (over the fixed list) and weighted F1."""
    s = class_scores(pred, labels, keys)
    n = F.sum("support")
    return s.groupBy(*keys).agg(
        n.alias("rows"), (F.sum(F.col("recall") * F.col("support")) / n).alias("accuracy"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / n).alias("weighted_f1"),
    )


def macro_f1_present(pred: DataFrame, labels: list, keys: list[str]) -> DataFrame:
    """Macro F1 over labels present in truth or prediction."""
    c = class_scores(pred, labels, keys)
    named = pred.select(*keys, F.col("predicted_label").alias("label")).distinct().withColumn("seen", F.lit(True))
    return c.join(named, [*keys, "label"], "left").filter("support > 0 OR seen").groupBy(*keys).agg(F.avg("f1").alias("macro_f1_present"), F.count(F.lit(1)).alias("labels"))


def metric_summary(metrics: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """Count, mean, sample deviation, minimum and maximum over folds."""
    return metrics.groupBy(*keys).agg(F.count(metric).alias("folds"), F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("sd"), F.min(metric).alias("min"), F.max(metric).alias("max"))


def fold_deltas(metrics: DataFrame, recipe: str, reference: str, fold: list[str], metric: str) -> DataFrame:
    """Each recipe's metric less the reference recipe's in the same fold."""
    base = metrics.filter(F.col(recipe) == reference).select(*fold, F.col(metric).alias("base"))
    return metrics.filter(F.col(recipe) != reference).join(base, fold).select(*fold, recipe, (F.col(metric) - F.col("base")).alias("delta"))


def fold_wins(deltas: DataFrame, keys: list[str]) -> DataFrame:
    return deltas.groupBy(*keys).agg(F.sum((F.col("delta") > 0).cast("long")).alias("wins"), F.count(F.lit(1)).alias("folds"), F.avg("delta").alias("mean_delta"))


def balanced_weights(df: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """n / (k * n_c) per label, per key."""
    n = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys)
    return n.select(*keys, label, "n", (F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n"))).alias("weight"))


def majority_baseline(df: DataFrame, label: str, fold: str) -> DataFrame:
    """Per fold the commonest label of the other folds (of equals the smallest), from counts per fold and label."""
    counts = df.groupBy(fold, label).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.groupBy(label).agg(F.sum("n").alias("total"))
    folds = counts.select(fold).distinct()
    rest = folds.crossJoin(whole).join(counts, [fold, label], "left").withColumn("train", F.col("total") - F.coalesce("n", F.lit(0)))
    return rest.groupBy(fold).agg(F.min(F.struct(-F.col("train"), F.col(label))).alias("m")).select(fold, F.col(f"m.{label}").alias("majority"))


def median_imputer(df: DataFrame, columns: list[str], fold: str, held: int) -> DataFrame:
    """Nulls replaced by the exact median of the other folds' rows."""
    medians = wide_quantiles(df.filter(F.col(fold) != held), columns, [], [0.5]).select(*[F.col(f"q_{c}")[0].alias(f"m_{c}") for c in columns])
    return df.crossJoin(F.broadcast(medians)).select(*[F.coalesce(F.col(c), F.col(f"m_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])


def agreement(df: DataFrame, tiers: dict, truth: str, output: str, mapping: dict) -> DataFrame:
    """Agreement per tier (tiers may overlap); an output without a mapping disagrees."""
    mapped = F.element_at(F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]), F.col(output))
    own = df.withColumn("tier", F.explode(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tiers.items()]))))
    return own.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(mapped == F.col(truth), F.lit(False)).cast("double")).alias("agreement"))
