"""Feature sets and picks: recipes, candidate columns, shortlists, importances, example rows and prototypes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.functions import scalar as S

from .ranking import cut, join_group, quantiles, row_numbers, wide_quantiles
from .selection import medoids


def recipe_columns(manifest: dict, recipe: str, replace: dict[str, str] | None = None, drop: tuple[str, ...] = ()) -> list[str]:
    """Columns of a recipe's feature sets in order, each once; some replaced or left out."""
    named = [c for s in manifest["baseline_recipes"][recipe] for c in manifest["feature_sets"][s]]
    return list(dict.fromkeys((replace or {}).get(c, c) for c in dict.fromkeys(named) if c not in drop))


def select_recipe(df: DataFrame, manifest: dict, recipe: str, keys: list[str], replace: dict[str, str] | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """keys and the recipe's columns; columns that df doesn't have are an error."""
    columns = recipe_columns(manifest, recipe, replace, drop)
    missing = [c for c in [*keys, *columns] if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns of {recipe}: {missing}")
    return df.select(*keys, *columns)


def complete_cases(df: DataFrame, columns: list[str], *tests: Column) -> DataFrame:
    """Rows that meet all tests and have a number in all columns."""
    whole = reduce(lambda a, b: a & b, [F.coalesce(t, F.lit(False)) for t in tests], F.lit(True))
    return df.filter(whole).filter(reduce(lambda a, b: a & b, [S.parse_number(F.col(c)).isNotNull() for c in columns], F.lit(True)))


#: Roles of columns that no model may use.
EXCLUDED_ROLES = ["id", "spatial_index", "sampling_frame", "label_or_label_quality", "climate_outcome", "coverage_or_quality_control", "admin_context"]


def candidate_predictors(profile: DataFrame, least_rows: int = 200, most_missing: float = 0.8, excluded: list[str] | None = None) -> DataFrame:
    """Columns of a profile that may be predictors: numbers, of an allowed role, not constant, with enough values."""
    number = F.col("median").isNotNull()
    enough = (F.col("non_null") >= least_rows) & (F.col("missing") / F.col("rows") < most_missing)
    roles = EXCLUDED_ROLES if excluded is None else excluded
    return profile.filter(number & ~F.col("role").isin(roles) & (F.col("constant_flag") == 0) & enough).select("column", "family", S.retention_score(F.col("column")).alias("score"))


def shortlist(wanted: DataFrame, available: DataFrame, groups: DataFrame) -> DataFrame:
    """A table of wanted features (feature, branch, decision) with available, whether it stands in a collinear group, and the decision,
    Missing where it isn't available.  available: column; groups: features, joined by "; "."""
    grouped = groups.select(F.explode(F.split("features", "; ")).alias("feature")).distinct().withColumn("_g", F.lit(True))
    have = available.select(F.col("column").alias("feature")).distinct().withColumn("_a", F.lit(True))
    joined = wanted.join(have, "feature", "left").join(grouped, "feature", "left")
    yes = F.coalesce("_a", F.lit(False))
    return joined.select("feature", "branch", F.when(yes, F.col("decision")).otherwise("Missing").alias("decision"), yes.alias("available"), F.coalesce("_g", F.lit(False)).alias("in_group"))


def importance_by_feature(importances: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and sample deviation over folds of each feature's importance, its family, and the feature's share of its group."""
    out = importances.withColumn("family", S.column_family(F.col("feature"))).groupBy(*keys, "feature", "family")
    return out.agg(F.avg("importance").alias("importance_mean"), F.stddev_samp("importance").alias("importance_sd"))


def importance_by_family(importances: DataFrame, keys: list[str], fold: str = "fold") -> DataFrame:
    """Importances summed per family within a fold, then their mean and sample deviation over folds."""
    own = importances.withColumn("family", S.column_family(F.col("feature"))).groupBy(*keys, fold, "family").agg(F.sum("importance").alias("s"))
    return own.groupBy(*keys, "family").agg(F.avg("s").alias("importance_mean"), F.stddev_samp("s").alias("importance_sd"))


def aligned_probabilities(df: DataFrame, classes: str, probabilities: str, labels: list, prefix: str = "prob_") -> DataFrame:
    """A column per label with its probability from arrays of classes and probabilities; 0 for a label that the model hasn't seen."""
    both = F.map_from_arrays(F.col(classes), F.col(probabilities))
    out = df.select("*", *[F.coalesce(F.element_at(both, F.lit(x)), F.lit(0.0)).alias(f"{prefix}{x}") for x in labels])
    return out.withColumn("predicted_probability", F.greatest(*[F.col(f"{prefix}{x}") for x in labels]))


def picked(df: DataFrame, picks: list[tuple[str, Column, list[Column]]], columns: list[str]) -> DataFrame:
    """The first row of each pick (name, filter, order), as name and columns; a pick without rows gives none."""
    parts = [df.filter(F.coalesce(test, F.lit(False))).orderBy(*order).limit(1).select(F.lit(name).alias("pick"), *columns) for name, test, order in picks]
    return reduce(DataFrame.unionByName, parts)


def first_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows by order with their position (the n is the operator's limit)."""
    return row_numbers(df.orderBy(*order).limit(n), order, [], "position").drop("position_of")


def thermal_pools(df: DataFrame, pool: DataFrame, group: str, value: str, key: str, least: int = 24) -> DataFrame:
    """pool twice over: its rows at or below the lower quartile that df has in the group (cool), and at or above the upper (hot).

    Where a group has no such row, the ``least`` lowest or highest of its pool stand in.  Adds thermal and threshold.
    """
    q = quantiles(df, [value], [group], [0.25, 0.75]).select(group, F.col("q")[0].alias("_low"), F.col("q")[1].alias("_high"))
    own = cut(join_group(pool, q, [group]))
    cool = own.filter(F.col(value) <= F.col("_low")).select(*pool.columns, F.lit("cool").alias("thermal"), F.col("_low").alias("threshold"))
    hot = own.filter(F.col(value) >= F.col("_high")).select(*pool.columns, F.lit("hot").alias("thermal"), F.col("_high").alias("threshold"))
    both = cool.unionByName(hot)
    for name, order, edge in (("cool", F.col(value).asc(), "_low"), ("hot", F.col(value).desc(), "_high")):
        have = both.filter(F.col("thermal") == name).select(group).distinct()
        ranked = row_numbers(own.join(have, group, "left_anti"), [order, F.col(key)], [group], "_n").filter(F.col("_n") <= least)
        both = both.unionByName(ranked.select(*pool.columns, F.lit(name).alias("thermal"), F.col(edge).alias("threshold")))
    return both


def thermal_picks(pools: DataFrame, group: str, columns: list[str], key: str) -> DataFrame:
    """The medoid of each group and thermal pool: group, thermal, key, score, threshold."""
    own = pools.withColumn("_pool", F.concat_ws("|", F.col(group).cast("string"), F.col("thermal")))
    best = medoids(own, "_pool", columns, key)
    return best.join(own.select("_pool", group, "thermal", "threshold").distinct(), "_pool").select(group, "thermal", key, "score", "threshold")


def prototypes(pools: DataFrame, group: list[str], key: str, columns: list[str], steps: list[tuple[str, Column]]) -> DataFrame:
    """For each group the row of the highest score of each step in turn, without rows that an earlier step took; of equals the smallest key.

    Scores may use z_<c>, a column's distance from the group's mean in population deviations (1 where that is 0), and typical, minus
    the squared distance from its medians; both come from the whole group.
    """
    stats = pools.groupBy(*group).agg(*[F.avg(c).alias(f"a_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    middle = wide_quantiles(pools, columns, group, [0.5])
    own = join_group(join_group(pools, stats, group), middle, group)

    def sd(c: str) -> Column:
        return F.when((F.col(f"s_{c}") > 0) & ~F.isnan(f"s_{c}"), F.col(f"s_{c}")).otherwise(F.lit(1.0))

    for c in columns:
        own = own.withColumn(f"z_{c}", (F.col(c) - F.col(f"a_{c}")) / sd(c))
    parts = [(F.col(c) - F.col(f"q_{c}")[0]) / sd(c) for c in columns]
    own = cut(own.withColumn("typical", -reduce(lambda a, b: a + b, [p * p for p in parts])))
    taken: list[DataFrame] = []
    for name, score in steps:
        left = own
        for t in taken:
            left = left.join(t.select(*group, key), [*group, key], "left_anti")
        best = left.withColumn("_score", score).groupBy(*group).agg(F.min(F.struct((-F.col("_score")).alias("s"), F.col(key).alias("k"))).alias("m"))
        taken.append(cut(best.select(*group, F.lit(name).alias("prototype"), F.col("m.k").alias(key), (-F.col("m.s")).alias("score"))))
    return reduce(DataFrame.unionByName, taken)


def two_models(primary: DataFrame, comparison: DataFrame, key: str, probabilities: list[str]) -> DataFrame:
    """Predictions of two models side by side: entropy and warning score of the first, whether it is right, and whether they differ."""
    own = primary.select(key, "true_label", F.col("predicted_label").alias("primary_label"), F.col("probability").alias("primary_probability"), S.row_entropy(F.array(*probabilities)).alias("entropy"))
    other = comparison.select(key, F.col("predicted_label").alias("comparison_label"))
    both = own.join(other, key, "left")
    differ = ~F.coalesce(F.col("primary_label") == F.col("comparison_label"), F.lit(False))
    return both.withColumn("correct", F.col("primary_label") == F.col("true_label")).withColumn("disagree", differ).withColumn("warning_score", 1 - F.col("primary_probability"))


def contradictions(df: DataFrame, label: str, truth: str, others: dict[str, str], labels: list) -> DataFrame:
    """Per label its rows and, for each output, the share in percent that contradicts the truth; labels without rows have n 0."""
    every = df.sparkSession.createDataFrame([(x,) for x in labels], f"{label} {df.schema[label].dataType.simpleString()}")

    def wrong(c: str) -> Column:
        return 100 * (1 - F.avg(F.coalesce(F.col(c) == F.col(truth), F.lit(False)).cast("double")))

    found = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[wrong(c).alias(f"{name}_contradiction") for name, c in others.items()])
    return F.broadcast(every).join(found, label, "left").fillna(0, ["n"])


def metric_ranges(metrics: DataFrame, key: str, columns: list[str], other: DataFrame, compared: str) -> DataFrame:
    """Per row the lowest and highest of the metrics, and how far the compared one leads that of another model."""
    against = other.select(key, F.col(compared).alias(f"other_{compared}"))
    low, high = F.least(*columns), F.greatest(*columns)
    return metrics.join(against, key, "left").select(key, *columns, low.alias("low"), high.alias("high"), f"other_{compared}", (F.col(compared) - F.col(f"other_{compared}")).alias("lead"))


def stretch_limits(df: DataFrame, value: str, name: str, floor: float | None = None, ceiling: float | None = None) -> DataFrame:
    """2nd and 98th percentile of finite values; the lower one no lower than ``floor``, the upper no lower than ``ceiling``."""
    own = df.select(S.parse_number(F.col(value)).alias("v"))
    q = quantiles(own, ["v"], [], [0.02, 0.98]).select(F.col("q")[0].alias("a"), F.col("q")[1].alias("b"))
    low = F.greatest(F.lit(float(floor)), F.col("a")) if floor is not None else F.col("a")
    high = F.greatest(F.lit(float(ceiling)), F.col("b")) if ceiling is not None else F.col("b")
    return q.select(F.lit(name).alias("name"), low.alias("p02"), high.alias("p98"))


def recipe_curve(summary: DataFrame, recipe: str, metric: str, features: str, order: list[str]) -> DataFrame:
    """The recipes of ``order`` with position, features and metric, and best, 1 for the first of the highest metric."""
    place = F.element_at(F.create_map(*[F.lit(x) for k, r in enumerate(order) for x in (r, k)]), F.col(recipe))
    own = summary.filter(F.col(recipe).isin(order)).select(recipe, place.alias("position"), features, metric)
    top = own.agg(F.min(F.struct((-F.col(metric)).alias("m"), "position")).alias("b")).select(F.col("b.position").alias("_top"))
    return own.crossJoin(F.broadcast(top)).withColumn("best", (F.col("position") == F.col("_top")).cast("int")).drop("_top")


def massing(buildings: DataFrame, floors: str, storey: float = 3.2, exaggeration: float = 1.0) -> DataFrame:
    """buildings with height: at least one floor, of ``storey`` metres."""
    return buildings.withColumn("height", F.greatest(F.coalesce(F.col(floors), F.lit(1)), F.lit(1)) * storey * exaggeration)


def chord_totals(confusion: DataFrame, true_label: str = "true_label", predicted: str = "predicted_label", n: str = "n") -> DataFrame:
    """Per label: rows that leave it, stay, and come in by prediction, their total, and its share of all totals."""
    off = F.col(true_label) != F.col(predicted)
    out = confusion.groupBy(F.col(true_label).alias("label")).agg(F.sum(F.when(off, F.col(n)).otherwise(0)).alias("outgoing"), F.sum(F.when(~off, F.col(n)).otherwise(0)).alias("kept"))
    into = confusion.groupBy(F.col(predicted).alias("label")).agg(F.sum(F.when(off, F.col(n)).otherwise(0)).alias("incoming"))
    both = out.join(into, "label").withColumn("total", F.col("outgoing") + F.col("kept") + F.col("incoming"))
    whole = both.agg(F.sum("total").alias("_all"))
    return both.crossJoin(F.broadcast(whole)).select("label", "outgoing", "kept", "incoming", "total", (F.col("total") / F.col("_all")).alias("share"))


def sheet_template(df: DataFrame, keep: list[str], added: list[str], order: list[str] | None = None) -> DataFrame:
    """The wanted columns that df has, with empty text columns to fill in."""
    own = df.orderBy(*order) if order else df
    return own.select(*[c for c in keep if c in df.columns], *[F.lit("").alias(c) for c in added])
