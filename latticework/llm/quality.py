"""Quality rules: text statistics and learned decision lists; DataFrame functions only.

A decision list is learned by sequential covering.  A rule grows one threshold condition at a time by FOIL's information gain on
two thirds of the labelled rows, is pruned back on the other third, and stays if it is precise enough there; the rows it covers
leave, and the next rule is learned.  All counting is Spark aggregation over a table of binned statistics; the driver sees only
sums per feature and bin.  The list compiles to an ordered conditional expression, so applying it is one projection.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, free_name, table

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Labelled rows that a list is fitted on, at most: those whose id hashes lowest.
FIT_ROWS = 50_000

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def quality_statistics(docs: DataFrame, text_col: str = "text", name: str = "stats") -> DataFrame:
    """The documents with a struct column ``name`` of text statistics (null text: all zero).

    Counts are exact on texts of any length: a document's words are held as one array in its task, and 3-word windows that hash alike
    are told apart by their words.  An empty table gives an empty result; the working columns take names that docs doesn't have.

    Longs: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_exclaim.  Doubles: shares of them, 0
    where the denominator is 0.  Boolean: base_failed.
    """
    t, w, s, p, d, e, c = (free_name(docs, f"quality_{x}") for x in "twspdec")
    out = docs.withColumn(t, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    out = out.withColumn(w, F.regexp_extract_all(t, F.lit(WORD), F.lit(0)))
    # Each 3-word window becomes a long: as many hash bits as fit above its position.  Sorted, windows that may be equal are neighbours.
    out = out.withColumn(s, F.expr(f"cast(ceil(log2(size({w}) + 1)) as int)"))
    out = out.withColumn(p, F.expr(f"sort_array(transform(slice({w}, 1, greatest(size({w}) - 2, 0)), (x, i) -> shiftleft(xxhash64(x, {w}[i + 1], {w}[i + 2]), {s}) | cast(i as bigint)))"))
    same = f"shiftrightunsigned(x ^ get({p}, j - 1), {s}) = 0 or shiftrightunsigned(x ^ get({p}, j + 1), {s}) = 0"
    # Of those the words themselves decide: sorted by whole hash and words, equal windows are neighbours, and only they are.
    out = out.withColumn(e, F.expr(f"sort_array(transform(transform(filter({p}, (x, j) -> coalesce({same}, false)), x -> named_struct('i', cast(x & (shiftleft(1L, {s}) - 1) as int))), y -> named_struct('h', xxhash64({w}[y.i], {w}[y.i + 1], {w}[y.i + 2]), 'a', {w}[y.i], 'b', {w}[y.i + 1], 'c', {w}[y.i + 2], 'i', y.i)))"))
    equal = " or ".join(f"(x.h = get({e}, {k}).h and x.a = get({e}, {k}).a and x.b = get({e}, {k}).b and x.c = get({e}, {k}).c)" for k in ("j - 1", "j + 1"))
    out = out.withColumn(d, F.expr(f"sort_array(transform(filter({e}, (x, j) -> coalesce({equal}, false)), x -> cast(x.i as bigint)))"))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = {
        "n_words": F.size(w),
        "word_chars": F.length(F.translate(F.col(t), " \t\n\x0b\x0c\r", "")),
        "n_symbols": F.length(t) - F.length(F.translate(F.col(t), SYMBOLS, "")),
        "lines": lines,
        "n_repeat_words": F.expr(f"aggregate(transform({d}, (x, k) -> least(3L, coalesce(get({d}, k + 1), x + 3L) - x)), 0L, (a, x) -> a + x)"),
        "n_upper": F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")),
        "n_exclaim": F.length(t) - F.length(F.replace(F.col(t), F.lit("!"), F.lit(""))),
    }
    out = out.withColumn(c, F.struct(*[v.alias(k) for k, v in counts.items()]))
    long = {k: F.col(f"{c}.{k}").cast("long") for k in ("n_words", "word_chars", "n_symbols", "n_repeat_words", "n_upper", "n_exclaim")}
    long["n_lines"] = F.size(F.col(f"{c}.lines")).cast("long")
    long["n_dup_lines"] = long["n_lines"] - F.size(F.array_distinct(F.col(f"{c}.lines"))).cast("long")

    def share(a: str, b: str) -> Column:
        return F.when(long[b] > 0, long[a] / long[b]).otherwise(F.lit(0.0))

    shares = {
        "mean_word": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "upper_share": share("n_upper", "word_chars"),
        "exclaim_share": share("n_exclaim", "n_words"),
        "line_share": share("n_lines", "n_words"),
    }
    failed = (long["n_words"] < 50) | (100 * long["n_repeat_words"] > 50 * long["n_words"])
    stats = F.struct(*[v.alias(k) for k, v in (long | shares).items()], failed.alias("base_failed"))
    # explode_outer of one element keeps later filters from being pushed below, which would copy the whole computation into them.
    return out.withColumn(name, stats).select(*[x for x in docs.columns if x.lower() != name.lower()], F.explode_outer(F.array(name)).alias(name))


FEATURES = ["n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "exclaim_share", "line_share"]


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self, stats: str) -> Column:
        value = F.col(f"{stats}.{self.feature}")
        return value >= self.threshold if self.at_least else value < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold!r}"


@dataclass(frozen=True)
class Rule:
    """A conjunction that rejects, with its precision and coverage on the pruning rows."""

    conditions: tuple[Condition, ...]
    precision: float
    covered: int

    def column(self, stats: str) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column(stats)
        return out


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...]

    def rule_number(self, stats: str) -> Column:
        """The first rule that holds, from 1; 0 if none does."""
        if not self.rules:
            return F.lit(0)
        out = F.when(self.rules[0].column(stats), F.lit(1))
        for k, rule in enumerate(self.rules[1:], 2):
            out = out.when(rule.column(stats), F.lit(k))
        return out.otherwise(F.lit(0))

    def sql(self) -> str:
        if not self.rules:
            return "0"
        cases = " ".join(f"WHEN {' AND '.join(map(str, r.conditions))} THEN {k}" for k, r in enumerate(self.rules, 1))
        return f"CASE {cases} ELSE 0 END"


def labelled_sample(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> DataFrame:
    """id and label (0 or 1) of at most ``fit_rows`` labelled ids, those that hash lowest; ids with conflicting labels are left out."""
    own = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("label")).filter(F.col("label_id").isNotNull() & F.col("label").isin(0, 1))
    agreed = own.groupBy("label_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter(F.col("label") == F.col("other"))
    return agreed.select("label_id", "label").orderBy(F.xxhash64("label_id"), "label_id").limit(fit_rows)


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def learn(rows: DataFrame, features: list[str] = FEATURES, max_rules: int = 8, max_conditions: int = 3, min_precision: float = 0.95, min_covered: int = 5) -> DecisionList:
    """A list of rules that reject rows of label 0 (rows: columns label, stats and grow, a boolean)."""
    quantiles = [0.005, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.995]
    asked = [F.percentile(F.when(F.col("label") == k, F.col(f"stats.{f}")), quantiles).alias(f"{f}_{k}") for f in features for k in (0, 1)]
    asked += [F.max(F.when(F.col("label") == k, F.col(f"stats.{f}"))).cast("double").alias(f"{f}_top_{k}") for f in features for k in (0, 1)]
    asked += [F.min(F.when(F.col("label") == k, F.col(f"stats.{f}"))).cast("double").alias(f"{f}_low_{k}") for f in features for k in (0, 1)]
    seen = rows.agg(*asked).first()
    edges: dict[str, list[float]] = {}
    gaps: dict[str, list[float]] = {}
    for f in features:
        raw = {x for k in (0, 1) for x in (*(seen[f"{f}_{k}"] or ()), seen[f"{f}_top_{k}"], seen[f"{f}_low_{k}"]) if x is not None}
        ordered = sorted(raw)
        edges[f] = [(a + b) / 2 for a, b in zip(ordered[:-1], ordered[1:], strict=True)]  # between observed values
        gaps[f] = [(b - a) / (abs(a) + abs(b)) for a, b in zip(ordered[:-1], ordered[1:], strict=True)]

    def bin_of(f: str) -> Column:
        value = F.col(f"stats.{f}")
        return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges[f]]), lambda e: e <= value)) if edges[f] else F.lit(0)

    binned = [bin_of(f).alias(f"b_{f}") for f in features]
    cube = cut(rows.select("label", "grow", *binned).groupBy("label", "grow", *[f"b_{f}" for f in features]).agg(F.count(F.lit(1)).alias("n")))

    def holds(bins: list[tuple[str, bool, int]]) -> Column:
        out = F.lit(True)
        for f, at_least, k in bins:
            out = out & ((F.col(f"b_{f}") >= k) if at_least else (F.col(f"b_{f}") < k))
        return out

    left, rules = F.lit(True), []
    while len(rules) < max_rules:
        chosen: list[tuple[str, bool, int]] = []
        while len(chosen) < max_conditions:
            long = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"b_{f}").alias("b")) for f in features])).alias("x")
            got = cube.filter(F.col("grow") & left & holds(chosen)).select(long, "label", "n").groupBy("x.f", "x.b", "label").agg(F.sum("n").alias("n")).collect()
            table_: dict[str, dict[tuple[int, int], int]] = {f: {} for f in features}
            for r in got:
                table_[r["f"]][(r["b"], r["label"])] = r["n"]
            p0, n0 = (sum(n for (_, y), n in table_[features[0]].items() if y == k) for k in (0, 1))
            if not p0 or not n0:
                break
            best = (1e-9, 0.0, None)  # of equal gains the threshold in the widest gap between observed values
            for f in features:
                for k in range(1, len(edges[f]) + 1):
                    p, n = (sum(x for (b, y), x in table_[f].items() if y == z and b >= k) for z in (0, 1))
                    for at_least, pp, nn in ((True, p, n), (False, p0 - p, n0 - n)):
                        best = max(best, (round(_gain(pp, nn, p0, n0), 9), gaps[f][k - 1], (f, at_least, k)), key=lambda x: x[:2])
            if best[2] is None:
                break
            chosen.append(best[2])
        if not chosen:
            break
        worth = [F.sum(F.when(holds(chosen[:k]) & (F.col("label") == y), F.col("n")).otherwise(0)).alias(f"c{k}_{y}") for k in range(1, len(chosen) + 1) for y in (0, 1)]
        held = cube.filter(~F.col("grow") & left).agg(*worth).first()
        scored = [((p - n) / (p + n) if p + n else -1.0, -k, k, p, n) for k in range(1, len(chosen) + 1) for p, n in [(held[f"c{k}_0"] or 0, held[f"c{k}_1"] or 0)]]
        _, _, k, p, n = max(scored)
        if p + n < min_covered or p / (p + n) < min_precision:
            break
        rules.append(Rule(tuple(Condition(f, up, edges[f][b - 1]) for f, up, b in chosen[:k]), p / (p + n), p + n))
        left = left & ~holds(chosen[:k])
    return DecisionList(tuple(rules))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS, label_id_col: str = "doc_id") -> DecisionList:
    """A decision list from the labelled documents (labels: ``label_id_col`` and ``label_col``); without labels of both kinds it has no
    rule and keeps everything.

    The sample of labels has ``fit_rows`` rows of two numbers at most (1.2 MB at the default), so it is broadcast.
    """
    sample = cut(labelled_sample(labels, label_id_col, label_col, fit_rows))
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), F.col("id") == F.col("label_id"))
    rows = quality_statistics(own, "text", "stats").filter(~F.col("stats.base_failed")).select("label", "stats", (F.pmod(F.xxhash64("label_id", F.lit(11)), F.lit(3)) != 0).alias("grow"))
    return learn(cut(rows))


def judge(docs: DataFrame, rules: DecisionList, text_col: str = "text", name: str = "stats") -> DataFrame:
    """The documents with the statistics struct and, in it, rule (the list's verdict: 0 or the rule that rejects) and kept.

    Null and empty texts fail the base rules; repeated rows are judged alike; whole texts are read, however long; an empty table gives an
    empty result, and a column called ``name`` is replaced.
    """
    rated = quality_statistics(docs, text_col, name)
    rule = rules.rule_number(name)
    return rated.withColumn(name, F.struct(F.col(f"{name}.*"), rule.alias("rule"), (~F.col(f"{name}.base_failed") & (rule == 0)).alias("kept")))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", label_id_col: str = "doc_id") -> DataFrame:
    """The documents, with all their columns, that neither fail the base rules nor meet a rule learned from the labels.

    Null and empty texts fail the base rules.  Repeated rows are judged alike; an empty table gives an empty result.
    """
    name = free_name(docs, "quality_stats")
    return judge(docs, fit_quality(docs, labels, id_col, text_col, label_col, label_id_col=label_id_col), text_col, name).filter(F.col(f"{name}.kept")).select(*docs.columns)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit_quality(docs, table(spark, sf_dir, "labels"))
    return judge(docs, rules).select("doc_id", *[f"stats.{c}" for c in COUNTS], "stats.base_failed", "stats.kept", "stats.rule")
