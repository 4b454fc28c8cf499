"""Audit checks: one rule per kind of issue, scored priorities and agreement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions import scalar as S

from .ranking import row_numbers


def issue(df: DataFrame, key: str, field: str, severity: str, name: str, test: Column, value: Column) -> DataFrame:
    return df.filter(test).select(F.col(key).alias("id"), F.lit(field).alias("field"), F.lit(severity).alias("severity"), F.lit(name).alias("issue"), value.cast("string").alias("value"))


def audit_issues(audit: DataFrame, source: DataFrame, key: str, label: str, codebook: list, quality: str, fixed: list[str], date: str | None = None) -> DataFrame:
    """Issues of an audit sheet against its source: keys missing on either side, duplicates, unknown or missing labels, changed fixed
    fields, out-of-range quality and bad dates; one DataFrame per rule, then their union."""
    text = F.trim(F.coalesce(F.col(label).cast("string"), F.lit("")))
    twice = audit.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key))).filter("_n > 1").drop("_n")
    rules = [
        issue(audit.join(source, key, "left_anti"), key, key, "error", "unknown_id", F.lit(True), F.col(key)),
        issue(source.join(audit, key, "left_anti"), key, key, "error", "missing_id", F.lit(True), F.col(key)),
        issue(twice, key, key, "error", "duplicate_id", F.lit(True), F.col(key)),
        issue(audit, key, label, "warning", "missing_label", text == "", text),
        issue(audit, key, label, "error", "label_not_in_codebook", (text != "") & ~text.isin([str(x) for x in codebook]), text),
        issue(audit, key, quality, "error", "bad_quality", F.col(quality).isNotNull() & ~F.col(quality).isin(0, 1), F.col(quality)),
    ]
    if fixed:
        both = audit.join(source.select(key, *[F.col(c).alias(f"_s_{c}") for c in fixed]), key)
        for c in fixed:
            own, other = F.col(c), F.col(f"_s_{c}")
            same = S.close_to(own, other) if audit.schema[c].dataType.simpleString() in ("double", "float") else own.eqNullSafe(other)
            rules.append(issue(both, key, c, "error", "fixed_field_changed", ~same, own))
    if date:
        d = F.trim(F.coalesce(F.col(date), F.lit("")))
        rules.append(issue(audit, key, date, "warning", "bad_date", (d != "") & S.iso_date(d).isNull(), d))
    return reduce(DataFrame.unionByName, rules)


def audit_status(issues: DataFrame, audit: DataFrame, label: str) -> DataFrame:
    """blocked with any error, incomplete while labels lack, else ready."""
    counts = issues.agg(F.sum((F.col("severity") == "error").cast("long")).alias("errors"), F.sum((F.col("severity") == "warning").cast("long")).alias("warnings"))
    done = audit.agg(F.count(F.lit(1)).alias("rows"), F.sum((F.trim(F.coalesce(F.col(label).cast("string"), F.lit(""))) != "").cast("long")).alias("labelled"))
    both = counts.crossJoin(done)
    status = F.when(F.coalesce("errors", F.lit(0)) > 0, "blocked").when(F.col("labelled") < F.col("rows"), "incomplete").otherwise("ready")
    return both.select(F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("warnings", F.lit(0)).alias("warnings"), "rows", "labelled", status.alias("status"))


def priority(df: DataFrame, key: str, confidence: str, tests: list[tuple[str, float, Column]], breaks: tuple[int, ...] = (150, 350)) -> DataFrame:
    """Score (2.5 times the doubt, and points of each test that holds), reasons, rank (score down, confidence up, key) and pass."""
    doubt = 2.5 * (1 - F.least(F.greatest(F.coalesce(S.parse_number(F.col(confidence)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))
    score = reduce(lambda a, b: a + b, [F.when(F.coalesce(t, F.lit(False)), F.lit(float(p))).otherwise(F.lit(0.0)) for _, p, t in tests], doubt)
    reasons = F.array_join(F.array_compact(F.array(F.when(doubt >= 0.75, F.lit("low_confidence")), *[F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, _, t in tests])), ";")
    out = df.select(key, confidence, score.alias("score"), reasons.alias("reasons"))
    ranked = row_numbers(out, [F.col("score").desc(), F.col(confidence).asc_nulls_last(), F.col(key)], [], "rank").drop("rank_of")
    named = F.when(F.col("rank") <= breaks[0], "pass_1").when(F.col("rank") <= breaks[1], "pass_2").otherwise("pass_3")
    return ranked.withColumn("audit_pass", named)


# What an audit sheet must hold, and the names of its states.
QUALITIES = ["high", "medium", "low", "reject_edge"]
REQUIRED = ["dominant_fabric_note", "audit_source_layers", "audit_reviewer", "audit_date"]


def _text(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))


def gate_issues(audit: DataFrame, source: DataFrame, key: str, codebook: DataFrame, texts: list[str], numbers: list[str], fields: list[str], required: list[str] = REQUIRED) -> DataFrame:
    """Issues of a finished audit sheet: grid_id, field, severity, issue, value.

    Columns that the sheet must have and hasn't are reported, and then nothing but its ids is looked at.  codebook: a column
    audit_label.  ``texts`` and ``numbers`` are fields that must be as in the source; ``fields`` are the auditor's.
    """
    session = audit.sparkSession
    kinds = "grid_id string, field string, severity string, issue string, value string"
    missing = [c for c in [key, *texts, *numbers, *fields] if c not in audit.columns]
    out = [session.createDataFrame([("", c, "error", "required_column_missing", "") for c in missing], kinds)]

    def add(df: DataFrame, field: str, severity: str, issue: str, test: Column | None = None, value: Column | None = None) -> None:
        rows = df if test is None else df.filter(F.coalesce(test, F.lit(False)))
        out.append(rows.select(F.col(key).cast("string").alias("grid_id"), F.lit(field).alias("field"), F.lit(severity).alias("severity"), F.lit(issue).alias("issue"), (F.lit("") if value is None else F.coalesce(value.cast("string"), F.lit(""))).alias("value")))

    again = audit.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    add(audit.join(again, key, "left_semi"), key, "error", "duplicate_grid_id", value=F.col(key))
    add(audit.select(key).distinct().join(source, key, "left_anti"), key, "error", "grid_id_not_in_source_gpkg", value=F.col(key))
    add(source.select(key).distinct().join(audit, key, "left_anti"), key, "error", "source_grid_id_missing_from_csv", value=F.col(key))
    if missing:
        return reduce(DataFrame.unionByName, out)
    absent = [c for c in [*texts, *numbers] if c not in source.columns]
    out.append(session.createDataFrame([("", c, "warning", "fixed_field_not_available_in_source_gpkg", "") for c in absent], kinds))
    fixed = [c for c in [*texts, *numbers] if c not in absent]
    both = audit.join(source.select(key, *[F.col(c).alias(f"_s_{c}") for c in fixed]), key)
    for c in fixed:
        same = S.close_to(S.parse_number(F.col(c)), S.parse_number(F.col(f"_s_{c}"))) if c in numbers else _text(c) == _text(f"_s_{c}")
        add(both, c, "error", "fixed_source_field_changed", ~same, F.col(c))
    label, quality, date = _text("audit_label"), _text("label_quality"), _text("audit_date")
    done = label != ""
    known = codebook.select(F.col("audit_label").cast("string").alias("_label")).distinct()
    add(audit, "audit_label", "error", "partial_row_without_audit_label", ~done & reduce(lambda a, b: a | b, [_text(c) != "" for c in fields]))
    add(audit.filter(done).join(known, label == F.col("_label"), "left_anti"), "audit_label", "error", "invalid_audit_label", value=label)
    add(audit, "label_quality", "error", "invalid_or_missing_label_quality", done & ~quality.isin(QUALITIES), quality)
    for c in required:
        add(audit, c, "error", "required_audit_field_missing", done & (_text(c) == ""))
    add(audit, "audit_date", "error", "date_not_iso_yyyy_mm_dd", done & (date != "") & S.iso_date(date).isNull(), date)
    add(audit, "label_quality", "error", "edge_insufficient_requires_reject_edge", (label == "edge_insufficient") & (quality != "reject_edge"), quality)
    add(audit, "audit_label", "warning", "reject_edge_quality_with_non_edge_label", done & (quality == "reject_edge") & (label != "edge_insufficient"), label)
    add(audit, "label_quality", "warning", "ambiguous_label_marked_high_quality", label.isin("mixed", "uncertain") & (quality == "high"), quality)
    return reduce(DataFrame.unionByName, out)


def gate_summary(audit: DataFrame, issues: DataFrame, codebook: DataFrame, weak: str, mapping: dict) -> DataFrame:
    """One row: status, rows, completed and valid rows, rows per quality, errors, warnings, exact agreement of weak labels, and ready."""
    label, quality = _text("audit_label"), _text("label_quality")
    known = codebook.select(F.col("audit_label").cast("string").alias("_label"), F.lit(True).alias("_known")).distinct()
    own = audit.withColumn("_l", label).withColumn("_q", quality).join(F.broadcast(known), F.col("_l") == F.col("_label"), "left")
    valid = F.coalesce(F.col("_known"), F.lit(False)) & (F.col("_l") != "") & F.col("_q").isin(QUALITIES)
    named = F.element_at(F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]), S.parse_number(F.col(weak)).cast("int"))
    agrees = F.coalesce(named == F.col("_l"), F.lit(False)).cast("double")
    sums = own.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_l") != "").alias("completed_rows"), F.count_if(valid).alias("valid_completed_rows"),
        *[F.count_if(F.col("_q") == q).alias(f"{q}_rows") for q in QUALITIES], F.avg(F.when(valid, agrees)).alias("exact_agreement"),
    )
    counts = issues.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    wrong = F.col("errors") > 0
    status = F.when(F.col("completed_rows") == 0, "not_started").when(F.col("completed_rows") < F.col("rows"), F.when(wrong, "partial_with_errors").otherwise("partial")).when(wrong, "complete_with_errors").otherwise("ready")
    out = sums.crossJoin(counts).withColumn("status", status)
    return out.withColumn("ready", (F.col("status") == "ready") & (F.col("high_rows") > 0)).withColumn("completion_share", F.coalesce(F.try_divide("completed_rows", "rows"), F.lit(0.0)))
