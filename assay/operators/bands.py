"""Metric values in bands, bands to a confidence per category, and ordered rules where the first match wins.

Bounds are a table, not code: they are joined (few rows, checked and broadcast) and applied in one pass over any number of runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.scalars import label, round4, utc_minute

#: Metric, category, direction, bound of the strong band, bound of the moderate band.
BANDS = (
    ("tstr", "utility", "higher", 0.95, 0.90),
    ("auc_gap", "utility", "lower", 0.03, 0.06),
    ("decision_agreement", "utility", "higher", 0.85, 0.70),
    ("demographic_parity", "fairness", "lower", 0.05, 0.10),
    ("equal_opportunity", "fairness", "lower", 0.05, 0.10),
    ("subgroup_performance", "fairness", "higher", 0.90, 0.80),
    ("membership_inference", "privacy", "lower", 0.05, 0.10),
    ("nn_distance_ratio", "privacy", "higher", 1.00, 0.80),
    ("duplicate_rate", "privacy", "lower", 0.01, 0.05),
    ("brier_score", "calibration", "lower", 0.18, 0.25),
    ("expected_calibration_error", "calibration", "lower", 0.05, 0.10),
    ("tail_coverage", "robustness", "higher", 0.90, 0.75),
    ("perturbation_stability", "robustness", "higher", 0.90, 0.80),
    ("rare_event_recall", "rare_event", "higher", 0.90, 0.75),
    ("rare_event_coverage", "rare_event", "higher", 0.90, 0.75),
)

DIRECTIONS = ("higher", "lower")


def band_table(spark: SparkSession, bands: tuple = BANDS) -> DataFrame:
    """Bounds as a table; an unknown direction is an error before any plan runs."""
    for metric, _, direction, _, _ in bands:
        if direction not in DIRECTIONS:
            raise ValueError(f"unknown direction {direction!r} of {metric!r}")
    return spark.createDataFrame([(*b,) for b in bands], "metric_key string, category string, direction string, strong_at double, weak_below double")


def latest(values: DataFrame, keys: list[str], time: str) -> DataFrame:
    """The last row of each key; ties go to the row that sorts last as a whole. Aggregated, so partial on the map side; whole null keys are a key of their own."""
    rest = [c for c in values.columns if c not in keys]
    packed = F.max(F.struct(F.col(time).alias("_t"), *(F.col(c) for c in rest))).alias("_row")
    return values.groupBy(*keys).agg(packed).select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest))


def strength(value: Column, direction: Column, strong_at: Column, weak_below: Column) -> Column:
    """Both bounds belong to the better band. Null and NaN are weak: NaN would compare as the greatest number."""
    higher = F.when(value >= strong_at, "strong").when(value >= weak_below, "moderate").otherwise("weak")
    lower = F.when(value <= strong_at, "strong").when(value <= weak_below, "moderate").otherwise("weak")
    return F.when(value.isNull() | F.isnan(value), "weak").when(direction == "higher", higher).otherwise(lower)


SMALL = 10_000


def small(table: DataFrame) -> DataFrame:
    """A table of rules or bounds, to be sent to all executors; more than `SMALL` rows are refused."""
    if table.limit(SMALL + 1).count() > SMALL:
        raise ValueError(f"a table of rules has more than {SMALL} rows")
    return F.broadcast(table)


def interpret(values: DataFrame, bands: DataFrame) -> DataFrame:
    """Adds the bounds, `strength` and `passed`. Metrics without bounds drop out."""
    joined = values.join(small(bands), "metric_key")
    out = joined.withColumn("strength", strength(F.col("value"), F.col("direction"), F.col("strong_at"), F.col("weak_below")))
    return out.withColumn("passed", F.col("strength") != "weak")


def threshold_text(direction: Column, strong_at: Column, weak_below: Column) -> Column:
    sign = F.when(direction == "higher", ">=").otherwise("<=")
    two = lambda x: F.format_string("%.2f", x)
    return F.concat(sign, F.lit(" "), two(strong_at), F.lit(" strong / "), sign, F.lit(" "), two(weak_below), F.lit(" moderate"))


def by_category(interpreted: DataFrame, run: str = "run_id", order: str = "metric_ord") -> DataFrame:
    """Per run and category the counts, the confidence and what decided it: two weak metrics make it low, one weak or two moderate ones medium."""
    first_of = lambda kind: F.min_by(F.when(F.col("strength") == kind, F.col("metric_key")), F.when(F.col("strength") == kind, F.struct(F.col(order), F.col("metric_key"))))
    count = lambda kind: F.count_if(F.col("strength") == kind)
    out = interpreted.groupBy(run, "category").agg(F.count(F.lit(1)).alias("metrics"), count("weak").alias("weak"), count("moderate").alias("moderate"), first_of("weak").alias("first_weak"), first_of("moderate").alias("first_moderate"))
    weak, moderate = F.col("weak"), F.col("moderate")
    confidence = F.when(weak >= 2, "low").when((weak == 1) | (moderate >= 2), "medium").otherwise("high")
    why = (
        F.when(weak >= 2, F.concat(weak.cast("string"), F.lit(" weak metrics")))
        .when(weak == 1, F.concat(F.lit("one weak metric: "), label(F.col("first_weak"))))
        .when(moderate >= 2, F.concat(moderate.cast("string"), F.lit(" moderate metrics, none weak")))
        .when(moderate == 1, F.concat(F.lit("one moderate metric: "), label(F.col("first_moderate"))))
        .otherwise("all metrics strong")
    )
    return out.withColumn("confidence", confidence).withColumn("reason", why).drop("first_weak", "first_moderate")


def first_match(df: DataFrame, rules: DataFrame, condition: Column, keys: list[str], order: str = "ord", result: str = "outcome", otherwise: str | None = None) -> DataFrame:
    """The outcome of the first rule, by `order`, whose condition holds for a row; `otherwise` if none does. `rules` is a small table,
    checked and broadcast; the choice is an aggregate on the row's keys, partial on the map side."""
    joined = df.join(small(rules), condition, "left")
    picked = joined.groupBy(*keys).agg(F.min_by(result, order).alias(result))
    return picked.withColumn(result, F.coalesce(result, F.lit(otherwise)))


def weakest(confidences: DataFrame, run: str = "run_id") -> DataFrame:
    """The lowest confidence of each run's categories, by rank."""
    rank = F.when(F.col("confidence") == "low", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
    return confidences.groupBy(run).agg(F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.min(rank) + 1).alias("confidence"), F.count_if(F.col("confidence") == "medium").alias("mediums"), F.bool_or(F.col("confidence") == "low").alias("any_low"))


def nested_record(interpreted: DataFrame, categories: DataFrame, run: str = "run_id") -> DataFrame:
    """One nested row per run: its categories in name order, each with its metrics in their order, and all values as a map."""
    metrics = interpreted.groupBy(run, "category").agg(F.transform(F.array_sort(F.collect_list(F.struct("metric_ord", "metric_key", "value", "strength", "passed"))), lambda m: F.struct(m["metric_key"].alias("key"), m["value"].alias("value"), m["strength"].alias("strength"), m["passed"].alias("passed"))).alias("metrics"))
    whole = categories.select(run, "category", "confidence", "reason").join(metrics, [run, "category"])
    nested = whole.groupBy(run).agg(F.array_sort(F.collect_list(F.struct("category", "confidence", "reason", "metrics"))).alias("categories"))
    values = interpreted.groupBy(run).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric_key", "value")))).alias("metric_values"))
    outcome = F.struct(*(F.lit(None).cast(t).alias(n) for n, t in (("deployment_date", "string"), ("incident_observed", "boolean"), ("drift_detected", "boolean"), ("audit_finding", "string"), ("retraining_triggered", "boolean"), ("production_success_label", "int"))))
    return nested.join(values, run).withColumn("production_outcome", outcome)


#: The fields of a whole record, in order; the decision's own fields are taken over from wherever they were decided.
CARRIED = ("record_id", "timestamp_utc", "config_version", "dataset", "task", "risk_tier", "fired_rule_id", "hard_flag", "reason", "recommendation")
RECORD = ("record_id", "timestamp_utc", "config_version", "dataset", "task", "risk_tier", "metric_values", "categories", "overall_confidence", "fired_rule_id", "hard_flag", "reason", "recommendation", "production_outcome")


def last_records(records: DataFrame, run: str = "run_id") -> DataFrame:
    """Of each run the record that came last (ties: the largest log_id), with the carried fields and `ingested_at`."""
    known = records.filter(F.col(run).isNotNull()).select(run, F.struct("ingested_at", "log_id", *CARRIED).alias("_row"))
    return known.groupBy(run).agg(F.max("_row").alias("_row")).select(run, "_row.ingested_at", *(F.col(f"_row.{c}").alias(c) for c in CARRIED))


def whole_record(nested: DataFrame, categories: DataFrame, records: DataFrame, run: str = "run_id") -> DataFrame:
    """Nested rows of `nested_record` with all fields of a record: those of `last_records`, and the weakest category as overall confidence. A run without a record has nulls."""
    overall = weakest(categories, run).select(run, F.col("confidence").alias("overall_confidence"))
    return nested.join(overall, run).join(records, run, "left").select(run, *RECORD)


def report_lines(interpreted: DataFrame, categories: DataFrame, records: DataFrame | None = None, run: str = "run_id") -> DataFrame:
    """A Markdown report of each run, as one text: evidence tables by category and, with `records` of `last_records`, a header, a summary, the bounds that were applied, and what was decided by which rule."""
    value = F.when(F.col("value").isNotNull() & ~F.isnan("value"), F.format_string("%.4f", round4(F.col("value")))).otherwise("-")
    bounds = threshold_text(F.col("direction"), F.col("strong_at"), F.col("weak_below"))
    row = F.concat(F.lit("| "), label(F.col("metric_key")), F.lit(" | "), value, F.lit(" | "), bounds, F.lit(" | "), F.initcap("strength"), F.lit(" |"))
    joined = lambda order, line: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(line)))), lambda x: x[line]), "\n")
    lines = interpreted.withColumn("_row", row).withColumn("_bound", F.concat(F.lit("- "), label(F.col("metric_key")), F.lit(": "), bounds))
    rows = lines.groupBy(run, "category").agg(joined(("metric_ord", "metric_key"), "_row").alias("_rows"))
    part = F.concat(F.lit("### "), label(F.col("category")), F.lit(": "), F.initcap("confidence"), F.lit("\n"), F.col("reason"), F.lit("\n| Metric | Value | Threshold | Strength |\n|---|---|---|---|\n"), F.col("_rows"))
    parts = categories.join(rows, [run, "category"]).withColumn("_part", part)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("category", "_part"))), lambda x: x["_part"]), "\n\n")
    evidence = parts.groupBy(run).agg(text.alias("_evidence"))
    if records is None:
        return evidence.withColumnRenamed("_evidence", "report")
    applied = lines.groupBy(run).agg(joined(("metric_ord", "metric_key"), "_bound").alias("_bounds"))
    overall = weakest(categories, run).select(run, F.initcap("confidence").alias("_overall"))
    every = evidence.join(applied, run).join(overall, run).join(records, run, "left")
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    head = F.concat(F.lit("# Evidence report\n\nRecord: "), said("record_id"), F.lit("\nMade: "), F.coalesce(utc_minute(F.col("ingested_at")), F.lit("-")), F.lit("\nSettings: "), said("config_version"))
    summary = F.concat(F.lit("\n\n## Summary\n\n- Dataset: "), said("dataset"), F.lit("\n- Task: "), F.coalesce(label(F.col("task")), F.lit("-")), F.lit("\n- Risk tier: "), F.coalesce(F.initcap("risk_tier"), F.lit("-")), F.lit("\n- Overall confidence: "), F.col("_overall"), F.lit("\n\n## Evidence\n\n"))
    trail = F.concat(F.lit("\n\n## Bounds applied\n\n"), F.col("_bounds"), F.lit("\n\n## Decision\n\n- Rule: "), said("fired_rule_id"), F.lit("\n- Flag: "), said("hard_flag"), F.lit("\n- Result: "), said("recommendation"), F.lit("\n- Reason: "), said("reason"))
    return every.select(run, F.concat(head, summary, F.col("_evidence"), trail).alias("report"))
