"""Ordered rules as tables: which rule of a set fires first for a run, what flags are raised, which outcome and follow-ups result.

The package ships no rules. Tables of rules, flags, outcomes and follow-ups are the user's (from settings or anywhere else); they are small, which is checked, and
broadcast, runs may be any number. Ranks are integers inside the plan: 0 low, 1 medium, 2 high.

Rule kinds: `any_low` (some required category is low), `marked_below` (a marked category is below `level`), `count_at` (at least `least` categories are at
`level`), `default` (always). A rule's `result` is a confidence, or null for that of the weakest category.

Defined results: categories that a task requires but a run lacks are skipped and listed in `missing`; a run without any required category
is listed with a null confidence; rules of equal order go by their id; with no rule firing the weakest category counts, with rule id `fallback`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.operators.bands import small

LEVELS = ("low", "medium", "high")
KINDS = ("any_low", "marked_below", "count_at", "default")

REQUIRED = "task string, category string, ord int, marked boolean"
RULES = "tier string, rule_id string, ord int, kind string, level string, least int, result string, reason string"
FLAGS = "flag_id string, ord int, category string, level string, tiers array<string>, tasks array<string>, reason string"
OUTCOMES = "ord int, confidence string, flagged boolean, outcome string"
FOLLOW_UPS = "category string, ord int, text string"


def rank(level: Column) -> Column:
    return F.array_position(F.array(*(F.lit(x) for x in LEVELS)), level).cast("int") - 1


def named(r: Column) -> Column:
    return F.get(F.array(*(F.lit(x) for x in LEVELS)), r)


def applies(tiers: Column, tasks: Column, tier: Column, task: Column) -> Column:
    """A null list applies to all."""
    return F.coalesce(F.array_contains(tiers, tier), F.lit(True)) & F.coalesce(F.array_contains(tasks, task), F.lit(True))


def gathered(runs: DataFrame, categories: DataFrame, required: DataFrame) -> DataFrame:
    """One row per run (run_id, task, tier): its required categories with rank and mark, in their order, and what is missing."""
    wanted = runs.join(small(required), "task", "left")
    met = wanted.join(categories.select("run_id", "category", rank(F.col("confidence")).alias("rank")), ["run_id", "category"], "left")
    one = F.struct("ord", "category", "rank", "marked")
    present = F.array_sort(F.collect_list(F.when(F.col("rank").isNotNull(), one)))
    missing = F.array_sort(F.collect_list(F.when(F.col("rank").isNull() & F.col("category").isNotNull(), F.col("category"))))
    return met.groupBy("run_id", "task", "tier").agg(present.alias("held"), missing.alias("missing"))


def _fires(held: Column) -> Column:
    level = rank(F.col("level"))
    marked = F.exists(held, lambda c: c["marked"] & (c["rank"] < level))
    counted = F.size(F.filter(held, lambda c: c["rank"] == level)) >= F.col("least")
    low = F.exists(held, lambda c: c["rank"] == 0)
    return F.when(F.col("kind") == "any_low", low).when(F.col("kind") == "marked_below", marked).when(F.col("kind") == "count_at", counted).otherwise(F.col("kind") == "default")


def evaluate(runs: DataFrame, categories: DataFrame, required: DataFrame, rules: DataFrame, flags: DataFrame, outcomes: DataFrame, otherwise: str) -> DataFrame:
    """Per run: confidence, rule_id, reason, flag, outcome (`otherwise` if no row of `outcomes` fits), missing."""
    unknown = rules.filter(~F.col("kind").isin(*KINDS)).select("rule_id").limit(5).collect()  # the rules are a small table
    if unknown:
        raise ValueError(f"unknown kinds of rules: {[r[0] for r in unknown]}")
    base = gathered(runs, categories, required)
    held = F.col("held")
    weakest = F.array_min(F.transform(held, lambda c: c["rank"]))
    fired = base.join(small(rules), (base["tier"] == rules["tier"]) & (F.size("held") > 0) & _fires(held), "left").select(base["run_id"], base["task"], base["tier"], "held", "missing", "rule_id", "ord", "result", "reason")
    first = fired.groupBy("run_id", "task", "tier").agg(F.first("held").alias("held"), F.first("missing").alias("missing"), F.min_by(F.struct("rule_id", "result", "reason"), F.struct(F.coalesce("ord", F.lit(2147483647)), "rule_id")).alias("r"))
    confident = first.withColumn("confidence", F.coalesce("r.result", named(weakest)))
    flag = flags.select("flag_id", F.col("ord").alias("flag_ord"), F.col("category").alias("flag_category"), rank(F.col("level")).alias("flag_rank"), "tiers", "tasks", F.col("reason").alias("flag_reason"))
    raised = applies(F.col("tiers"), F.col("tasks"), F.col("tier"), F.col("task")) & F.exists(held, lambda c: (c["category"] == F.col("flag_category")) & (c["rank"] == F.col("flag_rank")))
    flagged = confident.join(small(flag), raised, "left")
    one = flagged.groupBy("run_id", "task", "tier").agg(*(F.first(c).alias(c) for c in ("held", "missing", "r", "confidence")), F.min_by(F.struct("flag_id", "flag_reason"), F.struct(F.coalesce("flag_ord", F.lit(2147483647)), "flag_id")).alias("f"))
    out = outcomes.select(F.col("ord").alias("out_ord"), F.col("confidence").alias("out_confidence"), "flagged", "outcome")
    has = F.col("f.flag_id").isNotNull()
    fits = (F.col("flagged") & has) | (~F.col("flagged") & ~has & (F.col("out_confidence") == F.col("confidence")))
    mapped = one.join(small(out), fits, "left").groupBy("run_id", "task", "tier").agg(*(F.first(c).alias(c) for c in ("held", "missing", "r", "f", "confidence")), F.min_by("outcome", F.coalesce("out_ord", F.lit(2147483647))).alias("outcome"))
    rule = F.coalesce("r.rule_id", F.when(F.size("held") > 0, F.lit("fallback")))
    why = F.when(F.col("f.flag_reason").isNotNull(), F.concat(F.col("f.flag_reason"), F.lit(" (rule: "), F.coalesce("r.reason", F.lit("")), F.lit(")"))).otherwise(F.col("r.reason"))
    return mapped.select("run_id", "task", "tier", "confidence", rule.alias("rule_id"), why.alias("reason"), F.col("f.flag_id").alias("flag"), F.coalesce("outcome", F.lit(otherwise)).alias("outcome"), "held", "missing")


def follow_ups(evaluated: DataFrame, texts: DataFrame) -> DataFrame:
    """Per run the texts of the categories that decided, in order: the low ones if a flag was raised and there are any, else all below high."""
    low = F.filter("held", lambda c: c["rank"] == 0)
    below = F.filter("held", lambda c: c["rank"] < 2)
    drivers = F.when(F.col("flag").isNotNull() & (F.size(low) > 0), low).otherwise(below)
    spread = evaluated.select("run_id", F.explode(drivers).alias("c")).select("run_id", F.col("c.ord").alias("cat_ord"), F.col("c.category").alias("category"))
    joined = spread.join(small(texts), "category")
    line = F.concat(F.lit("["), F.col("category"), F.lit("] "), F.col("text"))
    return joined.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("cat_ord", "ord", line.alias("line")))), lambda x: x["line"]).alias("follow_ups"))
