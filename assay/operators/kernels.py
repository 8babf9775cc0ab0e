"""Metric kernels over scored tables: (rid, y, p, pred, pred_other, grp). Each is DataFrame algebra that ends in one row.

Defined results: rows whose inputs are null or NaN are left out of a kernel; a null group is left out and counted apart; empty
tables give the metric's neutral value where it has one, else null.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.scalars import usable
from assay.operators.encode import present
from assay.operators.ranks import exact_quantiles, positions, quantiles, running_sum

#: The lower edges of ten equal bins as doubles, and the upper end.
EDGES = (0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0)


def rates_by_group(df: DataFrame, group: str, y: str) -> DataFrame:
    return df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(y).cast("double")).alias("rate"))


def demographic_parity(df: DataFrame, group: str, y: str) -> DataFrame:
    """Spread of the labels' rate over groups."""
    return rates_by_group(df, group, y).agg(F.coalesce(F.max("rate") - F.min("rate"), F.lit(0.0)).alias("demographic_parity"))


def group_quality(df: DataFrame, group: str, y: str, pred: str) -> DataFrame:
    """equal_opportunity (spread of hit rates among positives; a group without positives has 0) and subgroup_performance (worst accuracy over that of all)."""
    right = (F.col(pred) == F.col(y)).cast("double")
    by = df.filter(F.col(group).isNotNull()).groupBy(group).agg(
        F.coalesce(F.avg(F.when(F.col(y) == 1, (F.col(pred) == 1).cast("double"))), F.lit(0.0)).alias("hits"), F.avg(right).alias("accuracy"), F.sum(right).alias("right"), F.count(F.lit(1)).alias("n")
    )
    whole = by.agg((F.max("hits") - F.min("hits")).alias("eo"), F.min("accuracy").alias("worst"), F.sum("right").alias("right"), F.sum("n").alias("n"))
    overall = F.col("right") / F.col("n")
    return whole.select(F.coalesce("eo", F.lit(0.0)).alias("equal_opportunity"), F.when(F.col("n") > 0, F.when(overall > 0, F.least(F.col("worst") / overall, F.lit(1.0))).otherwise(1.0)).otherwise(1.0).alias("subgroup_performance"))


#: What a table without a sensitive column has, and what one without two classes has instead of a model's metrics.
NO_GROUPS = {"demographic_parity": 0.0, "equal_opportunity": 0.0, "subgroup_performance": 1.0}
ONE_CLASS = {"equal_opportunity": 0.0, "subgroup_performance": 1.0}


def fairness(df: DataFrame, group: str | None, y: str, predicted: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """demographic_parity, equal_opportunity and subgroup_performance of a table and of the predictions (`pred`) that `predicted` adds to it.

    Without a sensitive column, or where it is named but not there, the neutral values; with fewer than two classes parity and neutral values, and no model is asked."""
    if not present(df, group):
        return df.limit(0).agg(*(F.coalesce(F.max(F.lit(v)), F.lit(v)).alias(n) for n, v in NO_GROUPS.items()))
    parity = demographic_parity(df, group, y)
    if df.filter(F.col(y).isNotNull()).select(F.col(y).cast("int")).distinct().limit(2).count() < 2:
        return parity.select("*", *(F.lit(v).alias(n) for n, v in ONE_CLASS.items()))
    return parity.crossJoin(group_quality(predicted(df), group, y, "pred"))


def agreement(df: DataFrame, one: str, other: str) -> Column:
    return F.avg((F.col(one) == F.col(other)).cast("double"))


def auc(df: DataFrame, y: str, p: str, name: str = "auc") -> DataFrame:
    """Area under the ROC curve with mid-ranks. Rows are first counted by score, so ties cost nothing and the running sum is over
    distinct scores, range by range."""
    counted = df.filter(usable(F.col(p)) & F.col(y).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.sum((F.col(y) == 1).cast("long")).alias("_pos"), F.count(F.lit(1)).alias("_n"))
    placed = running_sum(counted.withColumn("_neg", F.col("_n") - F.col("_pos")), ["_p"], "_neg", "_below")
    wins = F.sum(F.col("_pos").cast("double") * (F.col("_below") + F.col("_neg") / 2.0))
    pos, neg = F.sum("_pos"), F.sum(F.col("_n") - F.col("_pos"))
    return placed.agg(F.when((pos > 0) & (neg > 0), wins / (pos.cast("double") * neg)).alias(name))


def transfer(df: DataFrame, y: str, p_real: str, p_synthetic: str) -> DataFrame:
    """tstr and auc_gap of two scores of the same rows."""
    both = auc(df, y, p_real, "a").crossJoin(auc(df, y, p_synthetic, "b"))
    return both.select(F.when(F.col("a") > 0, F.least(F.col("b") / F.col("a"), F.lit(1.0))).otherwise(0.0).alias("tstr"), F.greatest(F.lit(0.0), F.col("a") - F.col("b")).alias("auc_gap"))


def bin_of(p: Column) -> Column:
    """Index of the left-closed bin, 10 for 1.0 itself."""
    return reduce(lambda a, b: a + b, [(p >= F.lit(e)).cast("int") for e in EDGES]) - 1


def calibration(df: DataFrame, y: str, p: str) -> DataFrame:
    """brier_score and expected_calibration_error. Scores of exactly 1.0 fall outside the ten bins but count among all rows."""
    known = df.filter(usable(F.col(p)) & F.col(y).isNotNull())
    bins = known.groupBy(bin_of(F.col(p)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("p"), F.avg(F.col(y).cast("double")).alias("y"), F.sum(F.pow(F.col(p) - F.col(y), 2)).alias("sq"))
    gap = F.sum(F.when(F.col("bin").between(0, 9), F.col("n") * F.abs(F.col("p") - F.col("y"))).otherwise(0.0))
    return bins.agg((F.sum("sq") / F.sum("n")).alias("brier_score"), (gap / F.sum("n")).alias("expected_calibration_error"))


def tail_coverage(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """Share of the real rows below the 5th or above the 95th percentile that lies within the synthetic range; mean over the columns that have such rows, 1 if none has."""
    tall = lambda df: df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).select("x.c", "x.v").filter(usable(F.col("v")))
    counted = tall(real).groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    ends = quantiles(tall(real), ["c"], "v", [0.05, 0.95], ["p05", "p95"]).drop("n")
    span = tall(synthetic).groupBy("c").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    limits = ends.join(span, "c", "left")  # one row per column
    tail = counted.join(F.broadcast(limits), "c").filter((F.col("v") < F.col("p05")) | (F.col("v") > F.col("p95")))
    inside = F.coalesce(F.col("v").between(F.col("lo"), F.col("hi")), F.lit(False)).cast("long")
    per = tail.groupBy("c").agg((F.sum(inside * F.col("n")) / F.sum("n")).alias("share"))
    return per.agg(F.coalesce(F.avg("share"), F.lit(1.0)).alias("tail_coverage"))


def minority(real: DataFrame, y: str, key: str) -> DataFrame:
    """The rarer class of the real table (ties: whose first row comes first), one row: minority, real_rate."""
    counts = real.filter(F.col(y).isNotNull()).groupBy(F.col(y).cast("int").alias("class")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"))
    return counts.agg(F.min_by("class", F.struct("n", "first")).alias("minority"), (F.min("n") / F.sum("n")).alias("real_rate"))


def rare_coverage(real: DataFrame, synthetic: DataFrame, y: str, key: str) -> DataFrame:
    rare = minority(real, y, key)
    counts = synthetic.filter(F.col(y).isNotNull()).groupBy(F.col(y).cast("int").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    rate = counts.crossJoin(F.broadcast(rare)).agg((F.sum(F.when(F.col("class") == F.col("minority"), F.col("n")).otherwise(0)) / F.sum("n")).alias("synthetic_rate"))
    share = F.when(F.col("real_rate") > 0, F.least(F.col("synthetic_rate") / F.col("real_rate"), F.lit(1.0))).otherwise(1.0)
    return rare.crossJoin(rate).select("minority", F.coalesce(share, F.lit(1.0)).alias("rare_event_coverage"))


def rare_recall(df: DataFrame, y: str, pred: str, rare: DataFrame) -> DataFrame:
    joined = df.crossJoin(F.broadcast(rare.select("minority")))
    return joined.agg(F.coalesce(F.avg(F.when(F.col(y) == F.col("minority"), (F.col(pred) == F.col("minority")).cast("double"))), F.lit(0.0)).alias("rare_event_recall"))


def privacy(real: DataFrame, synthetic: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """membership_inference, nn_distance_ratio and duplicate_rate, from exact nearest distances in units of the real table's population deviations."""
    from assay.operators.blocks import NearestIndex
    from assay.operators.encode import scales
    from assay.session import cut

    deviations = scales(real, columns).first()  # one row
    scaled = lambda df: df.select(key, *((F.col(c) / F.lit(float(deviations[f"{c}_std"]))).alias(c) for c in columns))
    r, s = cut(scaled(real)), cut(scaled(synthetic))
    both = r.withColumn("_own", F.lit(True)).unionByName(s.withColumn("_own", F.lit(False)))
    # Distances that are equal but for the last bits of the scaling must compare as equal.
    rounded = F.round("distance", 9).alias("distance")
    to_real = cut(NearestIndex(r, key, columns).nearest(both, "_own").select("_own", rounded))
    near = to_real.filter("NOT _own")
    reach = cut(NearestIndex(s, key, columns).nearest(r, False).select(key, rounded))
    kinds = to_real.select(F.when(F.col("_own"), "rr").otherwise("sr").alias("kind"), "distance").unionByName(reach.select(F.lit("rs").alias("kind"), "distance"))
    found = cut(quantiles(kinds, ["kind"], "distance", [0.05, 0.5], ["p05", "p50"]))  # three rows
    at = lambda kind, name: F.max(F.when(F.col("kind") == kind, F.col(name))).alias(f"{kind}_{name}")
    limits = found.agg(at("rr", "p05"), at("rr", "p50"), at("sr", "p50"), at("rs", "p50"))
    copies = near.crossJoin(F.broadcast(limits)).agg(F.avg((F.col("distance") <= F.col("rr_p05")).cast("double")).alias("duplicate_rate"))
    ratio = limits.select((F.col("sr_p50") / F.when(F.col("rr_p50") > 0, F.col("rr_p50")).otherwise(1e-9)).alias("nn_distance_ratio"))
    ranked = cut(positions(reach, [key]))
    total = ranked.count()
    member = (F.col("position") < total // 2).cast("int")
    guessed = (F.col("distance") <= F.col("rs_p50")).cast("int")
    hit = ranked.crossJoin(F.broadcast(limits)).agg((F.abs(F.avg((guessed == member).cast("double")) - 0.5) * 2).alias("membership_inference"))
    return hit.crossJoin(copies).crossJoin(ratio).select("membership_inference", "nn_distance_ratio", "duplicate_rate")
