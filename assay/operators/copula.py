"""Synthetic tables by a Gaussian copula: marginals as in the real table, correlations kept, targets from a fitted model.

Fitting counts the values of all columns in one melted table and orders them once, range by range; ranks and quantile grids of every column come from that.
The model is a few numbers, `grid` quantiles per column and the shares of the category's levels, so sampling is a pure projection over a range of ids and scales
with the rows asked for. A category of more than 10,000 levels is refused, never cut off.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.scalars import doubles, logistic, normal, normal_cdf, normal_quantile, uniform, usable
from assay.operators.encode import scales, z_scores
from assay.operators.models import fit_logistic
from assay.operators.ranks import few_or_shuffled, positions, running_sum_within
from assay.session import cut


#: What is added to the correlations' diagonal, and by how much latent scores are spread.
RIDGE, TEMPERATURE = 1e-6, 1.08


@dataclass(frozen=True)
class Copula:
    columns: tuple[str, ...]
    factor: np.ndarray  # lower triangular, of the correlations
    quantiles: dict[str, list[float]]
    shares: dict[str, float]  # of the categorical column
    weights: tuple[float, ...]
    intercept: float
    means: dict[str, float]
    deviations: dict[str, float]


def ordered_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct values of all columns, once in order: `column` (its place), `_v`, `_n` (rows), `_before` (rows of the column below) and `_all` (its rows)."""
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("column"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns))))
    tall = df.select(cells.alias("x")).select("x.column", F.col("x.v").alias("_v")).filter(usable(F.col("_v")))
    counted = tall.groupBy("column", "_v").agg(F.count(F.lit(1)).alias("_n"))
    return cut(running_sum_within(counted, ["column"], ["_v"], "_n", "_before", "_all"))


def normal_scores(df: DataFrame, columns: list[str], ordered: DataFrame | None = None) -> DataFrame:
    """Columns as normal scores of their mid-ranks, joined back by value: a column of few distinct values is sent to all executors."""
    ordered = ordered_values(df, columns) if ordered is None else ordered
    out = df
    for i, c in enumerate(columns):
        score = normal_quantile((F.col("_before") + (F.col("_n") + 1) / 2.0) / (F.col("_all") + 1))
        ranks = ordered.filter(F.col("column") == i).select(F.col("_v").alias("_value"), score.alias(f"{c}_score"))
        out = out.join(few_or_shuffled(ranks), F.col(c).cast("double") == F.col("_value"), "left").drop("_value")
    return out


def quantile_grids(ordered: DataFrame, columns: list[str], grid: int) -> dict[str, list[float]]:
    """For each column its linearly interpolated quantiles at 0, 1/grid, ... 1, in whole-number arithmetic on ranks."""
    span = F.greatest(F.col("_all") - 1, F.lit(1))
    up = lambda x, y: F.expr(f"({x} + {y} - 1) div {y}")
    rows = ordered.withColumn("_span", span).withColumn("_g", F.lit(grid).cast("long"))
    low = rows.withColumn("_from", up("_before * _g", "_span")).withColumn("_to", F.least(F.expr("((_before + _n) * _g - 1) div _span"), F.col("_g")))
    high = rows.withColumn("_from", F.when(F.col("_before") == 0, F.lit(0)).otherwise(F.expr("((_before - 1) * _g) div _span") + 1)).withColumn("_to", F.least(F.expr("((_before + _n - 1) * _g) div _span"), F.col("_g")))
    parts = [x.filter("_from <= _to").select("column", "_all", F.explode(F.sequence("_from", "_to")).alias("i"), F.lit(side).alias("side"), "_v") for side, x in ((0, low), (1, high))]
    at = parts[0].unionByName(parts[1]).groupBy("column", "_all", "i").agg(F.max(F.when(F.col("side") == 0, F.col("_v"))).alias("lo"), F.max(F.when(F.col("side") == 1, F.col("_v"))).alias("hi"))
    share = F.expr(f"(i * (_all - 1)) % {grid}") / grid
    value = F.coalesce(F.col("lo") + (F.col("hi") - F.col("lo")) * share, "lo", "hi")
    out: dict[str, list[float]] = {c: [float("nan")] * (grid + 1) for c in columns}
    for r in at.select("column", "i", value.alias("value")).collect():  # columns times grid points
        out[columns[r["column"]]][r["i"]] = r["value"]
    for c, values in out.items():  # a single row has only its ends
        known = [v for v in values if v == v]
        out[c] = [v if v == v else known[0] for v in values] if known else []
    return out


def correlations(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Pearson correlations of all pairs in a single aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*(F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs))).first() if pairs else []
    out = np.eye(len(columns))
    for i, (a, b) in enumerate(pairs):
        out[columns.index(a), columns.index(b)] = out[columns.index(b), columns.index(a)] = row[i] if row[i] is not None and not np.isnan(row[i]) else 0.0
    return out


def level_shares(df: DataFrame, category: str, limit: int = 10_000) -> dict[str, float]:
    """Shares of the levels among the rows that have one; more than `limit` levels are refused."""
    counts = df.filter(F.col(category).isNotNull()).groupBy(category).count().limit(limit + 1).collect()
    if len(counts) > limit:
        raise ValueError(f"{category} has more than {limit} levels")
    total = sum(r[1] for r in counts) or 1
    return {r[0]: r[1] / total for r in sorted(counts, key=lambda r: r[0])}


def fit(real: DataFrame, columns: list[str], category: str, target: str, grid: int = 1000) -> Copula:
    ordered = ordered_values(real, columns)
    scored = normal_scores(real, columns, ordered)
    corr = correlations(scored, [f"{c}_score" for c in columns])
    s = scales(real, columns)
    model = fit_logistic(z_scores(real, s, columns), columns, target)
    row = s.first()
    factor = np.linalg.cholesky(corr + RIDGE * np.eye(len(columns)))
    return Copula(tuple(columns), factor, quantile_grids(ordered, columns, grid), level_shares(real, category), tuple(model.coefficients), float(model.intercept), {c: row[f"{c}_mean"] for c in columns}, {c: row[f"{c}_std"] for c in columns})


#: Bounds of the generated columns.
LIMITS = {"duration": (4, 72), "age": (19, 80), "installment_rate": (1, 4), "credit_amount": (250, 20000)}


def sample(spark: SparkSession, model: Copula, rows: int, category: str, target: str, tag: str, temperature: float = TEMPERATURE, target_from_model: bool = True) -> DataFrame:
    """`rows` new rows with `rid` from 0."""
    df = spark.range(rows).withColumnRenamed("id", "rid")
    key = F.col("rid")
    z = [normal(f"{tag}/{c}", key) * temperature for c in model.columns]
    df = df.withColumns({f"_z{i}": v for i, v in enumerate(z)})
    for i, c in enumerate(model.columns):
        mixed = sum((F.col(f"_z{j}") * float(model.factor[i, j]) for j in range(i + 1)), F.lit(0.0))
        table = model.quantiles[c]
        at = F.floor(normal_cdf(mixed) * (len(table) - 1)).cast("int")
        value: Column = F.element_at(doubles(table), F.greatest(F.lit(1), F.least(at + 1, F.lit(len(table)))))
        if c in LIMITS:
            value = F.least(F.greatest(value, F.lit(float(LIMITS[c][0]))), F.lit(float(LIMITS[c][1])))
        df = df.withColumn(c, F.floor(value + 0.5))
    df = df.drop(*(f"_z{i}" for i in range(len(model.columns))))
    if target_from_model:
        score = sum((F.lit(w) * (F.col(c) - model.means[c]) / model.deviations[c] for w, c in zip(model.weights, model.columns, strict=True)), F.lit(model.intercept))
        df = df.withColumn(target, (uniform(f"{tag}/target", key) < logistic(score)).cast("int"))
    else:
        df = df.withColumn(target, (uniform(f"{tag}/target", key) < 0.5).cast("int"))
    names, ends = list(model.shares), np.cumsum(list(model.shares.values()))[:-1].tolist()
    u = uniform(f"{tag}/{category}", key)
    at = F.size(F.filter(doubles(ends), lambda end: end <= u)) if ends else F.lit(0)
    level = F.element_at(F.array(*(F.lit(n) for n in names)), at + 1) if names else F.lit(None).cast("string")
    return df.withColumn(category, level)


def high_fidelity(spark: SparkSession, model: Copula, rows: int) -> DataFrame:
    return sample(spark, model, rows, "sex", "target", "high_fidelity")


#: Share of positives that lose their label, share of copied rows.
FLIPPED, COPIED = 0.11, 0.35


def fairness_degraded(spark: SparkSession, model: Copula, rows: int) -> DataFrame:
    """A ninth of the positives of one group lose their label."""
    out = sample(spark, model, rows, "sex", "target", "fairness_degraded")
    return out.withColumn("target", F.when((F.col("sex") == "female") & (F.col("target") == 1) & (uniform("flip", F.col("rid")) < FLIPPED), 0).otherwise(F.col("target")))


def overwritten_by_position(df: DataFrame, source: DataFrame, columns: list[str], key: str, first: int, tag: str) -> DataFrame:
    """The first rows of a table, those whose position `_at` is below `first`, with the columns of rows of `source` that a hash of the position draws with replacement.
    Positions on both sides are by key; the draw is a join on the position drawn, of which each row of `source` has its share whatever their number."""
    n = source.count()
    numbered = positions(source.select(key, *columns), [key], "_drawn").select("_drawn", *(F.col(c).alias(f"_r_{c}") for c in columns))
    drawn = df.withColumn("_drawn", F.when(F.col("_at") < first, F.floor(uniform(tag, F.col("_at")) * n).cast("long")))
    joined = drawn.join(numbered, "_drawn", "left")
    hit = F.col("_drawn").isNotNull() & F.lit(n > 0)
    return joined.select(*(F.when(hit, F.col(f"_r_{c}")).otherwise(F.col(c)).cast(df.schema[c].dataType).alias(c) if c in columns else F.col(c) for c in df.columns))


def privacy_leaky(spark: SparkSession, model: Copula, real: DataFrame, rows: int) -> DataFrame:
    """The first 35 % of the rows are copies of real ones, drawn with replacement by a hash."""
    out = sample(spark, model, rows, "sex", "target", "privacy_leaky").withColumn("_at", F.col("rid"))
    return overwritten_by_position(out, real, [*model.columns, "sex", "target"], "rid", int(COPIED * rows), "copy").drop("_at")


def low_utility(spark: SparkSession, model: Copula, rows: int) -> DataFrame:
    return sample(spark, model, rows, "sex", "target", "low_utility", target_from_model=False)
