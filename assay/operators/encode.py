"""Feature tables: aligned pairs, one-hot columns, scales, positions and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.scalars import uniform
from assay.operators.ranks import positions_within


def levels(df: DataFrame, column: str, limit: int = 10_000) -> list[str]:
    """Sorted distinct values but for null. One-hot encoding makes a column of each, so more than `limit` is refused rather than cut off."""
    found = sorted(r[0] for r in df.select(F.col(column).cast("string")).filter(F.col(column).isNotNull()).distinct().limit(limit + 1).collect())
    if len(found) > limit:
        raise ValueError(f"{column} has more than {limit} levels")
    return found


def one_hot(df: DataFrame, column: str, known: list[str]) -> DataFrame:
    """One 0/1 column per level but the first sorted one; a null row is all zeros. The column itself goes."""
    kept = [F.col(f"`{c}`") for c in df.columns if c != column]
    return df.select(*kept, *(F.when(F.col(f"`{column}`") == value, 1.0).otherwise(0.0).alias(f"{column}_{value}") for value in known[1:]))


def align(real: DataFrame, synthetic: DataFrame, categorical: list[str], source: str = "src") -> DataFrame:
    """Both tables by column name over a shared encoding, told apart by `source` ('r' and 's'); what one lacks is null."""
    if source in real.columns or source in synthetic.columns:
        raise ValueError(f"a column is already called {source}")
    both = real.withColumn(source, F.lit("r")).unionByName(synthetic.withColumn(source, F.lit("s")), allowMissingColumns=True)
    for column in categorical:
        both = one_hot(both, column, levels(both, column))
    return both


def default_target(df: DataFrame, wanted: str = "target") -> str:
    return wanted if wanted in df.columns else df.columns[-1]


def present(df: DataFrame, column: str | None) -> bool:
    """Whether a column is named and there."""
    return column is not None and column in df.columns


def default_sensitive(df: DataFrame, wanted: str = "sex") -> str | None:
    return wanted if present(df, wanted) else None


def scales(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the mean and population deviation of each column; a deviation of 0 counts as 1."""
    parts = []
    for c in columns:
        parts += [F.avg(c).alias(f"{c}_mean"), F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(F.lit(1.0)).alias(f"{c}_std")]
    return df.agg(*parts)


def z_scores(df: DataFrame, fitted: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled by one row of `scales` (a single row, always broadcast)."""
    joined = df.crossJoin(F.broadcast(fitted))
    drop = [f"{c}_{e}" for c in columns for e in ("mean", "std")]
    return joined.withColumns({c: (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std") for c in columns}).drop(*drop)


def _shuffled_positions(df: DataFrame, by: list[str], key: str, tag: str) -> DataFrame:
    """Adds each row's place in its class, in an order that depends on the key alone, and the class's size."""
    return positions_within(df.withColumn("_turn", uniform(tag, *(F.col(c) for c in by), F.col(key))), by, ["_turn", key], "_at", "_size").drop("_turn")


def holdout(df: DataFrame, by: list[str], key: str, share: float, tag: str = "split") -> DataFrame:
    """Adds `is_test`: a repeatable split that takes `share` of each class, to the nearest row. A null class is a class of its own."""
    return _shuffled_positions(df, by, key, tag).withColumn("is_test", F.col("_at") < F.floor(F.col("_size") * share + 0.5)).drop("_at", "_size")


def folds(df: DataFrame, by: list[str], key: str, k: int, tag: str = "fold") -> DataFrame:
    """Adds `fold` from 0 to k - 1: each class is dealt out evenly, so its folds differ by one row at most."""
    return _shuffled_positions(df, by, key, tag).withColumn("fold", (F.col("_at") % k).cast("int")).drop("_at", "_size")


def conditional_update(df: DataFrame, column: str, where: Column, value: object) -> DataFrame:
    return df.withColumn(column, F.when(where, F.lit(value)).otherwise(F.col(column)))
