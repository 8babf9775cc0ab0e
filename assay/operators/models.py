"""Models behind the metrics: forests, logistic regression and calibrated scores, by Spark ML.

Training rows are sorted by their key within one layout before a forest is fitted, since a forest depends on the layout of its rows; scores agree
between runs on the same data, not with other libraries digit by digit. Rows with nulls in features or target take no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions.scalars import normal
from assay.operators.encode import folds
from assay.session import cut


@dataclass(frozen=True)
class ForestSpec:
    trees: int = 120
    depth: int = 8
    seed: int = 42


def _vectors(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="skip").transform(df)


def classes(df: DataFrame, target: str) -> int:
    """A model needs both classes; the check is made before fitting, as Spark would fit one class without a word."""
    return df.filter(F.col(target).isNotNull()).select(F.col(target).cast("int")).distinct().count()


def _laid_out(df: DataFrame, key: str) -> DataFrame:
    """The same rows in the same places whatever the input's layout: hashed to a number of partitions that follows the row count, sorted by key."""
    parts = max(1, min(2048, df.count() // 8_000 + 1))
    return df.repartition(parts, key).sortWithinPartitions(key)


def fit_forest(df: DataFrame, key: str, features: list[str], target: str, spec: ForestSpec = ForestSpec()):
    if classes(df, target) < 2:
        raise ValueError("a forest needs two classes")
    rows = cut(_vectors(_laid_out(df.withColumn("_label", F.col(target).cast("double")), key), features).select("_features", "_label"))  # read once for each level of the trees
    return RandomForestClassifier(featuresCol="_features", labelCol="_label", numTrees=spec.trees, maxDepth=spec.depth, seed=spec.seed, cacheNodeIds=False, maxMemoryInMB=1024).fit(rows)


def fit_logistic(df: DataFrame, features: list[str], target: str):
    """Ridge penalty of weight 1 on the sum of losses, features as they are."""
    if classes(df, target) < 2:
        raise ValueError("a logistic regression needs two classes")
    rows = _vectors(df.withColumn("_label", F.col(target).cast("double")), features)
    n = rows.count()
    return LogisticRegression(featuresCol="_features", labelCol="_label", regParam=1.0 / max(1, n), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-8).fit(rows)


def scored(model, df: DataFrame, features: list[str], p: str, pred: str) -> DataFrame:
    out = model.transform(_vectors(df, features))
    return out.withColumn(p, vector_to_array("probability")[1]).withColumn(pred, F.col("prediction").cast("int")).drop("_features", "rawPrediction", "probability", "prediction")


def calibrated(df: DataFrame, test: DataFrame, key: str, features: list[str], target: str, p: str = "p", k: int = 3, spec: ForestSpec = ForestSpec()) -> DataFrame:
    """`test` scored by the mean of k forests, each calibrated by isotonic regression on the fold it has not seen."""
    rows = cut(folds(df, [target], key, k, "calibration").withColumnRenamed("fold", "_fold"))
    out = test
    for i in range(k):
        model = fit_forest(rows.filter(F.col("_fold") != i), key, features, target, spec)
        held = scored(model, rows.filter(F.col("_fold") == i), features, "_raw", "_hard").withColumn("_label", F.col(target).cast("double"))
        steps = IsotonicRegression(featuresCol="_raw", labelCol="_label", predictionCol="_p").fit(held.select("_raw", "_label"))
        out = scored(model, out, features, "_raw", "_hard")
        out = steps.transform(out).withColumnRenamed("_p", f"_p{i}").drop("_raw", "_hard")
    return out.withColumn(p, sum(F.col(f"_p{i}") for i in range(k)) / k).drop(*(f"_p{i}" for i in range(k)))


def perturbed(df: DataFrame, key: str, features: list[str], scale: float = 0.05) -> DataFrame:
    """Features with normal noise of `scale` sample deviations of the column; the noise depends on key and column only."""
    deviations = df.agg(*(F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"_s_{c}") for c in features))
    joined = df.crossJoin(F.broadcast(deviations))  # one row
    return joined.withColumns({c: F.col(c) + normal(f"noise/{c}", F.col(key)) * scale * F.col(f"_s_{c}") for c in features}).drop(*(f"_s_{c}" for c in features))
