import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.operators import copula, kernels, models

COLUMNS = ["credit_amount", "age", "duration", "installment_rate"]


@pytest.fixture(scope="module")
def real(spark):
    from assay.plans.evidence import QUERIES

    return QUERIES["base_generator"](spark, "/root/testdata/sf0.001").cache()


def test_models_need_two_classes(spark, real):
    with pytest.raises(ValueError):
        models.fit_logistic(real.withColumn("target", F.lit(1)), COLUMNS, "target")


def test_forest_does_not_depend_on_the_input_layout(spark, real):
    small = models.ForestSpec(trees=8, depth=4)
    scores = []
    for df in (real.repartition(5), real.coalesce(1)):
        model = models.fit_forest(df, "rid", COLUMNS, "target", small)
        scores.append([r.p for r in models.scored(model, real, COLUMNS, "p", "pred").orderBy("rid").collect()])
    assert scores[0] == scores[1]


def test_calibrated_scores_are_probabilities(spark, real):
    df = models.calibrated(real, real.filter("rid < 200"), "rid", COLUMNS, "target", spec=models.ForestSpec(trees=6, depth=4))
    rows = df.collect()
    assert len(rows) == 200 and all(0 <= r.p <= 1 for r in rows)
    assert kernels.calibration(df, "target", "p").first().brier_score < 0.26


def test_copula_keeps_marginals_and_correlations(spark, real):
    model = copula.fit(real, COLUMNS, "sex", "target", grid=200)
    high = copula.high_fidelity(spark, model, 1000).cache()
    for c in COLUMNS:
        a, b = real.agg(F.avg(c), F.stddev(c)).first(), high.agg(F.avg(c), F.stddev(c)).first()
        assert abs(a[0] - b[0]) < 0.15 * a[1] and 0.8 < b[1] / a[1] < 1.3
    leaky = copula.privacy_leaky(spark, model, real, 1000)
    assert leaky.join(real.select(*COLUMNS, "sex", "target"), [*COLUMNS, "sex", "target"], "left_semi").count() >= 350
    share = lambda df: df.filter("sex = 'female'").agg(F.avg("target")).first()[0]
    assert share(copula.fairness_degraded(spark, model, 3000)) < share(copula.high_fidelity(spark, model, 3000))
    assert abs(copula.low_utility(spark, model, 3000).agg(F.avg("target")).first()[0] - 0.5) < 0.05
    assert np.allclose(model.factor, np.tril(model.factor))


def test_quantile_grids_and_scores_are_exact(spark):
    rng = np.random.default_rng(3)
    values = np.round(rng.normal(0, 3, (57, 2)), 1)
    df = spark.createDataFrame([(i, float(a), float(b) if i % 5 else None) for i, (a, b) in enumerate(values)], "rid long, a double, b double")
    grids = copula.quantile_grids(copula.ordered_values(df, ["a", "b"]), ["a", "b"], 200)
    for c, own in (("a", values[:, 0]), ("b", values[[i for i in range(57) if i % 5], 1])):
        assert np.allclose(grids[c], np.quantile(own, np.arange(201) / 200), rtol=1e-12)
    one = copula.quantile_grids(copula.ordered_values(df.limit(1), ["a"]), ["a"], 4)["a"]
    assert len(set(one)) == 1 and len(one) == 5
    scores = {r.rid: r.a_score for r in copula.normal_scores(df, ["a", "b"]).collect()}
    order = sorted(range(57), key=lambda i: values[i, 0])
    assert len(scores) == 57 and all(scores[i] <= scores[j] for i, j in zip(order, order[1:], strict=False))


def test_no_level_is_lost(spark):
    df = spark.range(6000).selectExpr("id % 1500 AS n").selectExpr("concat('level', n) AS level")
    shares = copula.level_shares(df, "level")
    assert len(shares) == 1500 and sum(shares.values()) == pytest.approx(1) and min(shares.values()) == pytest.approx(1 / 1500)
    with pytest.raises(ValueError):
        copula.level_shares(df, "level", 1499)
    model = copula.Copula(("age",), np.eye(1), {"age": [20.0, 30.0]}, shares, (0.1,), 0.0, {"age": 25.0}, {"age": 5.0})
    drawn = copula.sample(spark, model, 30_000, "level", "target", "t").groupBy("level").count().collect()
    assert len(drawn) > 1490 and all(r.level for r in drawn)
