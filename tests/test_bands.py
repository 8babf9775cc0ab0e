import itertools

import pytest

from assay.operators import bands

VALUES = "run_id string, task string, metric_key string, metric_ord int, value double, computed_at int"
NAN = float("nan")


def interpreted(spark, rows):
    return bands.interpret(spark.createDataFrame([(r, "t", k, o, v, 0) for r, k, o, v in rows], VALUES), bands.band_table(spark))


@pytest.mark.parametrize(
    "key,value,expected",
    [
        ("tstr", 0.97, "strong"), ("tstr", 0.92, "moderate"), ("tstr", 0.80, "weak"), ("tstr", 0.95, "strong"), ("tstr", 0.90, "moderate"),
        ("membership_inference", 0.02, "strong"), ("membership_inference", 0.07, "moderate"), ("membership_inference", 0.20, "weak"), ("membership_inference", 0.05, "strong"), ("membership_inference", 0.10, "moderate"),
        ("tstr", NAN, "weak"), ("tstr", None, "weak"), ("membership_inference", NAN, "weak"), ("membership_inference", None, "weak"),
    ],
)
def test_bands(spark, key, value, expected):
    row = interpreted(spark, [("r", key, 0, value)]).first()
    assert (row.strength, row.passed) == (expected, expected != "weak")


def test_unknown_metric_drops_out_and_unknown_direction_is_an_error(spark):
    assert interpreted(spark, [("r", "psi", 0, 1.0)]).count() == 0
    with pytest.raises(ValueError):
        bands.band_table(spark, (("x", "c", "sideways", 1.0, 0.5),))


VALUE = {"strong": (0.99, 0.0, 0.99), "moderate": (0.92, 0.05, 0.8), "weak": (0.5, 0.5, 0.5)}


def test_confidence_of_every_combination(spark):
    keys = ("tstr", "auc_gap", "decision_agreement")
    combos = list(itertools.product(VALUE, repeat=3))
    df = interpreted(spark, [("/".join(c), k, i, VALUE[s][i]) for c in combos for i, (k, s) in enumerate(zip(keys, c, strict=True))])
    for row in bands.by_category(df).collect():
        kinds = row.run_id.split("/")
        weak, moderate = kinds.count("weak"), kinds.count("moderate")
        assert row.confidence == ("low" if weak >= 2 else "medium" if weak == 1 or moderate >= 2 else "high")
        if weak == 1:
            assert row.reason == "one weak metric: " + ("Tstr", "Auc Gap", "Decision Agreement")[kinds.index("weak")]


def test_weakest_and_first_match(spark):
    df = spark.createDataFrame([("a", "high"), ("a", "medium"), ("b", "low"), ("b", "high"), ("c", "high")], "run_id string, confidence string")
    assert {r.run_id: r.confidence for r in bands.weakest(df).collect()} == {"a": "medium", "b": "low", "c": "high"}
    rules = spark.createDataFrame([(2, "low", "second"), (1, "low", "first"), (3, "medium", "third")], "ord int, is string, outcome string")
    got = bands.first_match(df, rules, df.confidence == rules["is"], ["run_id", "confidence"], otherwise="none")
    assert {(r.run_id, r.confidence): r.outcome for r in got.collect()} == {("a", "high"): "none", ("a", "medium"): "third", ("b", "low"): "first", ("b", "high"): "none", ("c", "high"): "none"}


def test_latest_takes_the_last_and_breaks_ties(spark):
    df = spark.createDataFrame([("r", "t", "k", 0, 1.0, 1), ("r", "t", "k", 0, 2.0, 3), ("r", "t", "k", 0, 3.0, 3), (None, "t", "k", 0, 9.0, 1)], VALUES)
    assert sorted((str(r.run_id), r.value) for r in bands.latest(df, ["run_id", "metric_key"], "computed_at").collect()) == [("None", 9.0), ("r", 3.0)]


def test_nested_record_keeps_order_and_empty_slots(spark):
    df = interpreted(spark, [("r", "auc_gap", 1, 0.0), ("r", "tstr", 0, None), ("r", "tail_coverage", 2, 0.5)])
    row = bands.nested_record(df, bands.by_category(df)).first()
    assert [c.category for c in row.categories] == ["robustness", "utility"] and [m.key for m in row.categories[1].metrics] == ["tstr", "auc_gap"]
    assert row.metric_values["tstr"] is None and set(row.production_outcome.asDict().values()) == {None}
    report = bands.report_lines(df, bands.by_category(df)).first().report
    assert report.index("Robustness") < report.index("Tstr") < report.index("Auc Gap") and ">= 0.95 strong / >= 0.90 moderate" in report


def test_empty(spark):
    df = interpreted(spark, [])
    assert bands.by_category(df).count() == 0 and bands.nested_record(df, bands.by_category(df)).count() == 0


def test_whole_record_and_report_without_a_record(spark):
    df = interpreted(spark, [("r", "tstr", 0, None), ("r", "auc_gap", 1, 0.01), ("s", "tstr", 0, 0.99)])
    records = bands.last_records(spark.createDataFrame([(7, "s", None, "id7", None, "v1", "set", "a_task", "high", "rule", None, "why", "yes"), (9, "s", None, "id9", None, "v1", None, "a_task", "high", "rule", None, "why", "yes")], "log_id long, run_id string, ingested_at timestamp, " + ", ".join(f"{c} string" for c in bands.CARRIED)))
    categories = bands.by_category(df)
    got = {r.run_id: r for r in bands.whole_record(bands.nested_record(df, categories), categories, records).collect()}
    assert (got["s"].record_id, got["s"].dataset, got["s"].overall_confidence) == ("id9", None, "high") and got["r"].record_id is None
    reports = {r.run_id: r.report for r in bands.report_lines(df, categories, records).collect()}
    assert "Record: id9" in reports["s"] and "- Task: A Task" in reports["s"] and "| Tstr | - |" in reports["r"] and "- Rule: -" in reports["r"]
    assert set(bands.report_lines(df, categories).columns) == {"run_id", "report"}
