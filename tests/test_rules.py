import itertools

import pytest

from assay.operators import rules

REQUIRED = [("paint", "colour", 0, False), ("paint", "gloss", 1, True), ("paint", "odour", 2, True), ("glaze", "colour", 0, True)]
RULES = [
    ("A", "floor", 1, "any_low", None, None, "low", "something is low"),
    ("A", "marked", 2, "marked_below", "high", None, "medium", "a marked one is below high"),
    ("A", "two", 3, "count_at", "medium", 2, "medium", "two are medium"),
    ("A", "rest", 4, "default", None, None, None, "the weakest"),
]
FLAGS = [("smell", 1, "odour", "low", ["A"], None, "it smells"), ("never", 0, "odour", "low", None, ["glaze"], "no")]
OUTCOMES = [(1, None, True, "stop"), (2, "high", False, "go"), (3, "medium", False, "wait")]


def tables(spark):
    return (spark.createDataFrame(REQUIRED, rules.REQUIRED), spark.createDataFrame(RULES, rules.RULES), spark.createDataFrame(FLAGS, rules.FLAGS), spark.createDataFrame(OUTCOMES, rules.OUTCOMES))


def by_hand(levels):
    ranks = [rules.LEVELS.index(x) for x in levels]
    if 0 in ranks:
        confidence, rule = "low", "floor"
    elif min(ranks[1:]) < 2:
        confidence, rule = "medium", "marked"
    elif ranks.count(1) >= 2:
        confidence, rule = "medium", "two"
    else:
        confidence, rule = rules.LEVELS[min(ranks)], "rest"
    flag = "smell" if ranks[2] == 0 else None
    return confidence, rule, flag, "stop" if flag else {"high": "go", "medium": "wait"}.get(confidence, "none")


def test_every_combination(spark):
    combos = list(itertools.product(rules.LEVELS, repeat=3))
    runs = spark.createDataFrame([("/".join(c), "paint", "A") for c in combos], "run_id string, task string, tier string")
    cats = spark.createDataFrame([("/".join(c), k, v) for c in combos for k, v in zip(("colour", "gloss", "odour"), c, strict=True)], "run_id string, category string, confidence string")
    required, table, flags, outcomes = tables(spark)
    got = rules.evaluate(runs, cats, required, table, flags, outcomes, "none")
    rows = {r.run_id: r for r in got.collect()}
    assert len(rows) == 27
    for c in combos:
        r = rows["/".join(c)]
        assert (r.confidence, r.rule_id, r.flag, r.outcome) == by_hand(c), c
    assert rows["high/high/low"].reason == "it smells (rule: something is low)"
    texts = spark.createDataFrame([("odour", 2, "air it"), ("odour", 1, "open it"), ("colour", 1, "mix it")], rules.FOLLOW_UPS)
    lines = {r.run_id: r.follow_ups for r in rules.follow_ups(got, texts).collect()}
    assert lines["medium/high/low"] == ["[odour] open it", "[odour] air it"] and lines["medium/high/medium"] == ["[colour] mix it", "[odour] open it", "[odour] air it"]
    assert "high/high/high" not in lines


def test_missing_categories_no_rules_and_bad_kinds(spark):
    runs = spark.createDataFrame([("x", "paint", "A"), ("y", "paint", "A"), ("z", "other", "B")], "run_id string, task string, tier string")
    cats = spark.createDataFrame([("x", "colour", "medium"), ("x", "unasked", "low")], "run_id string, category string, confidence string")
    required, table, flags, outcomes = tables(spark)
    rows = {r.run_id: r for r in rules.evaluate(runs, cats, required, table, flags, outcomes, "none").collect()}
    assert (rows["x"].confidence, rows["x"].rule_id, rows["x"].missing) == ("medium", "rest", ["gloss", "odour"])
    assert (rows["y"].confidence, rows["y"].rule_id, rows["y"].missing) == (None, None, ["colour", "gloss", "odour"]) and rows["z"].missing == []
    bare = rules.evaluate(runs, cats, required, table.limit(0), flags, outcomes, "none")
    assert {r.run_id: r.rule_id for r in bare.collect()}["x"] == "fallback"
    with pytest.raises(ValueError):
        rules.evaluate(runs, cats, required, table.replace("default", "odd", "kind"), flags, outcomes, "none")
