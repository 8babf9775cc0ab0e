import pytest

from assay.llm.queries import QUERIES, SQL
from tests.oracle import connect, differences


@pytest.mark.parametrize("name", list(SQL))
def test_same_rows_as_sql(spark, sf, name):
    assert differences(QUERIES[name](spark, sf), SQL[name], connect(sf)) == ""


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert len(df.collect()) >= 1


def test_every_document_has_its_ids(spark, sf):
    from assay.sources.tables import table

    df = QUERIES["p6_ids"](spark, sf)
    assert df.columns == ["doc_id", "ids"] and df.schema["ids"].dataType.simpleString() == "array<int>"
    assert df.count() == table(spark, sf, "documents").count()


def test_merged_days_equal_the_whole(spark, sf):
    whole, merged = QUERIES["p5_percentiles"](spark, sf), QUERIES["p5_daily_merged"](spark, sf)
    assert merged.columns == whole.columns
    assert sorted(map(str, merged.collect())) == sorted(map(str, whole.collect()))


def test_p5_found_survives_brackets_that_miss(spark, sf, monkeypatch):
    from pyspark.sql import functions as F

    from assay.llm import dyadic

    right, wrong = dyadic.percentiles, {"p500_low": 1e9, "p500_high": 1e9, "p950_low": 1.0, "p950_high": 1.0}
    monkeypatch.setattr(dyadic, "percentiles", lambda *a, **k: right(*a, **k).withColumns({c: F.lit(v) for c, v in wrong.items()}))
    assert differences(QUERIES["p5_found"](spark, sf), SQL["p5_found"], connect(sf)) == ""
    assert QUERIES["p5_found"](spark, sf).count() > 0
