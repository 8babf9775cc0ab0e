import json

import pytest

from assay.operators.bands import BANDS
from assay.sources import files
from assay.streaming import values


def test_csv_round_trip_and_missing_values(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("duration,credit_amount,age,installment_rate,sex,target\n12,500.5,NA, 2 ,male,1\n,null,30,,None,0\n")
    rows = files.read_csv(spark, str(path), files.CREDIT_SCHEMA).collect()
    assert tuple(rows[0]) == (12.0, 500.5, None, 2.0, "male", 1) and tuple(rows[1]) == (None, None, 30.0, None, None, 0)
    files.write_csv(files.read_csv(spark, str(path), files.CREDIT_SCHEMA), str(tmp_path / "out"))
    assert sorted(map(str, files.read_csv(spark, str(tmp_path / "out"), files.CREDIT_SCHEMA).collect())) == sorted(map(str, rows))
    path.write_text("duration,credit_amount,age,installment_rate,sex,target\nx,1,1,1,m,1\n")
    with pytest.raises(Exception, match="CAST"):
        files.read_csv(spark, str(path), files.CREDIT_SCHEMA).collect()


def test_quoted_cells_keep_what_is_in_them(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType()), T.StructField("c", T.StringType())])
    path = tmp_path / "q.csv"
    path.write_text('a,b,c\n1,"say ""hi"" now, ok",x\n2,"two\nlines",y\n3," padded ",\\\n4,"",""""\n')
    want = [(1, 'say "hi" now, ok', "x"), (2, "two\nlines", "y"), (3, " padded ", "\\"), (4, None, '"')]
    assert [tuple(r) for r in files.read_csv(spark, str(path), schema).collect()] == want
    files.write_csv(files.read_csv(spark, str(path), schema), str(tmp_path / "out"))
    assert sorted(tuple(r) for r in files.read_csv(spark, str(tmp_path / "out"), schema).collect()) == want


def test_times_and_ids(spark):
    from pyspark.sql import functions as F

    from assay.functions import scalars

    df = spark.createDataFrame([(_stamp("2025-03-01T09:08:07"),), (_stamp("2025-03-01T09:08:07.000250"),), (None,)], "t timestamp")
    got = [(r[0], r[1]) for r in df.select(scalars.utc_iso(F.col("t")), scalars.utc_minute(F.col("t"))).collect()]
    assert got == [("2025-03-01T09:08:07+00:00", "2025-03-01 09:08 UTC"), ("2025-03-01T09:08:07.000250+00:00", "2025-03-01 09:08 UTC"), (None, None)]
    row = spark.range(1).select(scalars.utc_iso(), scalars.utc_minute(), files.short_id()).first()
    assert row[0][:16].replace("T", " ") <= row[1][:16] and len(row[2]) == 8


def test_indented_documents_one_by_one(spark, tmp_path):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("r1", 1), ("r2", None)], "id string, n int").withColumn("doc", files.json_text(F.struct("id", "n"), True))
    files.write_each(df, "id", "doc", str(tmp_path / "each"))
    texts = {p.name: "".join(f.read_text() for f in p.glob("*.txt")) for p in (tmp_path / "each").iterdir() if p.is_dir()}
    assert {k: json.loads(v) for k, v in texts.items()} == {"id=r1": {"id": "r1", "n": 1}, "id=r2": {"id": "r2", "n": None}} and "\n" in texts["id=r2"].strip()


def test_whitespace_file_and_fallback(spark, tmp_path):
    path = tmp_path / "b.data"
    path.write_text("A11  6   67\n\n A12\t48 x\nA13\n")
    df = files.numbers(files.read_whitespace(spark, str(path), ["code", "months", "age"]), ["months", "age"])
    assert [tuple(r) for r in df.collect()] == [("A11", 6.0, 67.0), ("A12", 48.0, None), ("A13", None, None)]
    missing = lambda: spark.read.text(str(tmp_path / "no"))
    assert files.first_available(missing, lambda: df).count() == 3
    with pytest.raises(RuntimeError):
        files.first_available(missing)
    assert files.exists(spark, str(path)) and not files.exists(spark, str(tmp_path / "no"))


def test_documents_keep_null_slots(spark, tmp_path):
    df = spark.createDataFrame([("r", (None, 1))], "id string, o struct<a string, b int>")
    files.write_documents(df, str(tmp_path / "d"))
    files.write_documents(df, str(tmp_path / "d"))
    lines = [json.loads(x) for p in (tmp_path / "d").glob("*.json") for x in p.read_text().splitlines()]
    assert lines == [{"id": "r", "o": {"a": None, "b": 1}}] * 2
    files.write_markdown(df.selectExpr("'# x\n\ny' AS report"), "report", str(tmp_path / "m"))
    assert "# x" in "".join(p.read_text() for p in (tmp_path / "m").glob("*.txt"))


def test_settings(spark, tmp_path):
    path = tmp_path / "bands.yaml"
    path.write_text("tstr: {category: utility, direction: higher_better, strong_at: 0.95, weak_below: 0.9}\n")
    settings, version = files.read_settings(spark, str(path))
    assert files.bands_from(settings) == BANDS[:1] and len(version) == 10
    with pytest.raises(ValueError):
        files.bands_from({"x": {"category": "c"}})
    with pytest.raises(ValueError):
        files.bands_from({"x": {"category": "c", "direction": "up", "strong_at": 1, "weak_below": 0}})


def test_preview(spark):
    rows, n, columns = files.preview(spark.range(20).selectExpr("id", "-id AS b"), ["b"])
    assert [r.id for r in rows] == [19, 18, 17, 16, 15, 14] and (n, columns) == (20, 2)


def _stamp(text):
    from datetime import datetime

    return datetime.fromisoformat(text)


def test_streams(spark, tmp_path):
    rows = [("r1", "t", "tstr", 0, 0.5, _stamp("2025-01-01T10:00")), ("r1", "t", "tstr", 0, 0.5, _stamp("2025-01-01T11:00")), ("r2", "t", "tstr", 0, float("nan"), _stamp("2025-01-01T12:00")), ("r3", "t", "tstr", 0, 0.7, _stamp("2025-03-01T12:00"))]
    spark.createDataFrame(rows, values.VALUES).write.parquet(str(tmp_path / "in"))
    source = values.read(spark, str(tmp_path / "in"))
    values.write(values.once(source), str(tmp_path / "once"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "once")).count() == 3
    query = values.daily(source).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {str(r.start)[:10]: (r.n, r.known, r.mean) for r in spark.table("daily").collect()}
    assert got == {"2025-01-01": (3, 2, 0.5), "2025-03-01": (1, 1, 0.7)}


def test_late_outcomes(spark, tmp_path):
    spark.createDataFrame([("a", _stamp("2025-01-01T00:00"), "t"), ("b", _stamp("2025-01-02T00:00"), "t")], values.RECORDS).write.parquet(str(tmp_path / "r"))
    spark.createDataFrame([("a", _stamp("2025-03-01T00:00"), True, 0), ("z", _stamp("2025-03-01T00:00"), True, 0)], values.OUTCOMES).write.parquet(str(tmp_path / "o"))
    joined = values.with_outcomes(values.read(spark, str(tmp_path / "r"), values.RECORDS), values.read(spark, str(tmp_path / "o"), values.OUTCOMES))
    values.write(joined, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = {r.record_id: r.incident for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["a"] is True
