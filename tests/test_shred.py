from assay.operators import shred

SCHEMA = """log_id long, name string, a struct<x int, b struct<y string, tags array<string>>>,
  parts array<struct<kind string, parts_pos int, readings array<struct<k string, v double>>>>, extra array<struct<readings array<struct<k string, v double>>>>, m map<string, double>"""


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


ROW = (1, "n", (5, ("t", ["p", None, "q"])), [("one", 7, [("k", 1.0), None]), None, ("two", None, None)], [([("z", None)],)], {"u": None, "w": 2.0})


def test_tables_and_links(spark):
    out = shred.shred(frame(spark, [ROW, (2, None, None, None, None, None), (3, "e", (None, None), [], [], {})]), ("log_id",), "record")
    assert set(out) == {"record", "a_b_tags", "parts", "parts_readings", "extra", "extra_readings", "m", "shared_readings"}
    assert [tuple(r) for r in out["record"].orderBy("log_id").collect()] == [(1, "n", 5, "t"), (2, None, None, None), (3, "e", None, None)]
    assert [tuple(r) for r in out["a_b_tags"].collect()] == [(1, 0, "p"), (1, 2, "q")]
    assert out["parts"].columns == ["log_id", "parts_pos", "kind", "parts_pos_"]
    assert [tuple(r) for r in out["parts"].collect()] == [(1, 0, "one", 7), (1, 2, "two", None)]
    assert [tuple(r) for r in out["parts_readings"].collect()] == [(1, 0, 0, "k", 1.0)]
    assert sorted(tuple(r) for r in out["m"].collect()) == [(1, "u", None), (1, "w", 2.0)]
    shared = sorted((r.log_id, r.parent_table, r.parent_pos, r.k) for r in out["shared_readings"].collect())
    assert shared == [(1, "extra", "0/0", "z"), (1, "parts", "0/0", "k")]


def test_every_child_leads_to_its_parent(spark):
    out = shred.shred(frame(spark, [ROW, ROW]), ("log_id",), "record")
    orphans = out["parts_readings"].join(out["parts"], ["log_id", "parts_pos"], "left_anti")
    assert orphans.count() == 0 and out["parts"].count() == 4


def test_empty_table(spark):
    assert all(df.count() == 0 for df in shred.shred(frame(spark, []), ("log_id",), "record").values())


def test_scan_reads_only_what_it_needs(spark, sf):
    from assay.sources.tables import table

    out = shred.shred(table(spark, sf, "audit_record"), ("log_id",), "record")
    plan = out["metric_values"]._jdf.queryExecution().executedPlan().toString()
    assert "categories" not in plan and "production_outcome" not in plan
