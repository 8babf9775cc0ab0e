import json

from assay.operators import drift

SCHEMA = "line_id long, feed string, file_id string, file_no int, payload string"


def lines(spark, files):
    rows, n = [], 0
    for (feed, no), records in files.items():
        for record in records:
            n += 1
            rows.append((n, feed, f"{feed}/{no}", no, record if record is None or isinstance(record, str) else json.dumps(record)))
    return spark.createDataFrame(rows, SCHEMA)


def found(spark, files):
    df = drift.changes(drift.field_profiles(lines(spark, files), "payload"))
    return sorted((r.file_id, r.change_kind, r.old_field, r.new_field) for r in df.collect())


HASHES = ["9c0abe51c6", "d0bf3e6ee1", "0012a3fa00"]


def version(key, i):
    return {key: HASHES[i % 3], "n": i, "sub": {"a": "x y"}}


def test_kinds_of_change(spark):
    files = {
        ("f", 1): [version("config_version", i) for i in range(9)],
        ("f", 2): [version("configVersion", i) for i in range(9)],
        ("f", 3): [{**version("configVersion", i), "n": str(i), "extra": {"deep": 1}} for i in range(9)],
        ("f", 5): [{k: v for k, v in version("configVersion", i).items() if k != "sub"} | {"n": str(i), "extra": {"deep": 1, "more": None}} for i in range(9)],
        ("g", 1): [version("config_version", 1)],
    }
    assert found(spark, files) == [
        ("f/2", "renamed", "config_version", "configVersion"),
        ("f/3", "added", "", "extra"),
        ("f/3", "type_changed", "n", "n"),
        ("f/5", "added", "", "extra.more"),
        ("f/5", "removed", "sub", ""),
    ]


def test_other_content_is_no_rename(spark):
    files = {("f", 1): [{"model": f"mdl-{i}", "s": 0.1 + i / 100} for i in range(9)], ("f", 2): [{"note": f"{i} words in a row.", "rows": 5000 + i} for i in range(9)]}
    assert found(spark, files) == [("f/2", "added", "", "note"), ("f/2", "added", "", "rows"), ("f/2", "removed", "model", ""), ("f/2", "removed", "s", "")]


def test_bad_payloads_do_not_count(spark):
    good = {"a": 1}
    files = {("f", 1): [good, None, "", "{", "NaN", '{"b": NaN}', "[1]", '{"c": 1', "7"], ("f", 2): [good], ("f", 3): [{"a": None}], ("f", 4): [{"a": "x"}]}
    assert found(spark, files) == []


def test_only_the_topmost_change(spark):
    rows = lambda name, inner: [{name: [{"key": k, inner: 0.5} for k in ("u", "v")]} for _ in range(5)]
    assert found(spark, {("f", 1): rows("values", "value"), ("f", 2): rows("vals", "value")}) == [("f/2", "renamed", "values", "vals")]
    assert found(spark, {("f", 1): rows("values", "value"), ("f", 2): rows("values", "val")}) == [("f/2", "renamed", "values[].value", "values[].val")]
    assert found(spark, {("f", 1): [{"m": {"a": 1}}], ("f", 2): [{"m": [{"key": "a"}]}]}) == [("f/2", "type_changed", "m", "m")]


def test_placing_and_repeats(spark):
    files = {("f", 1): [{"a": 1}] * 3, ("f", 2): [{"a": 2, "b": 1}] * 2}
    df = lines(spark, files)
    lost = spark.createDataFrame([(90, None, "x", 1, '{"z": 1}'), (91, "f", None, 2, '{"z": 1}'), (92, "f", "f/2", None, '{"z": 1}')], SCHEMA)
    got = drift.changes(drift.field_profiles(df.union(lost).union(df), "payload")).collect()
    assert [(r.change_kind, r.new_field) for r in got] == [("added", "b")]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert drift.changes(drift.field_profiles(empty, "payload")).count() == 0
    assert drift.unified(empty, "payload").columns == ["line_id", "feed", "file_id", "file_no", "is_valid"]


def test_one_table(spark):
    files = {
        ("f", 1): [{"config_version": HASHES[i % 3], "m": {"a": 0.5}, "line_id": 1} for i in range(6)],
        ("f", 2): [{"configVersion": HASHES[i % 3], "m": [{"key": "a", "value": 0.5}], "line_id": 2} for i in range(6)],
        ("f", 3): [{"configVersion": {"hash": HASHES[i % 3], "rev": 1}, "m": {"a": None}} for i in range(6)] + ["broken"],
    }
    df = drift.unified(lines(spark, files), "payload")
    assert df.count() == 19 and df.filter("is_valid").count() == 18
    assert {"line_id", "line_id_", "m", "m__json"} <= set(df.columns) and len({c for c in df.columns if c.lower().startswith("config")}) == 3
    assert {json.loads(r.m)["a"] for r in df.filter("is_valid").collect()} == {0.5, None}


def test_deep_payload_is_no_crash(spark):
    deep = '{"a":' * 3000 + "1" + "}" * 3000
    assert drift.changes(drift.field_profiles(lines(spark, {("f", 1): [deep, {"b": 1}], ("f", 2): [{"b": 2}]}), "payload")).collect() is not None


def test_huge_numbers_and_large_ids(spark):
    rows = [(2**60 + 1, "f", "f/1", 1, '{"a": 1' + "0" * 400 + "}"), (None, "f", "f/1", 1, '{"a": 2}')]
    got = drift.unified(spark.createDataFrame(rows, SCHEMA), "payload").collect()
    assert {r.line_id for r in got} == {2**60 + 1, None} and sorted(r.a__number for r in got) == [2.0, float("inf")]


def test_renames_do_not_depend_on_file_size(spark):
    def records(names, n, at):
        values = lambda i: (f"2026-01-{1 + at:02d}T{i // 60:02d}:{i % 60:02d}", f"{at:02d}ab{i:08x}", f"set-{at}{i}", [{"id": f"run{at}x{i}"}])
        return [{"kept": {k: v} if at % 2 else {k: v, "n": i}} for i in range(n) for k, v in [(names[0], values(i)[0])]] + [dict(zip(names[1:], values(i)[1:], strict=True)) for i in range(n)]

    want = [("f/2", "renamed", "kept.made", "kept.madeAt"), ("f/2", "renamed", "key", "recordKey"), ("f/2", "renamed", "set", "dataset"), ("f/2", "added", "", "kept.n"), ("f/2", "renamed", "runs", "executions")]
    for n in (20, 2000):
        assert found(spark, {("f", 1): records(("made", "key", "set", "runs"), n, 1), ("f", 2): records(("madeAt", "recordKey", "dataset", "executions"), n, 2)}) == sorted(want)


def test_part_of_a_large_vocabulary_is_alike():
    def picture(values):
        fold, texts = drift._Fold(), drift._Texts()
        for v in values:
            fold.string(texts[v])
        return {"t_string": fold.types[0], "hashes": sorted(fold.hashes)[: drift.KEPT_HASHES], **{f"s_{s}": c for s, c in zip(drift.SHAPES, fold.shapes, strict=True)}}

    letters = "abcdefghij"
    words = [f"{a}{b}{c}word" for a in letters for b in letters for c in letters]
    assert drift._strings_alike(picture(words[::3]), picture(words)) == 1.0
    assert drift._strings_alike(picture(words[:12]), picture(words)) >= drift.LIKE
    assert drift._strings_alike(picture(words[:400]), picture(words[500:])) < drift.LIKE
    # A small vocabulary that repeats and does not recur is no rename, in a file of any size.
    assert drift._strings_alike(picture(["low", "mid"] * 500), picture(["red", "blue"] * 500)) < drift.LIKE


def test_both_names_of_a_rename_in_one_record(spark):
    part = lambda **k: [{"rows": 1, **{name: f"{v}-{i}" for name, v in k.items()}} for i in range(6)]
    files = {
        ("f", 1): part(dataset="set"), ("f", 2): part(model_ref="mdl"),  # looks like a rename
        ("g", 1): part(dataset="set", model_ref="mdl"),
        ("h", 1): part(config_version="v"), ("h", 2): part(configVersion="v"),
    }
    assert ("f/2", "renamed", "dataset", "model_ref") in found(spark, files)
    got = drift.unified(lines(spark, files), "payload")
    assert sorted(r.dataset for r in got.filter("dataset is not null").collect()) == sorted(2 * [f"set-{i}" for i in range(6)])
    assert sorted(r.model_ref for r in got.filter("model_ref is not null").collect()) == sorted(2 * [f"mdl-{i}" for i in range(6)])
    assert got.filter("feed = 'g' and dataset is not null and model_ref is not null").count() == 6
    assert len([c for c in got.columns if c.lower().startswith("config") and "__" not in c]) == 1


def test_both_names_in_a_line_that_cannot_be_placed(spark):
    files = {("f", 1): [{"dataset": f"set-{i}"} for i in range(6)], ("f", 2): [{"model_ref": f"mdl-{i}"} for i in range(6)]}
    lost = spark.createDataFrame([(90, None, "x", 1, '{"dataset": "a-1", "model_ref": "b-1", "only_here": 1}')], SCHEMA)
    row = drift.unified(lines(spark, files).union(lost), "payload").filter("line_id = 90").first()
    assert (row.dataset, row.model_ref, row.only_here) == ("a-1", "b-1", "1")


def test_a_taken_name_keeps_the_value():
    names = drift.Names({("m.a", "m.b"): 1}, {"m.a": 2, "m.b": 1})
    assert drift.canonical_value({"m": {"b": 1}}, "", names, set()) == {"m": {"a": 1}}
    assert drift.canonical_value({"m": {"b": 1, "a": 2}}, "", names, set()) == {"m": {"a": 2, "b": 1}}
    # The frequent rename is kept, the chain through a pair that occurs together is not.
    chain = drift.Names({("a", "b"): 9, ("b", "c"): 1}, {"a": 5, "b": 4, "c": 3}, [("a", "c")])
    assert [chain.canonical(p) for p in "abc"] == ["a", "a", "c"]


def test_floats_beyond_a_double(spark):
    payloads = ['{"a": 1e400, "m": {"b": -1e400}}', '{"a": -2.5e400, "m": {"b": 1e99999999999999999999}}', '{"a": 2, "m": {"b": 0e400}}']
    df = spark.createDataFrame([(i, "f", f"f/{i % 2}", i % 2, x) for i, x in enumerate(payloads * 2)], SCHEMA)
    assert drift.changes(drift.field_profiles(df, "payload")).collect() == []
    got = drift.unified(df, "payload").filter("is_valid").collect()
    assert sorted(r.a__number for r in got) == 2 * [float("-inf")] + [2.0, 2.0] + 2 * [float("inf")]
    assert {int(r.a) for r in got} == {10**400, -25 * 10**399, 2}
    assert all("Infinity" not in r.m for r in got) and {json.loads(r.m)["b"] for r in got} >= {-(10**400), 0.0}


def test_alternatives_that_appear_and_go(spark):
    numbers = [{"a": i, "m": {"b": "x"}, "l": [{"c": 1}]} for i in range(100)]
    mixed = [{"a": i if i % 3 else str(i), "m": {"b": "x"}, "l": [{"c": True if i == 7 else 1}]} for i in range(100)]
    only = [{"a": str(i), "m": {"b": None}, "l": []} for i in range(100)]
    df = lines(spark, {("f", 1): numbers, ("f", 2): mixed, ("f", 4): only, ("g", 1): only})
    got = {(r.file_id, r.path, r.change, r.json_type, r.records) for r in drift.alternatives(drift.field_profiles(df, "payload")).collect()}
    assert got == {("f/2", "a", "alternative_added", "string", 34), ("f/2", "l[].c", "alternative_added", "boolean", 1), ("f/4", "a", "alternative_removed", "number", 66)}
    assert found(spark, {("f", 1): numbers, ("f", 2): mixed}) == []  # the commonest types stay


def test_branches_of_nested_fields(spark):
    records = [{"m": {"b": 1, "c": "x"}, "l": [{"v": 1.5}, {"v": "high"}, 7, {}]}, {"m": {"b": "one"}, "l": [{"v": None}]}, {"m": 3, "l": None}, {"k": 1}]
    got = {r.line_id: r for r in drift.unified(lines(spark, {("f", 1): records}), "payload").collect()}
    assert (got[1].m_b__number, got[1].m_b__string, got[2].m_b__number, got[2].m_b__string, got[3].m_b__number) == (1.0, None, None, "one", None)
    assert (got[1].l_v__number, got[1].l_v__string, got[2].l_v__number) == ([1.5, None, None, None], [None, "high", None, None], [None])
    assert got[3].l_v__number is None and got[4].l_v__string is None and got[4].k == "1"
    assert got[3].m__number == 3.0 and got[1].m__json == json.dumps({"b": 1, "c": "x"}) and "m_c__string" not in got[1]


def test_too_many_names_are_refused(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(drift, "MOST_PATHS", 5)
    with pytest.raises(ValueError):
        drift.unified(lines(spark, {("f", 1): [{f"k{i}": i for i in range(6)}]}), "payload")
    # Keys below a field are not columns, however many they are.
    df = drift.unified(lines(spark, {("f", 1): [{"m": {f"k{i}": i for i in range(60)}}]}), "payload")
    assert df.columns[-2:] == ["m", "m__json"]


def test_folds_given_out_early_add_up(spark, monkeypatch):
    rows = [{"a": i, "b": f"w{i}"} for i in range(40)]
    df = lines(spark, {("f", 1): rows, ("f", 2): rows}).coalesce(1)
    want = sorted(map(str, drift.field_profiles(df, "payload").collect()))
    batches = [df.toPandas()]
    monkeypatch.setattr(drift, "FOLDS_HELD", 2)
    parts = list(drift._fold_batches(batches))
    assert len(parts) > 1
    monkeypatch.setattr(drift, "_fold_batches", lambda _: iter(parts))
    assert len(want) == 6 and sum(p["n"].sum() for p in parts) == 6 * 40
