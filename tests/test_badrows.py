import random

import pytest

from assay.operators import badrows
from assay.operators.badrows import CREDIT_LAYOUT


def split_by_hand(text):
    """Fields of a record by reading it character by character, or None for broken quoting."""
    fields, at, n = [], 0, len(text)
    while True:
        if at < n and text[at] == '"':
            at, out = at + 1, []
            while True:
                if at >= n:
                    return None
                if text[at] == '"':
                    if at + 1 < n and text[at + 1] == '"':
                        out.append('"')
                        at += 2
                        continue
                    at += 1
                    break
                out.append(text[at])
                at += 1
            if at < n and text[at] != ",":
                return None
            fields.append("".join(out))
        else:
            end = text.find(",", at)
            end = n if end < 0 else end
            if '"' in text[at:end]:
                return None
            fields.append(text[at:end])
            at = end
        if at >= n:
            return fields
        at += 1


def reason_by_hand(raw):
    from decimal import Decimal
    import re

    fields = split_by_hand((raw or "").rstrip("\r\n"))
    if fields is None:
        return "broken_quoting"
    if len(fields) != 7:
        return "wrong_count"
    v = [f.strip(" ") for f in fields]
    for text, low, high in ((v[0], 4, 72), (v[1], 250, 20000)):
        if text not in ("", "NA") and not (re.fullmatch(r"[0-9]+(\.[0-9]+)?", text) and low <= Decimal(text) <= high):
            return "invalid_value"
    return None if v[5] in ("0", "1") else "invalid_value"


CASES = [
    "12,500,30,2,male,1,ok", "12,500,30,2,male,1", "12,500,30,2,male,1,a,b", "", None, '"12",500,30,2,male,1,"a ""b"" c"', '12,500,30,2,male,1,"open', '12,500,30,2,male,1,a"b',
    '12,500,30,2,male,1,"a"b', '"a""",500', '12,500,30,2,male,1,""', '12,500,30,2,male,1,"x,\ny"\r\n', " 12 ,NA,,,,0,", "3.99,500,1,1,m,1,", "72.0,20000.00,1,1,m,1,", "72.01,500,1,1,m,1,", "3.99999999999999999999999,500,1,1,m,1,",
    "12,20000.0000000000000000001,1,1,m,1,", "+12,500,1,1,m,1,", "1e1,500,1,1,m,1,", ".5,500,1,1,m,1,", "12.,500,1,1,m,1,", "١٢,500,1,1,m,1,", "12,500,1,1,m,2,", "12,500,1,1,m,,", "12 ,500,1,1,m,1,", '12,500,1,1,m,1,"\u0001c\u0001q"', '"12\n",500,1,1,m,1,x', ',,,,,1,', '"', '""', '","', '"",""', '""""', ',"",', '"a",b"', "004,0250,,,,0,", "12,500,30,2,male,1,\\\"", "\r\n", "12,500,1,1,m,1,\n",
]


def check(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "record_id long, raw_text string")
    found = {r.record_id: r.reason for r in badrows.rejected(df, "raw_text", CREDIT_LAYOUT).collect()}
    assert found == {i: reason_by_hand(t) for i, t in enumerate(texts) if reason_by_hand(t)}
    good = badrows.accepted(df, "raw_text", CREDIT_LAYOUT)
    assert good.count() == len(texts) - len(found)
    return good


def test_known_cases(spark):
    rows = {r.record_id: r for r in check(spark, CASES).collect()}
    assert rows[0].duration == 12.0 and rows[0].target == 1 and rows[0].remark == "ok"
    assert rows[5].remark == 'a "b" c' and rows[11].remark == "x,\ny"
    assert rows[12].credit_amount is None and rows[12].sex is None and rows[12].remark is None
    assert rows[26].remark == "\u0001c\u0001q"


def test_random_records(spark):
    rng = random.Random(4)
    pieces = ['"', '"', ",", ",", ",", "a", " ", "\n", "12", "500", "NA", "1", "0", '""', "\u0001", "\\"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 24))) for _ in range(1500)]
    plain = [",".join(rng.choice(['12', ' 40 ', '"50"', '"a,b"', '"q""q"', "NA", "", "1", "0", "500", "99999", 'x"']) for _ in range(rng.choice([6, 7, 7, 7, 7, 8]))) for _ in range(1500)]
    check(spark, texts + plain)


def test_very_long_texts(spark):
    long = '12,500,30,2,male,1,"' + '""' * 60_000 + "x" * 200_000 + '"'
    rows = check(spark, [long, long[:-1], "," * 100_000, '"' * 99_999]).collect()
    assert len(rows) == 1 and len(rows[0].remark) == 260_000


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "record_id long, raw_text string")
    assert badrows.rejected(empty, "raw_text", CREDIT_LAYOUT).count() == 0
    clash = spark.createDataFrame([(1, "12,500,30,2,male,1,ok", "mine", "old"), (1, "x", "mine", "old")], "record_id long, raw_text string, age string, reason string")
    assert [r.age for r in badrows.accepted(clash, "raw_text", CREDIT_LAYOUT).collect()] == [30.0]
    assert [r.reason for r in badrows.rejected(clash, "raw_text", CREDIT_LAYOUT).collect()] == ["wrong_count"]


@pytest.mark.parametrize("text,fields", [('a,"b,c",d', ["a", "b,c", "d"]), ('"x""y"', ['x"y'])])
def test_hand_parser(text, fields):
    assert split_by_hand(text) == fields


def test_every_column_that_breaks_its_rule_is_named(spark):
    df = spark.createDataFrame([(1, "3,100,30,2,male,5,x"), (2, "12,1000,30,2,male,1,x"), (3, 'a"b,1'), (4, "12,1,30,2,male,1,x")], "record_id long, raw_text string")
    good, bad = badrows.checked_once(df, "raw_text", badrows.CREDIT_LAYOUT)
    assert {r.record_id: (r.reason, r["columns"]) for r in bad.collect()} == {1: ("invalid_value", ["duration", "credit_amount", "target"]), 3: ("broken_quoting", []), 4: ("invalid_value", ["credit_amount"])}
    assert [r.record_id for r in good.collect()] == [2] and good.columns == ["record_id", *(n for n, _ in badrows.CREDIT_LAYOUT.columns)]
