"""Every query with SQL gives the SQL's rows; the others run and keep their columns."""

import pytest

import __spark_entry__
from assay.plans import decisions, evidence, records
from tests.oracle import connect, differences

CORE = [n for m in (records, evidence, decisions) for n in m.QUERIES]
SQL = {n: s for m in (records, evidence, decisions) for n, s in m.SQL.items()}
PARTS = {"forest_utility", "forest_calibration", "logistic_fairness"}  # run as parts of full_evidence


@pytest.mark.parametrize("name", [n for n in CORE if n in SQL])
def test_same_rows_as_sql(spark, sf, name):
    assert differences(__spark_entry__.queries()[name](spark, sf), SQL[name], connect(sf)) == ""


@pytest.mark.parametrize("name", [n for n in CORE if n not in SQL and n not in PARTS | {"full_evidence"}])
def test_runs(spark, sf, name):
    df = __spark_entry__.queries()[name](spark, sf)
    assert df.columns and len(df.collect()) >= 1


def test_all_evidence_with_its_production_models(spark, sf):
    """Fifteen metrics in their order, from forests of full size; those that SQL can compute are SQL's."""
    rows = {r.metric_key: r for r in __spark_entry__.queries()["full_evidence"](spark, sf).collect()}
    from assay.operators.bands import BANDS

    assert sorted(rows.values(), key=lambda r: r.metric_ord)[0].metric_key == "tstr" and set(rows) == {b[0] for b in BANDS}
    assert all(r.value is not None and 0 <= r.value and (r.value <= 1 or r.metric_key == "nn_distance_ratio") for r in rows.values())
    con = connect(sf)
    for name in ("privacy_distances", "tail_coverage", "rare_coverage"):
        cur = con.execute(SQL[name])
        for column, value in zip([d[0] for d in cur.description], cur.fetchone(), strict=True):
            assert column == "minority" or rows[column].value == pytest.approx(value, abs=1e-9)
    assert rows["tstr"].value > 0.8 and rows["perturbation_stability"].value > 0.6 and rows["brier_score"].value < 0.3


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_core_needs_no_llm_package():
    import ast
    from pathlib import Path

    root = Path(__spark_entry__.__file__).parent
    for path in [*root.glob("assay/*.py"), *(p for p in root.glob("assay/*/*.py") if p.parent.name != "llm")]:
        for node in ast.walk(ast.parse(path.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any(n.startswith("assay.llm") for n in names), path
