"""Queries over raw and nested records: p2, p3 and p4 (p4 in drift.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.operators import badrows, drift, shred
from assay.session import cut, ship
from assay.sources.tables import table

KEY = ("log_id",)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Records that can't be parsed, each with the first reason that applies."""
    raw = table(spark, sf, "credit_raw").select("record_id", "raw_text")
    return badrows.rejected(raw, "raw_text", badrows.CREDIT_LAYOUT).select("record_id", "reason")


def p2_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Valid records as typed rows."""
    raw = table(spark, sf, "credit_raw").select("record_id", "file_id", "record_no", "raw_text")
    return badrows.accepted(raw, "raw_text", badrows.CREDIT_LAYOUT)


def _tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return shred.shred(table(spark, sf, "audit_record"), KEY, "record")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every child that exists, named by its path, from the flat tables."""
    flat = _tables(spark, sf)
    index = lambda c: F.concat(F.lit("["), F.col(c).cast("string"), F.lit("]"))
    category = F.concat(F.lit("categories"), index("categories_pos"))
    metric = F.concat(category, F.lit(".metrics"), index("categories_metrics_pos"))
    outcome = [c for c in flat["record"].columns if c.startswith("production_outcome_")]
    present = F.coalesce(*(F.col(c).cast("string") for c in outcome)).isNotNull()
    return (
        flat["categories"].select("log_id", category.alias("node"))
        .unionByName(flat["categories_metrics"].select("log_id", metric.alias("node")))
        .unionByName(flat["metric_values"].select("log_id", F.concat(F.lit("metric_values["), F.col("metric_values_key"), F.lit("]")).alias("node")))
        .unionByName(flat["record"].filter(present).select("log_id", F.lit("production_outcome").alias("node")))
    )


def p3_records(spark: SparkSession, sf: str) -> DataFrame:
    return _tables(spark, sf)["record"]


def p3_categories(spark: SparkSession, sf: str) -> DataFrame:
    return _tables(spark, sf)["categories"]


def p3_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _tables(spark, sf)["categories_metrics"]


def p3_metric_values(spark: SparkSession, sf: str) -> DataFrame:
    return _tables(spark, sf)["metric_values"]


def _profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles of all files, written down as they are used more than once."""
    ship(spark)
    lines = table(spark, sf, "audit_line").select("feed", "file_id", "file_no", "payload")
    return cut(drift.field_profiles(lines, "payload"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every change of the fields between consecutive files of a feed."""
    return drift.changes(_profiles(spark, sf)).select("file_id", "change_kind", "old_field", "new_field")


def p4_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """How often each path has each JSON type in each file."""
    found = _profiles(spark, sf).filter("path <> ''")
    return found.select("feed", "file_no", "file_id", "path", "n", *(F.col(f"t_{t}").alias(t) for t in drift.JSON_TYPES))


def p4_alternatives(spark: SparkSession, sf: str) -> DataFrame:
    """Every alternative type that a path takes on or gives up, with the file in which that began."""
    return drift.alternatives(_profiles(spark, sf))


def p4_table(spark: SparkSession, sf: str) -> DataFrame:
    """All lines as one table with canonical names and typed branches."""
    ship(spark)
    lines = table(spark, sf, "audit_line").select("line_id", "feed", "file_id", "file_no", "payload")
    return drift.unified(lines, "payload")


QUERIES = {f.__name__: f for f in (p2_found, p2_rows, p3_found, p3_records, p3_categories, p3_metrics, p3_metric_values, p4_found, p4_table, p4_profiles, p4_alternatives)}

_QUOTED = r'("([^"]|"")*"|[^",]*)'
_PARSED = rf"""
WITH rec AS (SELECT record_id, file_id, record_no, regexp_replace(coalesce(raw_text, ''), '[\r\n]+\z', '') AS t FROM credit_raw),
shaped AS (SELECT *, regexp_full_match(t, '{_QUOTED}(,{_QUOTED})*') AS sound FROM rec),
cut AS (SELECT *, CASE WHEN sound THEN regexp_extract_all(',' || t, ',("(?:[^"]|"")*"|[^",]*)', 1) END AS raw_fields FROM shaped),
plain AS (SELECT *, [CASE WHEN left(x, 1) = '"' THEN replace(x[2:-2], '""', '"') ELSE x END FOR x IN raw_fields] AS f FROM cut),
trimmed AS (SELECT *, [trim(x, ' ') FOR x IN f] AS v FROM plain),
judged AS (SELECT *, CASE WHEN NOT sound THEN 'broken_quoting' WHEN len(v) <> 7 THEN 'wrong_count'
  WHEN (v[1] IN ('', 'NA') OR (regexp_full_match(v[1], '[0-9]+(\.[0-9]+)?') AND TRY_CAST(v[1] AS DECIMAL(38, 18)) BETWEEN 4 AND 72))
   AND (v[2] IN ('', 'NA') OR (regexp_full_match(v[2], '[0-9]+(\.[0-9]+)?') AND TRY_CAST(v[2] AS DECIMAL(38, 18)) BETWEEN 250 AND 20000))
   AND v[6] IN ('0', '1') THEN NULL ELSE 'invalid_value' END AS reason FROM trimmed)
"""

SQL = {
    "p2_found": _PARSED + "SELECT record_id, reason FROM judged WHERE reason IS NOT NULL",
    "p2_rows": _PARSED
    + """SELECT record_id, file_id, record_no, TRY_CAST(nullif(v[1], 'NA') AS DOUBLE) AS duration, TRY_CAST(nullif(v[2], 'NA') AS DOUBLE) AS credit_amount,
  TRY_CAST(nullif(v[3], 'NA') AS DOUBLE) AS age, CASE WHEN regexp_full_match(v[4], '[+-]?[0-9]+') THEN TRY_CAST(v[4] AS INT) END AS installment_rate,
  CASE WHEN v[5] NOT IN ('', 'NA') THEN v[5] END AS sex, TRY_CAST(v[6] AS INT) AS target, CASE WHEN v[7] <> '' THEN f[7] END AS remark FROM judged WHERE reason IS NULL""",
    "p3_records": """SELECT log_id, run_id, record_id, timestamp_utc, config_version, dataset, task, risk_tier, overall_confidence, fired_rule_id, hard_flag, reason, recommendation,
  production_outcome.deployment_date AS production_outcome_deployment_date, production_outcome.incident_observed AS production_outcome_incident_observed,
  production_outcome.drift_detected AS production_outcome_drift_detected, production_outcome.audit_finding AS production_outcome_audit_finding,
  production_outcome.retraining_triggered AS production_outcome_retraining_triggered, production_outcome.production_success_label AS production_outcome_production_success_label, ingested_at FROM audit_record""",
    "p3_categories": """SELECT log_id, CAST(i - 1 AS INT) AS categories_pos, c.category, c.confidence, c.reason
  FROM (SELECT log_id, unnest(categories) AS c, generate_subscripts(categories, 1) AS i FROM audit_record) WHERE c IS NOT NULL""",
    "p3_metrics": """SELECT log_id, CAST(i - 1 AS INT) AS categories_pos, CAST(j - 1 AS INT) AS categories_metrics_pos, m.key, m.value, m.strength, m.passed
  FROM (SELECT log_id, i, unnest(c.metrics) AS m, generate_subscripts(c.metrics, 1) AS j
  FROM (SELECT log_id, unnest(categories) AS c, generate_subscripts(categories, 1) AS i FROM audit_record) WHERE c IS NOT NULL) WHERE m IS NOT NULL""",
    "p3_metric_values": """SELECT log_id, e.key AS metric_values_key, e.value AS value FROM (SELECT log_id, unnest(map_entries(metric_values)) AS e FROM audit_record)""",
}
_P3 = {k: SQL[k] for k in ("p3_categories", "p3_metrics", "p3_metric_values")}
SQL["p3_found"] = f"""
SELECT log_id, 'categories[' || categories_pos || ']' AS node FROM ({_P3["p3_categories"]})
UNION ALL SELECT log_id, 'categories[' || categories_pos || '].metrics[' || categories_metrics_pos || ']' FROM ({_P3["p3_metrics"]})
UNION ALL SELECT log_id, 'metric_values[' || metric_values_key || ']' FROM ({_P3["p3_metric_values"]})
UNION ALL SELECT log_id, 'production_outcome' FROM audit_record WHERE production_outcome.deployment_date IS NOT NULL OR production_outcome.incident_observed IS NOT NULL
  OR production_outcome.drift_detected IS NOT NULL OR production_outcome.audit_finding IS NOT NULL OR production_outcome.retraining_triggered IS NOT NULL
  OR production_outcome.production_success_label IS NOT NULL"""

_KINDS = {"string": ("VARCHAR",), "number": ("UBIGINT", "BIGINT", "DOUBLE", "HUGEINT"), "boolean": ("BOOLEAN",), "object": ("OBJECT",), "array": ("ARRAY",)}
_PROFILES = (
    r"""WITH placed AS (SELECT feed, CAST(file_no AS BIGINT) AS file_no, file_id, payload FROM audit_line WHERE feed IS NOT NULL AND file_no IS NOT NULL AND file_id IS NOT NULL),
good AS (SELECT * FROM placed WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
cells AS (SELECT feed, file_no, file_id, replace(regexp_replace(substr(t.fullkey, 3), '\[[0-9]+\]', '[]', 'g'), '"', '') AS path, t.type AS kind FROM good, json_tree(good.payload) AS t WHERE t.fullkey <> '$'),
p AS (SELECT feed, file_no, file_id, path, count(*) AS n, """
    + ", ".join(f"count(*) FILTER (kind IN {kinds if len(kinds) > 1 else '(' + repr(kinds[0]) + ')'}) AS {name}" for name, kinds in _KINDS.items())
    + " FROM cells GROUP BY ALL)"
)
SQL["p4_profiles"] = _PROFILES + " SELECT * FROM p"
SQL["p4_alternatives"] = (
    _PROFILES
    + """, files AS (SELECT DISTINCT feed, file_no, file_id FROM placed),
steps AS (SELECT *, lag(file_no) OVER w AS old_no, lag(file_id) OVER w AS old_id FROM files WINDOW w AS (PARTITION BY feed ORDER BY file_no, file_id)),
pairs AS (SELECT now.feed, now.file_id, now.path, """
    + ", ".join(f"now.{t} AS now_{t}, was.{t} AS was_{t}" for t in _KINDS)
    + """ FROM p AS now JOIN steps AS s ON now.feed = s.feed AND now.file_no = s.file_no AND now.file_id = s.file_id
  JOIN p AS was ON was.feed = s.feed AND was.file_no = s.old_no AND was.file_id = s.old_id AND was.path = now.path
  WHERE """
    + " AND ".join("(" + " OR ".join(f"{side}.{t} > 0" for t in _KINDS) + ")" for side in ("now", "was"))
    + ") "
    + " UNION ALL ".join(f"SELECT feed, file_id, path, CASE WHEN now_{t} > 0 THEN 'alternative_added' ELSE 'alternative_removed' END AS change, '{t}' AS json_type, greatest(now_{t}, was_{t}) AS records FROM pairs WHERE (now_{t} > 0) <> (was_{t} > 0)" for t in _KINDS)
)
