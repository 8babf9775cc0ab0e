"""Queries over metric values in long form: bands, confidence per category, nested records and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.scalars import utc_iso, utc_minute
from assay.operators import bands, rules
from assay.session import shared_folder
from assay.sources import files
from assay.sources.tables import table


def _interpreted(spark: SparkSession, sf: str) -> DataFrame:
    values = bands.latest(table(spark, sf, "metric_value"), ["run_id", "metric_key"], "computed_at")
    return bands.interpret(values, bands.band_table(spark))


def band_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _interpreted(spark, sf).select("run_id", "metric_key", "category", "strength", "passed")


def category_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return bands.by_category(_interpreted(spark, sf)).select("run_id", "category", "metrics", "weak", "moderate", "confidence")


def category_reason(spark: SparkSession, sf: str) -> DataFrame:
    return bands.by_category(_interpreted(spark, sf)).select("run_id", "category", "reason")


def run_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """The weakest category of each run."""
    return bands.weakest(bands.by_category(_interpreted(spark, sf)))


def unknown_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics without bounds, which interpretation leaves out, and how often they occur."""
    return table(spark, sf, "metric_value").join(F.broadcast(bands.band_table(spark)), "metric_key", "left_anti").groupBy("metric_key").agg(F.count(F.lit(1)).alias("n"))


def first_match_grade(spark: SparkSession, sf: str) -> DataFrame:
    """A grade per run by ordered rules on the counts of its weak and moderate metrics."""
    rules = spark.createDataFrame([(1, 2, 0, "two weak"), (2, 1, 0, "one weak"), (3, 0, 2, "two moderate")], "ord int, least_weak int, least_moderate int, outcome string")
    counts = _interpreted(spark, sf).groupBy("run_id").agg(F.count_if(F.col("strength") == "weak").alias("weak"), F.count_if(F.col("strength") == "moderate").alias("moderate"))
    matches = (F.col("weak") >= F.col("least_weak")) & (F.col("moderate") >= F.col("least_moderate"))
    return bands.first_match(counts, rules, matches, ["run_id"], otherwise="clean")


def threshold_strings(spark: SparkSession, sf: str) -> DataFrame:
    return bands.band_table(spark).select("metric_key", bands.threshold_text(F.col("direction"), F.col("strong_at"), F.col("weak_below")).alias("threshold"))


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return bands.last_records(table(spark, sf, "audit_record"))


def _whole(spark: SparkSession, sf: str) -> DataFrame:
    interpreted = _interpreted(spark, sf)
    categories = bands.by_category(interpreted)
    return bands.whole_record(bands.nested_record(interpreted, categories), categories, _records(spark, sf))


def nested_records(spark: SparkSession, sf: str) -> DataFrame:
    """One whole record per run, its nested part written out in order so that it can be compared."""
    metric = lambda m: F.concat(m["key"], F.lit("="), m["strength"], F.when(m["passed"], "+").otherwise("-"))
    category = lambda c: F.concat(c["category"], F.lit(":"), c["confidence"], F.lit("("), F.array_join(F.transform(c["metrics"], metric), ","), F.lit(")"))
    flat = [c for c in bands.RECORD if c not in ("metric_values", "categories", "production_outcome")]
    values = F.array_join(F.array_sort(F.transform(F.map_entries("metric_values"), lambda e: F.concat(e["key"], F.when(e["value"].isNull(), "?").otherwise("")))), ",")
    unset = F.lit(True)
    for field in ("deployment_date", "incident_observed", "drift_detected", "audit_finding", "retraining_triggered", "production_success_label"):
        unset = unset & F.col(f"production_outcome.{field}").isNull()
    return _whole(spark, sf).select("run_id", *flat, F.array_join(F.transform("categories", category), ";").alias("categories"), values.alias("metric_values"), unset.alias("outcome_is_open"))


def record_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Whole records as JSON documents, written and read again: what is left of them must be what was written."""
    path = shared_folder(spark, "documents")
    whole = _whole(spark, sf).drop("run_id")
    files.write_documents(whole, path)
    back = spark.read.schema(whole.schema).json(path)
    return back.select("record_id", "dataset", "overall_confidence", F.size("categories").alias("n_categories"), F.size("metric_values").alias("n_values"), F.aggregate("categories", F.lit(0), lambda n, c: n + F.size(c["metrics"])).alias("n_metrics"))


def evidence_reports(spark: SparkSession, sf: str) -> DataFrame:
    """The report of each run."""
    interpreted = _interpreted(spark, sf)
    return bands.report_lines(interpreted, bands.by_category(interpreted), _records(spark, sf))


def time_formats(spark: SparkSession, sf: str) -> DataFrame:
    """Times as ISO text and to the minute, and a random short id's length."""
    rows = table(spark, sf, "audit_record").select("log_id", utc_iso(F.col("ingested_at")).alias("iso"), utc_minute(F.col("ingested_at")).alias("minute"), F.length(files.short_id()).alias("id_length"))
    return rows.withColumn("is_past", utc_iso() > F.col("iso"))


TEMPLATES = (("credit_underwriting", "utility", 1, True), ("credit_underwriting", "fairness", 2, True), ("fraud_detection", "rare_event", 1, True), ("fraud_detection", "privacy", 2, False), ("aml", "utility", 1, False))


def required_categories(spark: SparkSession, sf: str) -> DataFrame:
    """The categories that a run's task asks for: those it has, in order, and those it lacks."""
    runs = _records(spark, sf).select("run_id", "task", F.col("risk_tier").alias("tier"))
    required = spark.createDataFrame(list(TEMPLATES), rules.REQUIRED)
    held = rules.gathered(runs, bands.by_category(_interpreted(spark, sf)), required)
    return held.select("run_id", "task", F.array_join(F.transform("held", lambda c: c["category"]), ",").alias("held"), F.array_join("missing", ",").alias("missing"))


def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Raw records with quotes, separators and line breaks in them, written as delimited text and read again."""
    path = shared_folder(spark, "csv")
    rows = table(spark, sf, "credit_raw").select("record_id", "file_id", "raw_text")
    files.write_csv(rows, path)
    return files.read_csv(spark, path, rows.schema)


def whitespace_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A headerless file with fields between runs of white space."""
    path = shared_folder(spark, "text")
    table(spark, sf, "customer").select(F.concat(F.lit("  "), F.col("c_custkey").cast("string"), F.lit(" \t "), F.col("c_mktsegment"), F.lit("   "), F.format_string("%.2f", "c_acctbal")).alias("value")).write.text(path)
    df = files.read_whitespace(spark, path, ["c_custkey", "segment", "balance", "beyond"])
    return files.numbers(df, ["balance"]).withColumn("c_custkey", F.col("c_custkey").cast("bigint"))


def source_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """The first source that can be read, and which paths exist."""
    there, gone = f"{sf}/region.parquet", f"{sf}/no_such_table.parquet"
    rows = files.first_available(lambda: spark.read.parquet(gone), lambda: spark.read.parquet(there))
    return rows.select("r_name").withColumns({"there": F.lit(files.exists(spark, there)), "gone": F.lit(files.exists(spark, gone))})


def _settings_text() -> str:
    return "".join(f"{m}: {{category: {c}, direction: {d}_better, strong_at: {s}, weak_below: {w}}}\n" for m, c, d, s, w in bands.BANDS)


def settings_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Bounds read from a settings file, with the version of its bytes."""
    path = shared_folder(spark, "settings")
    spark.range(1).select(F.lit(_settings_text().rstrip("\n")).alias("value")).coalesce(1).write.text(path)
    settings, version = files.read_settings(spark, f"{path}/*.txt")
    return bands.band_table(spark, files.bands_from(settings)).withColumn("version", F.lit(version))


QUERIES = {f.__name__: f for f in (band_metrics, category_confidence, category_reason, run_confidence, unknown_metrics, first_match_grade, threshold_strings, nested_records, record_documents, evidence_reports, time_formats, required_categories, csv_round_trip, whitespace_scan, source_fallback, settings_scan)}

_BANDS = ", ".join(f"('{m}', '{c}', '{d}', {s}::DOUBLE, {w}::DOUBLE)" for m, c, d, s, w in bands.BANDS)
_WITH = f"""
WITH band(metric_key, category, direction, strong_at, weak_below) AS (VALUES {_BANDS}),
last_value AS (SELECT run_id, metric_key, max(row(computed_at, task, metric_ord, value)) AS r FROM metric_value GROUP BY ALL),
v AS (SELECT run_id, metric_key, r[3] AS metric_ord, r[4] AS value FROM last_value),
i AS (SELECT v.*, band.* EXCLUDE (metric_key), CASE WHEN value IS NULL OR isnan(value) THEN 'weak'
  WHEN direction = 'higher' THEN CASE WHEN value >= strong_at THEN 'strong' WHEN value >= weak_below THEN 'moderate' ELSE 'weak' END
  ELSE CASE WHEN value <= strong_at THEN 'strong' WHEN value <= weak_below THEN 'moderate' ELSE 'weak' END END AS strength FROM v JOIN band USING (metric_key)),
c AS (SELECT run_id, category, count(*) AS metrics, count(*) FILTER (strength = 'weak') AS weak, count(*) FILTER (strength = 'moderate') AS moderate,
  arg_min(metric_key, row(metric_ord, metric_key)) FILTER (strength = 'weak') AS first_weak, arg_min(metric_key, row(metric_ord, metric_key)) FILTER (strength = 'moderate') AS first_moderate FROM i GROUP BY ALL),
k AS (SELECT *, CASE WHEN weak >= 2 THEN 'low' WHEN weak = 1 OR moderate >= 2 THEN 'medium' ELSE 'high' END AS confidence FROM c)
"""
_LABEL = "(SELECT string_agg(upper(w[1]) || w[2:], ' ' ORDER BY o) FROM (SELECT unnest(string_split({x}, '_')) AS w, generate_subscripts(string_split({x}, '_'), 1) AS o))"
SQL = {
    "band_metrics": _WITH + "SELECT run_id, metric_key, category, strength, strength <> 'weak' AS passed FROM i",
    "category_confidence": _WITH + "SELECT run_id, category, metrics, weak, moderate, confidence FROM k",
    "category_reason": _WITH
    + f"""SELECT run_id, category, CASE WHEN weak >= 2 THEN weak || ' weak metrics' WHEN weak = 1 THEN 'one weak metric: ' || {_LABEL.format(x="first_weak")}
  WHEN moderate >= 2 THEN moderate || ' moderate metrics, none weak' WHEN moderate = 1 THEN 'one moderate metric: ' || {_LABEL.format(x="first_moderate")} ELSE 'all metrics strong' END AS reason FROM k""",
    "run_confidence": _WITH
    + """SELECT run_id, CASE WHEN bool_or(confidence = 'low') THEN 'low' WHEN bool_or(confidence = 'medium') THEN 'medium' ELSE 'high' END AS confidence,
  count(*) FILTER (confidence = 'medium') AS mediums, bool_or(confidence = 'low') AS any_low FROM k GROUP BY run_id""",
    "unknown_metrics": f"WITH band(metric_key, category, direction, strong_at, weak_below) AS (VALUES {_BANDS}) SELECT metric_key, count(*) AS n FROM metric_value WHERE metric_key NOT IN (SELECT metric_key FROM band) GROUP BY ALL",
    "first_match_grade": _WITH
    + """SELECT run_id, CASE WHEN count(*) FILTER (strength = 'weak') >= 2 THEN 'two weak' WHEN count(*) FILTER (strength = 'weak') >= 1 THEN 'one weak'
  WHEN count(*) FILTER (strength = 'moderate') >= 2 THEN 'two moderate' ELSE 'clean' END AS outcome FROM i GROUP BY run_id""",
    "threshold_strings": f"""WITH band(metric_key, category, direction, strong_at, weak_below) AS (VALUES {_BANDS}), s AS (SELECT *, CASE WHEN direction = 'higher' THEN '>=' ELSE '<=' END AS sign FROM band)
  SELECT metric_key, printf('%s %.2f strong / %s %.2f moderate', sign, strong_at, sign, weak_below) AS threshold FROM s""",
}
_LAST = """, last_record AS (SELECT * FROM audit_record WHERE run_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ingested_at DESC NULLS LAST, log_id DESC) = 1),
overall AS (SELECT run_id, CASE WHEN bool_or(confidence = 'low') THEN 'low' WHEN bool_or(confidence = 'medium') THEN 'medium' ELSE 'high' END AS overall_confidence FROM k GROUP BY run_id)"""
_WHY = SQL["category_reason"][len(_WITH) :]
_LABELLED = "array_to_string([upper(w[1]) || w[2:] FOR w IN string_split({x}, '_')], ' ')"
_THRESHOLD = "printf('%s %.2f strong / %s %.2f moderate', CASE WHEN direction = 'higher' THEN '>=' ELSE '<=' END, strong_at, CASE WHEN direction = 'higher' THEN '>=' ELSE '<=' END, weak_below)"
SQL["nested_records"] = _WITH + _LAST + """, m AS (SELECT run_id, category, string_agg(metric_key || '=' || strength || CASE WHEN strength <> 'weak' THEN '+' ELSE '-' END, ',' ORDER BY metric_ord, metric_key) AS metrics FROM i GROUP BY ALL),
n AS (SELECT run_id, string_agg(category || ':' || confidence || '(' || m.metrics || ')', ';' ORDER BY category) AS categories FROM k JOIN m USING (run_id, category) GROUP BY run_id),
e AS (SELECT run_id, string_agg(x, ',' ORDER BY x) AS metric_values FROM (SELECT run_id, metric_key || CASE WHEN value IS NULL THEN '?' ELSE '' END AS x FROM i) GROUP BY run_id)
SELECT n.run_id, record_id, timestamp_utc, config_version, dataset, task, risk_tier, overall.overall_confidence, fired_rule_id, hard_flag, reason, recommendation, n.categories, e.metric_values, true AS outcome_is_open
FROM n JOIN e USING (run_id) JOIN overall USING (run_id) LEFT JOIN last_record USING (run_id)"""
SQL["record_documents"] = _WITH + _LAST + """, n AS (SELECT run_id, count(DISTINCT category) AS n_categories, count(*) AS n_values, count(*) AS n_metrics FROM i GROUP BY run_id)
SELECT record_id, dataset, overall.overall_confidence, n_categories, n_values, n_metrics FROM n JOIN overall USING (run_id) LEFT JOIN last_record USING (run_id)"""
SQL["evidence_reports"] = _WITH + _LAST + f""", why AS (SELECT * FROM ({_WHY})),
line AS (SELECT *, '| ' || {_LABELLED.format(x='metric_key')} || ' | ' || coalesce(printf('%.4f', floor(CASE WHEN NOT isnan(value) THEN value END * 10000 + 0.5::DOUBLE) / 10000), '-') || ' | ' || {_THRESHOLD} || ' | ' || upper(strength[1]) || strength[2:] || ' |' AS line,
  '- ' || {_LABELLED.format(x='metric_key')} || ': ' || {_THRESHOLD} AS bound FROM i),
part AS (SELECT run_id, category, '### ' || {_LABELLED.format(x='category')} || ': ' || upper(any_value(k.confidence)[1]) || any_value(k.confidence)[2:] || chr(10) || any_value(why.reason) || chr(10) || '| Metric | Value | Threshold | Strength |' || chr(10) || '|---|---|---|---|' || chr(10)
  || string_agg(line, chr(10) ORDER BY metric_ord, metric_key) AS part FROM line JOIN k USING (run_id, category) JOIN why USING (run_id, category) GROUP BY run_id, category),
body AS (SELECT run_id, string_agg(part, chr(10) || chr(10) ORDER BY category) AS evidence FROM part GROUP BY run_id),
bounds AS (SELECT run_id, string_agg(bound, chr(10) ORDER BY metric_ord, metric_key) AS bounds FROM line GROUP BY run_id)
SELECT run_id, replace('# Evidence report~~Record: ' || coalesce(record_id, '-') || '~Made: ' || coalesce(strftime(ingested_at, '%Y-%m-%d %H:%M') || ' UTC', '-') || '~Settings: ' || coalesce(config_version, '-') || '~~## Summary~~- Dataset: ' || coalesce(dataset, '-')
  || '~- Task: ' || coalesce({_LABELLED.format(x='task')}, '-') || '~- Risk tier: ' || coalesce(upper(risk_tier[1]) || risk_tier[2:], '-') || '~- Overall confidence: ' || upper(overall.overall_confidence[1]) || overall.overall_confidence[2:] || '~~## Evidence~~', '~', chr(10)) || evidence
  || replace('~~## Bounds applied~~', '~', chr(10)) || bounds || replace('~~## Decision~~- Rule: ', '~', chr(10)) || coalesce(fired_rule_id, '-') || chr(10) || '- Flag: ' || coalesce(hard_flag, '-') || chr(10) || '- Result: ' || coalesce(recommendation, '-') || chr(10) || '- Reason: ' || coalesce(reason, '-') AS report
FROM body JOIN bounds USING (run_id) JOIN overall USING (run_id) LEFT JOIN last_record USING (run_id)"""
SQL["time_formats"] = """SELECT log_id, strftime(ingested_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime(ingested_at, '%f') <> '000000' THEN '.' || strftime(ingested_at, '%f') ELSE '' END || '+00:00' AS iso, strftime(ingested_at, '%Y-%m-%d %H:%M') || ' UTC' AS minute,
  8 AS id_length, CASE WHEN ingested_at IS NOT NULL THEN true END AS is_past FROM audit_record"""
_TEMPLATES = ", ".join(f"('{t}', '{c}', {o})" for t, c, o, _ in TEMPLATES)
SQL["required_categories"] = _WITH + _LAST + f""", want(task, category, ord) AS (VALUES {_TEMPLATES}),
met AS (SELECT l.run_id, l.task, w.category, w.ord, k.confidence FROM last_record AS l LEFT JOIN want AS w ON l.task = w.task LEFT JOIN k ON k.run_id = l.run_id AND k.category = w.category)
SELECT run_id, task, coalesce(string_agg(category, ',' ORDER BY ord) FILTER (confidence IS NOT NULL), '') AS held, coalesce(string_agg(category, ',' ORDER BY category) FILTER (confidence IS NULL), '') AS missing FROM met GROUP BY ALL"""
_MISSING = ", ".join(f"'{m}'" for m in files.MISSING)
SQL["csv_round_trip"] = f"SELECT record_id, CASE WHEN trim(file_id, ' ') NOT IN ({_MISSING}) THEN file_id END AS file_id, CASE WHEN trim(raw_text, ' ') NOT IN ({_MISSING}) THEN raw_text END AS raw_text FROM credit_raw"
SQL["whitespace_scan"] = "SELECT c_custkey::BIGINT AS c_custkey, c_mktsegment AS segment, printf('%.2f', c_acctbal)::DOUBLE AS balance, NULL::VARCHAR AS beyond FROM customer"
SQL["source_fallback"] = "SELECT r_name, true AS there, false AS gone FROM region"
_SETTINGS = _settings_text().replace("\n", "~")
SQL["settings_scan"] = f"WITH band(metric_key, category, direction, strong_at, weak_below) AS (VALUES {_BANDS}) SELECT *, substr(sha256(replace('{_SETTINGS}', '~', chr(10))), 1, 10) AS version FROM band"
