"""Queries over the real and the synthetic credit tables: encodings, kernels, models and generated tables.

The pair: all usable rows of real_credit and synthetic_credit, that is rows with all fields known and a positive amount, sex in one spelling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.scalars import clip, label, logistic, normal_cdf, normal_quantile, round4, uniform, usable
from assay.operators import copula, encode, kernels, models, ranks
from assay.session import cut, ship
from assay.sources.tables import table

NUMBERS = ["credit_amount", "age", "duration", "installment_rate"]
FEATURES = [*NUMBERS, "sex_male"]

#: Fixed values of the base generator: mean, deviation and bounds of the normal columns; the same for the logarithm of the amount;
#: levels of the rate; share of the first sex; intercept of the target's score, and per column weight, centre and scale.
NORMAL = {"age": (38, 11, 19, 75), "duration": (21, 12, 4, 72)}
LOG_AMOUNT = (7.8, 0.5, 250, 20000)
RATES = 4
MALE_SHARE = 0.69
INTERCEPT = 0.9
TERMS = (("duration", -0.03, 21, 12), ("credit_amount", -0.35, 3500, 3000), ("age", 0.02, 38, 11), ("installment_rate", -0.15, 2.5, 1))


def _clean(df: DataFrame) -> DataFrame:
    sex = F.lower(F.regexp_replace("sex", r"^\s+|\s+$", ""))
    out = df.select("rid", *(F.col(c).cast("double").alias(c) for c in NUMBERS), sex.alias("sex"), "target")
    known = F.col("target").isNotNull() & F.col("sex").isin("male", "female") & (F.col("credit_amount") > 0)
    for c in NUMBERS:
        known = known & usable(F.col(c))
    return out.filter(known)


def _real(spark: SparkSession, sf: str) -> DataFrame:
    return _clean(table(spark, sf, "real_credit"))


def _synthetic(spark: SparkSession, sf: str) -> DataFrame:
    return _clean(table(spark, sf, "synthetic_credit"))


def _score() -> Column:
    """The linear score of a good outcome."""
    return sum((w * (F.col(c) - centre) / scale for c, w, centre, scale in TERMS), F.lit(INTERCEPT))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Real rows with two closed-form scores, in thousandths."""
    one = _score()
    other = 1.1 - 0.05 * F.col("duration") + 0.01 * F.col("age") - 0.2 * F.col("installment_rate")
    thousandths = lambda x: F.floor(logistic(x) * 1000 + 0.5) / 1000
    df = _real(spark, sf).withColumn("p", thousandths(one)).withColumn("q", thousandths(other))
    return df.withColumn("pred", (F.col("p") >= 0.65).cast("int")).withColumn("pred_other", (F.col("q") >= 0.4).cast("int"))


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def note(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return note


_CLEAN = """SELECT rid, CAST(credit_amount AS DOUBLE) AS credit_amount, CAST(age AS DOUBLE) AS age, CAST(duration AS DOUBLE) AS duration, CAST(installment_rate AS DOUBLE) AS installment_rate,
  lower(regexp_replace(sex, '^\\s+|\\s+$', '', 'g')) AS sex, target FROM {t}
  WHERE target IS NOT NULL AND lower(regexp_replace(sex, '^\\s+|\\s+$', '', 'g')) IN ('male', 'female') AND credit_amount > 0 AND NOT isnan(credit_amount) AND age IS NOT NULL AND NOT isnan(age)
  AND duration IS NOT NULL AND NOT isnan(duration) AND installment_rate IS NOT NULL AND NOT isnan(CAST(installment_rate AS DOUBLE))"""
_PAIR = f"WITH r AS ({_CLEAN.format(t='real_credit')}), s AS ({_CLEAN.format(t='synthetic_credit')})"
_SCORED = (
    _PAIR
    + f", l AS (SELECT *, {INTERCEPT}::DOUBLE" + "".join(f" + {w}::DOUBLE * ({c} - {centre}::DOUBLE) / {scale}" for c, w, centre, scale in TERMS) + """ AS a,
  1.1::DOUBLE - 0.05::DOUBLE * duration + 0.01::DOUBLE * age - 0.2::DOUBLE * installment_rate AS b FROM r),
m AS (SELECT *, floor(1 / (1 + exp(-a)) * 1000 + 0.5::DOUBLE) / 1000 AS p, floor(1 / (1 + exp(-b)) * 1000 + 0.5::DOUBLE) / 1000 AS q FROM l),
d AS (SELECT *, CAST(p >= 0.65::DOUBLE AS INT) AS pred, CAST(q >= 0.4::DOUBLE AS INT) AS pred_other FROM m)"""
)
_R4 = "floor({} * 10000 + 0.5::DOUBLE) / 10000"


@query("SELECT rid, dataset, row_no, credit_amount FROM real_credit ORDER BY rid LIMIT 6")
def preview_limit(spark: SparkSession, sf: str) -> DataFrame:
    """The first six rows; the limit is the feature."""
    return table(spark, sf, "real_credit").select("rid", "dataset", "row_no", "credit_amount").orderBy("rid").limit(6)


@query("SELECT count(*) AS n, format('{:,}', count(*)) AS shown FROM real_credit")
def row_count(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "real_credit").agg(F.count(F.lit(1)).alias("n"), F.format_number(F.count(F.lit(1)), 0).alias("shown"))


@query("SELECT o_orderkey, TRY_CAST(split_part(o_orderpriority, '-', 1) AS DOUBLE) AS rank, TRY_CAST(o_orderpriority AS DOUBLE) AS whole, CAST(trunc(o_totalprice / 7) AS BIGINT) AS cut FROM orders")
def coercing_cast(spark: SparkSession, sf: str) -> DataFrame:
    """Text as numbers where it is one, else null; division cut towards zero."""
    return table(spark, sf, "orders").select("o_orderkey", F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).try_cast("double").alias("rank"), F.col("o_orderpriority").try_cast("double").alias("whole"), (F.col("o_totalprice") / 7).cast("bigint").alias("cut"))


@query(_PAIR + " SELECT 'r' AS src, count(*) AS n FROM r UNION ALL SELECT 's', count(*) FROM s")
def dropna_counts(spark: SparkSession, sf: str) -> DataFrame:
    both = _real(spark, sf).select(F.lit("r").alias("src")).unionByName(_synthetic(spark, sf).select(F.lit("s").alias("src")))
    return both.groupBy("src").agg(F.count(F.lit(1)).alias("n"))


_U = "(CAST('0x' || substr(md5({}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


@query(_PAIR + f" SELECT rid, sex, CASE WHEN sex = 'female' AND target = 1 AND {_U.format("'flip:' || rid")} < {copula.FLIPPED}::DOUBLE THEN 0 ELSE target END AS target FROM s")
def cond_update(spark: SparkSession, sf: str) -> DataFrame:
    """A repeatable ninth of one group's positives set to 0."""
    hit = (F.col("sex") == "female") & (F.col("target") == 1) & (uniform("flip", F.col("rid")) < copula.FLIPPED)
    return encode.conditional_update(_synthetic(spark, sf), "target", hit, 0).select("rid", "sex", "target")


@query("SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'heavy' ELSE 'light' END AS kind, least(greatest(c_acctbal, 0), 5000) AS bounded FROM customer")
def code_mapping(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "heavy").otherwise("light")
    return table(spark, sf, "customer").select("c_custkey", kind.alias("kind"), clip(F.col("c_acctbal"), 0, 5000).alias("bounded"))


@query(
    "SELECT c_custkey, "
    + ", ".join(f"CASE WHEN c_mktsegment = '{s}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c_mktsegment_{s}" for s in ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))
    + " FROM customer"
)
def onehot_drop_first(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return encode.one_hot(df, "c_mktsegment", encode.levels(df, "c_mktsegment"))


def _aligned(spark: SparkSession, sf: str) -> DataFrame:
    return encode.align(_real(spark, sf), _synthetic(spark, sf), ["sex"])


@query(_PAIR + " SELECT src, count(*) AS n, sum(CASE WHEN sex = 'male' THEN 1.0::DOUBLE ELSE 0 END) AS males, sum(duration) AS durations FROM (SELECT 'r' AS src, * FROM r UNION ALL SELECT 's', * FROM s) GROUP BY src")
def align_union(spark: SparkSession, sf: str) -> DataFrame:
    return _aligned(spark, sf).groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.sum("sex_male").alias("males"), F.sum("duration").alias("durations"))


@query("SELECT rid, src, variant_name, dataset FROM (SELECT rid, 'r' AS src, NULL AS variant_name, dataset FROM real_credit UNION ALL SELECT rid, 's', variant_name, NULL FROM synthetic_credit)")
def union_missing_columns(spark: SparkSession, sf: str) -> DataFrame:
    real, synthetic = table(spark, sf, "real_credit").select("rid", "dataset"), table(spark, sf, "synthetic_credit").select("rid", "variant_name")
    return encode.align(real, synthetic, []).select("rid", "src", "variant_name", "dataset")


@query("SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) AS size_z, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) AS price_z FROM part")
def zscore_pop(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    z = encode.z_scores(parts, encode.scales(parts, ["size", "price"]), ["size", "price"])
    return z.select("p_partkey", F.round("size", 6).alias("size_z"), F.round("price", 6).alias("price_z"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS rank FROM part")
def ordinal_rank(spark: SparkSession, sf: str) -> DataFrame:
    return ranks.positions(table(spark, sf, "part").select("p_partkey", "p_retailprice"), ["p_retailprice", "p_partkey"], "rank", 1).select("p_partkey", "rank")


@query(
    _PAIR
    + """, o AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY rid) - 1 AS pos, count(*) OVER (PARTITION BY target) AS n_all FROM r)
SELECT target, count(*) AS n, count(*) FILTER (pos < floor(n_all * 0.4::DOUBLE + 0.5::DOUBLE)) AS test, count(*) FILTER (pos % 3 = 0) AS fold_0, count(*) FILTER (pos % 3 = 1) AS fold_1, count(*) FILTER (pos % 3 = 2) AS fold_2,
  sum(rid) AS rids FROM o GROUP BY target"""
)
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    """Holdout of two fifths and three folds, exact to one row in each class; the sum of ids shows that no row is lost or doubled."""
    df = encode.folds(encode.holdout(_real(spark, sf), ["target"], "rid", 0.4), ["target"], "rid", 3)
    return df.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("test"), *(F.count_if(F.col("fold") == k).alias(f"fold_{k}") for k in range(3)), F.sum("rid").alias("rids"))


@query("SELECT round(corr(p_size, p_retailprice), 8) AS size_price, round(corr(p_partkey, p_retailprice), 8) AS key_price, round(corr(p_partkey, p_size), 8) AS key_size FROM part")
def correlation_matrix(spark: SparkSession, sf: str) -> DataFrame:
    pairs = (("p_size", "p_retailprice", "size_price"), ("p_partkey", "p_retailprice", "key_price"), ("p_partkey", "p_size", "key_size"))
    return table(spark, sf, "part").agg(*(F.round(F.corr(a, b), 8).alias(n) for a, b, n in pairs))


@query(_PAIR + " SELECT c, quantile_cont(v, 0.05) AS p05, median(v) AS p50, quantile_cont(v, 0.95) AS p95, min(v) AS lo, max(v) AS hi FROM (UNPIVOT r ON credit_amount, age, duration, installment_rate INTO NAME c VALUE v) GROUP BY c")
def quantile_table(spark: SparkSession, sf: str) -> DataFrame:
    tall = _real(spark, sf).unpivot([], NUMBERS, "c", "v")
    found = ranks.quantiles(tall, ["c"], "v", [0.05, 0.5, 0.95], ["p05", "p50", "p95"])
    return found.select("c", "p05", "p50", "p95", F.col("least").alias("lo"), F.col("most").alias("hi"))


@query("SELECT coalesce(sex, '?') AS sex, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM synthetic_credit GROUP BY sex")
def frequency_table(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "synthetic_credit").groupBy(F.coalesce("sex", F.lit("?")).alias("sex")).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all")))).select("sex", "n", (F.col("n") / F.col("all")).alias("share"))


@query("SELECT dataset, array_agg(task ORDER BY task) AS tasks FROM (SELECT DISTINCT dataset, task FROM audit_record WHERE dataset IS NOT NULL AND task IS NOT NULL) GROUP BY dataset")
def ordered_collect(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "audit_record").select("dataset", "task").filter("dataset IS NOT NULL AND task IS NOT NULL").distinct()
    return known.groupBy("dataset").agg(F.array_sort(F.collect_list("task")).alias("tasks"))


@query("SELECT record_id, min(log_id) AS log_id FROM audit_record WHERE record_id IS NOT NULL GROUP BY record_id")
def first_seen(spark: SparkSession, sf: str) -> DataFrame:
    """The first row of each key, by order and not by chance."""
    return table(spark, sf, "audit_record").filter("record_id IS NOT NULL").groupBy("record_id").agg(F.min("log_id").alias("log_id"))


@query("SELECT metric_key, count(*) AS n, substr(sha256(metric_key), 1, 10) AS version, upper(substr(metric_key, 1, 1)) || replace(substr(metric_key, 2), '_', '-') AS title FROM metric_value GROUP BY metric_key")
def text_functions(spark: SparkSession, sf: str) -> DataFrame:
    counted = table(spark, sf, "metric_value").groupBy("metric_key").agg(F.count(F.lit(1)).alias("n"))
    title = F.concat(F.upper(F.substring("metric_key", 1, 1)), F.replace(F.expr("substring(metric_key, 2)"), F.lit("_"), F.lit("-")))
    return counted.select("metric_key", "n", F.substring(F.sha2("metric_key", 256), 1, 10).alias("version"), title.alias("title"))


# ---------------------------------------------------------------- kernels


@query(_PAIR + " SELECT sex, count(*) AS n, avg(target) AS rate FROM s GROUP BY sex")
def pos_rate_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return kernels.rates_by_group(_synthetic(spark, sf), "sex", "target")


@query(_PAIR + f" SELECT {_R4.format('(max(x) - min(x))')} AS demographic_parity FROM (SELECT avg(target) AS x FROM s GROUP BY sex)")
def demographic_parity(spark: SparkSession, sf: str) -> DataFrame:
    return kernels.demographic_parity(_synthetic(spark, sf), "sex", "target").select(round4(F.col("demographic_parity")).alias("demographic_parity"))


@query(
    _SCORED
    + f""", g AS (SELECT sex, coalesce(avg(CAST(pred AS DOUBLE)) FILTER (target = 1), 0) AS h, avg(CAST(pred = target AS INT)) AS acc FROM d GROUP BY sex)
SELECT {_R4.format("(max(h) - min(h))")} AS equal_opportunity, {_R4.format("least(min(acc) / (SELECT avg(CAST(pred = target AS INT)) FROM d), 1)")} AS subgroup_performance FROM g"""
)
def group_quality(spark: SparkSession, sf: str) -> DataFrame:
    """equal_opportunity and subgroup_performance."""
    df = kernels.group_quality(_scored(spark, sf), "sex", "target", "pred")
    return df.select(*(round4(F.col(c)).alias(c) for c in df.columns))


@query(_SCORED + f" SELECT {_R4.format('avg(CAST(pred = pred_other AS INT))')} AS decision_agreement FROM d")
def agreement_rate(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).agg(round4(kernels.agreement(None, "pred", "pred_other")).alias("decision_agreement"))


_AUC = "(SELECT (sum(rk) FILTER (target = 1) - count(*) FILTER (target = 1) * (count(*) FILTER (target = 1) + 1) / 2) / (count(*) FILTER (target = 1) * count(*) FILTER (target = 0)) FROM (SELECT target, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS rk FROM d))"


@query(_SCORED + f" SELECT {_R4.format(_AUC.format(c='p'))} AS auc")
def auc_midrank(spark: SparkSession, sf: str) -> DataFrame:
    return kernels.auc(_scored(spark, sf), "target", "p").select(round4(F.col("auc")).alias("auc"))


@query(_SCORED + f", x AS (SELECT {_AUC.format(c='p')} AS a, {_AUC.format(c='q')} AS b) SELECT {_R4.format('least(b / a, 1)')} AS tstr, {_R4.format('greatest(0, a - b)')} AS auc_gap FROM x")
def tstr_auc_gap(spark: SparkSession, sf: str) -> DataFrame:
    df = kernels.transfer(_scored(spark, sf), "target", "p", "q")
    return df.select(*(round4(F.col(c)).alias(c) for c in df.columns))


_BIN = " + ".join(f"CAST(p >= {e!r}::DOUBLE AS INT)" for e in kernels.EDGES) + " - 1"


@query(
    _SCORED
    + f""", b AS (SELECT {_BIN} AS bin, count(*) AS n, avg(p) AS p, avg(target) AS y, sum((p - target) ^ 2) AS sq FROM d GROUP BY 1)
SELECT {_R4.format("(sum(sq) / sum(n))")} AS brier_score, {_R4.format("(sum(CASE WHEN bin BETWEEN 0 AND 9 THEN n * abs(p - y) ELSE 0 END) / sum(n))")} AS expected_calibration_error FROM b"""
)
def brier_ece(spark: SparkSession, sf: str) -> DataFrame:
    df = kernels.calibration(_scored(spark, sf), "target", "p")
    return df.select(*(round4(F.col(c)).alias(c) for c in df.columns))


@query(
    "WITH d AS (SELECT l_discount * 10 AS p, CAST(l_returnflag = 'R' AS INT) AS target FROM lineitem), "
    + f"b AS (SELECT {_BIN} AS bin, count(*) AS n, avg(p) AS p, avg(target) AS y FROM d GROUP BY 1) SELECT {_R4.format('(sum(CASE WHEN bin BETWEEN 0 AND 9 THEN n * abs(p - y) ELSE 0 END) / sum(n))')} AS expected_calibration_error FROM b"
)
def ece_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Scores that fall on the bins' edges and on 1.0."""
    df = table(spark, sf, "lineitem").select((F.col("l_discount") * 10).alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return kernels.calibration(df, "y", "p").select(round4(F.col("expected_calibration_error")).alias("expected_calibration_error"))


_TAILS = ", ".join(
    f"(SELECT avg(CAST({c} BETWEEN (SELECT min({c}) FROM s) AND (SELECT max({c}) FROM s) AS INT)) FROM r WHERE {c} < (SELECT quantile_cont({c}, 0.05) FROM r) OR {c} > (SELECT quantile_cont({c}, 0.95) FROM r))"
    for c in NUMBERS
)


@query(_PAIR + f" SELECT {_R4.format(f'(SELECT coalesce(avg(x), 1) FROM (SELECT unnest([{_TAILS}]) AS x))')} AS tail_coverage")
def tail_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return kernels.tail_coverage(_real(spark, sf), _synthetic(spark, sf), NUMBERS).select(round4(F.col("tail_coverage")).alias("tail_coverage"))


_RARE = "mm AS (SELECT arg_min(target, row(n, f)) AS c, min(n) / sum(n) AS rate FROM (SELECT target, count(*) AS n, min(rid) AS f FROM r GROUP BY target))"


@query(_PAIR + f", {_RARE} SELECT c AS minority, {_R4.format('least((SELECT avg(CAST(target = c AS INT)) FROM s) / rate, 1)')} AS rare_event_coverage FROM mm")
def rare_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return kernels.rare_coverage(_real(spark, sf), _synthetic(spark, sf), "target", "rid").select("minority", round4(F.col("rare_event_coverage")).alias("rare_event_coverage"))


@query(_SCORED + f", {_RARE} SELECT {_R4.format('(SELECT coalesce(avg(CAST(pred = c AS INT)), 0) FROM d WHERE target = c)')} AS rare_event_recall FROM mm")
def rare_recall(spark: SparkSession, sf: str) -> DataFrame:
    df = cut(_scored(spark, sf))
    return kernels.rare_recall(df, "target", "pred", kernels.minority(df, "target", "rid")).select(round4(F.col("rare_event_recall")).alias("rare_event_recall"))


_NN = _PAIR + (
    ", z AS (SELECT "
    + ", ".join(f"stddev_pop({c}) AS {c}" for c in NUMBERS)
    + ", stddev_pop(m) AS m FROM (SELECT *, CASE WHEN sex = 'male' THEN 1.0::DOUBLE ELSE 0 END AS m FROM r)), "
    + ", ".join(f"{t}z AS (SELECT {t}.rid, " + ", ".join(f"{t}.{c} / z.{c} AS v{i}" for i, c in enumerate(NUMBERS)) + f", (CASE WHEN sex = 'male' THEN 1.0::DOUBLE ELSE 0 END) / z.m AS v4 FROM {t}, z)" for t in "rs")
)
_D = "round(sqrt(min(" + " + ".join(f"(a.v{i} - b.v{i}) * (a.v{i} - b.v{i})" for i in range(5)) + ")), 9)"


@query(
    _NN
    + f""", rr AS (SELECT {_D} AS d FROM rz a JOIN rz b ON a.rid <> b.rid GROUP BY a.rid), sr AS (SELECT {_D} AS d FROM sz a, rz b GROUP BY a.rid), rs AS (SELECT a.rid, {_D} AS d FROM rz a, sz b GROUP BY a.rid),
tau AS (SELECT median(d) AS t FROM rs), pos AS (SELECT rid, d, row_number() OVER (ORDER BY rid) - 1 AS i FROM rs), half AS (SELECT count(*) // 2 AS h FROM rs)
SELECT {_R4.format("(SELECT abs(avg(CAST((d <= t) = (i < h) AS INT)) - 0.5) * 2 FROM pos, tau, half)")} AS membership_inference,
{_R4.format("((SELECT median(d) FROM sr) / (SELECT CASE WHEN median(d) > 0 THEN median(d) ELSE 1e-9 END FROM rr))")} AS nn_distance_ratio,
{_R4.format("(SELECT avg(CAST(d <= (SELECT quantile_cont(d, 0.05) FROM rr) AS INT)) FROM sr)")} AS duplicate_rate"""
)
def privacy_distances(spark: SparkSession, sf: str) -> DataFrame:
    """membership_inference, nn_distance_ratio and duplicate_rate over all rows of both tables."""
    ship(spark)
    both = _aligned(spark, sf)
    df = kernels.privacy(both.filter("src = 'r'"), both.filter("src = 's'"), "rid", FEATURES)
    return df.select(*(round4(F.col(c)).alias(c) for c in df.columns))


# ---------------------------------------------------------------- models (no SQL can express them)


def _split(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Real training rows, real test rows and synthetic rows, encoded alike."""
    both = cut(_aligned(spark, sf))
    real = cut(encode.holdout(both.filter("src = 'r'"), ["target"], "rid", 0.4))
    return real.filter("NOT is_test"), real.filter("is_test"), both.filter("src = 's'")


def _with_logistic(df: DataFrame) -> DataFrame:
    return models.scored(models.fit_logistic(df, FEATURES, "target"), df, FEATURES, "p", "pred")


@query()
def logistic_fairness(spark: SparkSession, sf: str) -> DataFrame:
    """Group quality of a logistic regression trained and scored on the synthetic rows."""
    df = _aligned(spark, sf).filter("src = 's'").withColumn("sex", F.when(F.col("sex_male") == 1, "male").otherwise("female"))
    return kernels.fairness(cut(df), "sex", "target", _with_logistic)


@query("SELECT 'none named' AS sensitive, 0.0::DOUBLE AS demographic_parity, 0.0::DOUBLE AS equal_opportunity, 1.0::DOUBLE AS subgroup_performance UNION ALL SELECT 'not there', 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE")
def fairness_without_groups(spark: SparkSession, sf: str) -> DataFrame:
    """No sensitive column is named, or the one that is named is not there."""
    df = _synthetic(spark, sf).drop("sex")
    rows = [kernels.fairness(df, group, "target", _with_logistic).select(F.lit(name).alias("sensitive"), "*") for name, group in (("none named", encode.default_sensitive(df)), ("not there", "sex"))]
    return rows[0].unionByName(rows[1])


@query(_PAIR + ", o AS (SELECT * FROM s WHERE target = 1) SELECT (SELECT max(x) - min(x) FROM (SELECT avg(target) AS x FROM o GROUP BY sex)) AS demographic_parity, 0.0::DOUBLE AS equal_opportunity, 1.0::DOUBLE AS subgroup_performance")
def fairness_of_one_class(spark: SparkSession, sf: str) -> DataFrame:
    """With a single class the parity is that of the table and the rest is neutral."""
    return kernels.fairness(_synthetic(spark, sf).filter("target = 1"), "sex", "target", _with_logistic)


@query("SELECT 'rid' AS col, true AS is_there UNION ALL SELECT 'sex', false UNION ALL SELECT 'target', true UNION ALL SELECT 'default_target', true UNION ALL SELECT 'default_sensitive', false")
def column_presence(spark: SparkSession, sf: str) -> DataFrame:
    """Whether columns are there, and what is taken by default where none is named."""
    df = table(spark, sf, "synthetic_credit").drop("sex")
    rows = [(c, encode.present(df, c)) for c in ("rid", "sex", "target")] + [("default_target", encode.default_target(df) == "target"), ("default_sensitive", encode.default_sensitive(df) is not None)]
    return spark.createDataFrame(rows, "col string, is_there boolean")


def _forests(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    train, test, synthetic = _split(spark, sf)
    one, two = models.fit_forest(train, "rid", FEATURES, "target"), models.fit_forest(synthetic, "rid", FEATURES, "target")
    scored = models.scored(two, models.scored(one, test, FEATURES, "p_real", "pred_real"), FEATURES, "p_synthetic", "pred_synthetic")
    noisy = models.scored(two, models.perturbed(test, "rid", FEATURES), FEATURES, "p_noisy", "pred_noisy")
    return cut(scored.select("rid", "target", "p_real", "pred_real", "p_synthetic", "pred_synthetic")), cut(noisy.select("rid", "pred_noisy"))


@query()
def forest_utility(spark: SparkSession, sf: str) -> DataFrame:
    """tstr, auc_gap, decision_agreement, perturbation_stability and rare_event_recall from two forests, each fitted once."""
    scored, noisy = _forests(spark, sf)
    rare = kernels.minority(_real(spark, sf), "target", "rid")
    stable = scored.join(noisy, "rid").agg(kernels.agreement(None, "pred_synthetic", "pred_noisy").alias("perturbation_stability"))
    out = kernels.transfer(scored, "target", "p_real", "p_synthetic").crossJoin(scored.agg(kernels.agreement(None, "pred_real", "pred_synthetic").alias("decision_agreement"))).crossJoin(stable).crossJoin(kernels.rare_recall(scored, "target", "pred_synthetic", rare))
    return out.select(*(round4(F.col(c)).alias(c) for c in out.columns))


@query()
def forest_calibration(spark: SparkSession, sf: str) -> DataFrame:
    _, test, synthetic = _split(spark, sf)
    df = kernels.calibration(models.calibrated(synthetic, test, "rid", FEATURES, "target"), "target", "p")
    return df.select(*(round4(F.col(c)).alias(c) for c in df.columns))


CATEGORY_METRICS = {
    "utility": ("forest_utility", ("tstr", "auc_gap", "decision_agreement")),
    "fairness": ("logistic_fairness", ("demographic_parity", "equal_opportunity", "subgroup_performance")),
    "privacy": ("privacy_distances", ("membership_inference", "nn_distance_ratio", "duplicate_rate")),
    "calibration": ("forest_calibration", ("brier_score", "expected_calibration_error")),
    "robustness": ("tail_coverage", ("tail_coverage",)),
    "rare_event": ("rare_coverage", ("rare_event_coverage",)),
}


def evidence(spark: SparkSession, sf: str, categories: list[str]) -> DataFrame:
    """The metrics of the wanted categories in long form, in their order; only the plans they need are built and each source runs once."""
    made: dict[str, DataFrame] = {}
    rows, order = None, 0
    for category in (c for c in CATEGORY_METRICS if c in categories):
        wanted = [CATEGORY_METRICS[category]]
        if category in ("robustness", "rare_event"):
            wanted.append(("forest_utility", ("perturbation_stability",) if category == "robustness" else ("rare_event_recall",)))
        for source, names in wanted:
            if source not in made:
                made[source] = cut(QUERIES[source](spark, sf))
            for name in names:
                part = made[source].select(F.lit(order).alias("metric_ord"), F.lit(category).alias("category"), F.lit(name).alias("metric_key"), round4(F.col(name)).alias("value"))
                rows = part if rows is None else rows.unionByName(part)
                order += 1
    if rows is None:
        raise ValueError("no known category asked for")
    return rows


@query()
def full_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """All fifteen metrics of the pair, with their bands."""
    from assay.operators.bands import band_table, interpret

    found = evidence(spark, sf, list(CATEGORY_METRICS))
    return interpret(found.drop("category"), band_table(spark)).select("metric_ord", "category", "metric_key", label(F.col("metric_key")).alias("title"), "value", "strength")


_COPIES = f"{copula.COPIED}::DOUBLE"


@query(
    _PAIR
    + f""", sp AS (SELECT *, row_number() OVER (ORDER BY rid) - 1 AS pos FROM s), rp AS (SELECT *, row_number() OVER (ORDER BY rid) - 1 AS pos FROM r),
d AS (SELECT sp.*, CASE WHEN pos < floor((SELECT count(*) FROM s) * {_COPIES}) THEN CAST(floor({_U.format("'draw:' || pos")} * (SELECT count(*) FROM r)) AS BIGINT) END AS drawn FROM sp)
SELECT d.rid, coalesce(rp.credit_amount, d.credit_amount) AS credit_amount, coalesce(rp.duration, d.duration) AS duration, coalesce(rp.target, d.target) AS target FROM d LEFT JOIN rp ON d.drawn = rp.pos"""
)
def positional_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    """The first synthetic rows overwritten by real ones that are drawn with replacement."""
    own = ["credit_amount", "duration", "target"]
    synthetic = cut(ranks.positions(_synthetic(spark, sf).select("rid", *own), ["rid"], "_at"))
    return copula.overwritten_by_position(synthetic, cut(_real(spark, sf)), own, "rid", int(copula.COPIED * synthetic.count()), "draw").drop("_at")


@query(_PAIR + " SELECT " + ", ".join(f"round(stddev_samp({c}), 6) AS {c}" for c in NUMBERS) + " FROM r")
def sample_deviations(spark: SparkSession, sf: str) -> DataFrame:
    """Sample deviations, the unit of the noise that rows are perturbed with."""
    return _real(spark, sf).agg(*(F.round(F.stddev_samp(c), 6).alias(c) for c in NUMBERS))


@query("SELECT CAST(i AS BIGINT) AS i, i / 100.0::DOUBLE AS share, CASE WHEN i < 50 THEN -1 WHEN i > 50 THEN 1 ELSE 0 END AS side FROM range(1, 100) AS t(i)")
def normal_functions(spark: SparkSession, sf: str) -> DataFrame:
    """The normal distribution undoes its inverse, and the inverse is below 0 for the lower half."""
    share = F.col("id") / 100.0
    z = normal_quantile(share)
    side = F.when(F.abs(z) < 0.001, 0).when(z < 0, -1).otherwise(1)
    return spark.range(1, 100).select(F.col("id").alias("i"), (F.floor(normal_cdf(z) * 100 + 0.5) / 100).alias("share"), side.alias("side"))


@query("SELECT round(corr(p_size, p_retailprice), 6) AS size_price, round(corr(p_partkey, p_retailprice), 6) AS key_price, round(corr(p_partkey, p_size), 6) AS key_size, 1.0::DOUBLE AS own FROM part")
def factor_product(spark: SparkSession, sf: str) -> DataFrame:
    """The triangular factor of a correlation matrix times its transpose gives the matrix."""
    import numpy as np

    c = copula.correlations(table(spark, sf, "part"), ["p_partkey", "p_size", "p_retailprice"])
    factor = np.linalg.cholesky(c + 1e-12 * np.eye(3))
    back = factor @ factor.T
    row = [round(float(x), 6) for x in (back[1, 2], back[0, 2], back[0, 1], back[0, 0])]
    return spark.createDataFrame([row], "size_price double, key_price double, key_size double, own double")


def _variants(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    real = cut(_real(spark, sf))
    model = copula.fit(real, NUMBERS, "sex", "target")
    n = real.count()
    return {"high_fidelity": copula.high_fidelity(spark, model, n), "fairness_degraded": copula.fairness_degraded(spark, model, n), "privacy_leaky": copula.privacy_leaky(spark, model, real, n), "low_utility": copula.low_utility(spark, model, n)}


@query()
def copula_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Four generated tables, each as large as the real one, summed up by sex."""
    rows = None
    for name, df in _variants(spark, sf).items():
        part = df.select(F.lit(name).alias("variant"), "sex", "target", *NUMBERS)
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("variant", "sex").agg(F.count(F.lit(1)).alias("n"), F.avg("target").alias("rate"), *(F.avg(c).alias(f"mean_{c}") for c in NUMBERS))


def _normal_sql(tag: str) -> str:
    one, two = (_U.format(f"'base/{tag}/{end}:' || rid") for end in "ab")
    return f"(sqrt(-2 * ln(({one} * 4294967296.0::DOUBLE + 1) / 4294967297.0::DOUBLE)) * cos(2 * pi() * {two}))"


_BASE = "WITH n AS (SELECT CAST(range AS BIGINT) AS rid FROM range((SELECT count(*) FROM real_credit))), g AS (SELECT rid, " + ", ".join(
    [f"floor(least(greatest({mean} + {deviation} * {_normal_sql(name)}, {low}), {high})::DOUBLE + 0.5::DOUBLE)::BIGINT AS {name}" for name, (mean, deviation, low, high) in NORMAL.items()]
    + [f"floor(least(greatest(exp({LOG_AMOUNT[0]}::DOUBLE + {LOG_AMOUNT[1]}::DOUBLE * {_normal_sql('amount')}), {LOG_AMOUNT[2]}), {LOG_AMOUNT[3]})::DOUBLE + 0.5::DOUBLE)::BIGINT AS credit_amount"]
    + [f"CAST(1 + floor({RATES} * {_U.format(chr(39) + 'base/rate:' + chr(39) + ' || rid')}) AS INT) AS installment_rate"]
    + [f"CASE WHEN {_U.format(chr(39) + 'base/sex:' + chr(39) + ' || rid')} < {MALE_SHARE}::DOUBLE THEN 'male' ELSE 'female' END AS sex"]
) + f" FROM n) SELECT *, CAST({_U.format(chr(39) + 'base/target:' + chr(39) + ' || rid')} < 1 / (1 + exp(-({INTERCEPT}::DOUBLE" + "".join(f" + {w}::DOUBLE * ({c} - {centre}::DOUBLE) / {scale}" for c, w, centre, scale in TERMS) + "))) AS INT) AS target FROM g"


@query(_BASE)
def base_generator(spark: SparkSession, sf: str) -> DataFrame:
    """A table of the same shape from nothing but a row count, that of real_credit."""
    from assay.functions.scalars import normal

    n = table(spark, sf, "real_credit").count()
    key = F.col("rid")
    whole = lambda x: F.floor(x + 0.5)
    df = spark.range(n).withColumnRenamed("id", "rid")
    for name, (mean, deviation, low, high) in NORMAL.items():
        df = df.withColumn(name, whole(clip(mean + deviation * normal(f"base/{name}", key), low, high)))
    mean, deviation, low, high = LOG_AMOUNT
    df = df.withColumn("credit_amount", whole(clip(F.exp(mean + deviation * normal("base/amount", key)), low, high)))
    df = df.withColumn("installment_rate", (1 + F.floor(RATES * uniform("base/rate", key))).cast("int"))
    df = df.withColumn("sex", F.when(uniform("base/sex", key) < MALE_SHARE, "male").otherwise("female"))
    return df.withColumn("target", (uniform("base/target", key) < logistic(_score())).cast("int"))
