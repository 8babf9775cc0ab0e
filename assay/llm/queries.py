"""Queries of the llm subpackage: p1 and p5 to p8."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm import collide, dyadic, packing, subjects, tokens
from assay.session import cut, ship
from assay.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# ---------------------------------------------------------------- p5: percentiles

GROUP = ["dataset", "sex", "age_band"]
PERCENTILES = [0.05, 0.25, 0.5, 0.75, 0.95]


def _amounts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that count, with their group and day."""
    sex = F.lower(F.regexp_replace("sex", r"(?U)^\s+|\s+$", ""))
    age = F.col("age")
    band = F.when(age < 40, "under_40").when((age >= 40) & ~F.isnan(age), "40_plus")
    rows = table(spark, sf, "real_credit").select("dataset", sex.alias("sex"), band.alias("age_band"), F.to_date("loaded_at").alias("load_day"), "credit_amount")
    counted = F.col("credit_amount").isNotNull() & ~F.isnan("credit_amount") & (F.col("credit_amount") > 0)
    return rows.filter(F.col("sex").isin("male", "female") & F.col("age_band").isNotNull() & counted)


@query
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Groups whose 95th percentile is at least four times the median, by sketches: the bounds that their exactly counted levels give for certain decide a group either way
    unless they leave it open; such a group is decided by exact counts inside the brackets of the ranks inverted down to the finest level."""
    ship(spark)
    rows = _amounts(spark, sf)
    sketched = cut(dyadic.percentiles(dyadic.build(rows, GROUP, "credit_amount"), [0.5, 0.95], certain=True).filter(F.col("n") >= 60))
    sure = F.col("p950_least") >= 4 * F.col("p500_most")
    open_yet = cut(sketched.filter(~sure & (F.col("p950_most") >= 4 * F.col("p500_least"))))
    exact = dyadic.exact_percentiles(rows, GROUP, "credit_amount", open_yet, [0.5, 0.95])
    both = exact.groupBy(*GROUP).agg(F.max(F.when(F.col("name") == "p500", F.col("percentile"))).alias("median"), F.max(F.when(F.col("name") == "p950", F.col("percentile"))).alias("top"))
    return sketched.filter(sure).select(*GROUP).unionByName(both.filter(F.col("top") >= 4 * F.col("median")).select(*GROUP))


@query
def p5_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Estimates and brackets of every group."""
    ship(spark)
    return dyadic.percentiles(dyadic.build(_amounts(spark, sf), GROUP, "credit_amount"), PERCENTILES)


@query
def p5_daily_merged(spark: SparkSession, sf: str) -> DataFrame:
    """The same as p5_percentiles, from sketches of single load days combined per group."""
    ship(spark)
    daily = dyadic.build(_amounts(spark, sf), [*GROUP, "load_day"], "credit_amount")
    return dyadic.percentiles(dyadic.merge(daily, GROUP), PERCENTILES)


@query
def p5_checked(spark: SparkSession, sf: str) -> DataFrame:
    """Each group's percentiles by exact counts, and whether the sketch's bracket holds them and its estimate is within the code's relative width of a value of the bracket's rank."""
    ship(spark)
    rows = _amounts(spark, sf)
    sketched = cut(dyadic.percentiles(dyadic.build(rows, GROUP, "credit_amount"), PERCENTILES))
    exact = dyadic.exact_percentiles(rows, GROUP, "credit_amount", sketched, PERCENTILES)
    sides = F.array(*(F.struct(F.lit(f"p{round(p * 1000):03d}").alias("name"), F.col(f"p{round(p * 1000):03d}_low").alias("low"), F.col(f"p{round(p * 1000):03d}").alias("mid"), F.col(f"p{round(p * 1000):03d}_high").alias("high")) for p in PERCENTILES))
    tall = sketched.select(*GROUP, F.explode(sides).alias("s")).select(*GROUP, "s.*")
    holds = F.col("percentile").between(F.col("low"), F.col("high")) & F.col("mid").between(F.col("low"), F.col("high"))
    return exact.join(tall, [*GROUP, "name"]).select(*GROUP, "n", "name", F.round("percentile", 6).alias("percentile"), holds.alias("bracket_holds"))


_COUNTED = r"""(
  SELECT dataset, lower(regexp_replace(sex, '^\s+|\s+$', '', 'g')) AS sex, CASE WHEN age < 40 THEN 'under_40' WHEN age >= 40 AND NOT isnan(age) THEN '40_plus' END AS age_band, credit_amount
  FROM real_credit WHERE credit_amount IS NOT NULL AND NOT isnan(credit_amount) AND credit_amount > 0)
WHERE sex IN ('male', 'female') AND age_band IS NOT NULL"""
SQL["p5_checked"] = " UNION ALL ".join(f"SELECT dataset, sex, age_band, count(*) AS n, 'p{round(p * 1000):03d}' AS name, round(quantile_cont(credit_amount, {p}), 6) AS percentile, true AS bracket_holds FROM {_COUNTED} GROUP BY ALL" for p in PERCENTILES)
SQL["p5_found"] = f"SELECT dataset, sex, age_band FROM {_COUNTED} GROUP BY ALL HAVING count(*) >= 60 AND quantile_cont(credit_amount, 0.95) >= 4 * quantile_cont(credit_amount, 0.5)"

# ---------------------------------------------------------------- p1: similar vectors

FEATURES = ["credit_amount", "age", "duration", "installment_rate"]


def _points(spark: SparkSession, sf: str) -> tuple[DataFrame, dict[str, float]]:
    spread = {r["feature"]: r["spread"] for r in table(spark, sf, "feature_spread").filter(F.col("feature").isin(FEATURES)).collect()}  # four rows, fixed
    return table(spark, sf, "synthetic_credit").select("rid", *FEATURES), spread


@query
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of a probe and one of its ten nearest rows."""
    ship(spark)
    rows, spread = _points(spark, sf)
    probes = rows.join(table(spark, sf, "knn_probe").select("rid").distinct(), "rid", "left_semi")
    near = collide.similar(rows, probes, "rid", FEATURES, spread)
    return near.select(F.least("query_id", "near_id").alias("rid_a"), F.greatest("query_id", "near_id").alias("rid_b")).distinct()


@query
def p1_similar(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest rows of every row whose id is divisible by 50, against all rows."""
    ship(spark)
    rows, spread = _points(spark, sf)
    near = collide.similar(rows, rows.filter(F.col("rid") % 50 == 0), "rid", FEATURES, spread)
    return near.select("query_id", "near_id", "rank", F.round("distance", 6).alias("distance"))


_NEAR = """
WITH s AS (SELECT max(CASE WHEN feature = 'credit_amount' THEN spread END) AS c, max(CASE WHEN feature = 'age' THEN spread END) AS a,
  max(CASE WHEN feature = 'duration' THEN spread END) AS d, max(CASE WHEN feature = 'installment_rate' THEN spread END) AS i FROM feature_spread),
v AS (SELECT rid, credit_amount / c AS c, age / a AS a, duration / d AS d, installment_rate / i AS i FROM synthetic_credit, s
  WHERE isfinite(credit_amount) AND isfinite(age) AND isfinite(duration) AND isfinite(installment_rate)),
pairs AS (SELECT q.rid AS query_id, v.rid AS near_id, (q.c - v.c) ^ 2 + (q.a - v.a) ^ 2 + (q.d - v.d) ^ 2 + (q.i - v.i) ^ 2 AS d2
  FROM v AS q JOIN v ON q.rid <> v.rid WHERE {which}),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, near_id) AS rank FROM pairs QUALIFY rank <= 10)
"""
SQL["p1_found"] = _NEAR.format(which="q.rid IN (SELECT rid FROM knn_probe)") + "SELECT DISTINCT least(query_id, near_id) AS rid_a, greatest(query_id, near_id) AS rid_b FROM near"
SQL["p1_similar"] = _NEAR.format(which="q.rid % 50 = 0") + "SELECT query_id, near_id, CAST(rank AS INT) AS rank, round(sqrt(d2), 6) AS distance FROM near"

# ---------------------------------------------------------------- p6: token ids


@query
def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    ship(spark)
    return tokens.token_ids(table(spark, sf, "documents").select("doc_id", "text"), "text", "byte_bpe_50k")


@query
def p6_checked(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's ids turned back into text: its digest must be that of the text itself."""
    ids = p6_ids(spark, sf)

    @F.pandas_udf("string")
    def digest(lists: pd.Series) -> pd.Series:
        return pd.Series([hashlib.md5(tokens.decode_bytes(x), usedforsecurity=False).hexdigest() for x in lists])

    return ids.select("doc_id", digest("ids").alias("digest"))


SQL["p6_checked"] = "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents"

# ---------------------------------------------------------------- p7: containers


@query
def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's place in the containers of each capacity."""
    ship(spark)
    wanted = table(spark, sf, "pack_spec").select("spec_id", "capacity", "tokenizer").collect()  # three rows, fixed
    documents = table(spark, sf, "documents").select("doc_id", "text")
    packed = []
    for tokenizer in sorted({r["tokenizer"] for r in wanted}):
        counted = tokens.token_counts(documents, "text", tokenizer)
        packed.append(packing.pack(counted, "doc_id", "n_tokens", {r["spec_id"]: r["capacity"] for r in wanted if r["tokenizer"] == tokenizer}))
    out = packed[0]
    for more in packed[1:]:
        out = out.unionByName(more)
    return out


@query
def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Containers, tokens and used share per capacity."""
    capacity = table(spark, sf, "pack_spec").select("spec_id", "capacity")
    filled = p7_containers(spark, sf).groupBy("spec_id").agg(F.countDistinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"))
    return filled.join(F.broadcast(capacity), "spec_id").select("spec_id", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("used_share"))


@query
def p7_checked(spark: SparkSession, sf: str) -> DataFrame:
    """Per capacity what must hold of any packing: documents held, containers over the capacity, documents with parts that don't follow each other from 0,
    documents split without need, and rows of more tokens than the capacity: all but the first must be 0."""
    capacity = table(spark, sf, "pack_spec").select("spec_id", "capacity")
    packed = cut(p7_containers(spark, sf))
    over = packed.groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("held")).join(F.broadcast(capacity), "spec_id").groupBy("spec_id").agg(F.count_if(F.col("held") > F.col("capacity")).alias("over_capacity"))
    parts = packed.groupBy("spec_id", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("part_no").alias("last"), F.min("part_no").alias("first"), F.sum("n_tokens").alias("size"), F.max(F.struct("token_start", "n_tokens")).alias("end"), F.max("n_tokens").alias("largest"))
    torn = (F.col("first") != 0) | (F.col("last") != F.col("n") - 1) | (F.col("end.token_start") + F.col("end.n_tokens") != F.col("size"))
    split = (F.col("n") > 1) & (F.col("size") <= F.col("capacity"))
    by = parts.join(F.broadcast(capacity), "spec_id").groupBy("spec_id").agg(F.count(F.lit(1)).alias("documents"), F.count_if(torn).alias("torn"), F.count_if(split).alias("split_without_need"), F.count_if(F.col("largest") > F.col("capacity")).alias("too_large"))
    return by.join(over, "spec_id").select("spec_id", "documents", "over_capacity", "torn", "split_without_need", "too_large")


SQL["p7_checked"] = "SELECT spec_id, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, 0::BIGINT AS over_capacity, 0::BIGINT AS torn, 0::BIGINT AS split_without_need, 0::BIGINT AS too_large FROM pack_spec"

# ---------------------------------------------------------------- p8: subject areas


MAIL = subjects.SubjectSpec(most_subjects=2)  # in this archive a document has none, one or two


def _with_subjects(spark: SparkSession, sf: str, *keep: str) -> DataFrame:
    ship(spark)
    documents = table(spark, sf, "documents").select("doc_id", "text", "mailbox", *(k for k in keep if k != "mailbox"))
    messages = subjects.parsed(documents, "doc_id", "text", ("mailbox",))
    model = subjects.fit(messages, table(spark, sf, "doc_label"), table(spark, sf, "subject_area"), MAIL)
    return subjects.assign(messages, model, MAIL)


@query
def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's subject areas, one row each."""
    return _with_subjects(spark, sf).select("doc_id", F.explode("subjects").alias("subject"))


@query
def p8_composition(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by subject and by language, source and mailbox; `none` counts those without a subject."""
    lang = F.coalesce(F.split_part(F.lower(F.trim("lang")), F.lit("-"), F.lit(1)), F.lit("und"))
    spread = F.array(*(F.struct(F.lit(n).alias("dimension"), v.cast("string").alias("value")) for n, v in (("lang", lang), ("source", F.col("source")), ("mailbox", F.col("mailbox")))))
    rows = _with_subjects(spark, sf, "lang", "source")
    rows = rows.withColumn("subject", F.explode(F.when(F.size("subjects") > 0, F.col("subjects")).otherwise(F.array(F.lit(subjects.NONE)))))
    return rows.select("subject", F.explode(spread).alias("d")).groupBy("subject", "d.dimension", "d.value").agg(F.count(F.lit(1)).alias("documents"))
