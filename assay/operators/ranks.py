"""Running sums, positions and exact quantiles of whole tables and groups, without a window over all rows in one task.

Rows are range-partitioned by the order, each partition runs its own sum, and the partitions' totals, one row each, are summed
up and broadcast. The range-partitioned rows are written to the checkpoint folder first: both steps must see the same partitions.
A group of any size is cut into ranges like everything else, so none is a single task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.scalars import usable
from assay.session import cut

BROADCAST_ROWS = 100_000  # a table of more rows is joined by a shuffle instead


def few_or_shuffled(df: DataFrame, most: int | None = None) -> DataFrame:
    """A written table as the small side of a join: sent to all executors only if it has few rows."""
    most = BROADCAST_ROWS if most is None else most
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def same(keys: list[str], prefix: str = "_k") -> Column:
    """Equality of keys with columns named by their place; nulls are equal."""
    out = F.lit(True)
    for i, k in enumerate(keys):
        out = out & F.col(k).eqNullSafe(F.col(f"{prefix}{i}"))
    return out


def running_sum(df: DataFrame, order: list[str], amount: str, name: str) -> DataFrame:
    """Adds the sum of `amount` over all rows before a row in the order (0 for the first). Rows of equal order follow each other in any order, so it should be a total one."""
    ranged = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(F.sum(amount).alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))  # one row per partition
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = ranged.withColumn("_within", F.coalesce(F.sum(amount).over(within), F.lit(0)))
    return inner.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + F.col("_within")).drop("_part", "_offset", "_within")


def running_sum_within(df: DataFrame, keys: list[str], order: list[str], amount: str, name: str, total: str | None = None) -> DataFrame:
    """Adds the sum of `amount` over the rows before a row in its group, and the group's whole sum as `total` if that is named."""
    placed = running_sum(df, [*keys, *order], amount, "_all_before")
    per = cut(placed.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.min("_all_before").alias("_base"), F.sum(amount).alias("_total")))
    out = placed.join(few_or_shuffled(per), same(keys)).drop(*(f"_k{i}" for i in range(len(keys))))
    out = out.withColumn(name, F.col("_all_before") - F.col("_base"))
    return (out.withColumnRenamed("_total", total) if total else out.drop("_total")).drop("_all_before", "_base")


def positions(df: DataFrame, order: list[str], name: str = "position", start: int = 0) -> DataFrame:
    """Adds the global position of each row."""
    summed = running_sum(df.withColumn("_one", F.lit(1).cast("long")), order, "_one", name)
    return summed.withColumn(name, (F.col(name) + start).cast("long")).drop("_one")


def positions_within(df: DataFrame, keys: list[str], order: list[str], name: str = "position", total: str | None = None) -> DataFrame:
    """Adds the position (from 0) of each row in its group, and the group's number of rows as `total` if that is named."""
    return running_sum_within(df.withColumn("_one", F.lit(1).cast("long")), keys, order, "_one", name, total).drop("_one")


def percentiles_within(known: DataFrame, keys: list[str], value: str, brackets: DataFrame, probabilities: list[float], names: list[str]) -> DataFrame:
    """Exact, linearly interpolated percentiles by counting inside brackets: keys, `n`, `name` and `percentile`, null where a bracket misses its ranks.

    `brackets` are written rows of keys, `n` (rows of the group) and for each name `<name>_low` and `<name>_high`. They meet the rows before anything is
    shuffled: rows above a bracket go, those below it become a single count per task, and only values inside are grouped."""
    known = known.select(*keys, F.col(value).alias("_v"))
    asked = F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"{n}_low").alias("low"), F.col(f"{n}_high").alias("high")) for n in names))
    wanted = brackets.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), asked.alias("_asked"))
    tall = known.join(few_or_shuffled(wanted), same(keys)).select(*keys, "_v", F.explode("_asked").alias("q")).filter(F.col("_v") <= F.col("q.high"))
    place = F.when(F.col("_v") >= F.col("q.low"), F.col("_v"))  # null for what lies below
    by = [*keys, "name"]
    inside = tall.select(*keys, F.col("q.name").alias("name"), place.alias("_v")).groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c"))
    placed = running_sum_within(inside, by, ["_v"], "_c", "_before").withColumn("_up", F.col("_before") + F.col("_c"))
    at = F.array(*(F.struct(F.lit(x).alias("name"), F.lit(float(p)).alias("p")) for x, p in zip(names, probabilities, strict=True)))
    ranks = brackets.select(*keys, "n", F.explode(at).alias("q")).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("q.name").alias(f"_k{len(keys)}"), "n", (F.col("q.p") * (F.col("n") - 1)).alias("_at"))
    joined = placed.join(few_or_shuffled(ranks), same(by))
    pick = lambda rank: F.min(F.when(F.col("_up") > rank, F.struct("_up", "_v")))
    found = joined.groupBy(*by, "n", "_at").agg(pick(F.floor("_at")).alias("lo"), pick(F.ceil("_at")).alias("hi"))
    between = F.when(F.col("lo._v") == F.col("hi._v"), F.col("lo._v")).otherwise(F.col("lo._v") + (F.col("hi._v") - F.col("lo._v")) * (F.col("_at") - F.floor("_at")))
    return found.select(*by, "n", between.alias("percentile"))


#: Ranks that a summary of this accuracy may be off, as a share of the rows, with room to spare.
_ACCURACY, _SLACK = 10_000, 0.0005


def quantiles(df: DataFrame, keys: list[str], value: str, probabilities: list[float], names: list[str]) -> DataFrame:
    """Exact quantiles per group of the values that are neither null nor NaN: keys, `n`, `least`, `most` and a column per name.
    A summary with a guaranteed rank error brackets each quantile, so only values inside the brackets are shuffled and ordered, range by range."""
    known = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(usable(F.col("_v")))
    ends = [min(1.0, max(0.0, p + s)) for p in probabilities for s in (-_SLACK, _SLACK)]
    summary = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most"), F.percentile_approx("_v", ends, _ACCURACY).alias("_q"))
    sides = {}
    for i, (p, name) in enumerate(zip(probabilities, names, strict=True)):
        # Of few rows all lie inside: the slack must be worth some ranks.
        narrow = F.col("n") * _SLACK >= 4
        sides[f"{name}_low"] = F.when(narrow & F.lit(p > _SLACK), F.col("_q")[2 * i]).otherwise(F.col("least"))
        sides[f"{name}_high"] = F.when(narrow & F.lit(p < 1 - _SLACK), F.col("_q")[2 * i + 1]).otherwise(F.col("most"))
    brackets = cut(summary.filter("n > 0").withColumns(sides).drop("_q"))
    found = percentiles_within(known, keys, "_v", brackets, probabilities, names)
    wide = found.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(*(F.max(F.when(F.col("name") == x, F.col("percentile"))).alias(x) for x in names))
    return brackets.select(*keys, "n", "least", "most").join(wide, same(keys)).select(*keys, "n", "least", "most", *names)


def exact_quantiles(df: DataFrame, column: str, probabilities: list[float], names: list[str]) -> DataFrame:
    """One row of exact quantiles of a whole table; null for none."""
    found = quantiles(df, [], column, probabilities, names)
    return found.agg(*(F.max(x).alias(x) for x in names))
