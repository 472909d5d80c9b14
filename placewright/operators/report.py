"""Tables of counts, shares and best rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_other(df: DataFrame, category: str, least_share: float = 0.04) -> DataFrame:
    """(category, cnt): categories of at least the share; the rest summed as Other, which is always there."""
    counts = df.where(F.col(category).isNotNull()).groupBy(category).agg(F.count("*").alias("cnt"))
    total = F.broadcast(counts.agg(F.sum("cnt").alias("total")))  # one row
    named = counts.join(total).select(F.when(F.col("cnt") / F.col("total") >= least_share, F.col(category)).otherwise("Other").alias(category), "cnt")
    other = df.sparkSession.createDataFrame([("Other", 0)], f"{category} string, cnt long")
    return named.unionByName(other).groupBy(category).agg(F.sum("cnt").alias("cnt"))


def described(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, n_unique) without nulls."""
    wide = df.agg(*[f for c in columns for f in (F.count(c).alias(f"{c}__n"), F.countDistinct(c).alias(f"{c}__u"))])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__n").alias("n"), F.col(f"{c}__u").alias("n_unique")) for c in columns])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def best_per_family(df: DataFrame, family: str, higher: list[str], lower: list[str]) -> DataFrame:
    """Rows that are best of their family in some metric."""
    w = Window.partitionBy(family)
    best = F.lit(False)
    for m, f in [*((m, F.max) for m in higher), *((m, F.min) for m in lower)]:
        best = best | (F.col(m) == f(m).over(w))
    return df.withColumn("_best", best).where("_best").drop("_best")


def cumulative_max(df: DataFrame, group: str, order: list[str], value: str, name: str) -> DataFrame:
    return df.withColumn(name, F.max(value).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def exact_quantiles(df: DataFrame, group: str, value: str, shares: list[float], accuracy: int = 10_000) -> DataFrame:
    """(group, share, quantile): exact interpolated quantiles, without holding a group's values in one task.

    Approximate quantiles, off by a known number of ranks, bracket each of them; what lies below is counted, and only the few values
    within the bracket are put in order. Approximate quantiles differ from one evaluation to the next, so one join counts both, and each
    row is in exactly one of the counts whatever bracket it met. A bracket that misses its quantile is an error. Nulls take no part.
    """
    rows = df.select(group, F.col(value).cast("double").alias("_v")).where("_v is not null")
    edge = 3.0 / accuracy
    probes = [min(max(p, 0.0), 1.0) for s in shares for p in (s - edge, s + edge)]
    bounds = rows.groupBy(group).agg(F.count("*").alias("_n"), F.percentile_approx("_v", probes, accuracy).alias("_b"))
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))  # nothing is greater than the latter
    each = [F.struct(F.lit(s).alias("share"), (-inf if s <= edge else F.col("_b")[2 * i]).alias("lo"), (nan if s >= 1 - edge else F.col("_b")[2 * i + 1]).alias("hi")) for i, s in enumerate(shares)]
    asked = bounds.select(group, "_n", F.explode(F.array(*each)).alias("a")).select(group, "_n", "a.*")
    met = rows.join(asked.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g"))).where(F.col("_v") <= F.col("hi"))
    # the null value stands for all that are below the bracket, and comes first
    counts = met.groupBy(group, "share", F.when(F.col("_v") >= F.col("lo"), F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"), F.first("_n").alias("_n"))
    order = Window.partitionBy(group, "share").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("_upto", F.sum("_c").over(order))
    rank = (F.col("_n") - 1) * F.col("share")
    at = lambda r: F.min(F.when(F.col("_upto") > r, F.col("_v")))
    missed = F.max((F.col("_v").isNull() & (F.col("_upto") > F.floor(rank))).cast("int")) > 0
    found = placed.groupBy(group, "share").agg(at(F.floor(rank)).alias("_lo"), at(F.ceil(rank)).alias("_hi"), F.first(rank - F.floor(rank)).alias("_f"), missed.alias("_missed"))
    found = found.withColumn("_hi", F.when(F.col("_missed") | F.col("_hi").isNull(), F.raise_error(F.lit("a quantile outside its bracket")).cast("double")).otherwise(F.col("_hi")))
    return found.select(group, "share", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias("quantile"))


def inclusion_gain(df: DataFrame, group: str, included: str, value: str) -> DataFrame:
    """(group, gain): median with less median without; null where one of them has no values."""
    keyed = df.where(F.col(included).isNotNull()).select(F.struct(F.col(group).alias("g"), F.col(included).alias("i")).alias("_k"), value)
    median = exact_quantiles(keyed, "_k", value, [0.5])
    some = median.groupBy(F.col("_k.g").alias(group)).agg(F.max(F.when(F.col("_k.i"), F.col("quantile"))).alias("_a"), F.max(F.when(~F.col("_k.i"), F.col("quantile"))).alias("_b"))
    return some.select(group, (F.col("_a") - F.col("_b")).alias("gain"))


def best_flags(df: DataFrame, higher: list[str], lower: list[str], digits: int = 2, *groups: str) -> DataFrame:
    """``df`` with ``<metric>_best``: whether the metric, rounded as a table shows it, is the best of its column (of its group)."""
    w = Window.partitionBy(*(groups or [F.lit(1)]))
    best = {f"{m}_best": F.coalesce(F.round(m, digits) == f(F.round(m, digits)).over(w), F.lit(False)) for ms, f in ((higher, F.max), (lower, F.min)) for m in ms}
    return df.withColumns(best)


def best_configs(df: DataFrame, family: str, higher: list[str], lower: list[str]) -> DataFrame:
    """Rows that are best of their family, or of all, in some metric."""
    w = Window.partitionBy(family)
    best = F.lit(False)
    for metrics, f in ((higher, F.max), (lower, F.min)):
        for m in metrics:
            best = best | (F.col(m) == f(m).over(w))  # the best of all is the best of its family
    return df.withColumn("_best", best).where("_best").drop("_best")


def top_studies(df: DataFrame, study: str, scores: list[str], k: int) -> DataFrame:
    """The ``k`` studies whose best trial is greatest, scores compared one after the other; ties to the smaller name."""
    best = df.groupBy(study).agg(F.max(F.struct(*scores)).alias("best"))
    return best.orderBy(F.desc("best"), study).limit(k).select(study, "best.*")


def mean_with_deviation(mean: str, deviation: str, digits: int = 2):
    return F.format_string(f"%.{digits}f±%.{digits}f", F.col(mean), F.col(deviation))


def metrics_report(rows: list[dict]) -> str:
    """A text report of a few rows of metrics."""
    return "\n".join(f"{k:<32}{v:>12.4f}" if isinstance(v, float) else f"{k:<32}{v!s:>12}" for r in rows for k, v in r.items())


def parsed_report(lines: DataFrame) -> DataFrame:
    """(key, value) of ``key  number`` lines; other lines are dropped."""
    pattern = r"^(\S.*?)\s{2,}(-?\d+(?:\.\d+)?)\s*$"
    return lines.select(F.regexp_extract("value", pattern, 1).alias("key"), F.regexp_extract("value", pattern, 2).alias("v")).where("key <> ''").select("key", F.col("v").cast("double").alias("value"))
