"""Looking at predictions: differences by row, errors, rates, spreads, and statistics of nested examples."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .report import exact_quantiles


def three_way(prediction: Column, label: Column) -> Column:
    """``correct``, ``wrong``, ``missed`` (a label without prediction) or ``extra``; null where both are missing. Empty is missing."""
    p, t = F.nullif(prediction, F.lit("")), F.nullif(label, F.lit(""))
    return F.when(p.isNull() & t.isNull(), None).when(p.isNull(), "missed").when(t.isNull(), "extra").when(p == t, "correct").otherwise("wrong")


def same_ignoring_case(a: Column, b: Column) -> Column:
    """Two nulls are the same."""
    return F.lower(a).eqNullSafe(F.lower(b))


def errors(df: DataFrame, prediction: str, label: str) -> DataFrame:
    """Rows whose prediction is not the label; two nulls agree."""
    return df.where(~F.col(prediction).eqNullSafe(F.col(label)))


def throughput(df: DataFrame, seconds: Column, failed: Column, of_all: int, *groups: str) -> DataFrame:
    """n, n_errors, error_rate, rate (rows a second, by pooled sums) and total_seconds for ``of_all`` rows; null where time is zero."""
    rows = df.groupBy(*groups).agg(F.count("*").alias("n"), F.count(F.when(failed, 1)).alias("n_errors"), F.sum(seconds).alias("_s"))
    rate = F.when(F.col("_s") > 0, F.col("n") / F.col("_s"))
    return rows.select(*groups, "n", "n_errors", (F.col("n_errors") / F.col("n")).alias("error_rate"), rate.alias("rate"), (F.lit(of_all) / rate).alias("total_seconds"))


def spread(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, low, q1, median, q3, high): exact interpolated quartiles, as a box plot shows them."""
    names = {0.0: "low", 0.25: "q1", 0.5: "median", 0.75: "q3", 1.0: "high"}
    found = exact_quantiles(df, group, value, list(names))
    return found.groupBy(group).agg(*[F.max(F.when(F.col("share") == s, F.col("quantile"))).alias(n) for s, n in names.items()])


def turns(df: DataFrame, key: str, conversation: str) -> DataFrame:
    """(key, turn, role, content) of stored conversations, JSON lists of messages."""
    messages = F.from_json(conversation, "array<struct<role:string,content:string>>")
    return df.select(key, F.posexplode(messages).alias("turn", "m")).select(key, "turn", "m.role", "m.content")


def split_fold(df: DataFrame, fold: int, name: str = "fold_idx") -> tuple[DataFrame, DataFrame]:
    """(train, validation) of a fold: all other folds, and the fold."""
    return df.where(F.col(name) != fold), df.where(F.col(name) == fold)


def config_grid(spark: SparkSession, axes: dict[str, list[str]], template: str) -> DataFrame:
    """(config_name, one column for each axis): all combinations of a few choices; names by ``template`` must be unique."""
    rows = [dict(zip(axes, values, strict=True)) for values in product(*axes.values())]
    names = [template % r for r in rows]
    if len(set(names)) < len(names):
        raise ValueError("configurations with one name")
    return spark.createDataFrame([(n, *r.values()) for n, r in zip(names, rows, strict=True)], ["config_name", *axes])


def example_scores(df: DataFrame, examples: str, *groups: str) -> DataFrame:
    """Mean, least and greatest score, and number of included ones, over arrays of (score, included) structs."""
    flat = df.select(*groups, F.explode(examples).alias("x"))
    x = F.col("x.score")
    return flat.groupBy(*groups).agg(F.avg(x).alias("mean_score"), F.min(x).alias("least_score"), F.max(x).alias("greatest_score"), F.count(F.when(F.col("x.included"), 1)).alias("n_included"))


def equal_folds(df: DataFrame, key: str, k: int = 10, seed: int = 42) -> DataFrame:
    """``df`` in a seeded order cut into ``k`` runs: fold_idx, sizes at most one apart and the first folds the larger ones.

    The order is the MD5 of seed and key, then the key (repeated keys in any order). Places are exact without a sort of the
    whole table in one task: 4,096 ranges of the hash are counted, and rows are numbered within their range. Null keys are one
    key. Ranges are even unless one key repeats very often.
    """
    hashed = df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))))
    hashed = hashed.withColumn("_r", F.substring("_h", 1, 3))
    counts = hashed.groupBy("_r").agg(F.count("*").alias("_c"))  # 4,096 rows at most
    whole = Window.partitionBy(F.lit(1))
    before = F.sum("_c").over(whole.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    ranges = counts.select("_r", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_c").over(whole).alias("_n"))
    within = F.row_number().over(Window.partitionBy("_r").orderBy("_h", key)) - 1
    placed = hashed.withColumn("_i", within).join(F.broadcast(ranges), "_r").withColumn("_p", F.col("_before") + F.col("_i"))
    small, extra = F.floor(F.col("_n") / k), F.col("_n") % k
    fold = F.when(F.col("_p") < extra * (small + 1), F.floor(F.col("_p") / (small + 1))).otherwise(extra + F.floor((F.col("_p") - extra * (small + 1)) / F.greatest(small, F.lit(1))))
    return placed.withColumn("fold_idx", fold.cast("int")).select(*df.columns, "fold_idx")
