"""Evaluation of predicted fields against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = (
    "accuracy", "accuracy_with_tol_1", "accuracy_with_tol_2", "accuracy_with_tol_3", "accuracy_with_tol_4", "precision", "recall", "f1",
    "average_levenshtein", "average_similarity", "average_levenshtein_match", "average_similarity_match", "no_match_rate",
)


def cells(predictions: DataFrame, labels: DataFrame, key: str, fields: list[str], missing_as_absent: bool = True) -> DataFrame:
    """(key, field, pred, label, present): one row for each field of each row; ``present`` is false for fields never predicted.

    A field that no prediction has counts otherwise than one that is null: its cells are wrong even where the label is null.
    """
    have = [f for f in fields if f in predictions.columns]
    pred = predictions.select(F.col(key), *[F.col(f).alias(f"_p_{f}") for f in have])
    both = labels.select(key, *fields).join(pred, key, "left")
    rows = F.array(*[F.struct(F.lit(f).alias("field"), (F.col(f"_p_{f}") if f in have else F.lit(None)).cast("string").alias("pred"), F.col(f).cast("string").alias("label"), F.lit(f in have or not missing_as_absent).alias("present")) for f in fields])
    return both.select(key, F.explode(rows).alias("c")).select(key, "c.*")


def map_cells(predictions: DataFrame, labels: DataFrame, key: str, fields: list[str], groups: list[str] | None = None, ignore_other_fields: bool = True) -> DataFrame:
    """(groups, key, field, pred, label, present) from predictions (groups, key, prediction: map of strings).

    A field that no prediction of a group has is absent there. Without ``ignore_other_fields``, what is predicted for fields that
    ``labels`` lacks counts too: as predictions that are wrong by their length.
    """
    groups = groups or []
    long = predictions.select(*groups, key, F.explode("prediction").alias("field", "pred"))
    seen = long.where(F.col("field").isin(*fields)).select(*groups, "field").distinct().withColumn("present", F.lit(True))
    asked = predictions.select(*groups, key).distinct()
    label_rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("label")) for f in fields])
    wanted = asked.join(labels, key).select(*groups, key, F.explode(label_rows).alias("c")).select(*groups, key, "c.*")
    found = wanted.join(long, [*groups, key, "field"], "left").join(F.broadcast(seen), [*groups, "field"], "left")  # a row for each group and field
    out = found.select(*groups, key, "field", "pred", "label", F.coalesce("present", F.lit(False)).alias("present"))
    if ignore_other_fields:
        return out
    other = long.where(~F.col("field").isin(*labels.columns) & F.col("pred").isNotNull())
    return out.unionByName(other.select(*groups, key, "field", "pred", F.lit(None).cast("string").alias("label"), F.lit(False).alias("present")))


def micro_metrics(cell_rows: DataFrame, *groups: str, sets: list[list[str]] | None = None) -> DataFrame:
    """Micro-averaged metrics of cells, for each group; with ``sets``, for each of these sets of the group columns, others null."""
    p, lab = F.coalesce("pred", F.lit("")), F.coalesce("label", F.lit(""))
    d = F.levenshtein(F.lower(p), F.lower(lab))
    longest = F.greatest(F.char_length(p), F.char_length(lab))
    rows = cell_rows.withColumn("longest", longest).withColumn("d", F.when(F.col("present"), d).otherwise(F.col("longest")))
    rows = rows.withColumn("sim", F.when(~F.col("present"), F.lit(None).cast("double")).when(F.col("longest") == 0, 1.0).otherwise((F.col("longest") - F.col("d")) / F.col("longest")))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    here, hit = F.col("present"), F.col("sim") > 0
    grouped = rows.groupBy(*groups) if sets is None else rows.groupingSets([[F.col(c) for c in s] for s in sets], *groups)
    sums = grouped.agg(
        F.count("*").alias("n"), *[count(here & (F.col("d") <= k)).alias(f"_a{k}") for k in range(5)],
        count(here & (F.col("d") == 0) & F.col("pred").isNotNull() & F.col("label").isNotNull()).alias("_tp"),
        count(F.col("pred").isNotNull()).alias("_np"), count(F.col("label").isNotNull()).alias("_nl"), F.sum("d").alias("_d"), F.coalesce(F.sum("sim"), F.lit(0.0)).alias("_s"),
        count(hit).alias("_hit"), F.coalesce(F.sum(F.when(here, F.col("d"))), F.lit(0)).alias("_dm"),
    )
    share = lambda a, b: F.when(F.col(b) == 0, F.lit(0.0)).otherwise(F.col(a) / F.col(b))
    out = sums.withColumn("precision", share("_tp", "_np")).withColumn("recall", share("_tp", "_nl"))
    f1 = F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    out = out.withColumn("f1", f1).withColumn("accuracy", share("_a0", "n"))
    for k in range(1, 5):
        out = out.withColumn(f"accuracy_with_tol_{k}", share(f"_a{k}", "n"))
    out = out.withColumn("average_levenshtein", share("_d", "n")).withColumn("average_similarity", share("_s", "n"))
    out = out.withColumn("average_levenshtein_match", share("_dm", "_hit")).withColumn("average_similarity_match", share("_s", "_hit")).withColumn("no_match_rate", 1 - share("_hit", "n"))
    return out.select(*groups, "n", *METRICS)


def config_metrics(configs: DataFrame, predictions: DataFrame, labels: DataFrame, key: str, fields: list[str], total: int) -> DataFrame:
    """Metrics of each configuration, with seconds, rows a second, the estimated time for ``total`` rows, errors and their rate.

    configs: config_name, deltatime; predictions: config_name, key, prediction (map), error. A configuration without predictions has
    failed as a whole: all rows are errors, the rate is 1, and metrics are null.
    """
    rows = labels.agg(F.count("*").alias("rows"))  # one row
    errors = predictions.groupBy("config_name").agg(F.count("error").alias("error"))
    metrics = micro_metrics(map_cells(predictions, labels, key, fields, ["config_name"]), "config_name")
    out = configs.join(metrics, "config_name", "left").join(errors, "config_name", "left").join(F.broadcast(rows))
    rate = F.when(F.col("n").isNotNull(), F.col("rows") / F.col("deltatime"))
    failed = F.col("n").isNull()
    return out.select(
        "config_name", "n", *METRICS, "deltatime", rate.alias("rate"), (F.lit(float(total)) / rate).alias("estimated_total_time"),
        F.when(failed, F.col("rows")).otherwise(F.col("error")).alias("error"), F.when(failed, 1.0).otherwise(F.col("error") / F.col("rows")).alias("error_rate"),
    )


def fold_metrics(cell_rows: DataFrame, fold: str = "fold_idx", model: str = "model", part: str | None = None) -> DataFrame:
    """(model, part, metric, mean, std) over folds: ``part`` is ``all``, each field, and each value of the column ``part``."""
    every = [F.struct(F.lit("all").alias("part")), F.struct(F.concat(F.lit("entity:"), F.col("field")).alias("part"))]
    if part is not None:
        every.append(F.struct(F.concat(F.lit("field:"), F.col(part)).alias("part")))
    cut = cell_rows.withColumn("_p", F.explode(F.array(*every))).withColumn("part", F.col("_p.part")).where("part is not null")
    per_fold = micro_metrics(cut, model, fold, "part")
    values = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])
    long = per_fold.select(model, "part", F.explode(values).alias("m")).select(model, "part", "m.*")
    return long.groupBy(model, "part", "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def subset_metrics(cell_rows: DataFrame, subsets: dict[str, list[str]], *groups: str) -> DataFrame:
    """Metrics of each named subset of the fields, such as required ones, city and country, or all."""
    inside = F.array(*[F.when(F.col("field").isin(*fields), F.lit(name)) for name, fields in subsets.items()])
    cut = cell_rows.withColumn("subset", F.explode(F.filter(inside, lambda s: s.isNotNull())))
    return micro_metrics(cut, *groups, "subset")


def alignment_counts(rows: DataFrame, text: str, fields: list[str], spans: str) -> DataFrame:
    """(examples, skipped, not_aligned): rows with spans, rows without a text or a span, and field values that no span was found for."""
    given = F.array(*[F.when(F.trim(F.coalesce(F.col(f), F.lit(""))) != "", F.lit(f)) for f in fields])
    empty = F.coalesce(F.col(text), F.lit("")) == ""
    missing = F.size(F.array_except(F.filter(given, lambda f: f.isNotNull()), F.transform(spans, lambda s: s["label"])))
    none = empty | (F.size(spans) == 0)
    return rows.agg(F.sum((~none).cast("long")).alias("examples"), F.sum(none.cast("long")).alias("skipped"), F.sum(F.when(empty, 0).otherwise(missing)).alias("not_aligned"))


def summary(df: DataFrame, columns: list[str], *groups: str) -> DataFrame:
    """(n, sum, mean, min, max) over all numbers of the columns together, without nulls and NaN; the mean of none is null."""
    cells_of = df.select(*groups, F.explode(F.array(*[F.col(c).cast("double") for c in columns])).alias("x")).where("x is not null and not isnan(x)")
    return cells_of.groupBy(*groups).agg(F.count("x").alias("n"), F.sum("x").alias("sum"), F.avg("x").alias("mean"), F.min("x").alias("min"), F.max("x").alias("max"))


def span_scores(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """True and false positives and false negatives of spans (row, start, end, label), by label and overall (null label)."""
    keys = ["row", "start", "end", "label"]
    g, p = gold.select(*keys).distinct().withColumn("g", F.lit(1)), predicted.select(*keys).distinct().withColumn("p", F.lit(1))
    both = g.join(p, keys, "full")
    return both.rollup("label").agg(
        F.count(F.when(F.col("g").isNotNull() & F.col("p").isNotNull(), 1)).alias("tp"), F.count(F.when(F.col("g").isNull(), 1)).alias("fp"), F.count(F.when(F.col("p").isNull(), 1)).alias("fn")
    )


def folds(df: DataFrame, key: str, k: int = 10, seed: int = 42) -> DataFrame:
    """``df`` with fold_idx in 0 .. k-1 by a seeded hash of the key: no sort of the whole table, folds of about equal size."""
    return df.withColumn("fold_idx", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(k)).cast("int"))


def mean_and_deviation(df: DataFrame, metrics: list[str], *groups: str) -> DataFrame:
    return df.groupBy(*groups).agg(*[f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_samp))])
