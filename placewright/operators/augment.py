"""Augmentation: copies of records with a part replaced by others of its pool."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import replaced_once


def augmented(df: DataFrame, pool: DataFrame, text: str, part: str, group: str, n: int, seed: int = 42) -> DataFrame:
    """``df`` and ``n`` copies of each row with ``part`` replaced in ``text`` by a value of its group's pool (group, value).

    The choice is a hash of seed, text and copy number. Pools are numbered by value; a pick is an equi-join on its number.
    """
    from pyspark.sql import Window

    sized = pool.select(group, "value").distinct().withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy("value")) - 1)
    sizes = sized.groupBy(group).agg(F.count("*").alias("_size"))
    copies = df.join(sizes, group).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(n))))
    picked = copies.withColumn("_k", F.pmod(F.xxhash64(F.lit(seed), F.col(text), F.col("_copy")), F.col("_size")).cast("int")).join(sized, [group, "_k"])
    new = replaced_once(F.col(text), F.col(part), F.col("value"))
    changed = picked.withColumn("source_text", F.col(text)).withColumn(text, new).where(F.col(text).isNotNull()).withColumn(part, F.col("value")).withColumn("is_augmented", F.lit(True))
    columns = [*df.columns, "source_text", "is_augmented"]
    return df.withColumn("source_text", F.lit(None).cast("string")).withColumn("is_augmented", F.lit(False)).select(*columns).unionByName(changed.select(*columns))
