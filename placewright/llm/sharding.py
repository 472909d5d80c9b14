"""Sharding by sampled splitters: a size-weighted sample of keys gives quantile boundaries, ranges between them get exact sizes.

A row's key is the hash of its text, then the hash of its id, then a number that is its own; rows of equal texts, however
many, are so told apart and may lie on both sides of a boundary. The sample, of bounded size, takes rows with a chance in
proportion to their size. Its quantiles cut the keys into many fine ranges, more of them for more rows, so that a range fits a task;
an overfull range is subdivided by a further hash.
The exact bytes of all rows before a row, from sums by range and a running sum within its range, decide its shard, so shard
sizes differ by one row's size at most.

Law ``bytes``. Null texts have size 8 and the checksum of an empty text. Repeated rows are placed one by one. An empty table
gives an empty result. Everything runs as DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, text_of, written

SHARDS, ROW_BYTES = 24, 8
#: Expected rows of the sample for each fine range, fine ranges for each shard at least, rows of a range (about), and ranges at most.
SAMPLE_PER_RANGE, RANGES_PER_SHARD, RANGE_ROWS, MOST_RANGES = 35, 48, 500_000, 20_000
#: A range that holds more than so many times its share is subdivided.
OVERFULL = 2.0


def _range_of(key: Column, bounds: list[tuple[int, int]]) -> Column:
    """The number of boundaries at or below a key, by binary search in a constant array."""
    if not bounds:
        return F.lit(0)
    ordered = F.from_json(F.lit("[" + ",".join(f'{{"a":{a},"b":{b}}}' for a, b in bounds) + "]"), "array<struct<a:bigint,b:bigint>>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    below = lambda at: F.coalesce(F.get(ordered, at - 1) <= key, F.lit(False))
    return F.aggregate(steps, F.lit(0), lambda acc, step: F.when(below(acc + step), acc + step).otherwise(acc))


def splitters(keyed: DataFrame, ranges: int, sample_rows: int | None = None) -> list[tuple[int, int]]:
    """Boundaries of ``ranges`` ranges of about equal bytes, from a sample of keys (a, b) weighted by ``size``."""
    total = keyed.agg(F.sum("size")).first()[0] or 0
    if not total:
        return []
    sample_rows = sample_rows or SAMPLE_PER_RANGE * ranges
    # a row's own uniform number against its chance: expected hits at and above 1 are certain
    uniform = F.pmod(F.xxhash64("a", "b", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    hits = F.col("size") * (sample_rows / total)
    taken = keyed.select("a", "b", (F.floor(hits) + F.when(uniform < hits - F.floor(hits), 1).otherwise(0)).cast("int").alias("n")).where("n > 0")
    sample = sorted((r["a"], r["b"], r["n"]) for r in taken.collect())  # sample_rows expected
    weight, out, reached = sum(n for *_, n in sample), [], 0
    for a, b, n in sample:
        reached += n
        while len(out) < ranges - 1 and reached * ranges >= weight * (len(out) + 1):
            out.append((a, b))
    return sorted(set(out))


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for every row of ``docs`` (doc_id, text)."""
    text = text_of(docs)
    size = F.octet_length(text).cast("long") + ROW_BYTES
    rows = docs.select(
        docs["doc_id"].alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("a"), F.xxhash64(docs["doc_id"], F.monotonically_increasing_id()).alias("b"),
    )
    keyed = written(rows, "sharding")  # from here on a row's own number stays the same
    ranges = min(max(shards * RANGES_PER_SHARD, keyed.count() // RANGE_ROWS), max(MOST_RANGES, shards * RANGES_PER_SHARD))
    bounds = splitters(keyed, ranges)
    ranged = keyed.withColumn("range", _range_of(F.struct("a", "b"), bounds))
    # sums by range: as many rows as there are splitters
    sums = {r["range"]: (r["bytes"], r["n"]) for r in ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
    total, share = sum(x for x, _ in sums.values()), sum(x for x, _ in sums.values()) / max(1, ranges)
    parts = {k: min(n, int(x / share) + 1) for k, (x, n) in sums.items() if x > OVERFULL * share and n > 1}
    if parts:
        # an overfull range is cut again by a further hash: the order within a range is free
        number = _lookup(parts, F.col("range"), 1)
        ranged = ranged.withColumn("part", F.pmod(F.xxhash64("b", F.lit("part")), number.cast("long")).cast("int"))
    else:
        ranged = ranged.withColumn("part", F.lit(0))
    fine = sorted((r["range"], r["part"], r["bytes"], r["n"]) for r in ranged.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect())
    before, at = [], 0
    for k, p, x, _ in fine:
        before.append((k, p, at))
        at += x
    cells = docs.sparkSession.createDataFrame(before or [(0, 0, 0)], "range int, part int, before long")  # bounded by the splitters
    order = Window.partitionBy("range", "part").orderBy("a", "b", "doc_id")
    placed = ranged.withColumn("_upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).join(F.broadcast(cells), ["range", "part"])
    start = F.col("before") + F.col("_upto") - F.col("size")
    # the middle of a row's bytes decides, so that each boundary is off by half a row at most
    shard = F.least(F.floor((start + F.col("size") / 2) * shards / float(max(1, total))), F.lit(shards - 1)).cast("int")
    placed = written(placed.select("doc_id", "size", "text_crc32", "range", "part", "a", "b", shard.alias("shard")), "sharding-placed")
    counted = sorted((r["shard"], r["range"], r["part"], r["n"]) for r in placed.groupBy("shard", "range", "part").agg(F.count("*").alias("n")).collect())
    firsts, last, at = [], None, 0
    for s, k, p, n in counted:
        at = at if s == last else 0
        firsts.append((s, k, p, at))
        last, at = s, at + n
    offsets = docs.sparkSession.createDataFrame(firsts or [(0, 0, 0, 0)], "shard int, range int, part int, first long")
    rank = F.row_number().over(Window.partitionBy("range", "part", "shard").orderBy("a", "b", "doc_id"))
    slotted = placed.withColumn("_rank", rank).join(F.broadcast(offsets), ["shard", "range", "part"])
    return slotted.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("_rank") - 1).alias("slot"))


def _lookup(values: dict[int, int], key: Column, default: int) -> Column:
    """The value of a key in a constant map."""
    known = F.from_json(F.lit("{" + ",".join(f'"{k}":{v}' for k, v in values.items()) + "}"), "map<string,int>")
    return F.coalesce(F.element_at(known, key.cast("string")), F.lit(default))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(documents(spark, sf_dir)).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
