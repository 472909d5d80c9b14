"""Few-shot retrieval: nearest examples by vectors or structure, pooled, thresholded, with a fallback."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import sequence_ratio


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


#: Examples of a block, and queries of a block: what meets at once in a task.
BLOCK_EXAMPLES, BLOCK_QUERIES = 4096, 4096


def _best(scored: DataFrame, k: int, *local: str) -> DataFrame:
    """(query_id, example_id, score, rank): the best by query, first within ``local`` groups, so that few rows are shuffled."""
    if local:
        first = Window.partitionBy("query_id", *local).orderBy(F.desc("score"), "example_id")
        scored = scored.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k)
    whole = Window.partitionBy("query_id").orderBy(F.desc("score"), "example_id")
    return scored.withColumn("rank", F.row_number().over(whole).cast("long")).where(F.col("rank") <= k).select("query_id", "example_id", "score", "rank")


def _blocks(df: DataFrame, size: int) -> int:
    return max(1, -(-df.count() // size))


def nearest(queries: DataFrame, examples: DataFrame, k: int, score, itself: bool = True) -> DataFrame:
    """(query_id, example_id, score, rank) of the ``k`` best examples of each query by any ``score``, ties to the smaller example.

    queries: query_id, q; examples: example_id, e. Blocks of examples, as many as their number asks for, meet all queries of a stated set;
    within a block only the ``k`` best of a query go on, so what is shuffled is k rows for each query and block. Without ``itself``,
    the example with a query's own id is left out.
    """
    blocks = max(16, _blocks(examples, BLOCK_EXAMPLES))
    dealt = examples.withColumn("_b", F.pmod(F.xxhash64("example_id"), F.lit(blocks)).cast("int"))
    asked = queries.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = asked.join(dealt, "_b")
    met = met if itself else met.where("query_id <> example_id")
    return _best(met.select("query_id", "example_id", "_b", score(F.col("q"), F.col("e")).alias("score")), k, "_b")


def nearest_vectors(queries: DataFrame, examples: DataFrame, k: int, itself: bool = True) -> DataFrame:
    """As ``nearest`` by the cosine of vectors of one length; a block of queries meets a block of examples as matrices.

    Vectors that are null, of another length than the first of their block, or zero take no part.
    """
    cuts, asks = max(16, _blocks(examples, BLOCK_EXAMPLES)), _blocks(queries, BLOCK_QUERIES)
    number = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    known = examples.where("e is not null").select("example_id", F.col("e").cast("array<double>").alias("e"), number("example_id", cuts).alias("_b")).withColumn("_a", every(asks))
    asked = queries.where("q is not null").select("query_id", F.col("q").cast("array<double>").alias("q"), number("query_id", asks).alias("_a")).withColumn("_b", every(cuts))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, vectors = _matrix(left)
        examples_of, e = _matrix(right)
        out: list[list] = [[], [], []]
        for i, q in zip(ids, vectors if len(e) and len(vectors) and e.shape[1] == vectors.shape[1] else [], strict=False):
            scores = (e * q).sum(axis=1)  # alike for equal vectors, wherever they are
            order = np.lexsort((examples_of, -scores))
            chosen = (order if itself else order[examples_of[order] != i])[:k]
            out[0] += [i] * len(chosen)
            out[1] += examples_of[chosen].tolist()
            out[2] += scores[chosen].tolist()
        return pa.table({"query_id": pa.array(out[0], left.schema.field("query_id").type), "example_id": pa.array(out[1], right.schema.field("example_id").type), "score": pa.array(out[2], pa.float64())})

    kinds = queries.schema["query_id"].dataType.simpleString(), examples.schema["example_id"].dataType.simpleString()
    found = asked.groupBy("_a", "_b").cogroup(known.groupBy("_a", "_b")).applyInArrow(meet, f"query_id {kinds[0]}, example_id {kinds[1]}, score double")
    return _best(found, k)


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and vectors scaled to length 1."""
    lists = table.column(1).combine_chunks()
    ids, size = table.column(0).to_numpy(), lists.value_lengths().to_numpy()
    if not len(ids):
        return ids, np.zeros((0, 0))
    same = np.flatnonzero(size == size[0])
    flat, start = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(size)[:-1]))
    vectors = flat[start[same][:, None] + np.arange(size[0])]
    length = np.sqrt((vectors * vectors).sum(axis=1))
    good = np.isfinite(length) & (length > 0)
    return ids[same][good], vectors[good] / length[good][:, None]


def pooled(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of two pools of hits; an example in both counts with its score in the first."""
    both = first.withColumn("source", F.lit(0)).unionByName(second.withColumn("source", F.lit(1)))
    once = both.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "example_id").orderBy("source", "rank"))).where("_n = 1")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "example_id")
    return once.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("query_id", "example_id", "score", "rank", "source")


def with_inclusion(hits: DataFrame, threshold: float) -> DataFrame:
    """Hits below the threshold stay in the record but are not included."""
    return hits.withColumn("included", F.col("score") >= threshold)


def needs_fallback(hits: DataFrame, threshold: float = 0.92) -> DataFrame:
    """(query_id, mean_score, fallback): queries whose hits are too far on average take curated examples instead."""
    return hits.groupBy("query_id").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("mean_score")).withColumn("fallback", F.col("mean_score") < threshold)


def pattern_hits(queries: DataFrame, examples: DataFrame, k: int) -> DataFrame:
    """Nearest examples by the similarity of structural patterns (query_id, pattern; example_id, pattern); equal patterns are compared once."""
    q, e = queries.select(F.col("pattern").alias("q")).distinct(), examples.select(F.col("pattern").alias("e")).distinct()
    blocks = max(16, _blocks(e, BLOCK_EXAMPLES))
    met = q.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(e.withColumn("_b", F.pmod(F.xxhash64("e"), F.lit(blocks)).cast("int")), "_b")
    scored = met.select("q", "e", sequence_ratio(F.col("q"), F.col("e")).alias("score"))
    # of one pattern, the k smallest examples can be among the best
    some = examples.withColumn("_n", F.row_number().over(Window.partitionBy("pattern").orderBy("example_id"))).where(F.col("_n") <= k).select(F.col("pattern").alias("e"), "example_id")
    best = scored.join(some, "e").withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "example_id")).cast("long")).where(F.col("rank") <= k)
    return queries.select("query_id", F.col("pattern").alias("q")).join(best, "q").select("query_id", "example_id", "score", "rank")


def ordered_labels(address: Column, labels: Column) -> Column:
    """A map's labels that are not null, as (label, part) structs in the order of their parts in the address; absent parts come first."""
    placed = F.transform(F.map_entries(F.map_filter(labels, lambda k, v: v.isNotNull())), lambda e: F.struct((F.instr(address, e["value"])).alias("at"), e["key"].alias("label"), e["value"].alias("part")))
    return F.transform(F.array_sort(placed), lambda x: F.struct(x["label"], x["part"]))


SHOT = "struct<rank:bigint,score:double,example_id:string,address:string,labels:map<string,string>,source:string,included:boolean>"


def few_shot(queries: DataFrame, hits: DataFrame, examples: DataFrame, threshold: float | None = None) -> DataFrame:
    """(query_id, shots): for each query its hits by rank as an array of ``SHOT``; hits below the threshold stay, not included.

    examples: example_id, address, labels (map). Queries without hits have no shots, as with zero examples.
    """
    source = F.col("source").cast("string") if "source" in hits.columns else F.lit("similar")
    included = F.lit(True) if threshold is None else F.col("score") >= threshold
    full = hits.join(examples, "example_id")
    shot = F.struct("rank", F.col("score").cast("double").alias("score"), F.col("example_id").cast("string").alias("example_id"), "address", "labels", source.alias("source"), included.alias("included"))
    found = full.groupBy("query_id").agg(F.array_sort(F.collect_list(shot), lambda a, b: (a["rank"] - b["rank"]).cast("int")).cast(f"array<{SHOT}>").alias("shots"))  # k rows of a query
    return queries.select("query_id").join(found, "query_id", "left").select("query_id", F.coalesce("shots", F.array().cast(f"array<{SHOT}>")).alias("shots"))


def fixed_shots(fixed: list[tuple[str, dict[str, str]]], labels: list[str] | None = None, n: int | None = None, keep_empty: bool = False) -> Column:
    """The same examples for every query: with some labels only, without empty values."""
    out = []
    for i, (address, parts) in enumerate(fixed[:n], 1):
        some = {k: v for k, v in parts.items() if (labels is None or k in labels) and (v or keep_empty)}
        values = F.create_map(*[F.lit(x) for kv in some.items() for x in kv]) if some else F.create_map().cast("map<string,string>")
        out.append(F.struct(F.lit(i).cast("long").alias("rank"), F.lit(1.0).alias("score"), F.lit(None).cast("string").alias("example_id"), F.lit(address).alias("address"), values.alias("labels"), F.lit("fixed").alias("source"), F.lit(True).alias("included")))
    return (F.array(*out) if out else F.array()).cast(f"array<{SHOT}>")


def with_fallback(shots: DataFrame, fixed: Column, threshold: float = 0.92) -> DataFrame:
    """Queries whose shots, included or not, score too low on average, or that have none, take the fixed ones."""
    mean = F.coalesce(F.aggregate("shots", F.lit(0.0), lambda acc, x: acc + F.coalesce(x["score"], F.lit(0.0))) / F.nullif(F.size("shots"), F.lit(0)), F.lit(0.0))
    return shots.withColumn("shots", F.when(mean < threshold, fixed).otherwise(F.col("shots")))


def included_examples(shots: Column) -> Column:
    return F.filter(shots, lambda s: s["included"])
