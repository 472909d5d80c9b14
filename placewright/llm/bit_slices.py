"""Exact top-k search by a bit-sliced index of quantised vectors.

Every block of vectors has an index: for each dimension one bitmap for each binary digit, over the rows of the block, of the value less
the dimension's least value in the block. For a query, slices are added with bitmap arithmetic: each digit of each query
component adds the dimension's slices, shifted; negative components add the complement. The sums are slices again, and the
largest are found from the most significant slice downward; rows tied at the boundary are resolved by id.

The queries are a stated set. They go in blocks of bounded bytes, one block after the other, to all tasks that hold a part of the index,
which stays where it is; a task gives the best rows of its part, and those of all tasks are ranked.

Vectors that are null or hold a null or a non-finite component take no part, as queries or candidates; those of another length
than the query's are no candidates. Components are supported while scores fit a signed long. Repeated ids are candidates each, of which the least vector is the query;
null ids are no queries, and candidates that rank behind equal scores. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import release, written

SCALE, EVERY, TOP = 256, 50, 5
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 256
#: Bytes of the queries that are sent to all tasks at once.
QUERY_BYTES = 32 << 20


def quantised(vector: Column) -> Column:
    """floor(scale * x) of each component; null if the vector takes no part."""
    usable = vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(usable, F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long")))


class SliceIndex:
    """Bitmaps of a block of integer vectors."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, values = ids[order], values[order]
        self.rows, self.width = values.shape
        self.least = values.min(axis=0) if self.rows else np.zeros(self.width, np.int64)
        above = (values - self.least).astype(np.uint64)
        self.words = -(-self.rows // 64)
        self.digits = [int(x).bit_length() for x in above.max(axis=0)] if self.rows else [0] * self.width
        self.slices = []
        for d, digits in enumerate(self.digits):
            bits = (above[:, d][None, :] >> np.arange(digits, dtype=np.uint64)[:, None]) & np.uint64(1)
            self.slices.append(self._bitmap(bits.astype(np.uint8)))
        self.all = self._bitmap(np.ones((1, self.rows), np.uint8))[0]

    def to_columns(self) -> list[bytes]:
        """Ids, least values, numbers of digits, and all slices, as bytes."""
        parts = [self.ids.astype("<i8"), self.least.astype("<i8"), np.array(self.digits, "<i4"), np.concatenate(self.slices).astype("<u8") if self.slices else np.zeros(0, "<u8")]
        return [np.ascontiguousarray(p).tobytes() for p in parts]

    @classmethod
    def from_columns(cls, ids: bytes, least: bytes, digits: bytes, slices: bytes) -> SliceIndex:
        self = cls.__new__(cls)
        self.ids, self.least = np.frombuffer(ids, "<i8"), np.frombuffer(least, "<i8")
        self.digits = np.frombuffer(digits, "<i4").tolist()
        self.rows, self.width = len(self.ids), len(self.least)
        self.words = -(-self.rows // 64)
        every = np.frombuffer(slices, "<u8").reshape(-1, self.words)
        ends = np.cumsum(self.digits).tolist()
        self.slices = [every[end - n : end] for n, end in zip(self.digits, ends, strict=True)]
        self.all = self._bitmap(np.ones((1, self.rows), np.uint8))[0]
        return self

    def _bitmap(self, bits: np.ndarray) -> np.ndarray:
        packed = np.packbits(bits, axis=1, bitorder="little")
        out = np.zeros((len(bits), self.words * 8), np.uint8)
        out[:, : packed.shape[1]] = packed
        return out.view(np.uint64)

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """(slices of score - constant, constant)."""
        total: list[np.ndarray] = []
        constant = int(sum(int(a) * int(b) for a, b in zip(query, self.least, strict=True)))
        for d in range(self.width):
            q, digits = int(query[d]), self.digits[d]
            if not q or not digits:
                continue
            terms = self.slices[d]
            if q < 0:  # q * v = |q| * (2^digits - 1 - v) - |q| * (2^digits - 1)
                terms = self.all & ~terms
                constant += q * ((1 << digits) - 1)
                q = -q
            shift = 0
            while q:
                if q & 1:
                    self._add(total, terms, shift)
                q >>= 1
                shift += 1
        return total, constant

    def _add(self, total: list[np.ndarray], terms: np.ndarray, shift: int) -> None:
        """total += terms << shift, digit by digit with carry."""
        while len(total) < shift + len(terms):
            total.append(np.zeros(self.words, np.uint64))
        carry = None
        at = shift
        for t in terms:
            old = total[at]
            half = old ^ t
            if carry is None:
                total[at], carry = half, old & t
            else:
                total[at], carry = half ^ carry, (old & t) | (half & carry)
            at += 1
        while carry.any():
            if at == len(total):
                total.append(carry)
                break
            old = total[at]
            total[at], carry = old ^ carry, old & carry
            at += 1

    def top(self, query: np.ndarray, query_id: int, k: int) -> list[tuple[int, int]]:
        """(id, score) of the ``k`` best rows other than the query's own, ties to smaller ids."""
        total, constant = self.scores(query)
        candidates = self.all.copy()
        for own in range(int(np.searchsorted(self.ids, query_id, "left")), int(np.searchsorted(self.ids, query_id, "right"))):
            candidates[own >> 6] &= ~np.uint64(1 << (own & 63))
        sure, tied, n_sure = np.zeros(self.words, np.uint64), candidates, 0
        for digit in reversed(total):
            above = tied & digit
            n = n_sure + int(np.bitwise_count(above).sum())
            if n > k:
                tied = above
            else:
                sure, n_sure = sure | above, n
                tied = tied & ~digit
            if n == k:
                tied = tied & np.uint64(0)
                break
        rows = self._rows(sure, self.rows)
        rows += self._rows(tied, k - n_sure)  # rows are in order of id
        word, bit = np.array(rows, np.int64) >> 6, (np.array(rows, np.int64) & 63).astype(np.uint64)
        found = [constant] * len(rows)
        for power, digit in enumerate(total):
            for i, x in enumerate(((digit[word] >> bit) & np.uint64(1)).tolist()):
                found[i] += x << power
        return [(int(self.ids[r]), s) for r, s in zip(rows, found, strict=True)]

    def _rows(self, bitmap: np.ndarray, most: int) -> list[int]:
        out: list[int] = []
        for w in np.flatnonzero(bitmap).tolist() if most > 0 else []:
            x = int(bitmap[w])
            while x and len(out) < most:
                out.append((w << 6) + (x & -x).bit_length() - 1)
                x &= x - 1
            if len(out) >= most:
                break
        return out


INDEX = "length int, ids binary, least binary, digits binary, slices binary"
QUERIES = "length int, ids binary, vectors binary"


def _blocks(rows: int, names: list[str], build):
    """Rows (id, vector) to rows of a length and ``build``'s columns of bytes: blocks of vectors of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(length: int) -> pa.RecordBatch:
            ids, values = (np.concatenate(x) for x in zip(*held.pop(length), strict=True))
            return pa.RecordBatch.from_arrays([pa.array([length], pa.int32()), *(pa.array([x], pa.binary()) for x in build(ids, values))], names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                lists = part.column(1)
                size = lists.value_lengths().to_numpy(zero_copy_only=False)
                flat, start = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(size)))
                for length in np.unique(size).tolist():
                    of = np.flatnonzero(size == length)
                    held.setdefault(length, []).append((ids[of], flat[start[of][:, None] + np.arange(length)].astype(np.int64)))
                    if sum(len(x[0]) for x in held[length]) >= rows:
                        yield block(length)
        for length in list(held):
            yield block(length)

    return run


def _search(sent, k: int):
    """Rows of the index to (query_id, vec_id, score): the ``k`` best rows of the task's part for each of the queries that were sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for length, ids, vectors in sent.value:
            asked.setdefault(length, []).append((np.frombuffer(ids, "<i8"), np.frombuffer(vectors, "<i8").reshape(-1, length)))
        best: dict[int, list[tuple[int, int]]] = {}  # (-score, id): a query has one vector, so one length
        for batch in batches:
            for i in range(batch.num_rows):
                length, *columns = (batch.column(c)[i].as_py() for c in range(5))
                index = SliceIndex.from_columns(*columns)
                for ids, vectors in asked.get(length, ()):
                    for query, vector in zip(ids.tolist(), vectors, strict=True):
                        found = [(-score, row) for row, score in index.top(vector, query, k)]
                        best[query] = heapq.nsmallest(k, best.get(query, []) + found)
        rows = [(query, row, -score) for query, found in best.items() for score, row in found]
        for at in range(0, len(rows), 50_000):
            columns = zip(*rows[at : at + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return run


def _rounds(blocks: DataFrame, most_bytes: int) -> Iterator[list[tuple[int, bytes, bytes]]]:
    """The blocks of queries, some at a time: the driver holds ``most_bytes`` and a block."""
    held, size = [], 0
    for row in blocks.toLocalIterator():
        held.append((row["length"], bytes(row["ids"]), bytes(row["vectors"])))
        size += len(row["ids"]) + len(row["vectors"])
        if size >= most_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def top_k(vectors: DataFrame, asked: Column, k: int = TOP, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best of all ``vectors`` (vec_id, embedding) for each row where ``asked`` holds."""
    last = (1 << 63) - 1
    ready = vectors.select(F.coalesce(vectors["vec_id"].cast("long"), F.lit(last)).alias("vec_id"), quantised(vectors["embedding"]).alias("v"), F.coalesce(asked, F.lit(False)).alias("asked"))
    ready = ready.where("v is not null")
    spark = vectors.sparkSession
    names = [f.split(" ")[0] for f in INDEX.split(", ")]
    index = written(ready.select("vec_id", "v").mapInArrow(_blocks(block_rows, names, lambda i, v: SliceIndex(i, v).to_columns()), INDEX), "slices")
    asking = ready.where("asked").groupBy("vec_id").agg(F.min("v").alias("v"))  # of rows with one id, one asks
    names = [f.split(" ")[0] for f in QUERIES.split(", ")]
    queries = written(asking.mapInArrow(_blocks(block_queries, names, lambda i, v: [np.ascontiguousarray(x, "<i8").tobytes() for x in (i, v)]), QUERIES), "slice-queries")
    found = []
    for some in _rounds(queries, query_bytes):
        sent = spark.sparkContext.broadcast(some)  # bounded by query_bytes and a block
        found.append(written(index.mapInArrow(_search(sent, k), "query_id long, vec_id long, score long"), "slice-hits"))
        sent.unpersist()
    release(spark, index, queries)
    hits = reduce(DataFrame.union, found) if found else spark.createDataFrame([], "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("vec_id") != last, F.col("vec_id")).alias("vec_id"), "score")


ORACLE_SQL = """
WITH usable AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), parts AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM usable),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM parts q JOIN parts c ON q.i = c.i AND q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
  GROUP BY q.vec_id, c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""


def op6_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, vectors["vec_id"] % EVERY == 0)
