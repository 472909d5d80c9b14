"""Suffix-array dedup: bytes that a repeated string of 200 bytes covers are removed, exactly, over a corpus of any size.

1. Each text is cut into segments, runs of windows (strings of 200 bytes) with one key: the least gram hash in the window. Equal
   windows have equal keys wherever they are, so only segments of equal key need to meet.
2. Keys that occur once, in a segment without a period, hold no repeat. A key whose segments are all equal is repeated as a whole. Both are decided by one
   aggregate of the keys.
3. The distinct segments of other keys meet in blocks, where a Burrows-Wheeler transform and threshold-bounded interval
   expansion tell which of their windows occur twice (``bwt``).
4. A key with very many distinct segments is dealt over several blocks. Windows that are single within their block are then
   compared across blocks by hashes, with one row for each window and block at most.
5. The repeated windows of each text are gathered and their bytes removed.

What is decided by hashes: whether segments of one key are equal (64 bits; never compared between keys, so that 1e14 pairs within keys
would meet by chance 5e-6 times) and whether windows of a crowded key are (128 bits). Everything else is decided by the transform on
the bytes. Segments refer to texts by the place of a row in its file (``with_row_keys``), which no change of the cluster alters.
Keys and segments that very many rows hold are not shuffled by them (``joined_by_frequency``).

Null texts are empty ones. Texts under 200 bytes stay as they are. Repeated rows remove each other. Ids and other columns play no
part; columns of any name are kept. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bwt, segments
from .common import SENT_KEYS, begin, column, documents, joined_by_frequency, release, text_of, unused, with_row_keys, written

LENGTH = 200
#: Distinct segments of one key in a block at most; bytes of a block, about.
CROWD, BLOCK_BYTES = 2048, 750_000
_INTS = "array<int>"


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("suffix-cut")
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                got = [segments.cut(t.encode("utf-8", "surrogatepass"), length) for t in part.column(2).to_pylist()]
                of = pa.array(np.repeat(np.arange(len(got)), [len(g[0]) for g in got]))
                join = lambda k: np.concatenate([g[k] for g in got])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(of), part.column(1).take(of), pa.array(join(0).view(np.int64)), pa.array(join(1).view(np.int64)),
                        pa.array(join(2).astype(np.int32)), pa.array(join(3).astype(np.int32)), pa.array(join(4)),
                    ],
                    names=["file", "row", "m", "s", "start", "n", "periodic"],
                )

    return run


def _fetch(length: int):
    """(text, [(m, s, c, blocks, start, n)]) to (m, sub, blocks, s, c, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("suffix-fetch")
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                out: list[list] = [[] for _ in range(6)]
                for text, asked in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    raw = text.encode("utf-8", "surrogatepass")
                    for x in asked:
                        sub = x["s"] % x["blocks"]
                        for column, value in zip(out, (x["m"], sub, x["blocks"], x["s"], x["c"], raw[x["start"] : x["start"] + x["n"] + length - 1]), strict=True):
                            column.append(value)
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["m", "sub", "blocks", "s", "c", "data"])

    return run


def _runs(flags: np.ndarray) -> list[int]:
    """Starts and ends of the runs of true values, alternately."""
    return np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))).tolist()


def _expand(length: int):
    """Rows (m, sub, blocks, s, c, data), sorted by (m, sub), to (m, s, c, ranges, asks, offers)."""

    def decide(rows: list[tuple]) -> pa.RecordBatch:
        groups: dict[tuple[int, int], int] = {}
        number = np.array([groups.setdefault((r[0], r[1]), len(groups)) for r in rows], np.int64)
        flags = bwt.repeated_windows([r[5] for r in rows], number, length)
        ranges, asks, offers, offered = [], [], [], set()
        for row, flag, group in zip(rows, flags, number.tolist(), strict=True):
            ask, offer = [], []
            if row[2] > 1:  # a key in several blocks: what is single here, and one of each that is not, goes to the other blocks
                view = memoryview(row[5])
                for j in range(len(flag)):
                    high, low = divmod(xxhash.xxh3_128_intdigest(view[j : j + length]), 1 << 64)
                    h = (high - (1 << 64) if high >> 63 else high, low - (1 << 64) if low >> 63 else low)
                    if row[4] < 2 and not flag[j]:
                        ask.append({"h": h[0], "l": h[1], "j": j})
                    elif (group, h) not in offered:
                        offered.add((group, h))
                        offer.append({"h": h[0], "l": h[1]})
            ranges.append([0, len(flag)] if row[4] > 1 else _runs(flag))
            asks.append(ask)
            offers.append(offer)
        hashes = [("h", pa.int64()), ("l", pa.int64())]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64()), pa.array(ranges, pa.list_(pa.int32())),
                pa.array(asks, pa.list_(pa.struct([*hashes, ("j", pa.int32())]))), pa.array(offers, pa.list_(pa.struct(hashes))),
            ],
            names=["m", "s", "c", "ranges", "asks", "offers"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("suffix-expand")
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if held >= BLOCK_BYTES and row[:2] != rows[-1][:2]:
                    yield decide(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[5])
        if rows:
            yield decide(rows)

    return run


def removal_ranges(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(file, row, ranges) for ``rows`` (file, row, text: string without nulls): starts and ends of runs of repeated windows, alternately.

    ``file`` and ``row`` must name a row alike whenever ``rows`` is computed. Runs may touch or come in any order. Rows without repeats
    are left out.
    """
    spark = rows.sparkSession
    long_rows = rows.where(F.octet_length("text") >= length)
    cut = written(long_rows.mapInArrow(_cut(length), "file long, row long, m long, s long, start int, n int, periodic boolean"), "suffix-cut")
    many = cut.count()
    keys = cut.groupBy("m").agg(F.count("*").alias("c"), F.min("s").alias("a"), F.max("s").alias("b"), F.max("periodic").alias("periodic"))
    keys = written(keys.where("c > 1 or periodic").select("m", "c", ((F.col("a") != F.col("b")) | (F.col("c") == 1)).alias("mixed")), "suffix-keys")
    shared = written(joined_by_frequency(cut.drop("periodic"), keys, ["m"], "c", many), "suffix-shared")
    release(spark, cut, keys)
    mixed = shared.where("mixed").drop("mixed")
    distinct = mixed.groupBy("m", "s").agg(F.count("*").alias("c"), *[F.first(x).alias(x) for x in ("file", "row", "start", "n")])
    distinct = written(distinct, "suffix-distinct")
    crowded = distinct.groupBy("m").agg(F.count("*").alias("k")).where(F.col("k") > CROWD).select("m", F.ceil(F.col("k") / CROWD).cast("int").alias("blocks"))
    few = distinct.count() // CROWD <= SENT_KEYS  # no more keys than that can be crowded
    dealt = distinct.join(F.broadcast(crowded) if few else crowded, "m", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    asked = dealt.groupBy("file", "row").agg(F.collect_list(F.struct("m", "s", "c", "blocks", "start", "n")).alias("asked"))
    fetched = long_rows.join(asked, ["file", "row"]).select("text", "asked").mapInArrow(_fetch(length), "m long, sub int, blocks int, s long, c long, data binary")
    met = fetched.repartition("m", "sub").sortWithinPartitions("m", "sub")
    answers = written(met.mapInArrow(_expand(length), f"m long, s long, c long, ranges {_INTS}, asks array<struct<h:long,l:long,j:int>>, offers array<struct<h:long,l:long>>"), "suffix-answers")
    release(spark, distinct)
    asks = answers.where(F.size("asks") > 0).select("m", "s", "c", F.explode("asks").alias("x")).select("m", "s", "c", "x.h", "x.l", "x.j")
    offers = answers.where(F.size("offers") > 0).select(F.explode("offers").alias("x")).select("x.h", "x.l")
    repeated = answers.where(F.size("ranges") > 0).select("m", "s", "c", "ranges")
    if not asks.isEmpty():
        twice = asks.select("h", "l").union(offers).groupBy("h", "l").agg(F.count("*").alias("t")).where("t > 1").select("h", "l")
        more = asks.join(twice, ["h", "l"]).select("m", "s", "c", F.array(F.col("j"), F.col("j") + 1).alias("ranges"))
        repeated = repeated.union(more).groupBy("m", "s").agg(F.max("c").alias("c"), F.flatten(F.collect_list("ranges")).alias("ranges"))  # of one segment's windows
        repeated = written(repeated, "suffix-repeated")
    shift = F.transform("ranges", lambda x: x + F.col("start"))
    some = joined_by_frequency(mixed, repeated, ["m", "s"], "c", many).select("file", "row", shift.alias("ranges"))
    whole = shared.where("not mixed").select("file", "row", F.array(F.col("start"), F.col("start") + F.col("n")).alias("ranges"))
    return some.union(whole).groupBy("file", "row").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def _covered(n: int, ranges: np.ndarray, length: int) -> np.ndarray:
    """Starts and ends of the maximal runs of covered bytes, alternately."""
    pairs = ranges.reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    start, end = pairs[:, 0], np.maximum.accumulate(pairs[:, 1] + length - 1)
    head = np.ones(len(start), bool)
    head[1:] = start[1:] > end[:-1]
    tail = np.concatenate((head[1:], [True]))
    return np.stack([start[head], np.minimum(end[tail], n)], axis=1)


def removed_runs(data: bytes, ranges, length: int = LENGTH) -> list[tuple[int, int]]:
    return [tuple(x) for x in _covered(len(data), np.asarray(ranges, np.int64), length).tolist()] if ranges is not None and len(ranges) else []


def _without(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in runs:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def _with_ranges(docs: DataFrame, name: str, length: int) -> DataFrame:
    """``docs`` with the repeated windows of each text as column ``name``, null where there are none."""
    file, row, of_file, of_row = unused([*docs.columns, name], "file", "row", "of_file", "of_row")
    keyed = with_row_keys(docs, file, row)
    rows = keyed.select(F.col(file).alias("file"), F.col(row).alias("row"), text_of(keyed).alias("text"))
    found = removal_ranges(rows, length).select(F.col("file").alias(of_file), F.col("row").alias(of_row), F.col("ranges").alias(name))
    return keyed.join(found, (F.col(file) == F.col(of_file)) & (F.col(row) == F.col(of_row)), "left").select(*map(column, docs.columns), name)


def with_kept_text(docs: DataFrame, name: str, length: int = LENGTH) -> DataFrame:
    """``docs`` with the text that is left as column ``name``, which must be a new one; a character that is covered only in part stays.

    Null texts stay null, texts without repeats (empty and short ones among them) as they are; repeated rows of ``LENGTH`` bytes and more
    lose all of their text. All columns are kept; an empty table stays empty.
    """

    @F.pandas_udf("string")
    def left(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        begin("suffix-left")
        for texts, ranges in batches:
            out = []
            for text, rs in zip(texts, ranges, strict=True):
                if text is None or rs is None or not len(rs):
                    out.append(text)
                    continue
                data = text.encode("utf-8", "surrogatepass")
                inner = lambda i: i < len(data) and data[i] & 0xC0 == 0x80
                runs = []
                for a, b in removed_runs(data, rs, length):
                    while inner(a):
                        a += 1
                    while inner(b):
                        b -= 1
                    runs.append((a, max(a, b)))
                out.append(_without(data, runs).decode("utf-8", "surrogatepass"))
            yield pd.Series(out, index=texts.index, dtype=object)

    (ranges,) = unused([*docs.columns, name], "ranges")
    both = _with_ranges(docs, ranges, length)
    return both.select(*map(column, docs.columns), left(F.col("text").cast("string"), F.col(ranges)).alias(name))


def digest(text: Column, ranges: Column, length: int = LENGTH) -> Column:
    """n_bytes, n_removed, n_spans and kept_sha256 of each text."""

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, found in batches:
            out = []
            for text, rs in zip(texts, found, strict=True):
                data = text.encode("utf-8", "surrogatepass")
                runs = removed_runs(data, rs, length)
                kept = _without(data, runs)
                out.append((len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"], index=texts.index)

    return of(text, ranges)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    both = _with_ranges(docs, "ranges", LENGTH)
    return both.select("doc_id", digest(text_of(both), F.col("ranges")).alias("d")).select("doc_id", "d.*")
