"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at 3 or fewer differing bits, found by Golay codes.

A fingerprint is cut into three segments, each a word of the perfect binary Golay code (23 bits, 12 of them information,
any word lies within 3 bits of one codeword). At 3 errors over three segments, two segments have at most one error each. If two
segments differ in at most one bit, the codeword of the one is among the codewords of the other and of its one-bit
neighbours. So each fingerprint gives, for each pair of segments, the keys (neighbourhood of the first, codeword of the
second) and (codeword of the first, neighbourhood of the second): any two linked fingerprints meet in some key. What meets is
verified by counting bits, and a meeting of many gives a spanning forest of its links rather than all pairs.

These keys have 24 bits, so chance meetings grow with the square of the number of distinct fingerprints. Beyond ``FEW`` of them the
third segment lengthens the keys: where the two others differ in a bit at most each, the third differs in two at most, or in
three if they are equal; so one of its three parts of 7 bits is equal, or the two others are. The links are the same.

Null texts are empty ones; texts without words have fingerprint zero, which links like any other. Null ids take part, and
the smallest id of a component is that of its rows with an id, null if none has. Repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import begin, column, documents, joined_by_frequency, release, text_of, unused, with_row_keys, written
from .graph import components

WORDS, SEED, BITS = 3, 42, 3
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # shift, width
GENERATOR = 0xAE3  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
#: A key with more fingerprints than this is met in blocks of this size, each pair of blocks in a task's turn.
BLOCK = 4096
#: Row keys that are sent to all tasks at most: 16 MB. Distinct fingerprints from which keys are longer.
SENT_ROWS, FEW = 1_000_000, 1 << 26
PART = 7
_STEP = 1 << 16


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """A bit is 1 if it is set in over half the hashes of the shingles, repeats included."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    whole, n = b" ".join(parts), max(1, len(parts) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[min(words, len(parts)) - 1 :] - 1).tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _STEP):
        slices = [whole[a:b] for a, b in zip(starts[at : at + _STEP], stops[at : at + _STEP], strict=True)]
        hashes = np.array(list(map(xxhash.xxh64_intdigest, slices, repeat(seed))), dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(text: Column) -> Column:
    """The fingerprint of each text, as a signed long of the same bits."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        begin("simhash")
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64), index=texts.index)

    return of(text)


# Golay code


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator."""
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


_TABLES: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    """Syndromes of the low 12 and high 11 bits, and the error of each syndrome."""
    if not _TABLES:
        errors = np.array([sum(1 << b for b in c) for k in range(4) for c in combinations(range(23), k)])
        by_syndrome = np.zeros(2048, np.int64)
        by_syndrome[_syndromes(errors)] = errors
        _TABLES.extend([_syndromes(np.arange(4096)), _syndromes(np.arange(2048) << 12), by_syndrome])
    return _TABLES


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The 12 information bits of the codeword nearest to each 23-bit word."""
    low, high, error = _tables()
    return (words ^ error[low[words & 4095] ^ high[words >> 12]]) >> 11


def golay_keys(prints: np.ndarray, longer: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for every key of every fingerprint, each once."""
    own, near, words = [], [], []
    for shift, width in SEGMENTS:
        word = (prints.view(np.uint64) >> np.uint64(shift)).astype(np.int64) & ((1 << width) - 1)
        flipped = word[:, None] ^ np.concatenate(([0], 1 << np.arange(width)))
        index = np.sort(codeword_index(flipped), axis=1)
        index[:, 1:][index[:, 1:] == index[:, :-1]] = -1
        own.append(codeword_index(word))
        near.append(index)
        words.append(word)
    rows, keys = [], []
    for p, (i, j) in enumerate(combinations(range(3), 2)):
        for first, second in ((near[i], own[j][:, None]), (own[i][:, None], near[j])):
            row, at = np.nonzero((first >= 0) & (second >= 0))
            wide = np.broadcast_arrays(first, second)
            key = p << 24 | wide[0][row, at] << 12 | wide[1][row, at]
            if longer:
                third = words[3 - i - j][row]
                for part in range(3):  # the third part has what is left: 7 or 8 bits
                    rows.append(row)
                    keys.append(key << 10 | part << 8 | (third >> (PART * part) & ((1 << (PART + (part == 2))) - 1)))
            else:
                rows.append(row)
                keys.append(key)
        if longer:  # both equal: all their bits, below the other keys
            rows.append(np.arange(len(prints)))
            keys.append(~(np.int64(p) << 44 | words[i] << 22 | words[j]))
    row, key = np.concatenate(rows), np.concatenate(keys)
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return row[fresh], key[fresh]


def _emit_keys(longer: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("simhash-keys")
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(prints), 10_000):
                part = prints[at : at + 10_000]
                row, key = golay_keys(part, longer)
                yield pa.RecordBatch.from_arrays([pa.array(key if longer else key.astype(np.int32)), pa.array(part[row])], names=["key", "fp"])

    return run


def _bucket_links(prints: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints."""
    links, left = [], np.arange(len(prints))
    bits = prints.view(np.uint64)
    while len(left):
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            u = reached.pop()
            close = np.bitwise_count(bits[left] ^ bits[u]) <= BITS
            found, left = left[close], left[~close]
            reached += found.tolist()
            links += [(u, v) for v in found.tolist()]
    return links


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, low, high, fp), sorted, to links (a, b). The last cell of a batch waits for the next batch."""
    begin("simhash-meet")
    held_k, held_f, last, number = np.zeros(0, np.int64), np.zeros(0, np.int64), None, 0

    def links(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        keep = np.ones(len(k), bool)
        keep[1:] = (k[1:] != k[:-1]) | (f[1:] != f[:-1])
        k, f = k[keep], f[keep]
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, int)
        size = np.diff(np.concatenate((first, [len(k)])))
        a, b = [], []
        two = first[size == 2]
        two = two[np.bitwise_count((f[two] ^ f[two + 1]).view(np.uint64)) <= BITS] if len(two) else two
        a.append(f[two])
        b.append(f[two + 1] if len(two) else f[two])
        for s, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            group = f[s : s + n]
            if found := _bucket_links(group):
                at = np.array(found)
                a.append(group[at[:, 0]])
                b.append(group[at[:, 1]])
        x, y = np.concatenate(a), np.concatenate(b)
        pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cell = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        starts = np.ones(batch.num_rows, bool)
        starts[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cell])
        first = tuple(int(c[0]) for c in cell)
        k = np.cumsum(starts) + (len(held_k) > 0 and first == last) * -1 + number  # cells are numbered as they come
        last, number = tuple(int(c[-1]) for c in cell), int(k[-1])
        k, f = np.concatenate((held_k, k)), np.concatenate((held_f, batch.column(3).to_numpy(zero_copy_only=False)))
        cut = int(np.flatnonzero(k != k[-1])[-1]) + 1 if k[0] != k[-1] else 0
        held_k, held_f = k[cut:], f[cut:]
        if cut:
            yield links(k[:cut], f[:cut])
    yield links(held_k, held_f)


def fingerprint_links(distinct: DataFrame, few: int | None = None) -> DataFrame:
    """Links (a, b) that join the same fingerprints as all links do; ``distinct``: column fp, each value once."""
    prints = written(distinct.select("fp"), "simhash-prints")
    longer = prints.count() > (FEW if few is None else few)
    keyed = written(prints.mapInArrow(_emit_keys(longer), f"key {'long' if longer else 'int'}, fp long"), "simhash-keys")
    crowded = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    cells = keyed.select("key", F.lit(0).alias("low"), F.lit(0).alias("high"), "fp")
    if not crowded.isEmpty():
        joined = keyed.join(crowded, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        own = F.pmod(F.xxhash64("fp"), F.col("blocks").cast("long")).cast("int")
        spread = joined.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cells = spread.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp")
    dealt = cells.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "fp")
    links = written(dealt.mapInArrow(_meet, "a long, b long").distinct(), "simhash-pairs")
    release(distinct.sparkSession, keyed, prints)
    return links


def _rooted(prints: DataFrame, least: Column) -> DataFrame:
    """fp, n (rows that have it), least, root for each distinct fingerprint."""
    distinct = written(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min(least).alias("least")), "simhash-distinct")
    roots = components(fingerprint_links(distinct), "simhash-links")
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root"))


def with_components(docs: DataFrame) -> DataFrame:
    """doc_id, fp (signed long) and component_id for each row of ``docs`` (doc_id, text)."""
    prints = written(docs.select(docs["doc_id"].alias("doc_id"), fingerprints(text_of(docs)).alias("fp")), "simhash")
    rooted = _rooted(prints, F.col("doc_id"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = written(rooted.join(named, "root").select("fp", "n", "component_id"), "simhash-classes")
    return joined_by_frequency(prints, classes, ["fp"], "n").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component, one row each; all columns stay.

    Rows are told apart by their place in the table's files (``with_row_keys``), so equal and null ids are safe: of rows with equal ids
    the first place stays, and rows with an id stay rather than rows without. Null and empty texts are one component; an empty table stays empty.
    The rows that go are joined back: sent to all tasks while their number is at most ``SENT_ROWS``, by a shuffle beyond.
    """
    file, row, of_file, of_row = unused(docs, "file", "row", "of_file", "of_row")
    keyed = with_row_keys(docs, file, row)
    prints = written(keyed.select(F.col(file).alias("file"), F.col(row).alias("row"), keyed["doc_id"].alias("doc_id"), fingerprints(text_of(keyed)).alias("fp")), "simhash")
    order = F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("y"), F.col("file").alias("file"), F.col("row").alias("row"))
    kept = _rooted(prints, order).groupBy("root").agg(F.min("least").alias("least")).select("least.file", "least.row")
    gone = prints.select("file", "row").join(kept, ["file", "row"], "left_anti")
    gone = written(gone.select(F.col("file").alias(of_file), F.col("row").alias(of_row)), "simhash-gone")
    release(docs.sparkSession, prints)
    few = gone.count() <= SENT_ROWS
    left = keyed.join(F.broadcast(gone) if few else gone, (F.col(file) == F.col(of_file)) & (F.col(row) == F.col(of_row)), "left_anti")
    return left.select(*map(column, docs.columns))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_components(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
