"""Best-fit packing of tokenised documents into sequences, by vectors of capacities.

A document's ids are those of the tokenizer, then id 0. Longer documents are cut into whole sequences and a rest. The rests
are packed in order of decreasing length: a sequence has capacities for tokens, documents and attention cost (the sum of
squared lengths); among the sequences that can take a piece under every constraint, one with the least weighted norm of what
would then be left is chosen. Whole sequences stand alone. Groups of pieces are packed side by side; then the sequences of all
groups that are at most half full are packed again, as pieces, by the same vectors, until one group holds them: so the number
of groups adds no sequences but one.

Tokenising keeps a cache of words of bounded bytes: texts of Latin letters are split into words whose ids are looked up; words not
in the cache go through the tokenizer, and texts that hold anything else, or a special token's string, go through it whole.

Null texts are empty ones and have the closing id alone. Repeated rows are packed one by one; ties go to the piece and the
sequence that came first; null ids stay null. An empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import bisect
import heapq
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import WordCache, begin, documents, kept, release, text_of, written

CAPACITY, END = 2048, 0
TOKENIZER = "word_bpe_49k.json"
#: Pieces that one task packs, about; sequences that are sent to all tasks with their new place at most.
GROUP, SENT_SEQUENCES = 60_000, 200_000
#: Bytes that a worker's cache of words takes at most, about; words and texts' characters that are handled at once.
CACHE_BYTES, WORDS_AT_ONCE, CHARS_AT_ONCE = 96 << 20, 20_000, 1 << 18
#: New words that the tokenizer gets at once.
LEARNT_AT_ONCE = 1000

# Texts of these characters split alike by this pattern and by the tokenizer's: no character of other classes, no joining marks.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-©«-±´¶-¸»¿-ſ]*")
_LETTER = r"a-zµß-öø-ſ"
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\s{_LETTER}0-9]+")


class Words:
    """Ids of texts by a cache of words. Ids are held as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        vocab, suffix = self.tokenizer.get_vocab(), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        if suffix:
            self.ends[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        self.cache = WordCache(cache_bytes, self._learn)

    def _plain(self, text: str) -> bool:
        return bool(_PLAIN.fullmatch(text)) and "İ" not in text and not any(s in text for s in self.special) and unicodedata.is_normalized("NFC", text)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Words are encoded as one text with spaces between them, and told apart by the tokens that end a word."""
        out = {}
        for first in range(0, len(words), LEARNT_AT_ONCE):
            some = words[first : first + LEARNT_AT_ONCE]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(cuts) == len(some) and cuts[-1] == ids.nbytes:
                data = ids.tobytes()
                out.update(zip(some, (data[a:b] for a, b in zip([0, *cuts], cuts, strict=False)), strict=True))
            else:  # a tokenizer that does not mark the ends of words
                found = self.tokenizer.encode_batch(some, add_special_tokens=False)
                out.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(some, found, strict=True))
        return out

    def _ids_of(self, words: list[list[str]]) -> list[bytes]:
        look = self.cache.of(set(chain.from_iterable(words))).__getitem__
        return [b"".join(map(look, w)) for w in words]

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, in order."""
        waiting: list[list[str]] = []
        chars = 0
        for text in texts:
            if not self._plain(text):
                yield from self._ids_of(waiting)
                waiting, chars = [], 0
                yield self._whole(text)
            elif len(text) > CHARS_AT_ONCE:  # the words of a long text are looked up in stretches
                yield from self._ids_of(waiting)
                waiting, chars = [], 0
                words, parts = (m[0] for m in _SPLIT.finditer(text.lower())), []
                while stretch := list(islice(words, WORDS_AT_ONCE)):
                    parts += self._ids_of([stretch])
                yield b"".join(parts)
            else:
                waiting.append(_SPLIT.findall(text.lower()))
                chars += len(text)
                if chars > CHARS_AT_ONCE:
                    yield from self._ids_of(waiting)
                    waiting, chars = [], 0
        yield from self._ids_of(waiting)


_WORDS: dict[str, Words] = kept("packing-pieces")


def token_ids(texts: list[str], path: str) -> Iterator[np.ndarray]:
    """The ids of each text without special tokens added."""
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    for data in _WORDS[path].ids(texts):
        yield np.frombuffer(data, "<u4")


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, row, piece, start, length, ids_crc32 for each piece of each document.

    ``row`` numbers the documents of one computation of the result, which has to be written once before it is used.
    """
    path = path or public_tokenizers.path(TOKENIZER)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("packing-pieces")
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                out: list[list] = [[] for _ in range(5)]
                for i, ids in enumerate(token_ids(part.column("text").to_pylist(), path)):
                    data = np.append(ids, np.uint32(END)).astype("<u4")
                    for k, start in enumerate(range(0, len(data), capacity)):
                        piece = data[start : start + capacity]
                        for column, value in zip(out, (i, k, start, len(piece), zlib.crc32(piece.tobytes())), strict=True):
                            column.append(value)
                at = pa.array(out[0], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(at), part.column("row").take(at), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])],
                    names=["doc_id", "row", "piece", "start", "length", "ids_crc32"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    asked = docs.select(docs["doc_id"].alias("doc_id"), F.monotonically_increasing_id().alias("row"), text_of(docs).alias("text"))
    return asked.mapInArrow(cut, f"doc_id {kind}, row long, piece int, start long, length long, ids_crc32 long")


@dataclass(frozen=True)
class Capacities:
    """What a sequence holds at most, and the weight of each dimension in the norm of what is left.

    At the values given here only the tokens bind, as a sequence of 2,048 tokens has at most so many documents and that square as its
    attention cost; the other two only tell sequences with equal room apart.
    """

    tokens: int = CAPACITY
    documents: int = CAPACITY
    attention: int = CAPACITY**2
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)


def best_fit(lengths: np.ndarray, limits: Capacities, documents: np.ndarray | None = None, attention: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, in the order given; a piece is one document, with its squared length, unless told otherwise.

    Sequences are kept by the tokens they have left, in heaps by what else they have left. The token term is least in the first class
    that can take the piece; a later class is tried only while its token term alone may still beat the best norm found. A piece that
    exceeds a capacity by itself stands alone.
    """
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    documents = np.ones(len(lengths), np.int64) if documents is None else documents
    attention = lengths.astype(np.int64) ** 2 if attention is None else attention
    wt, wd, wa = (w / c**2 for w, c in zip(limits.weights, (limits.tokens, limits.documents, limits.attention), strict=True))
    left: list[list[tuple[float, int, int, int]]] = [[] for _ in range(limits.tokens + 1)]
    open_classes: list[int] = []  # sorted classes that have sequences
    n = 0

    for i in np.argsort(-lengths, kind="stable").tolist():
        size, docs, cost = int(lengths[i]), int(documents[i]), int(attention[i])
        best = None
        for c in open_classes[bisect.bisect_left(open_classes, size) :]:
            token_term = wt * (c - size) ** 2
            if best is not None and token_term >= best[0]:
                break
            # the heap's least has the least of the other terms; if it lacks room, look at all of the class
            for entry in left[c] if left[c][0][1] < docs or left[c][0][2] < cost else left[c][:1]:
                _, docs_left, cost_left, which = entry
                if docs_left >= docs and cost_left >= cost:
                    norm = token_term + wd * (docs_left - docs) ** 2 + wa * (cost_left - cost) ** 2
                    if best is None or norm < best[0]:
                        best = norm, c, entry
        if best is None:
            which, c, docs_left, cost_left = n, limits.tokens, limits.documents, limits.attention
            n += 1
        else:
            _, c, entry = best
            _, docs_left, cost_left, which = entry
            if left[c][0] is entry:
                heapq.heappop(left[c])
            else:
                left[c].remove(entry)
                heapq.heapify(left[c])
            if not left[c]:
                del open_classes[bisect.bisect_left(open_classes, c)]
        sequence[i], offset[i] = which, limits.tokens - c
        rest, docs_left, cost_left = c - size, docs_left - docs, cost_left - cost
        if rest and docs_left > 0 and cost_left > 0:
            if not left[rest]:
                bisect.insort(open_classes, rest)
            heapq.heappush(left[rest], (wd * docs_left**2 + wa * cost_left**2, docs_left, cost_left, which))
    return sequence, offset


def _grouped(table: DataFrame, sizes: list[str], limits: Capacities, group: int, many: int, *key: str) -> DataFrame:
    """``table`` with sequence and offset; groups of about ``group`` rows, dealt at random, are packed side by side."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        begin("packing")
        rows = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        sequence, offset = best_fit(rows.column(sizes[0]).to_numpy(), limits, *(rows.column(s).to_numpy() for s in sizes[1:]))
        base = TaskContext.get().partitionId() << 24  # a group has far fewer sequences
        yield from rows.append_column("sequence_id", pa.array(sequence + base)).append_column("offset", pa.array(offset)).to_batches()

    dealt = table.repartition(max(1, round(many / group)), F.xxhash64(*key))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)
    return dealt.mapInArrow(pack, f"{fields}, sequence_id long, offset long")


def _merged(placed: DataFrame, limits: Capacities, group: int) -> DataFrame | None:
    """(sequence_id, into, shift) for sequences at most half full: where to they move; nothing if no two groups have such sequences.

    Each round packs those of up to ``group`` sequences together, which leaves about one for each task; the last round has one task.
    """
    spark = placed.sparkSession
    whole = placed.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), F.count("*").alias("documents"), F.sum(F.col("length") * F.col("length")).alias("attention"))
    items = written(whole.where(F.col("tokens") <= limits.tokens // 2), "packing-open")
    many = items.count()
    if many < 2:
        release(spark, items)
        return None
    moves = items.select("sequence_id", F.col("sequence_id").alias("into"), F.lit(0).cast("long").alias("shift"))
    level = 0
    while True:
        level += 1
        tasks = max(1, round(many / group))
        named = items.withColumnRenamed("sequence_id", "item")
        done = _grouped(named, ["tokens", "documents", "attention"], limits, group, many, "item")
        # numbers of merged sequences: below zero, apart by round
        done = written(done.select("*", (-(F.col("sequence_id") * 64 + level)).alias("merged")).drop("sequence_id"), "packing-merged")
        step = done.select(F.col("item").alias("into"), "merged", F.col("offset").alias("more"))
        moves = written(moves.join(step, "into", "left").select("sequence_id", F.coalesce("merged", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")), "packing-moves")
        if tasks == 1:
            return moves
        whole = done.groupBy("merged").agg(F.sum("tokens").alias("tokens"), F.sum("documents").alias("documents"), F.sum("attention").alias("attention"))
        items = written(whole.where(F.col("tokens") <= limits.tokens // 2).withColumnRenamed("merged", "sequence_id"), "packing-open")
        many = items.count()
        if many < 2:
            return moves


def packed(cut: DataFrame, limits: Capacities | None = None, group: int = GROUP) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``; ``cut`` should be a stored table."""
    limits = limits or Capacities()
    many = cut.count()
    if many <= group:
        return _grouped(cut, ["length"], limits, group, many, "row", "piece")
    placed = written(_grouped(cut, ["length"], limits, group, many, "row", "piece"), "packing-placed")
    moves = _merged(placed, limits, group)
    if moves is None:
        return placed
    few = moves.count() <= SENT_SEQUENCES
    found = placed.join(F.broadcast(moves) if few else moves, "sequence_id", "left")
    return found.select(*cut.columns, F.coalesce("into", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))


def packed_documents(docs: DataFrame) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with their sequences; nulls, repeats and empty tables as the module says."""
    cut = written(pieces(docs), "packing")
    return packed(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(documents(spark, sf_dir))
