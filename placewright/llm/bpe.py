"""Byte-level BPE by DuckDB recursive queries: words of a partition are contracted in a table of token positions, ids decoded in order.

A text is split by the tokenizer's pattern. Words that are no token themselves become rows (word, position, token, next position, next
token); each step of a recursive query joins them with the merge table, takes each word's pair of least rank, the leftmost of
equals, and contracts it, until no pair of any word has a rank. Ids of words are remembered in a worker's cache of bounded bytes.
Decoding starts from the ids of a text alone: they are joined with the vocabulary, and an ordered aggregate puts their bytes together.

For words over ``LONG`` bytes a step that copies all rows would be quadratic. A second recursive query keeps one row for each
position and rewrites only what changes, and takes in one step all places of a word's least pair, from the left, up to the first
whose contraction makes a pair of no greater rank: what the single steps would do. Words are first cut where two bytes meet that
no token holds side by side, as no contraction can reach over them. A worker holds one such word's positions at a time.

Null texts are empty ones: no ids. Repeated rows give equal results; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import chain, islice

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordCache, documents, text_of

RANKS = "byte_bpe_50k.tiktoken"
#: Bytes of a word from which it is long; words that are contracted at once, and positions; texts and characters that are handled at once.
LONG, AT_ONCE, ROWS_AT_ONCE, TEXTS_AT_ONCE, CHARS_AT_ONCE = 256, 20_000, 250_000, 500, 1 << 20
#: Bytes that a worker's cache of words takes at most, about.
CACHE_BYTES = 128 << 20

# Texts of these characters are split alike by this pattern and by the tokenizer's.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-ſ]*")
_L, _N = "a-zA-ZªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼½¾"
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
_ANY = regex.compile(public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))

_CONTRACT = """
WITH RECURSIVE s AS (
    SELECT w, p, t, q, u, 0 AS i FROM fresh
    UNION ALL (
        WITH pair AS (SELECT s.w, s.p, s.q, m.m FROM s JOIN merges m ON m.k = s.t::BIGINT * 65536 + s.u),
        best AS (SELECT w, min(m::BIGINT * 65536 + p) AS mp FROM pair GROUP BY w),
        gone AS (
            SELECT b.w, (b.mp % 65536)::INT AS p, (b.mp // 65536)::INT AS m, l.q AS g, r.q, r.u
            FROM best b JOIN s l ON l.w = b.w AND l.p = b.mp % 65536 JOIN s r ON r.w = b.w AND r.p = l.q
        )
        SELECT s.w, s.p,
               CASE WHEN s.p = g.p THEN g.m ELSE s.t END AS t,
               CASE WHEN s.p = g.p THEN g.q ELSE s.q END AS q,
               CASE WHEN s.p = g.p THEN g.u WHEN s.q = g.p THEN g.m ELSE s.u END AS u,
               s.i + 1 AS i
        FROM s JOIN gone g ON g.w = s.w WHERE s.p <> g.g
    )
),
last AS (SELECT w, max(i) AS i FROM s GROUP BY w)
SELECT s.w, list(s.t ORDER BY s.p) AS ids FROM s JOIN last USING (w, i) GROUP BY s.w
"""

_CONTRACT_LONG = """
WITH RECURSIVE s(w, p, t, q, u, k) USING KEY (w, p) AS (
    SELECT f.w, f.p, f.t, f.q, f.u, m.m FROM fresh f LEFT JOIN merges m ON m.k = f.t::BIGINT * 65536 + f.u
    UNION (
        WITH live AS (SELECT w, p, q, k FROM recurring.s WHERE k IS NOT NULL),
        best AS (SELECT w, min(k) AS k FROM live GROUP BY w),
        same AS (
            SELECT l.w, l.p, l.q, l.k, coalesce(lag(l.q) OVER (PARTITION BY l.w ORDER BY l.p) <> l.p, true) AS head
            FROM live l JOIN best b ON b.w = l.w AND b.k = l.k
        ),
        run AS (SELECT w, p, q, k, sum(head::INT) OVER (PARTITION BY w ORDER BY p) AS run FROM same),
        placed AS (SELECT w, p, q, k, row_number() OVER (PARTITION BY w, run ORDER BY p) AS i FROM run),
        every AS (SELECT w, p, q AS g, k AS m FROM placed WHERE i % 2 = 1),
        beside AS (
            SELECT c.w, c.p, c.g, c.m, r.q AS q, r.u AS u, CASE WHEN x.w IS NOT NULL THEN c.m ELSE l.t END AS t
            FROM every c JOIN recurring.s r ON r.w = c.w AND r.p = c.g
            LEFT JOIN recurring.s l ON l.w = c.w AND l.q = c.p AND l.t >= 0 LEFT JOIN every x ON x.w = l.w AND x.g = l.p
        ),
        until AS (
            SELECT b.w, min(b.p) AS p
            FROM beside b LEFT JOIN merges y ON y.k = b.t::BIGINT * 65536 + b.m LEFT JOIN merges z ON z.k = b.m::BIGINT * 65536 + b.u
            WHERE y.m <= b.m OR z.m <= b.m GROUP BY b.w
        ),
        chosen AS (SELECT b.* FROM beside b LEFT JOIN until e ON e.w = b.w WHERE e.p IS NULL OR b.p <= e.p),
        merged AS (SELECT c.w, c.p, c.m AS t, c.q, coalesce(n.m, c.u) AS u FROM chosen c LEFT JOIN chosen n ON n.w = c.w AND n.p = c.q),
        before AS (
            SELECT r.w, r.p, r.t, r.q, c.m AS u
            FROM recurring.s r JOIN chosen c ON c.w = r.w AND c.p = r.q
            LEFT JOIN chosen x ON x.w = r.w AND x.p = r.p LEFT JOIN chosen y ON y.w = r.w AND y.g = r.p
            WHERE r.t >= 0 AND x.w IS NULL AND y.w IS NULL
        ),
        changed AS (SELECT * FROM merged UNION ALL SELECT * FROM before)
        SELECT c.w, c.p, c.t, c.q, c.u, m.m FROM changed c LEFT JOIN merges m ON m.k = c.t::BIGINT * 65536 + c.u
        UNION ALL
        SELECT w, g, -1, -1, -1, NULL FROM chosen
    )
)
SELECT w, list(t ORDER BY p) AS ids FROM s WHERE t >= 0 GROUP BY w
"""

_DECODE = "SELECT r.d, string_agg(v.bytes, '' ORDER BY r.p) AS bytes FROM ids r JOIN vocabulary v ON v.id = r.id GROUP BY r.d"


def _table(**columns: array) -> pa.Table:
    return pa.table({name: pa.Array.from_buffers(pa.int32(), len(x), [None, pa.py_buffer(x)]) for name, x in columns.items()})


class Codec:
    """Ids of texts and bytes of ids, by a DuckDB database of merges in a worker's memory. Ids are little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.one = [self.ranks[bytes([b])] for b in range(256)]
        pairs: dict[int, int] = {}
        self.beside = np.zeros((256, 256), bool)  # bytes that some token holds side by side
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                self.beside[token[cut - 1], token[cut]] = True
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 16 | right] = rank
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        merges = pa.table({"k": pa.array(list(pairs), pa.int64()), "m": pa.array(list(pairs.values()), pa.int32())})  # noqa: F841
        # a character for each byte
        vocabulary = pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "bytes": [t.decode("latin-1") for t in self.ranks]})  # noqa: F841
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges")
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary")
        self.cache = WordCache(cache_bytes, self._ids_of)

    def _contracted(self, words: list[bytes], query: str) -> list[bytes]:
        w, p, t, q, u = (array("i") for _ in range(5))
        one = self.one
        for k, data in enumerate(words):
            n = len(data)
            own = [one[b] for b in data]
            w.extend([k] * n)
            p.extend(range(n))
            t.extend(own)
            q.extend(range(1, n))
            q.append(-1)
            u.extend(own[1:])
            u.append(-1)
        fresh = _table(w=w, p=p, t=t, q=q, u=u)  # noqa: F841
        found = self.db.execute(query).to_arrow_table().combine_chunks()
        out = [b""] * len(words)
        ids = found.column("ids").chunk(0) if found.num_rows else pa.array([], pa.list_(pa.int32()))
        flat, ends = ids.flatten().to_numpy().astype("<u4").tobytes(), np.cumsum(ids.value_lengths().to_numpy()) * 4
        start = 0
        for k, end in zip(found.column("w").to_pylist(), ends.tolist(), strict=True):
            out[k], start = flat[start:end], end
        return out

    def _long(self, data: bytes) -> bytes:
        raw = np.frombuffer(data, np.uint8)
        cuts = np.flatnonzero(~self.beside[raw[:-1], raw[1:]]) + 1
        parts = [data[a:b] for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(data)], strict=True)]
        out, at = [], 0
        while at < len(parts):
            size, to = len(parts[at]), at + 1
            while to < len(parts) and size + len(parts[to]) <= ROWS_AT_ONCE:
                size, to = size + len(parts[to]), to + 1
            out += self._contracted(parts[at:to], _CONTRACT_LONG)
            at = to
        return b"".join(out)

    def _ids_of(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words: tokens are their own, others are contracted, words of like length together."""
        found: dict[str, bytes] = {}
        others: list[tuple[int, str, bytes]] = []
        for word in words:
            data = word.encode("utf-8", "surrogatepass")
            if (rank := self.ranks.get(data)) is not None:
                found[word] = rank.to_bytes(4, "little")
            elif len(data) > LONG:
                found[word] = self._long(data)
            else:
                others.append((len(data), word, data))
        others.sort()
        at = 0
        while at < len(others):
            part = others[at : at + max(1, min(AT_ONCE, ROWS_AT_ONCE // others[min(at + AT_ONCE, len(others)) - 1][0]))]
            found.update(zip([x[1] for x in part], self._contracted([x[2] for x in part], _CONTRACT), strict=True))
            at += len(part)
        return found

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, in order. What is held at once is bounded by ``CHARS_AT_ONCE`` and the longest word."""
        waiting: list[list[str]] = []
        chars = 0

        def ready() -> Iterator[bytes]:
            look = self.cache.of(set(chain.from_iterable(waiting))).__getitem__
            return (b"".join(map(look, words)) for words in waiting)

        for text in texts:
            pattern = _SPLIT if _PLAIN.fullmatch(text) else _ANY
            if len(text) > CHARS_AT_ONCE:  # the words of a long text are looked up in stretches
                yield from ready()
                waiting, chars = [], 0
                words, parts = (m[0] for m in pattern.finditer(text)), []
                while stretch := list(islice(words, AT_ONCE)):
                    waiting = [stretch]
                    parts += ready()
                waiting = []
                yield b"".join(parts)
                continue
            waiting.append(pattern.findall(text))
            chars += len(text)
            if chars > CHARS_AT_ONCE:
                yield from ready()
                waiting, chars = [], 0
        yield from ready()

    def decode(self, all_ids: list[bytes]) -> list[bytes]:
        """The bytes of each list of ids, by an ordered aggregate; an id without a token is an error."""
        out: list[bytes] = []
        at = 0
        while at < len(all_ids):
            size, to = len(all_ids[at]) // 4, at + 1
            while to < len(all_ids) and size + len(all_ids[to]) // 4 <= ROWS_AT_ONCE:
                size, to = size + len(all_ids[to]) // 4, to + 1
            part = all_ids[at:to]
            flat = np.frombuffer(b"".join(part), "<u4").astype(np.int64)
            if size and int(flat.max()) >= len(self.ranks):
                raise ValueError("unknown token id")
            ids = pa.table({"d": np.repeat(np.arange(len(part), dtype=np.int32), [len(x) // 4 for x in part]), "p": np.arange(size, dtype=np.int32), "id": flat.astype(np.int32)})  # noqa: F841
            texts = dict(self.db.execute(_DECODE).fetchall())
            out += [texts.get(d, "").encode("latin-1") for d in range(len(part))]
            at = to
        return out


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def digests(text: Column, path: str | None = None) -> Column:
    """n_tokens, ids_sha256 and decoded_sha256 of each text."""
    path = path or public_tokenizers.path(RANKS)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for at in range(0, len(texts), TEXTS_AT_ONCE):
                ids = list(codec(path).encode(texts.iloc[at : at + TEXTS_AT_ONCE].tolist()))
                out += [(len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(d).hexdigest()) for i, d in zip(ids, codec(path).decode(ids), strict=True)]
            yield pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"], index=texts.index)

    return of(text)


def encoded(text: Column, path: str | None = None) -> Column:
    """The ids of each text."""
    path = path or public_tokenizers.path(RANKS)

    @F.pandas_udf("array<int>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.frombuffer(ids, "<u4").astype(np.int32) for ids in codec(path).encode(texts.tolist())], index=texts.index)

    return of(text)


def decoded(ids: Column, path: str | None = None) -> Column:
    """The text of each array of ids; bytes that are no UTF-8 become replacement characters."""
    path = path or public_tokenizers.path(RANKS)

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in batches:
            data = codec(path).decode([b"" if x is None else np.asarray(x, "<u4").tobytes() for x in lists])
            yield pd.Series([d.decode("utf-8", "replace") for d in data], index=lists.index)

    return of(ids)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", digests(text_of(docs)).alias("d")).select("doc_id", "d.*")
