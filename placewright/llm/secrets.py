"""Secret scans: fixed patterns, and character Markov models of random strings and of ordinary identifiers.

Everything runs as DataFrame expressions. The patterns give the base spans, leftmost and not overlapping for each kind. The
models are tables of transitions between character classes, counted from labelled samples; a token of a text whose mean
log-likelihood ratio (random against ordinary) exceeds a threshold is a further span of kind ``markov``, unless it overlaps a
base span.

Spans are half-open and count code points. Null texts are empty ones; repeated rows give equal results; an empty table gives
an empty result; other columns of the table do not matter. ``with_spans`` keeps them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, documents, text_of, unused

ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX, TOKEN = r"AKIA[A-Z0-9]+", r"[0-9a-f]+", r"[A-Za-z0-9+/_=-]+"
#: What must be somewhere in a text for the pattern to be worth running: necessary, not sufficient.
HINTS = {"assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": "AKIA", "hex": "[0-9a-f]{24}", "markov": r"[A-Za-z0-9+/_=-]{20}"}
KINDS = ("assign", "access", "hex", "markov")
LEAST = {"assign": 6, "access": 20, "hex": 24, "markov": 20}
_CHUNK, _PIECE = 256, 1024

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
STATES = len(ALPHABET)
#: Rows of the labelled samples at most; mean log-likelihood ratio for each transition from which a token is a secret, with figures and without.
SAMPLE_STRINGS, THRESHOLD, THRESHOLD_LETTERS = 4000, 0.5, 1.0
#: Parts of ordinary identifiers: syllables of words and names that programs use.
PARTS = (
    "get set read write open close make find list item node tree index count value key user name path file line text data type code mode "
    "time date start stop begin end first last next size width height table column order group filter select insert update delete merge "
    "document sentence paragraph language station number street country region customer supplier payment account message request response "
    "tion ment able ing er est ly ness heit keit lich ung schaft mente ción ado eau que leur oir ich ein ver be ge zu ach ste er in an re"
).split()


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prefix_scan(numbers: Column, join) -> Column:
    """0, then the first element, the first two joined, and so on; in chunks, so that long arrays stay far from quadratic work.

    ``join`` is associative and 0 changes nothing in it: a sum, or the greater of numbers from 0.
    """
    zero = F.lit(0).cast("long")
    running = lambda a: F.aggregate(a, F.array(zero), lambda acc, x: F.concat(acc, F.array(join(F.element_at(acc, -1), x))))
    total = lambda a: F.aggregate(a, zero, join)

    def chunked(chunks: Column) -> Column:
        return let(running(F.transform(chunks, total)), lambda bases: F.flatten(F.transform(chunks, lambda c, i: F.transform(F.slice(running(c), 2, _CHUNK), lambda x: join(x, F.get(bases, i))))))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / _CHUNK).cast("int")), lambda i: F.slice(numbers, i * _CHUNK + 1, F.lit(_CHUNK)))
    return F.concat(F.array(zero), F.when(F.size(numbers) == 0, F.array().cast("array<bigint>")).otherwise(let(chunks, chunked)))


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _later(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


_SPAN = "array<struct<start:bigint,end:bigint,kind:int,text:string>>"


def pattern_spans(text: Column, kind: str, pattern: str, group: int = 0) -> Column:
    """Leftmost, non-overlapping matches whose ``group`` is long enough, as structs (start, end, kind, text)."""
    zero = F.lit(0).cast("long")

    def steps(hits: Column) -> Column:
        """Lengths of the text before the first match, the match, the text before the second, and so on."""
        gaps = F.split(text, pattern, -1)
        return F.flatten(F.zip_with(gaps, hits, lambda g, x: F.array(F.char_length(g).cast("long"), F.coalesce(F.char_length(x).cast("long"), zero))))

    def spans(hits: Column) -> Column:
        valued = hits if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        sizes = F.transform(valued, lambda x: F.char_length(x))
        placed = lambda ends, sized: F.filter(
            F.transform(hits, lambda x, i: F.struct(F.get(ends, 2 * i + 1).alias("start"), F.get(ends, 2 * i + 2).alias("end"), F.when(F.get(sized, i) >= LEAST[kind], F.lit(KINDS.index(kind))).alias("kind"), x.alias("text"))),
            lambda x: x["kind"].isNotNull(),
        )
        return let(prefix_scan(steps(hits), _plus), lambda ends: let(sizes, lambda sized: placed(ends, sized)))

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)
    return F.when(text.rlike(HINTS[kind]), found.cast(_SPAN)).otherwise(F.array().cast(_SPAN))


# the models


def labelled_strings(spark: SparkSession, rows: int = SAMPLE_STRINGS) -> DataFrame:
    """(text, random): strings drawn by hashing, and identifiers put together from ``PARTS``. Deterministic."""
    digest = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    base64 = F.substring(F.regexp_replace(F.base64(F.unhex(digest("a"))), "=", ""), 1, 40)
    upper = F.upper(F.substring(F.translate(base64, "+/", "27"), 1, 24))
    drawn = F.when(F.col("id") % 3 == 0, base64).when(F.col("id") % 3 == 1, F.substring(digest("b"), 1, 40)).otherwise(upper)
    words = F.split(F.lit(" ".join(PARTS)), " ")
    part = lambda k: F.element_at(words, (F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.size(words).cast("long")) + 1).cast("int"))
    joined = F.concat_ws("", *[part(k) for k in range(5)])
    shapes = (joined, F.concat_ws("_", *[part(k) for k in range(4)]), F.concat(part(0), F.initcap(part(1)), F.initcap(part(2)), F.initcap(part(3))), F.upper(joined), F.concat_ws("-", part(0), part(1), part(2), (F.col("id") % 100).cast("string")))
    named = F.get(F.array(*shapes), (F.col("id") % len(shapes)).cast("int"))
    ids = spark.range(rows)
    return ids.select(drawn.alias("text"), F.lit(True).alias("random")).union(ids.select(named.alias("text"), F.lit(False).alias("random")))


def log_ratios(samples: DataFrame) -> list[float]:
    """log P(b after a | random) - log P(b after a | ordinary), for all pairs of states, row by row.

    The counts are one aggregate with at most 2 x ``STATES`` squared rows.
    """
    at = lambda i: F.instr(F.lit(ALPHABET), F.substring(F.col("text"), i, F.lit(1)))
    position = F.explode(F.sequence(F.lit(1), F.char_length("text") - 1))
    pairs = samples.where(F.char_length("text") > 1).select("text", "random", position.alias("i")).select("random", at(F.col("i")).alias("a"), at(F.col("i") + 1).alias("b"))
    counts = {(r["random"], r["a"] - 1, r["b"] - 1): r["count"] for r in pairs.where("a > 0 and b > 0").groupBy("random", "a", "b").count().collect()}
    # a token's case and digits carry little of its nature by themselves: half a count for every transition
    row = {(k, a): sum(counts.get((k, a, b), 0) for b in range(STATES)) for k in (True, False) for a in range(STATES)}
    chance = lambda k, a, b: (counts.get((k, a, b), 0) + 0.5) / (row[k, a] + 0.5 * STATES)
    return [math.log(chance(True, a, b) / chance(False, a, b)) for a in range(STATES) for b in range(STATES)]


def mean_ratio(token: Column, model: list[float]) -> Column:
    """The mean log-likelihood ratio of a token's transitions; 0 for tokens of under two characters."""
    table = F.split(F.lit(",".join(f"{x:.5f}" for x in model)), ",").cast("array<double>")
    codes = F.transform(F.sequence(F.lit(1), F.char_length(token)), lambda i: F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1))) - 1)
    total = lambda c: F.aggregate(F.sequence(F.lit(1), F.size(c) - 1), F.lit(0.0), lambda acc, i: acc + F.get(table, F.get(c, i - 1) * STATES + F.get(c, i)))
    return F.when(F.char_length(token) < 2, F.lit(0.0)).otherwise(let(codes, total) / (F.char_length(token) - 1))


def markov_spans(text: Column, model: list[float], threshold: float = THRESHOLD, threshold_letters: float = THRESHOLD_LETTERS) -> Column:
    """Tokens that the models call random. Without figures a token has to be clearer: long words and paths are mostly letters."""
    tokens = F.filter(pattern_spans(text, "markov", TOKEN), lambda x: x["text"].rlike("[A-Za-z]"))
    return F.filter(tokens, lambda x: mean_ratio(x["text"], model) > F.when(x["text"].rlike("[0-9]"), threshold).otherwise(threshold_letters))


def _clear_of(spans: Column, known: Column) -> Column:
    """``spans`` that overlap none of ``known``, which is sorted by start: a binary search for each."""

    def against(starts: Column, ends: Column) -> Column:
        def before(end: Column) -> Column:  # how many of ``known`` start before ``end``
            return F.aggregate(F.sequence(F.lit(27), F.lit(0), F.lit(-1)), F.lit(0), lambda at, bit: let(at + F.call_function("shiftleft", F.lit(1), bit), lambda to: F.when(F.get(starts, to - 1) < end, to).otherwise(at)))

        return F.filter(spans, lambda x: F.get(ends, before(x["end"])) <= x["start"])

    return let(F.transform(known, lambda x: x["start"]), lambda starts: let(prefix_scan(F.transform(known, lambda x: x["end"]), _later), lambda ends: against(starts, ends)))


def with_spans(docs: DataFrame, model: list[float] | None = None, text: str = "text", base_name: str = "base_spans", all_name: str = "all_spans") -> DataFrame:
    """``docs`` with two arrays of spans, by start and kind: those of the patterns, and with those of the models.

    The two names must be new ones. Null and empty texts have empty arrays; repeated rows have equal ones; all columns are kept.
    """
    model = model or log_ratios(labelled_strings(docs.sparkSession))
    value = text_of(docs, text)
    base = F.concat(pattern_spans(value, "assign", ASSIGN, 1), pattern_spans(value, "access", ACCESS), pattern_spans(value, "hex", HEX))

    def more(known: Column) -> Column:
        found = F.when(value.rlike(HINTS["markov"]), let(markov_spans(value, model), lambda m: F.when(F.size(m) == 0, m).otherwise(_clear_of(m, known)))).otherwise(F.array().cast(_SPAN))
        return F.struct(known.alias("base"), _by_start_and_kind(F.concat(known, found)).alias("all"))

    (both,) = unused([*docs.columns, base_name, all_name], "spans")
    found = docs.select("*", let(_by_start_and_kind(base), more).alias(both))
    return found.select(*map(column, docs.columns), F.col(both)["base"].alias(base_name), F.col(both)["all"].alias(all_name))


def _by_start_and_kind(spans: Column) -> Column:
    keyed = F.transform(spans, lambda x: F.struct(x["start"], x["kind"], x["end"], x["text"]))
    return F.transform(F.array_sort(keyed), lambda x: F.struct(x["start"], x["end"], x["kind"], x["text"])).cast(_SPAN)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """``text`` with each of ``spans``, sorted by start, replaced by ``mark``; overlapping spans become one mark.

    Stretches between spans are put together from pieces of ``_PIECE`` characters, so that no span walks through the whole text.
    """

    def between(pieces: Column, start: Column, end: Column) -> Column:
        first, last = F.floor(start / _PIECE).cast("int"), F.floor(end / _PIECE).cast("int")
        piece = lambda i, at, n: F.coalesce(F.substring(F.get(pieces, i), (at + 1).cast("int"), n.cast("int")), F.lit(""))
        inner = F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        apart = F.concat(piece(first, start % _PIECE, F.lit(_PIECE)), inner, piece(last, F.lit(0), end % _PIECE))
        return F.when(first == last, piece(first, start % _PIECE, end - start)).otherwise(apart)

    def whole(pieces: Column, until: Column) -> Column:
        parts = F.transform(spans, lambda x, i: F.when(x["start"] >= F.get(until, i), F.concat(between(pieces, F.get(until, i), x["start"]), F.lit(mark))).otherwise(""))
        return F.concat(F.array_join(parts, ""), between(pieces, F.element_at(until, -1), F.char_length(text).cast("long")))

    ends = prefix_scan(F.transform(spans, lambda x: x["end"]), _later)
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))
    return F.when(F.size(spans) == 0, text).otherwise(let(pieces, lambda p: let(ends, lambda e: whole(p, e))))


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_spans(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "base_spans", "all_spans")
    count = lambda kind: F.size(F.filter("base_spans", lambda x: x["kind"] == KINDS.index(kind))).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"), joined(F.col("all_spans")).alias("spans"))
