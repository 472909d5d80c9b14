"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation estimates how right they are, a posterior decides.

Each rule calls a text good, bad or neither from statistics of the whole text. The number of texts with each pattern of votes
(at most three to the power of the rules) is counted over all documents. On these counts, without labels, expectation-maximisation
estimates the share of good texts and, for each rule, how often its votes are right on good and on bad texts: rules that agree with
the others weigh much, rules that call bad what the others call good weigh little, so a single bad vote may be outvoted.

Null texts are empty ones: no words, so they fail the base rule. Repeated rows get equal results. A text on which all rules abstain
has the estimated share of good texts. An empty table gives an empty result. Other columns are dropped.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_of, written

LEAST_WORDS, MOST_REPEATED_PERCENT, KEEP_AT = 50, 50, 0.5
SYMBOLS = "#*$%&|<>"
#: Pseudo-counts, as a share of the documents: half of them good, and of their votes so many right on good and on bad texts.
BELIEF, RIGHT_ON_GOOD, RIGHT_ON_BAD = 0.01, 0.9, 0.4
#: name, statistic, bad below, good from, good to, bad above
RULES = (
    ("length", "n_words", 20, 50, 1e12, 1e18),
    ("word length", "mean_chars", 2.5, 3.5, 6.5, 7.0),
    ("symbols", "symbol_rate", -1, -1, 0.02, 0.10),
    ("letters", "letter_rate", 0.70, 0.90, 2.0, 3.0),
    ("marked words", "marked_rate", -1, -1, 0.02, 0.20),
    ("lines", "dup_line_rate", -1, -1, 0.10, 0.30),
    ("phrases", "repeat_rate", -1, -1, 0.15, 0.30),
    ("capitals", "capital_rate", -1, -1, 0.10, 0.30),
    ("exclamations", "shout_rate", -1, -1, 0.02, 0.10),
    ("vocabulary", "distinct_rate", 0.10, 0.30, 2.0, 3.0),
    ("common words", "common_rate", 0.05, 0.12, 2.0, 3.0),
)
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_shouts", "n_distinct", "n_letterless", "n_marked", "n_common")
#: Words that ordinary text of the four languages of the corpus is full of.
COMMON = frozenset(
    w.encode()
    for w in (
        "the of and to in is that it for was with on as are be this der die das und zu den mit von ist ein eine für auf nicht sich "
        "le la les de des et en un une du que est pour dans qui el los las y se por con del"
    ).split()
)
_UPPER, _ASIDE = bytes(range(65, 91)), b".,;:!?\"'()"
_SPACE = rb"\x20\x09-\x0D"
_LETTERLESS = re.compile(rb"(?<![^" + _SPACE + rb"])[^A-Za-z\x80-\xff" + _SPACE + rb"]+(?![^" + _SPACE + rb"])")
_MARKED = re.compile(rb"[^" + _SPACE + rb"]*[#*$%&|<>][^" + _SPACE + rb"]*")
_LETTER = re.compile(rb"[A-Za-z\x80-\xff]")


def statistics(text: str) -> tuple[int, ...]:
    """``STATISTICS`` of one text. Letters are those of ASCII and all characters beyond it."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\r\x0b\x0c"))
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < n - 2:
            counts = Counter(windows)
            until = 0  # words before this are counted
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    repeated += i + 3 - max(i, until)
                    until = i + 3
    symbols = sum(map(text.count, SYMBOLS))
    marked = sum(1 for m in _MARKED.finditer(data) if _LETTER.search(m[0])) if symbols else 0
    common = sum(map(COMMON.__contains__, data.lower().translate(None, _ASIDE).split()))
    return (
        n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), len(data) - len(data.translate(None, _UPPER)), data.count(b"!"), len(set(words)),
        sum(1 for _ in _LETTERLESS.finditer(data)), marked, common,
    )


def _statistics(text: Column) -> Column:
    @F.pandas_udf(", ".join(f"{s} long" for s in STATISTICS))
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([statistics(t) for t in texts], columns=list(STATISTICS), index=texts.index)

    return of(text)


def _votes() -> Column:
    """The votes as digits to base three: 0 bad, 1 neither, 2 good."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    value = {
        "n_words": F.col("n_words"),
        "mean_chars": F.col("word_chars") / words,
        "symbol_rate": F.col("n_symbols") / words,
        "letter_rate": F.when(F.col("n_words") == 0, 1.0).otherwise((F.col("n_words") - F.col("n_letterless")) / words),
        "marked_rate": F.col("n_marked") / words,
        "common_rate": F.col("n_common") / words,
        "dup_line_rate": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_rate": F.col("n_repeat_words") / words,
        "capital_rate": F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1)),
        "shout_rate": F.col("n_shouts") / words,
        "distinct_rate": F.col("n_distinct") / words * F.when(F.col("n_words") > 2000, F.sqrt(F.col("n_words") / 2000)).otherwise(1.0),
    }
    code = F.lit(0)
    for _, name, bad_below, good_from, good_to, bad_above in RULES:
        x = value[name]
        code = code * 3 + F.when((x < bad_below) | (x > bad_above), 0).when((x >= good_from) & (x <= good_to), 2).otherwise(1)
    return code.cast("int")


def posterior(counts: dict[int, int], rounds: int = 500) -> dict[int, float]:
    """The probability of good for each pattern of votes, by expectation-maximisation.

    Votes are independent given the class. Abstaining is no evidence. A rule never counts against its own vote: where its estimate would
    say so, it counts as none. ``BELIEF`` keeps estimates from 0 and 1; it is small, so that agreement decides. It starts from
    votes as they are: two bad votes make a text likely bad, one leaves it open.
    """
    if not counts:
        return {}
    patterns = sorted(counts)
    k = len(RULES)
    votes = np.array([[p // 3 ** (k - 1 - r) % 3 for r in range(k)] for p in patterns])
    n = np.array([counts[p] for p in patterns], float)
    bad_votes = (votes == 0).sum(1)
    good = np.where(bad_votes > 1, 0.1, np.where(bad_votes == 1, 0.5, 0.9))
    weight = max(1.0, BELIEF * n.sum())
    for _ in range(rounds):
        share = (n @ good + weight / 2) / (n.sum() + weight)
        odds = np.full(len(n), np.log(share) - np.log1p(-share))
        for r in range(k):
            bad_vote, good_vote = votes[:, r] == 0, votes[:, r] == 2
            on_good = np.array([n[bad_vote] @ good[bad_vote], n[good_vote] @ good[good_vote]]) + weight * np.array([1 - RIGHT_ON_GOOD, RIGHT_ON_GOOD])
            on_bad = np.array([n[bad_vote] @ (1 - good[bad_vote]), n[good_vote] @ (1 - good[good_vote])]) + weight * np.array([RIGHT_ON_BAD, 1 - RIGHT_ON_BAD])
            ratio = np.log(on_good / on_good.sum()) - np.log(on_bad / on_bad.sum())
            odds += np.where(bad_vote, min(ratio[0], 0.0), 0.0) + np.where(good_vote, max(ratio[1], 0.0), 0.0)
        after = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        done = np.abs(after - good).max() < 1e-8
        good = after
        if done:
            break
    return dict(zip(patterns, good.tolist(), strict=True))


def with_verdict(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) as doc_id, ``STATISTICS``, votes, p_good."""
    found = docs.select(docs["doc_id"].alias("doc_id"), _statistics(text_of(docs)).alias("s")).select("doc_id", "s.*")
    table = written(found.withColumn("votes", _votes()), "quality-rules")
    counts = {r["votes"]: r["count"] for r in table.groupBy("votes").count().collect()}  # at most 3^11 patterns: 177,147 pairs of numbers
    known = list(posterior(counts).items()) or [(0, 0.0)]
    scores = docs.sparkSession.createDataFrame(known, "votes int, p_good double")
    return table.join(F.broadcast(scores), "votes", "left")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = with_verdict(documents(spark, sf_dir))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return judged.select("doc_id", *STATISTICS[:5], failed.alias("base_failed"), (~failed & (F.col("p_good") >= KEEP_AT)).alias("kept"), "p_good")
