"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features: lexicon densities, hits near a second-person word, capitals, punctuation, digits and obfuscation rates. The lexicon
holds words and word beginnings that are far more frequent in toxic than in other labelled texts; it is learned from the
same bounded sample as the trees. Obfuscated words are looked up again after undoing common character swaps.

Null and empty texts get the features of an empty text and a score between 0 and 1 like any other. Repeated rows score alike;
other columns are kept. Without labelled rows of both kinds every text scores the mean label, or 0.5.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import trees
from .common import documents, id_remainder, text_of
from .training import labelled_sample

MODULUS, HELD_OUT, PREDICT_AT = 3, 1, 0.7
#: Lexicon entries at most (of a bounded sample: those in most toxic texts), and the least ratio of a word's frequency in toxic and in other texts.
LEXICON_SIZE, LEAST_RATIO, LEAST_DOCS = 600, 12.0, 3
STEMS = (4, 5, 6)
#: Words that address somebody, in the four languages of the corpus.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen euch euer ihr sie tu toi te ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
NEAR = 5
_SWAPS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"})
_WORD = re.compile(r"[^\W\d_]+")
_SIGNS = re.compile(r"[0-9@$!|+*._-]+(?=[^\W\d_])")
_LETTERS_AFTER = re.compile(r"[\w@$!|+*.-]*")
_SINGLES = re.compile(r"\S{4,}")
_CAPITALS = bytes(range(65, 91))
_ASIDE = re.compile(r"[\W\d_]+")
N_FEATURES = 16


def _keys(word: str) -> Iterator[str]:
    yield word
    for n in STEMS:
        if len(word) > n:
            yield word[:n] + "*"


def learn_lexicon(texts: list[str], y: np.ndarray) -> dict[str, float]:
    """Log-ratios of words and word beginnings (marked by a star) by the documents that hold them."""
    seen = (Counter(), Counter())
    for text, toxic in zip(texts, y, strict=True):
        seen[int(toxic)].update({k for w in set(_WORD.findall(text.lower())) for k in _keys(w)})
    many, few = int((y == 0).sum()), int((y == 1).sum())
    ratio = lambda k: ((seen[1][k] + 0.5) / (few + 1)) / ((seen[0][k] + 0.5) / (many + 1))
    found = [(seen[1][k], k, r) for k in seen[1] if seen[1][k] >= LEAST_DOCS and (r := ratio(k)) >= LEAST_RATIO]
    found.sort(key=lambda x: (-x[0], x[1]))
    return {k: math.log(r) for _, k, r in found[:LEXICON_SIZE]}


def _weight(word: str, lexicon: dict[str, float]) -> float:
    return max((lexicon.get(k, 0.0) for k in _keys(word)), default=0.0)


def _mixed(text: str) -> list[str]:
    """Words with digits or signs among their letters, such as ``m0r*n``."""
    out, past = [], 0
    for m in _SIGNS.finditer(text):
        at = m.start()
        if at >= past and at and text[at - 1].isalpha():
            start = at
            while start > past and text[start - 1].isalnum():
                start -= 1
            past = _LETTERS_AFTER.match(text, m.end()).end()
            out.append(text[start:past])
    return out


def features(texts: list[str], lexicon: dict[str, float]) -> np.ndarray:
    """One row of ``N_FEATURES`` numbers for each text. Whole texts are read."""
    out = np.zeros((len(texts), N_FEATURES))
    known: dict[str, float] = {}
    for i, text in enumerate(texts):
        n, lower = len(text), text.lower()
        words = _WORD.findall(lower)
        count = max(1, len(words))
        if len(known) > 500_000:
            known.clear()
        distinct = set(words)
        known.update((w, _weight(w, lexicon)) for w in distinct.difference(known))
        weights = list(map(known.__getitem__, words))
        hits = [j for j, w in enumerate(weights) if w]
        near = sum(any(w in SECOND_PERSON for w in words[max(0, j - NEAR) : j + NEAR + 1]) for j in hits)
        disguised = 0.0
        mixed = _mixed(text)
        for m in mixed:
            plain = _ASIDE.sub("", m.lower().translate(_SWAPS))
            disguised += _weight(plain, lexicon) > 0 and not any(_weight(w, lexicon) for w in _WORD.findall(m.lower()))
        spelled = _SINGLES.findall("".join([w if len(w) == 1 else " " for w in words]))
        disguised += sum(_weight(w, lexicon) > 0 for w in spelled)
        total = sum(weights[j] for j in hits)
        data = text.encode("utf-8", "surrogatepass")
        capitals = len(data) - len(data.translate(None, _CAPITALS))
        letters = max(1, sum(map(len, words)))
        out[i] = (
            math.log1p(len(words)), math.log1p(len(hits)), len(hits) / count, total / count, max((weights[j] for j in hits), default=0.0), len({words[j] for j in hits}),
            near, near / count, sum(map(text.count, "!?")) / max(1, n), capitals / letters, sum(map(text.count, ".,;:")) / max(1, n),
            sum(map(text.count, "#*$%&|<>@")) / max(1, n), len(mixed) / count, disguised, len(spelled) / count, sum(map(SECOND_PERSON.__contains__, words)) / count,
        )
    return out


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: dict[str, float]
    forest: trees.Boosted | None
    knots: tuple[np.ndarray, np.ndarray]
    prior: float

    def score(self, texts: list[str]) -> np.ndarray:
        if self.forest is None:
            return np.full(len(texts), self.prior)
        return trees.calibrated(self.forest.raw(features(texts, self.lexicon)), self.knots)


def fit(sample: pd.DataFrame) -> ToxicityModel:
    """A third of the rows each for the lexicon, the trees and the calibration, so that none is judged on what it has seen."""
    prior = float(sample.y.mean()) if len(sample) else 0.5
    parts = [sample.iloc[k::3] for k in range(3)]
    if any(p.y.nunique() < 2 for p in parts):
        return ToxicityModel({}, None, (np.array([0.0]), np.array([0.5])), prior)
    lexicon = learn_lexicon(parts[0].text.tolist(), parts[0].y.to_numpy())
    x = [features(p.text.tolist(), lexicon) for p in parts[1:]]
    forest = trees.boost(x[0], parts[1].y.to_numpy().astype(float), least=min(8, max(1, len(x[0]) // 20)))
    return ToxicityModel(lexicon, forest, trees.isotonic(forest.raw(x[1]), parts[2].y.to_numpy()), prior)


def scorer(model: ToxicityModel):
    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(texts.tolist()), index=texts.index)

    return toxicity


def trained(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    return fit(labelled_sample(docs, labels, "toxic", MODULUS, HELD_OUT))


def with_toxicity(docs: DataFrame, model: ToxicityModel, name: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with the probability of being toxic as column ``name``."""
    return docs.withColumn(name, scorer(model)(text_of(docs, text)))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(id_remainder(docs["doc_id"], MODULUS) == HELD_OUT, F.lit(False))
    scored = with_toxicity(docs.withColumn("held_out", held), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))
