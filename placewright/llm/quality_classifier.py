"""Quality by compression: dictionaries of good and bad labelled text, the normalised difference of compressed sizes, calibrated.

Each text is cut into blocks of ``BLOCK`` bytes, all of which are compressed on their own with either Zstandard dictionary:
a longer stretch would soon be coded by its own beginning rather than by the dictionary. The difference of the summed sizes,
over the bytes of the text, becomes a probability by isotonic regression on labelled rows that built neither dictionary.

Null and empty texts score the share of good rows among the fitted ones. Repeated rows score alike; other columns are kept.
Without labelled rows of both kinds every text scores 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import trees
from .common import begin, documents, id_remainder, kept, text_of
from .training import labelled_sample

BLOCK, LEVEL, DICTIONARY_BYTES = 512, 3, 112 * 1024
MODULUS, HELD_OUT, PREDICT_AT = 4, 2, 0.7
#: The pipeline drops texts whose probability of being good is below this.
KEEP_AT = 0.5


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    knots: tuple[np.ndarray, np.ndarray]
    prior: float

    def difference(self, texts: list[str]) -> np.ndarray:
        """(compressed size by the bad dictionary - by the good one) / bytes, for each text; 0 for empty ones."""
        one, two = (_compressor(d) for d in (self.good, self.bad))
        out = np.zeros(len(texts))
        for i, text in enumerate(texts):
            data = text.encode("utf-8", "surrogatepass")
            gain = 0
            for at in range(0, len(data), BLOCK):
                block = data[at : at + BLOCK]
                gain += len(two.compress(block)) - len(one.compress(block))
            out[i] = gain / max(1, len(data))
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        if not self.good:
            return np.full(len(texts), self.prior)
        out = trees.calibrated(self.difference(texts), self.knots)
        out[[not t for t in texts]] = self.prior
        return out


_COMPRESSORS: dict[bytes, zstandard.ZstdCompressor] = kept("quality_classifier")


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    if dictionary not in _COMPRESSORS:
        data = zstandard.ZstdCompressionDict(dictionary)
        data.precompute_compress(level=LEVEL)
        if len(_COMPRESSORS) > 8:
            _COMPRESSORS.clear()
        _COMPRESSORS[dictionary] = zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)
    return _COMPRESSORS[dictionary]


def _dictionary(texts: list[str]) -> bytes:
    samples = [t.encode("utf-8", "surrogatepass") for t in texts if t]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"".join(samples)[-DICTIONARY_BYTES:]


def fit(sample: pd.DataFrame) -> CompressionModel:
    """Rows in even places build the dictionaries, those in odd places the calibration."""
    prior = float(sample.y.mean()) if len(sample) else 0.5
    built, held = sample.iloc[::2], sample.iloc[1::2]
    parts = [built.text[built.y == y].tolist() for y in (1, 0)]
    if not all(any(p) for p in parts) or held.y.nunique() < 2:
        return CompressionModel(b"", b"", (np.array([0.0]), np.array([0.5])), prior if sample.y.nunique() == 1 else 0.5)
    model = CompressionModel(_dictionary(parts[0]), _dictionary(parts[1]), (np.array([0.0]), np.array([0.5])), prior)
    knots = trees.isotonic(model.difference(held.text.tolist()), held.y.to_numpy())
    return CompressionModel(model.good, model.bad, knots, prior)


def scorer(model: CompressionModel):
    """The model as a column function of a text column."""

    @F.pandas_udf("double")
    def quality(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        begin("quality_classifier")
        for texts in batches:
            yield pd.Series(model.score(texts.tolist()), index=texts.index)

    return quality


def trained(docs: DataFrame, labels: DataFrame) -> CompressionModel:
    return fit(labelled_sample(docs, labels, "quality", MODULUS, HELD_OUT))


def with_quality(docs: DataFrame, model: CompressionModel, name: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with the probability of being good as column ``name``."""
    return docs.withColumn(name, scorer(model)(text_of(docs, text)))


def _held_out(docs: DataFrame) -> Column:
    return F.coalesce(id_remainder(docs["doc_id"], MODULUS) == HELD_OUT, F.lit(False))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = with_quality(docs.withColumn("held_out", _held_out(docs)), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))
