"""A corpus pipeline: documents of low quality go, near-duplicates go, repeated passages go, secrets are masked, the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last return its columns. ``run`` writes
each stage's result in the shared folder and reads it again for the next.

Null texts count as empty ones and stay null unless a stage changes them. Repeated rows are told apart. An empty table stays
empty. Columns of any other name are kept as they are; a column ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.llm import packing, quality_classifier, secrets, simhash, suffix_dedup
from placewright.llm.common import column, documents, release, text_of, unused, written


def _with_text(docs: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` with the column ``text`` as their text, and ``n_chars`` by it where the text has changed."""
    new = F.col(text)
    out = []
    for c in columns:
        if c.lower() == "text":
            out.append(new.alias(c))
        elif c.lower() == "n_chars":
            kind = docs.schema[c].dataType
            out.append(F.when(new.eqNullSafe(F.col("text").cast("string")), column(c)).otherwise(F.char_length(new).cast(kind)).alias(c))
        else:
            out.append(column(c))
    return docs.select(*out)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents whose probability of being good is under ``KEEP_AT`` go.

    Null and empty texts have the share of good rows among the fitted ones, repeated rows score alike; an empty table stays empty, and
    without labels of both kinds all documents stay.
    """
    (score,) = unused(docs, "quality")
    model = quality_classifier.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality_classifier.with_quality(docs, model, score)
    return scored.where(F.col(score) >= quality_classifier.KEEP_AT).select(*map(column, docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: one document of each component stays, the one with the smallest id.

    Null and empty texts are one component; of repeated rows one stays; an empty table stays empty.
    """
    return simhash.one_of_each(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup: bytes covered by a repeated 200-byte string go; characters that are covered only in part stay.

    Null texts stay null; empty and short ones stay as they are; repeated rows lose their texts, if long enough; no row goes.
    """
    (kept,) = unused(docs, "kept")
    return _with_text(suffix_dedup.with_kept_text(docs, kept), kept, docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: each secret becomes a mark. Null and empty texts stay as they are; repeated rows are masked alike; no row goes."""
    base, spans, new = unused(docs, "base_spans", "all_spans", "masked")
    found = secrets.with_spans(docs, base_name=base, all_name=spans)
    masked = F.when(F.size(spans) > 0, secrets.redacted(text_of(found), F.col(spans))).otherwise(F.col("text").cast("string"))
    return _with_text(found.withColumn(new, masked), new, docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of what is left. A null or empty text has its closing id; repeated rows are packed one by one; an empty table gives no rows."""
    return packing.packed_documents(docs)


STAGES = [
    ("quality classifier", drop_low_quality),
    ("simhash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", drop_repeated_passages),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack),
]
#: Stages fit models, decode codes and pack bins: there is no SQL for the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), []
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        release(spark, *before)  # a stage's input is not needed once its result is stored
        before = [docs]
    return docs
