"""Bounded labelled samples for the classifiers that are fitted on the driver."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, release, text_of, written

#: At most so many labelled rows, and bytes of their texts, are used to fit a classifier; they come to the driver.
SAMPLE_ROWS, SAMPLE_BYTES = 6000, 64 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> pd.DataFrame:
    """(text, y) of at most ``rows`` labelled documents whose crc32(id) mod ``modulus`` is not ``held_out``.

    Ids of any type are compared as texts. The rows are those with the smallest hash of their id, so the sample is the same on every run
    and does not depend on the order of the table; of these, texts are taken whole while their bytes sum up to ``most_bytes``, and a text
    that would exceed that is left out. Rows with a null id or label take no part; of rows with one id the least text counts, and the
    greatest label. The id only selects. An empty table of labels gives an empty sample.
    """
    ident = F.col("doc_id").cast("string")
    chosen = (
        labels.select(ident.alias("_id"), F.col(label).cast("int").alias("_y"))
        .where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & (id_remainder(F.col("_id"), modulus) != held_out))
        .groupBy("_id")
        .agg(F.max("_y").alias("_y"))
        .orderBy(F.xxhash64("_id", F.lit(17)), "_id")
        .limit(rows)
    )
    ids = [(r["_id"], r["_y"], place) for place, r in enumerate(chosen.collect())]  # at most ``rows`` pairs
    if not ids:
        return pd.DataFrame({"text": pd.Series([], dtype=str), "y": pd.Series([], dtype=int)})
    small = docs.sparkSession.createDataFrame(ids, "_id string, _y int, _place int")
    texts = docs.select(docs["doc_id"].cast("string").alias("_id"), text_of(docs).alias("_text"))
    found = texts.join(F.broadcast(small), "_id").groupBy("_place").agg(F.min("_text").alias("text"), F.max("_y").alias("y"))  # bounded by ``rows``
    found = written(found, "labelled")
    left, taken = most_bytes, []
    for place, size in found.select("_place", F.octet_length("text")).orderBy("_place").collect():
        if size <= left:
            taken.append(place)
            left -= size
    got = found.where(F.col("_place").isin(taken)).toPandas().sort_values("_place")
    release(docs.sparkSession, found)
    return got[["text", "y"]].reset_index(drop=True)
