"""Queries do the whole job: held against SQL over whole tables, or against brute force."""

import decimal
import random
from collections.abc import Iterator
from unittest import mock

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from placewright import plans
from placewright.operators import report

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("part", "documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same_rows(got, want) -> None:
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda values: sorted(repr([float(x) if isinstance(x, decimal.Decimal) else x for x in r]) for r in values)
    assert plain(got.select(*columns).collect()) == plain(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_cascade_links_all_parts(spark, db):
    want = db.sql(plans.ORACLES["cascade_link"])
    same_rows(plans.QUERIES["cascade_link"](spark, SF), want)


def test_clean_keys_hold_all_lines(spark, db):
    want = db.sql(plans.ORACLES["clean_keys"])
    same_rows(plans.QUERIES["clean_keys"](spark, SF), want)


def test_address_patterns_hold_all_lines(spark, tmp_path):
    texts = ["Hauptstr. 5, Köln\nKreis Stolp", "\nbei  Ulm 3b", "Ulm\n\nAm Ring 7", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.pattern for r in plans.QUERIES["address_pattern"](spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(["WORD NUM, WORD DIST WORD", "PREP WORD NUM", "WORD PREP STREET NUM", "", None]))


@pytest.mark.parametrize("name", ["knn_cosine_topk", "fallback_examples", "hybrid_topk"])
def test_searches_find_other_queries_but_not_themselves(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings AS SELECT i AS vec_id, [(1 + (i % 100 <> 0)::INT * ((i * 37 + j * j * 11) % 23) + ((i + 3 * j) % 7) / 10)::FLOAT FOR j IN range(8)] AS embedding, (i % 3)::INT AS label FROM range(301) t(i)")
    con.execute(f"COPY embeddings TO '{tmp_path}/embeddings.parquet'")
    want = con.sql(plans.ORACLES[name])
    cut = con.sql(plans.ORACLES[name].replace("e.vec_id <> q.vec_id", "e.vec_id % 100 <> 0"))  # without the other queries
    assert sorted(cut.fetchall()) != sorted(want.fetchall())
    same_rows(plans.QUERIES[name](spark, str(tmp_path)), want)


def test_left_join_holds_all_sizes(spark, db):
    want = db.sql(plans.ORACLES["left_join_suffix"])
    same_rows(plans.QUERIES["left_join_suffix"](spark, SF), want)


def test_quantiles_hold_when_brackets_differ_between_evaluations(spark):
    """Where blocks come in any order, approximate quantiles are off by some ranks, and otherwise at each evaluation."""
    many, shares = 40_000, [0.0, 0.25, 0.5, 0.75, 1.0]
    values = spark.range(0, many, 1, 4).select((F.col("id") % 2).alias("g"), F.floor(F.col("id") / 2).cast("double").alias("v"))

    @F.pandas_udf("double")
    def moved(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        by = random.Random().uniform(-2, 2)  # within the bracket's margin of 6 ranks, along with the approximation's 2
        for v in batches:
            yield v + by

    with mock.patch.object(report.F, "percentile_approx", lambda v, *a, real=F.percentile_approx: real(moved(v), *a)):
        got = report.exact_quantiles(values, "g", "v", shares).collect()
    assert sorted(tuple(r) for r in got) == [(g, s, s * (many // 2 - 1)) for g in (0, 1) for s in shares]


def test_quantiles_of_not_a_number(spark):
    values = spark.createDataFrame([("a", x) for x in (1.0, 2.0, float("nan"), None)], "g string, v double")
    got = {r.share: r.quantile for r in report.exact_quantiles(values, "g", "v", [0.0, 0.5, 1.0]).collect()}
    assert got[0.0] == 1 and got[0.5] == 2 and got[1.0] != got[1.0]  # the greatest, as in the SQL
