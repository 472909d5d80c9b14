"""Queries over candidate names, hints, differences, folds and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import prompts
from ..operators import candidates as C
from ..operators import inspect as I
from .linking import NOISY
from .tables import table


def three_way_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("pred", F.expr(f"CASE WHEN p_size % 7 = 0 THEN '' ELSE {NOISY} END")).withColumn("label", F.expr("CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_name END"))
    return p.select("p_brand", I.three_way(F.col("pred"), F.col("label")).alias("kind")).groupBy("p_brand", "kind").agg(F.count("*").alias("cnt"))


DIFF_SQL = f"""
WITH x AS (SELECT p_brand, CASE WHEN p_size % 7 = 0 THEN NULL ELSE {NOISY} END AS p, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_name END AS t FROM part)
SELECT p_brand, CASE WHEN p IS NULL AND t IS NULL THEN NULL WHEN p IS NULL THEN 'missed' WHEN t IS NULL THEN 'extra' WHEN p = t THEN 'correct' ELSE 'wrong' END AS kind, count(*) AS cnt
FROM x GROUP BY ALL
"""


def candidate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier names as place names in nations."""
    s = table(spark, sf_dir, "supplier")
    names = s.select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("name"), F.expr("CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'de-AT' WHEN 2 THEN 'fr' WHEN 3 THEN 'it' ELSE 'abbr' END").alias("language"))
    places = s.select(F.col("s_suppkey").alias("entity_id"), F.col("s_nationkey").alias("country"))
    nation = table(spark, sf_dir, "nation")
    neighbours = F.expr("CASE WHEN n_nationkey % 4 = 0 THEN 'FR,DE' ELSE 'FR' END")
    countries = nation.select(F.col("n_nationkey").alias("country"), F.expr("CASE WHEN n_nationkey % 3 = 0 THEN 'fr-FR,br' ELSE 'it' END").alias("languages"), neighbours.alias("neighbours"))
    return C.candidate_names(names, places.withColumn("country", F.col("country").cast("string")), countries.withColumn("country", F.col("country").cast("string")))


CANDIDATES_SQL = r"""
WITH n AS (SELECT s_suppkey AS entity_id, s_name AS name, CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'de-AT' WHEN 2 THEN 'fr' WHEN 3 THEN 'it' ELSE 'abbr' END AS language, s_nationkey AS c FROM supplier),
k AS (SELECT n_nationkey AS c, CASE WHEN n_nationkey % 3 = 0 THEN 'fr-FR,br' ELSE 'it' END AS languages, CASE WHEN n_nationkey % 4 = 0 THEN 'FR,DE' ELSE 'FR' END AS neighbours FROM nation)
SELECT entity_id, name, language, c::VARCHAR AS country, regexp_replace(lower(name), '[^\w\s]', '', 'g') AS clean, contains(neighbours, 'DE') AS reduced
FROM n JOIN k USING (c) WHERE language IS NULL OR split_part(language, '-', 1) IN ('en', 'de', 'abbr') OR contains(languages, language)
"""


def country_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("country_name"))
    matches = table(spark, sf_dir, "nation").select(F.expr("CASE n_nationkey % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' ELSE 'OTHER' END").alias("country_name"), F.col("n_nationkey").cast("string").alias("code"))
    return C.country_hints(c, matches).select("c_custkey", F.array_join("hint", ",").alias("hint"))


HINTS_SQL = """
WITH m AS (SELECT CASE n_nationkey % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' ELSE 'OTHER' END AS name, string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey::VARCHAR) AS hint FROM nation GROUP BY 1)
SELECT c_custkey, hint FROM customer LEFT JOIN m ON name = c_mktsegment
"""


def best_unless_tied(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").withColumn("rank", F.rank().over(Window.partitionBy("s_nationkey").orderBy(F.desc(F.floor(F.col("s_acctbal") / 1000)))))
    return C.unless_tied(s, "s_nationkey").select("s_nationkey", "s_suppkey")


TIED_SQL = """
WITH r AS (SELECT *, rank() OVER (PARTITION BY s_nationkey ORDER BY floor(s_acctbal / 1000) DESC) AS k FROM supplier)
SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM r WHERE k = 1 GROUP BY 1 HAVING count(*) = 1
"""


def redirected_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = table(spark, sf_dir, "nation").where("n_nationkey % 3 <> 1").select(F.col("n_nationkey").alias("old"), F.expr("CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey + 100 END").alias("new"))
    return C.redirected(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), to, "s_nationkey", "old", "new")


REDIRECT_SQL = "SELECT s_suppkey, CASE WHEN s_nationkey % 3 = 0 THEN s_nationkey + 100 ELSE s_nationkey END::INTEGER AS s_nationkey FROM supplier WHERE s_nationkey % 3 <> 2"


def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    found = I.throughput(e, F.round(F.col("value") * 100).cast("long"), F.col("user_id") % 10 == 0, 1_000_000, "event_type")
    return found.select("event_type", "n", "n_errors", *[F.round(c, 6).alias(c) for c in ("error_rate", "rate", "total_seconds")])


THROUGHPUT_SQL = """
WITH c AS (SELECT event_type, count(*) AS n, count(*) FILTER (user_id % 10 = 0) AS n_errors, sum(round(value * 100)::BIGINT)::DOUBLE AS s FROM events GROUP BY 1)
SELECT event_type, n, n_errors, round(n_errors / n, 6) AS error_rate, round(n / s, 6) AS rate, round(1000000 / (n / s), 6) AS total_seconds FROM c
"""


def value_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = I.spread(table(spark, sf_dir, "events"), "event_type", "value")
    return found.select("event_type", *[F.round(c, 6).alias(c) for c in ("low", "q1", "median", "q3", "high")])


SPREAD_SQL = 'SELECT event_type, round(min(value), 6) AS low, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS "median", round(quantile_cont(value, 0.75), 6) AS q3, round(max(value), 6) AS high FROM events GROUP BY 1'


def example_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as examples of their customers; a third of the price range counts as included."""
    o = table(spark, sf_dir, "orders").withColumn("x", F.struct(F.floor("o_totalprice").cast("double").alias("score"), (F.col("o_totalprice") > 100000).alias("included")))
    nested = o.groupBy("o_orderpriority", "o_custkey").agg(F.collect_list("x").alias("examples"))
    out = I.example_scores(nested, "examples", "o_orderpriority")
    return out.withColumn("mean_score", F.round("mean_score", 4))


SCORES_SQL = "SELECT o_orderpriority, round(avg(floor(o_totalprice)), 4) AS mean_score, min(floor(o_totalprice)) AS least_score, max(floor(o_totalprice)) AS greatest_score, count(*) FILTER (o_totalprice > 100000) AS n_included FROM orders GROUP BY 1"


def equal_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.equal_folds(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", 7)


EQUAL_SQL = """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS p, count(*) OVER () AS n FROM labels)
SELECT doc_id, CASE WHEN p < (n % 7) * (n // 7 + 1) THEN p // (n // 7 + 1) ELSE n % 7 + (p - (n % 7) * (n // 7 + 1)) // greatest(n // 7, 1) END::INTEGER AS fold_idx FROM r
"""


def section_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", F.array_join(prompts.permutation(F.col("n_nationkey").cast("long"), ["role", "task", "hints", "format"]), ",").alias("sections"))


ORDER_SQL = """
WITH i AS (SELECT * FROM (VALUES (0, 'role'), (1, 'task'), (2, 'hints'), (3, 'format')) t(k, s)),
p AS (SELECT row_number() OVER (ORDER BY a.k, b.k, c.k, d.k) - 1 AS n, concat_ws(',', a.s, b.s, c.s, d.s) AS sections FROM i a, i b, i c, i d WHERE a.k NOT IN (b.k, c.k, d.k) AND b.k NOT IN (c.k, d.k) AND c.k <> d.k)
SELECT n_nationkey, coalesce(sections, NULL) AS sections FROM nation LEFT JOIN p ON n = n_nationkey
"""

QUERIES = {
    "three_way_diff": (three_way_diff, DIFF_SQL), "candidate_names": (candidate_names, CANDIDATES_SQL), "country_hints": (country_hints, HINTS_SQL), "best_unless_tied": (best_unless_tied, TIED_SQL),
    "redirected_ids": (redirected_ids, REDIRECT_SQL), "throughput": (throughput, THROUGHPUT_SQL), "value_spread": (value_spread, SPREAD_SQL), "example_scores": (example_scores, SCORES_SQL),
    "equal_folds": (equal_folds, EQUAL_SQL), "section_order": (section_order, ORDER_SQL),
}
