"""Queries that evaluate, aggregate, reshape and retrieve."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import gazetteer as G
from ..operators import report as R
from ..operators import reshape as S
from ..operators import retrieve as K
from .linking import NOISY
from .tables import table


def names_union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"))
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    return G.union_by_name(c, s, p).select("name", "segment", "brand")


UNION_SQL = "SELECT c_name AS name, c_mktsegment AS segment, NULL AS brand FROM customer UNION SELECT s_name, NULL, NULL FROM supplier UNION SELECT p_name, NULL, p_brand FROM part"


def left_parents_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    pairs = nation.select((F.col("n_nationkey") % 7).alias("child"), F.col("n_nationkey").alias("parent"))
    found = G.parents(pairs, nation.where("n_nationkey <> 3").select(F.col("n_nationkey").alias("id")), "child", "parent", "id")
    left = nation.select(F.col("n_nationkey").alias("child"), "n_name").join(found, "child", "left")
    return left.select("n_name", F.array_join("parents", ",").alias("parents"))


PARENTS_SQL = """
WITH f AS (SELECT n_nationkey % 7 AS child, string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) AS parents FROM nation WHERE n_nationkey <> 3 AND n_nationkey % 7 <> 3 GROUP BY 1)
SELECT n_name, parents FROM nation LEFT JOIN f ON n_nationkey = child
"""


def hierarchy_levels_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_regionkey").alias("a"), F.lit(None).cast("int").alias("b"), F.lit(None).cast("long").alias("c"))
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_regionkey").alias("a"), F.col("n_nationkey").alias("b"), F.lit(None).cast("long").alias("c"))
    of = nation.select("a", "b")
    supplier = table(spark, sf_dir, "supplier").join(of, F.col("s_nationkey") == F.col("b")).select(F.concat(F.lit("s"), "s_suppkey").alias("id"), "a", "b", F.col("s_suppkey").alias("c"))
    found = G.level_pairs(region.union(nation).union(supplier), "id", ["a", "b", "c"])
    return found.groupBy("parent", "level").agg(F.count("*").alias("children")).select("parent", F.col("level").cast("long").alias("level"), "children")


LEVELS_SQL = """
WITH p AS (SELECT 'r' || r_regionkey AS id, r_regionkey AS a, NULL AS b, NULL AS c FROM region UNION ALL SELECT 'n' || n_nationkey, n_regionkey, n_nationkey, NULL FROM nation
    UNION ALL SELECT 's' || s_suppkey, n_regionkey, n_nationkey, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
l AS (SELECT x.id AS parent, y.id AS child, 1 AS level FROM p x JOIN p y ON x.a = y.a WHERE x.id <> y.id AND x.b IS NULL
    UNION ALL SELECT x.id, y.id, 2 FROM p x JOIN p y ON x.a = y.a AND x.b = y.b WHERE x.id <> y.id AND x.c IS NULL
    UNION ALL SELECT x.id, y.id, 3 FROM p x JOIN p y ON x.a = y.a AND x.b = y.b AND x.c = y.c WHERE x.id <> y.id)
SELECT parent, level::BIGINT AS level, count(*) AS children FROM l GROUP BY ALL
"""


def anti_except_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a finished order."""
    finished = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"))
    return G.unlinked(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).distinct(), finished)


EXCEPT_SQL = "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'"


def upsert_bool_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", (F.col("l_quantity") > 45).alias("preferred"))
    return G.merged_flags(rows, ["l_partkey", "l_returnflag"], "preferred")


UPSERT_SQL = "SELECT l_partkey, l_returnflag, bool_or(l_quantity > 45) AS preferred FROM lineitem GROUP BY ALL"


def update_from_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_linenumber").alias("v"))
    return G.updated(table(spark, sf_dir, "part").select("p_partkey", "p_size"), sold, "p_partkey", "p_size", "v")


UPDATE_SQL = "SELECT p_partkey, CASE WHEN v.k IS NULL THEN p_size ELSE v.v END AS p_size FROM part LEFT JOIN (SELECT l_partkey AS k, max(l_linenumber) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) v ON v.k = p_partkey"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    labels = part.select("p_partkey", F.col("p_name").alias("name"), F.when(F.col("p_size") > 10, F.col("p_brand")).alias("brand"), F.col("p_type").alias("type"))
    pred = part.select("p_partkey", F.expr(NOISY).alias("name"), F.when(F.col("p_size") > 5, F.col("p_brand")).alias("brand"))
    return E.cells(pred, labels, "p_partkey", ["name", "brand", "type"])


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in E.METRICS else F.col(c) for c in df.columns])


def field_eval_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(E.micro_metrics(_cells(spark, sf_dir)))


def field_eval_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(E.micro_metrics(_cells(spark, sf_dir), "field"))


#: Metrics of cells: ``cells`` gives field, pred, label, present and the columns of ``by``.
EVAL = """
WITH c AS ({cells}),
r AS (SELECT *, greatest(length(coalesce(pred, '')), length(coalesce(label, ''))) AS l FROM c),
e AS (SELECT *, CASE WHEN present THEN levenshtein(lower(coalesce(pred, '')), lower(coalesce(label, ''))) ELSE l END AS d FROM r),
s AS (SELECT *, CASE WHEN NOT present THEN NULL WHEN l = 0 THEN 1.0 ELSE (l - d)::DOUBLE / l END AS sim FROM e),
a AS (SELECT {by}count(*) AS n, count(*) FILTER (present AND d <= 0)::DOUBLE AS a0, count(*) FILTER (present AND d <= 1)::DOUBLE AS a1, count(*) FILTER (present AND d <= 2)::DOUBLE AS a2,
    count(*) FILTER (present AND d <= 3)::DOUBLE AS a3, count(*) FILTER (present AND d <= 4)::DOUBLE AS a4, count(*) FILTER (present AND d = 0 AND pred IS NOT NULL AND label IS NOT NULL)::DOUBLE AS tp,
    count(pred)::DOUBLE AS np, count(label)::DOUBLE AS nl, sum(d)::DOUBLE AS d, coalesce(sum(sim), 0)::DOUBLE AS sim, count(*) FILTER (sim > 0)::DOUBLE AS hit, coalesce(sum(d) FILTER (present), 0)::DOUBLE AS dm FROM s {group}),
b AS (SELECT *, CASE WHEN np = 0 THEN 0.0 ELSE tp / np END AS p, CASE WHEN nl = 0 THEN 0.0 ELSE tp / nl END AS r FROM a),
m AS (SELECT {by}n, a0 / n AS accuracy, a1 / n AS accuracy_with_tol_1, a2 / n AS accuracy_with_tol_2, a3 / n AS accuracy_with_tol_3, a4 / n AS accuracy_with_tol_4,
    p AS precision, r AS recall, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f1, d / n AS average_levenshtein, sim / n AS average_similarity,
    CASE WHEN hit = 0 THEN 0.0 ELSE dm / hit END AS average_levenshtein_match, CASE WHEN hit = 0 THEN 0.0 ELSE sim / hit END AS average_similarity_match, 1 - hit / n AS no_match_rate FROM b)
"""
ALL_METRICS = ", ".join(f"round({m}, 6) AS {m}" for m in E.METRICS)
CELLS = f"""SELECT p_partkey, 'name' AS field, {NOISY} AS pred, p_name AS label, true AS present FROM part
    UNION ALL SELECT p_partkey, 'brand', CASE WHEN p_size > 5 THEN p_brand END, CASE WHEN p_size > 10 THEN p_brand END, true FROM part
    UNION ALL SELECT p_partkey, 'type', NULL, p_type, false FROM part"""
MICRO_SQL = EVAL.format(cells=CELLS, by="", group="") + f"SELECT n, {ALL_METRICS} FROM m"
FIELD_SQL = EVAL.format(cells=CELLS, by="field, ", group="GROUP BY field") + f"SELECT field, n, {ALL_METRICS} FROM m"


def span_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    gold = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row"), F.lit(0).alias("start"), F.col("quality").alias("end"), F.when(F.col("toxic") == 1, "toxic").otherwise("fine").alias("label"))
    pred = d.select(F.col("doc_id").alias("row"), F.lit(0).alias("start"), F.when(F.col("n_chars") > 400, 1).otherwise(0).alias("end"), F.when(F.col("text").contains("idiot"), "toxic").otherwise("fine").alias("label"))
    return E.span_scores(gold, pred)


SPAN_SQL = """
WITH g AS (SELECT DISTINCT doc_id AS row, quality AS e, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'fine' END AS label, 1 AS g FROM labels),
p AS (SELECT DISTINCT doc_id AS row, CASE WHEN n_chars > 400 THEN 1 ELSE 0 END AS e, CASE WHEN contains(text, 'idiot') THEN 'toxic' ELSE 'fine' END AS label, 1 AS p FROM documents)
SELECT label, count(*) FILTER (g IS NOT NULL AND p IS NOT NULL) AS tp, count(*) FILTER (g IS NULL) AS fp, count(*) FILTER (p IS NULL) AS fn FROM g FULL JOIN p USING (row, e, label) GROUP BY ROLLUP (label)
"""


def fold_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("fold", F.col("doc_id") % 10)
    per_fold = both.groupBy("lang", "fold").agg(F.avg("quality").alias("quality"))
    return E.mean_and_deviation(per_fold, ["quality"], "lang").select("lang", F.round("quality_mean", 6).alias("quality_mean"), F.round("quality_std", 6).alias("quality_std"))


FOLD_SQL = "SELECT lang, round(avg(q), 6) AS quality_mean, round(stddev_samp(q), 6) AS quality_std FROM (SELECT lang, doc_id % 10 AS fold, avg(quality) AS q FROM documents JOIN labels USING (doc_id) GROUP BY ALL) GROUP BY lang"


def pivot_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.split_counts(table(spark, sf_dir, "documents"), "source", "lang", ["en", "fr", "de", "es"])


PIVOT_SQL = "SELECT coalesce(source, 'Total') AS source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'es') AS es, count(*) AS total FROM documents GROUP BY ROLLUP (source)"


def share_other_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_other(table(spark, sf_dir, "part"), "p_brand", 0.041)


OTHER_SQL = "WITH c AS (SELECT p_brand, count(*) AS cnt FROM part WHERE p_brand IS NOT NULL GROUP BY 1), s AS (SELECT p_brand, cnt, cnt / sum(cnt) OVER () >= 0.041 AS big FROM c) SELECT p_brand, sum(cnt)::BIGINT AS cnt FROM (SELECT CASE WHEN big THEN p_brand ELSE 'Other' END AS p_brand, cnt FROM s UNION ALL SELECT 'Other', 0) GROUP BY 1"


def describe_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.described(table(spark, sf_dir, "customer"), ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])


DESCRIBE_SQL = " UNION ALL ".join(f'SELECT \'{c}\' AS "column", count({c}) AS n, count(DISTINCT {c}) AS n_unique FROM customer' for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))


def melt_join_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    label = part.select("p_partkey", "p_name", "p_brand").unpivot("p_partkey", ["p_name", "p_brand"], "entity", "label")
    pred = part.select("p_partkey", F.expr(NOISY).alias("p_name"), F.when(F.col("p_size") > 5, F.col("p_brand")).alias("p_brand")).unpivot("p_partkey", ["p_name", "p_brand"], "entity", "pred")
    return label.join(pred, ["p_partkey", "entity"]).where(~F.col("label").eqNullSafe(F.col("pred"))).select("p_partkey", "entity", "label", "pred")


MELT_SQL = f"WITH l AS (SELECT p_partkey, 'p_name' AS entity, p_name AS label, {NOISY} AS pred FROM part UNION ALL SELECT p_partkey, 'p_brand', p_brand, CASE WHEN p_size > 5 THEN p_brand END FROM part) SELECT * FROM l WHERE label IS DISTINCT FROM pred"


def left_join_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "part").groupBy("p_name", "p_size").agg(F.count("*").alias("n"))
    pred = sizes.select("p_name", F.col("p_size").alias("size_pred"), F.col("n").alias("n_pred"))
    true = sizes.select("p_name", F.col("p_size").alias("size_true"), F.col("n").alias("n_true"))
    pairs = F.col("n_pred") * F.coalesce("n_true", F.lit(1))
    return pred.join(true, "p_name", "left").select("p_name", "size_pred", "size_true", pairs.alias("cnt"))


SUFFIX_SQL = "SELECT p_name, x.p_size AS size_pred, y.p_size AS size_true, count(*) AS cnt FROM part x LEFT JOIN (SELECT p_name, p_size FROM part) y USING (p_name) GROUP BY ALL"


def best_per_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.best_per_family(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), "s_nationkey", ["s_acctbal"], ["s_suppkey"])


BEST_SQL = "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier QUALIFY s_acctbal = max(s_acctbal) OVER (PARTITION BY s_nationkey) OR s_suppkey = min(s_suppkey) OVER (PARTITION BY s_nationkey)"


def median_inclusion_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("included", F.col("user_id") % 2 == 0)
    return R.inclusion_gain(e, "event_type", "included", "value").select("event_type", F.round("gain", 6).alias("gain"))


GAIN_SQL = "SELECT event_type, round(median(value) FILTER (user_id % 2 = 0) - median(value) FILTER (user_id % 2 <> 0), 6) AS gain FROM events GROUP BY 1"


def cummax_over_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cumulative_max(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), "user_id", ["event_id"], "value", "best")


CUMMAX_SQL = "SELECT event_id, user_id, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS best FROM events"


def lexicographic_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(F.max(F.struct("o_orderpriority", "o_totalprice", "o_orderkey")).alias("b")).select("o_custkey", "b.*")


LEXI_SQL = "SELECT o_custkey, o_orderpriority, o_totalprice, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC, o_totalprice DESC, o_orderkey DESC) = 1"


def alias_map_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    alias = spark.createDataFrame([("EN", "English"), ("De", "German"), ("fr", "French")], "alias string, name string").select(F.lower("alias").alias("k"), "name")
    d = table(spark, sf_dir, "documents")
    named = d.join(F.broadcast(alias), F.lower("lang") == F.col("k"), "left")  # a constant table
    return named.select(F.coalesce("name", "lang", F.lit("No language")).alias("language")).groupBy("language").agg(F.count("*").alias("cnt"))


ALIAS_SQL = "SELECT coalesce(CASE lower(lang) WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' END, lang, 'No language') AS language, count(*) AS cnt FROM documents GROUP BY 1"


def _hits(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    examples = e.select(F.col("vec_id").alias("example_id"), F.col("embedding").alias("e"))
    return K.nearest_vectors(queries, examples, k, itself=False)


def knn_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).withColumn("score", F.round("score", 6))


_KNN = """
WITH h AS (SELECT q.vec_id AS query_id, e.vec_id AS example_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score
    FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, example_id) AS rank FROM h)
"""
KNN_SQL = _KNN + "SELECT query_id, example_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5"


def fallback_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.needs_fallback(_hits(spark, sf_dir), 0.4).select("query_id", F.round("mean_score", 6).alias("mean_score"), "fallback")


FALLBACK_SQL = _KNN + "SELECT query_id, round(avg(score), 6) AS mean_score, avg(score) < 0.4 AS fallback FROM r WHERE rank <= 5 GROUP BY query_id"


def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest by cosine pooled with nearest by label and first component, both on one scale of scores."""
    near = _hits(spark, sf_dir, 4)
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id"), "label", F.round(F.col("embedding")[0].cast("double"), 6).alias("x"))
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.struct("label", "x").alias("q"))
    examples = e.select(F.col("vec_id").alias("example_id"), F.struct("label", "x").alias("e"))
    alike = K.nearest(queries, examples, 4, lambda q, x: F.when(q["label"] == x["label"], 1.0).otherwise(0.0) - F.abs(q["x"] - x["x"]), itself=False)
    return K.pooled(near, alike, 6).select("query_id", "example_id", F.round("score", 5).alias("score"), "rank", F.col("source").cast("long").alias("source"))


HYBRID_SQL = """
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, round(embedding[1]::DOUBLE, 6) AS x FROM embeddings),
h AS (SELECT q.vec_id AS query_id, e.vec_id AS example_id, list_cosine_similarity(q.v, e.v) AS a, CASE WHEN q.label = e.label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END - abs(q.x - e.x) AS b FROM e q, e WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id),
pools AS (SELECT query_id, example_id, a AS score, 0 AS source FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY a DESC, example_id) <= 4
    UNION ALL SELECT query_id, example_id, b, 1 FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY b DESC, example_id) <= 4),
once AS (SELECT * FROM pools QUALIFY row_number() OVER (PARTITION BY query_id, example_id ORDER BY source) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, example_id) AS rank FROM once)
SELECT query_id, example_id, round(score, 5) AS score, rank, source::BIGINT AS source FROM r WHERE rank <= 6
"""


def split_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, share of all and rows for each distinct user by event type, with a total row."""
    e = table(spark, sf_dir, "events")
    counts = e.rollup("event_type").agg(F.count("*").alias("cnt"), F.countDistinct("user_id").alias("users"))
    whole = F.max("cnt").over(Window.partitionBy(F.lit(1)))  # as many rows as there are types
    return counts.select(F.coalesce("event_type", F.lit("Total")).alias("event_type"), "cnt", F.round(F.col("cnt") / whole, 6).alias("share"), F.round(F.col("cnt") / F.col("users"), 6).alias("per_user"))


SPLIT_SQL = "WITH c AS (SELECT event_type, count(*) AS cnt, count(DISTINCT user_id) AS users FROM events GROUP BY ROLLUP (event_type)) SELECT coalesce(event_type, 'Total') AS event_type, cnt, round(cnt / max(cnt) OVER (), 6) AS share, round(cnt / users, 6) AS per_user FROM c"


def hierarchy_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("address"), F.col("o_orderstatus").alias("group"), (F.col("o_orderkey") % 5).alias("rank"))
    out = G.best_of_group(o)
    return out.select("address", F.col("group").alias("grp"), "size", F.round("mean_rank", 6).alias("mean_rank"), F.col("group_rank").cast("long").alias("group_rank"))


GROUPS_SQL = "WITH g AS (SELECT o_custkey AS address, o_orderstatus AS grp, count(*) AS size, avg(o_orderkey % 5) AS m FROM orders GROUP BY ALL) SELECT address, grp, size, round(m, 6) AS mean_rank, rank() OVER (PARTITION BY address ORDER BY size DESC, m) AS group_rank FROM g"

QUERIES = {
    "names_union_by_name": (names_union_by_name, UNION_SQL), "left_parents_list": (left_parents_list, PARENTS_SQL), "hierarchy_levels_union": (hierarchy_levels_union, LEVELS_SQL),
    "anti_except_ids": (anti_except_ids, EXCEPT_SQL), "upsert_bool_or": (upsert_bool_or, UPSERT_SQL), "update_from_join": (update_from_join, UPDATE_SQL), "field_eval_micro": (field_eval_micro, MICRO_SQL),
    "field_eval_by_field": (field_eval_by_field, FIELD_SQL), "span_prf": (span_prf, SPAN_SQL), "fold_mean_std": (fold_mean_std, FOLD_SQL), "pivot_split_counts": (pivot_split_counts, PIVOT_SQL),
    "share_other_rollup": (share_other_rollup, OTHER_SQL), "describe_columns": (describe_columns, DESCRIBE_SQL), "melt_join_errors": (melt_join_errors, MELT_SQL), "left_join_suffix": (left_join_suffix, SUFFIX_SQL),
    "best_per_family": (best_per_family, BEST_SQL), "median_inclusion_gain": (median_inclusion_gain, GAIN_SQL), "cummax_over_trials": (cummax_over_trials, CUMMAX_SQL), "lexicographic_best": (lexicographic_best, LEXI_SQL),
    "alias_map_counts": (alias_map_counts, ALIAS_SQL), "knn_cosine_topk": (knn_cosine_topk, KNN_SQL), "fallback_examples": (fallback_examples, FALLBACK_SQL), "hybrid_topk": (hybrid_topk, HYBRID_SQL),
    "split_lengths": (split_lengths, SPLIT_SQL), "hierarchy_groups": (hierarchy_groups, GROUPS_SQL),
}
