"""Queries that build gazetteer tables, turn tables, and use small functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompts
from ..functions import text as X
from ..operators import evaluate as E
from ..operators import gazetteer as G
from ..operators import report as R
from ..operators import reshape as S
from ..operators import retrieve as K
from .tables import table

#: Regions as countries, nations as divisions of the first level, suppliers as divisions of the second or cities in them.
_PLACES_SQL = """
SELECT r_regionkey AS id, r_name AS name, 'A' AS feature_class, 'PCLI' AS feature_code, 'r' || r_regionkey AS country_code, NULL::VARCHAR AS admin1_code, NULL::VARCHAR AS admin2_code, NULL::VARCHAR AS admin3_code, NULL::VARCHAR AS admin4_code, NULL::VARCHAR AS admin5_code, 0.0::DOUBLE AS population FROM region
UNION ALL SELECT 100 + n_nationkey, n_name, 'A', 'ADM1', 'r' || n_regionkey, 'n' || n_nationkey, NULL, NULL, NULL, NULL, 0.0 FROM nation
UNION ALL SELECT 1000 + s_suppkey, s_name, CASE WHEN s_suppkey % 3 = 0 THEN 'A' ELSE 'P' END, CASE s_suppkey % 3 WHEN 0 THEN 'ADM2' WHEN 1 THEN 'PPL' ELSE 'PPLX' END, 'r' || n_regionkey, 'n' || n_nationkey, 's' || (s_suppkey // 3), NULL, NULL, NULL, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""
_LINKS_SQL = "SELECT 1000 + (s_suppkey * 7) % 50 AS parent, 1000 + s_suppkey AS child, CASE WHEN s_suppkey % 5 = 0 THEN 'ADM' END AS type FROM supplier UNION ALL SELECT 1000 + (s_suppkey * 11) % 60, 1000 + s_suppkey, NULL FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT 100 + s_suppkey % 25, 1000 + s_suppkey, 'part' FROM supplier WHERE s_suppkey % 2 = 0"


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    none = [F.lit(None).cast("string").alias(f"admin{i}_code") for i in range(1, 6)]
    head = lambda key, base, name: [(F.col(key) + base).cast("long").alias("id"), F.col(name).alias("name")]
    kinds = lambda a, b: [a.alias("feature_class"), b.alias("feature_code")]
    zero = F.lit(0.0).alias("population")
    country = F.concat(F.lit("r"), "n_regionkey").alias("country_code")
    first = F.concat(F.lit("n"), "n_nationkey").alias("admin1_code")
    a = region.select(*head("r_regionkey", 0, "r_name"), *kinds(F.lit("A"), F.lit("PCLI")), F.concat(F.lit("r"), "r_regionkey").alias("country_code"), *none, zero)
    b = nation.select(*head("n_nationkey", 100, "n_name"), *kinds(F.lit("A"), F.lit("ADM1")), country, first, *none[1:], zero)
    third = F.col("s_suppkey") % 3
    c = supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(  # nations: 25 rows
        *head("s_suppkey", 1000, "s_name"), *kinds(F.when(third == 0, "A").otherwise("P"), F.when(third == 0, "ADM2").when(third == 1, "PPL").otherwise("PPLX")),
        country, first, F.concat(F.lit("s"), F.floor(F.col("s_suppkey") / 3).cast("string")).alias("admin2_code"), *none[2:], F.col("s_acctbal").cast("double").alias("population"),
    )
    return a.union(b).union(c)


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").withColumn("child", (F.col("s_suppkey") + 1000).cast("long"))
    part = lambda rows, parent, kind: rows.select(parent.cast("long").alias("parent"), "child", kind.cast("string").alias("type"))
    k = F.col("s_suppkey")
    return part(s, 1000 + (k * 7) % 50, F.when(k % 5 == 0, "ADM")).union(part(s.where(k % 4 == 0), 1000 + (k * 11) % 60, F.lit(None))).union(part(s.where(k % 2 == 0), 100 + k % 25, F.lit("part")))


def informal_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    places, links = _places(spark, sf_dir), _links(spark, sf_dir)
    cities, regions = (G.informal_parents(links, places, k) for k in ("city", "region"))
    out = G.simplified(places.select("id", "name"), cities, regions)
    return out.select("id", "name", *[F.array_join(c, ",").alias(c) for c in ("parent_city_ids", "parent_region_ids")])


INFORMAL_SQL = f"""
WITH p AS ({_PLACES_SQL}), l AS ({_LINKS_SQL}),
j AS (SELECT l.*, p.feature_class, p.feature_code FROM l JOIN p ON l.parent = p.id JOIN p c ON l.child = c.id),
a AS (SELECT child, string_agg(parent::VARCHAR, ',' ORDER BY parent) AS v FROM j WHERE feature_class = 'P' AND feature_code <> 'PPLX' AND type IS DISTINCT FROM 'ADM' GROUP BY child),
b AS (SELECT child, string_agg(parent::VARCHAR, ',' ORDER BY parent) AS v FROM j WHERE feature_class = 'A' AND feature_code LIKE 'ADM%' GROUP BY child)
SELECT id, name, a.v AS parent_city_ids, b.v AS parent_region_ids FROM p LEFT JOIN a ON id = a.child LEFT JOIN b ON id = b.child
"""


def full_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = _places(spark, sf_dir)
    return G.full_hierarchy(places, places.where("feature_code = 'PCLI'"), G.informal_parents(_links(spark, sf_dir), places, "either"))


HIERARCHY_SQL = f"""
WITH p AS ({_PLACES_SQL}), l AS ({_LINKS_SQL}),
i AS (SELECT child, any_value(parent) AS parent FROM l JOIN p ON l.parent = p.id WHERE feature_class = 'P' AND feature_code <> 'PPLX' AND type IS DISTINCT FROM 'ADM' AND child IN (SELECT id FROM p) GROUP BY child HAVING count(*) = 1)
SELECT child, parent, level FROM (
    SELECT c.id AS child, x.id AS parent, 'Country' AS level FROM p c JOIN p x USING (country_code) WHERE x.feature_code = 'PCLI'
    UNION SELECT c.id, x.id, 'ADM1' FROM p c JOIN p x USING (country_code, admin1_code) WHERE x.feature_class = 'A' AND x.feature_code LIKE 'ADM1%' AND x.admin2_code IS NULL
    UNION SELECT c.id, x.id, 'ADM2' FROM p c JOIN p x USING (country_code, admin1_code, admin2_code) WHERE x.feature_class = 'A' AND x.feature_code LIKE 'ADM2%' AND x.admin3_code IS NULL
    UNION SELECT child, parent, 'City' FROM i) WHERE child <> parent
"""


def match_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that match a supplier, its nation and a region; a group is led by what is no other's parent."""
    places = _places(spark, sf_dir).withColumn("parent_ids", F.when(F.col("id") % 10 == 4, F.array((F.col("id") - 1).cast("long"))))
    kind = F.when(F.col("feature_code") == "PCLI", "Country").when(F.col("feature_code") == "ADM1", "State").when(F.col("feature_code") == "ADM2", "District").otherwise("City")
    typed = places.withColumn("entity_type", kind)
    # every seventh supplier with the one before it, its region and the nation with its number
    s = table(spark, sf_dir, "supplier").where("s_suppkey > 0").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 rows
    k = F.col("s_suppkey")
    ids = s.select(k.alias("address"), F.explode(F.array_distinct(F.array((k + 1000).cast("long"), (k + 999).cast("long"), F.col("n_regionkey").cast("long"), (100 + k % 25).cast("long")))).alias("id"))
    matches = typed.join(ids, "id").withColumn("rank", F.col("id") % 3)
    found = G.best_of_group(G.hierarchy_match_groups(matches))
    return found.select("address", F.col("group").alias("leader"), "size", F.round("mean_rank", 6).alias("mean_rank"), F.col("group_rank").cast("long").alias("group_rank"))


GROUPS_SQL = f"""
WITH p AS (SELECT *, CASE feature_code WHEN 'PCLI' THEN 'Country' WHEN 'ADM1' THEN 'State' WHEN 'ADM2' THEN 'District' ELSE 'City' END AS kind FROM ({_PLACES_SQL})),
a AS (SELECT DISTINCT s_suppkey AS address, unnest([s_suppkey + 1000, s_suppkey + 999, n_regionkey, 100 + s_suppkey % 25]) AS id FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey > 0),
m AS (SELECT a.address, p.*, p.id % 3 AS rank FROM a JOIN p USING (id)),
x AS (SELECT DISTINCT c.address, c.id AS child, q.id AS parent FROM m c JOIN m q USING (address) WHERE c.kind <> q.kind AND c.id <> q.id AND (
    (q.feature_class = 'A' AND ((q.kind = 'Country' AND q.country_code = c.country_code) OR (q.kind = 'State' AND q.country_code = c.country_code AND q.admin1_code = c.admin1_code)
        OR (q.kind = 'District' AND q.country_code = c.country_code AND q.admin1_code = c.admin1_code AND q.admin2_code = c.admin2_code))) OR (c.id % 10 = 4 AND q.id = c.id - 1))),
leads AS (SELECT address, id FROM m WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.address = m.address AND x.parent = m.id)),
g AS (SELECT address, id AS leader, id FROM leads UNION SELECT l.address, l.id, x.parent FROM leads l JOIN x ON x.address = l.address AND x.child = l.id),
s AS (SELECT address, leader, count(*) AS size, avg(id % 3) AS mean FROM g GROUP BY ALL)
SELECT address, leader, size, round(mean, 6) AS mean_rank, rank() OVER (PARTITION BY address ORDER BY size DESC, mean) AS group_rank FROM s
"""


def largest_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.largest_places(_places(spark, sf_dir), n=3)


LARGEST_SQL = f"SELECT country_code, name, row_number() OVER (PARTITION BY country_code ORDER BY population DESC NULLS LAST, name) AS place FROM ({_PLACES_SQL}) WHERE feature_class = 'P' QUALIFY place <= 3"


def first_of_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return G.first_of_key(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).withColumn("o_orderdate", F.col("o_orderdate").cast("date").cast("string"))


FIRST_SQL = "SELECT o_custkey, o_orderkey, o_orderstatus, o_orderdate::DATE::VARCHAR AS o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1"


# tables turned


def dropna_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a value, and a column without any, go."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr("CASE WHEN p_size % 3 = 0 THEN p_name END").alias("name"), F.expr("CASE WHEN p_size % 4 = 0 THEN p_brand END").alias("brand"), F.lit(None).cast("string").alias("never"))
    return S.without_empty_columns(S.without_empty_rows(p, ["name", "brand", "never"]))


DROPNA_SQL = "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name END AS name, CASE WHEN p_size % 4 = 0 THEN p_brand END AS brand FROM part WHERE p_size % 3 = 0 OR p_size % 4 = 0"


def wide_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("cnt"))
    return S.wide(counts, "o_orderpriority", "o_orderstatus", "cnt", ["F", "O", "P"])


WIDE_SQL = "SELECT o_orderpriority, nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS F, nullif(count(*) FILTER (o_orderstatus = 'O'), 0) AS O, nullif(count(*) FILTER (o_orderstatus = 'P'), 0) AS P FROM orders GROUP BY 1"


def long_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr("CASE WHEN p_size % 3 = 0 THEN p_size END").alias("size"), F.col("p_brand").alias("brand"))
    return S.long(p, "p_partkey", ["size", "brand"])


LONG_SQL = "SELECT p_partkey, 'size' AS name, p_size::VARCHAR AS value FROM part WHERE p_size % 3 = 0 UNION ALL SELECT p_partkey, 'brand', p_brand FROM part"


def transposed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"), F.max("o_orderkey").alias("last"))
    return S.transposed(rows, "o_orderstatus", ["n", "customers", "last"], ["F", "O", "P"])


TRANSPOSED_SQL = """
WITH r AS (SELECT o_orderstatus AS s, count(*)::DOUBLE AS n, count(DISTINCT o_custkey)::DOUBLE AS customers, max(o_orderkey)::DOUBLE AS "last" FROM orders GROUP BY 1)
SELECT name, max(value) FILTER (s = 'F') AS F, max(value) FILTER (s = 'O') AS O, max(value) FILTER (s = 'P') AS P FROM (SELECT s, unnest(['n', 'customers', 'last']) AS name, unnest([n, customers, "last"]) AS value FROM r) GROUP BY name
"""


def nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.expr("CASE WHEN p_size % 4 > 0 THEN p_size END").alias("size"))
    return S.numbered(p, "size", "p_partkey", within=["p_brand"])


NULLS_SQL = "SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY size ASC NULLS LAST, p_partkey) AS place FROM (SELECT p_partkey, p_brand, CASE WHEN p_size % 4 > 0 THEN p_size END AS size FROM part)"


def drawn_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: its number of rows, all of them the table's, each once."""
    rows = S.drawn(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 100)
    return rows.distinct().agg(F.count("*").alias("rows"), (F.min("p_partkey") >= 0).alias("known"))


DRAWN_SQL = "SELECT least(100, count(*)) AS rows, true AS known FROM part"


# numbers


def number_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_brand", F.expr("CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 5 = 0 THEN double('NaN') ELSE double(p_size) END").alias("a"), F.col("p_partkey").cast("double").alias("b"))
    return E.summary(p, ["a", "b"], "p_brand").withColumn("mean", F.round("mean", 6))


SUMMARY_SQL = """
WITH v AS (SELECT p_brand, CASE WHEN p_size % 3 = 0 OR p_size % 5 = 0 THEN NULL ELSE p_size::DOUBLE END AS x FROM part UNION ALL SELECT p_brand, p_partkey::DOUBLE FROM part)
SELECT p_brand, count(x) AS n, sum(x) AS sum, round(avg(x), 6) AS mean, min(x) AS min, max(x) AS max FROM v WHERE x IS NOT NULL GROUP BY p_brand
"""


def alignment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a name and words that are in it, are not, or are blank."""
    from ..functions import spans

    p = table(spark, sf_dir, "part").select(
        F.expr("CASE WHEN p_size % 7 = 0 THEN '' WHEN p_size % 11 = 0 THEN NULL ELSE p_name END").alias("text"), F.element_at(F.split("p_name", " "), 1).alias("first"),
        F.expr("CASE WHEN p_size % 2 = 0 THEN 'absent' ELSE ' ' END").alias("second"),
    )
    parts = F.array(*[F.struct(F.lit(c).alias("label"), F.when(F.col("text") != "small ring", F.col(c)).alias("part")) for c in ("first", "second")])
    return E.alignment_counts(p.withColumn("spans", spans.spans(F.col("text"), parts)), "text", ["first", "second"], "spans")


ALIGNED_SQL = """
WITH p AS (SELECT p_size, p_size % 7 = 0 OR p_size % 11 = 0 AS empty, p_name = 'small ring' AS ring FROM part)
SELECT count(*) FILTER (NOT empty AND NOT ring)::BIGINT AS examples, count(*) FILTER (empty OR ring)::BIGINT AS skipped, (count(*) FILTER (NOT empty AND ring) + count(*) FILTER (NOT empty AND p_size % 2 = 0))::BIGINT AS not_aligned FROM p
"""


def best_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return R.best_flags(s, ["s_acctbal"], ["s_suppkey"], -3, "s_nationkey")


FLAGS_SQL = "SELECT s_suppkey, s_nationkey, s_acctbal, round(s_acctbal, -3) = max(round(s_acctbal, -3)) OVER w AS s_acctbal_best, round(s_suppkey, -3) = min(round(s_suppkey, -3)) OVER w AS s_suppkey_best FROM supplier WINDOW w AS (PARTITION BY s_nationkey)"


def top_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_studies(table(spark, sf_dir, "orders").withColumn("price", F.floor("o_totalprice")), "o_custkey", ["o_orderpriority", "price"], 5)


STUDIES_SQL = "SELECT o_custkey, o_orderpriority, price FROM (SELECT o_custkey, o_orderpriority, floor(o_totalprice)::BIGINT AS price FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC, floor(o_totalprice) DESC) = 1) ORDER BY o_orderpriority DESC, price DESC, o_custkey LIMIT 5"


def group_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value by the number of examples in a configuration's name."""
    name = F.concat(F.lit("model-"), (F.col("user_id") % 4).cast("string"), F.lit("shot-v2"))
    e = table(spark, sf_dir, "events").select(name.alias("config"), "value")
    return e.groupBy(X.without_shots(F.col("config")).alias("prefix"), X.shots(F.col("config")).cast("long").alias("shots")).agg(F.round(F.avg("value"), 6).alias("mean"))


MEANS_SQL = "SELECT 'model-v2' AS prefix, (user_id % 4)::BIGINT AS shots, round(avg(value), 6) AS mean FROM events GROUP BY 2"


# small functions


def config_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    strategy = F.when(n % 3 == 0, "embedding").when(n % 3 == 1, "pattern").otherwise("hybrid")
    name = X.config_name(F.col("n_name"), strategy, n % 5, F.lit("mini"), n % 7, n % 2 == 0, F.when(n % 4 == 0, n / 25.0).otherwise(0.0))
    return table(spark, sf_dir, "nation").select("n_nationkey", name.alias("config"))


NAMES_SQL = """
SELECT n_nationkey, concat_ws('_', n_name, 'prompt2', CASE n_nationkey % 3 WHEN 0 THEN 'emb-mini-' || (n_nationkey % 5) || 'shot' WHEN 1 THEN 'pat-ner-' || (n_nationkey % 5) || 'shot' ELSE 'hybrid-ner-emb-mini-' || (n_nationkey % 5) || 'shot-pool' || (n_nationkey % 7) END,
    CASE WHEN n_nationkey % 2 = 0 THEN 'rules' END, CASE WHEN n_nationkey % 4 = 0 AND n_nationkey > 0 THEN 'fb' || replace(printf('%.2f', n_nationkey / 25.0), '.', '') END) AS config FROM nation
"""


def lehmer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of orders, some of them out of range, with one item left out at times."""
    n = F.col("n_nationkey")
    items = F.array(*[F.lit(x) for x in ("role", "task", "hints", "format")])
    code = F.array((n % 5).cast("int"), (n % 3).cast("int"), (n % 2).cast("int"), F.lit(0))
    short = F.array((n % 3).cast("int"), (n % 2).cast("int"), F.lit(0))
    included = F.array(F.lit(True), F.lit(True), n % 2 == 0, F.lit(True))
    some = prompts.partial_permutation(included, F.when(n % 2 == 0, code).otherwise(short), items)
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(prompts.permutation_of_code(code, items), ",").alias("whole"), F.array_join(some, ",").alias("some"))


LEHMER_SQL = """
WITH c AS (SELECT n_nationkey AS n, n_nationkey % 5 AS a, n_nationkey % 3 AS b, n_nationkey % 2 AS c FROM nation),
one AS (SELECT n, a, b, c, ['role', 'task', 'hints', 'format'] AS l0, ['role', 'task', 'format'] AS m0 FROM c),
two AS (SELECT *, l0[a + 1] AS w1, [l0[i] FOR i IN range(1, 5) IF i <> a + 1] AS l1, m0[b + 1] AS v1, [m0[i] FOR i IN range(1, 4) IF i <> b + 1] AS m1 FROM one),
three AS (SELECT *, l1[b + 1] AS w2, [l1[i] FOR i IN range(1, 4) IF i <> b + 1] AS l2, m1[c + 1] AS v2, [m1[i] FOR i IN range(1, 3) IF i <> c + 1] AS m2 FROM two),
four AS (SELECT *, l2[c + 1] AS w3, [l2[i] FOR i IN range(1, 3) IF i <> c + 1] AS l3 FROM three),
done AS (SELECT n, CASE WHEN a < 4 THEN concat_ws(',', w1, w2, w3, l3[1]) END AS whole, concat_ws(',', v1, v2, m2[1]) AS odd FROM four)
SELECT n AS n_nationkey, whole, CASE WHEN n % 2 = 0 THEN whole ELSE odd END AS some FROM done
"""

_NAME = "concat(upper(substring(p_name, 1, 1)), substring(replace(p_name, ' ', upper(substring(p_name, 1, 1))), 2, 100))"


def split_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camel case as words, signs set apart, tokens, spaces made visible, separators trimmed, pieces of words."""
    p = table(spark, sf_dir, "part").select("p_name", "p_brand").distinct()
    odd = F.concat(F.lit("-. ("), "p_name", F.lit("). "))
    return p.select(
        "p_name", "p_brand", X.spaced_words(F.expr(_NAME)).alias("words"), X.spaced_signs(F.col("p_brand")).alias("signs"), F.array_join(X.word_tokens(F.col("p_brand")), "|").alias("tokens"),
        X.visible_spaces(F.col("p_name")).alias("visible"), X.without_separators(odd).alias("bare"), X.begins_no_word(F.col("p_name"), F.lit(1), F.lit(3)).alias("inner"), X.begins_no_word(F.col("p_name"), F.lit(0), F.lit(3)).alias("outer"),
    )


SPLIT_SQL = f"""
SELECT DISTINCT p_name, p_brand, array_to_string(regexp_extract_all({_NAME}, '[A-Z][a-z]*'), ' ') || ' ' AS words, replace(p_brand, '#', ' # ') AS signs, replace(p_brand, '#', '|#|') AS tokens,
    replace(p_name, ' ', '␣') AS visible, p_name || ').' AS bare, strpos(p_name, ' ') > 3 AS inner, false AS outer FROM part
"""


def label_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of an example in the order of their parts in the text."""
    p = table(spark, sf_dir, "part").select("p_name", "p_brand").distinct()
    labels = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("last"), F.element_at(F.split("p_name", " "), -1), F.lit("first"), F.split("p_name", " ")[0], F.lit("none"), F.lit(None).cast("string"))
    found = K.ordered_labels(F.concat_ws(" ", "p_name", "p_brand"), labels)
    return p.select("p_name", "p_brand", F.array_join(F.transform(found, lambda x: F.concat(x["label"], F.lit("="), x["part"])), ";").alias("labels"))


ORDERED_SQL = "SELECT DISTINCT p_name, p_brand, 'first=' || split_part(p_name, ' ', 1) || ';last=' || split_part(p_name, ' ', -1) || ';brand=' || p_brand AS labels FROM part"


def few_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors as examples, of which some are too far, and fixed ones where all are."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    known = e.select(F.col("vec_id").alias("example_id"), F.col("embedding").alias("e"))
    examples = e.select(F.col("vec_id").alias("example_id"), F.concat(F.lit("at "), F.col("vec_id").cast("string")).alias("address"), F.create_map(F.lit("City"), F.col("label").cast("string")).alias("labels"))
    shots = K.few_shot(asked, K.nearest_vectors(asked, known, 3, itself=False), examples, 0.45)
    fixed = K.fixed_shots([("Am Ring 5, Ulm", {"City": "Ulm", "State": ""})], ["City", "State"])
    found = K.with_fallback(shots, fixed, 0.4)
    shown = F.array_join(F.transform(K.included_examples(F.col("shots")), lambda s: F.concat(s["address"], F.lit(":"), s["labels"]["City"])), ";")
    return found.select("query_id", shown.alias("examples"), F.size("shots").cast("long").alias("shots"))


SHOTS_SQL = """
WITH h AS (SELECT q.vec_id AS query_id, e.vec_id AS example_id, e.label, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, example_id) AS rank FROM h QUALIFY rank <= 3)
SELECT query_id, CASE WHEN avg(score) < 0.4 THEN 'Am Ring 5, Ulm:Ulm' ELSE coalesce(string_agg('at ' || example_id || ':' || label, ';' ORDER BY rank) FILTER (score >= 0.45), '') END AS examples, (CASE WHEN avg(score) < 0.4 THEN 1 ELSE count(*) END)::BIGINT AS shots FROM r GROUP BY query_id
"""


def byte_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of words with umlauts and accents, by bytes and by characters, with and without a bound."""
    p = table(spark, sf_dir, "part").select("p_name").distinct()
    odd = F.translate("p_name", "aeiou", "äéíöü")
    return p.select("p_name", X.byte_distance(F.col("p_name"), odd).cast("long").alias("bytes"), X.edit_distance(F.col("p_name"), F.upper(odd)).cast("long").alias("characters"), X.edit_distance(F.col("p_name"), odd, 2).cast("long").alias("bounded"), X.edit_distance(F.col("p_name"), F.lit(""), 2).cast("long").alias("empty"))


BYTES_SQL = """
WITH p AS (SELECT DISTINCT p_name, translate(p_name, 'aeiou', 'äéíöü') AS odd, length(p_name) - length(replace(translate(p_name, 'aeiou', '#####'), '#', '')) AS vowels FROM part)
SELECT p_name, levenshtein(p_name, odd) AS bytes, vowels AS characters, least(vowels, 3) AS bounded, length(p_name) AS empty FROM p
"""

QUERIES = {
    "informal_parents": (informal_parents, INFORMAL_SQL), "full_hierarchy": (full_hierarchy, HIERARCHY_SQL), "match_groups": (match_groups, GROUPS_SQL), "largest_places": (largest_places, LARGEST_SQL), "first_of_key": (first_of_key, FIRST_SQL),
    "dropna_all": (dropna_all, DROPNA_SQL), "wide_table": (wide_table, WIDE_SQL), "long_table": (long_table, LONG_SQL), "transposed_table": (transposed_table, TRANSPOSED_SQL), "nulls_last": (nulls_last, NULLS_SQL), "drawn_rows": (drawn_rows, DRAWN_SQL),
    "number_summary": (number_summary, SUMMARY_SQL), "alignment_counts": (alignment_counts, ALIGNED_SQL), "best_flags": (best_flags, FLAGS_SQL), "top_studies": (top_studies, STUDIES_SQL), "group_means": (group_means, MEANS_SQL),
    "config_names": (config_names, NAMES_SQL), "lehmer_orders": (lehmer_orders, LEHMER_SQL), "split_words": (split_words, SPLIT_SQL), "label_order": (label_order, ORDERED_SQL), "few_shot": (few_shot, SHOTS_SQL), "byte_distances": (byte_distances, BYTES_SQL),
}
