"""Queries for plain table work, and for sources and sinks: tables written to the shared folder in some format come back the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompts, spans
from ..functions import text as X
from ..operators import candidates as C
from ..operators import inspect as I
from ..operators import parse as P
from ..sources import readers as R
from ..sources.shared import shared_folder
from .linking import NOISY
from .tables import table


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def other_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns but some, in another order."""
    left = table(spark, sf_dir, "supplier").drop("s_acctbal")
    return left.select("s_name", *[c for c in left.columns if c != "s_name"])


OTHER_SQL = "SELECT * EXCLUDE (s_acctbal) FROM supplier"


def masked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks by comparison, membership and part of a text, and a count for each of their combinations."""
    p = table(spark, sf_dir, "part")
    masks = [(F.col("p_size") > 25).alias("big"), F.col("p_type").isin("ECONOMY", "SMALL").alias("plain"), F.col("p_name").contains("ring").alias("ring")]
    return p.select(*masks).groupBy("big", "plain", "ring").agg(F.count("*").alias("cnt"))


MASKS_SQL = "SELECT p_size > 25 AS big, p_type IN ('ECONOMY', 'SMALL') AS plain, contains(p_name, 'ring') AS ring, count(*) AS cnt FROM part GROUP BY ALL"


def aligned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables by an explicit row id, and whether their texts agree in any case."""
    p = table(spark, sf_dir, "part")
    label = p.select("p_partkey", F.expr("CASE WHEN p_size % 5 > 0 THEN p_name END").alias("label"))
    pred = p.select("p_partkey", F.expr(f"CASE WHEN p_size % 7 > 0 THEN rtrim('!', {NOISY}) END").alias("pred"))
    return label.join(pred, "p_partkey").withColumn("same", I.same_ignoring_case(F.col("label"), F.col("pred")))


ALIGNED_SQL = f"WITH x AS (SELECT p_partkey, CASE WHEN p_size % 5 > 0 THEN p_name END AS label, CASE WHEN p_size % 7 > 0 THEN rtrim({NOISY}, '!') END AS pred FROM part) SELECT *, lower(label) IS NOT DISTINCT FROM lower(pred) AS same FROM x"


def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority").distinct()


DISTINCT_SQL = "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders"


def tagged_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables put under each other with the name of their part, and the training rows of a fold."""
    s = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("split"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("split"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    train, _ = I.split_fold(s.unionByName(c).withColumn("fold_idx", F.col("key") % 4), 2)
    return train


UNION_SQL = "SELECT *, key % 4 AS fold_idx FROM (SELECT 'supplier' AS split, s_suppkey AS key, s_name AS name FROM supplier UNION ALL SELECT 'customer', c_custkey, c_name FROM customer) WHERE key % 4 <> 2"


def level_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity types of nations compared with those of the nation before."""
    kind = "CASE n_nationkey % 7 WHEN 0 THEN 'Country' WHEN 1 THEN 'State' WHEN 2 THEN 'Region' WHEN 3 THEN 'District' WHEN 4 THEN 'City' WHEN 5 THEN 'Neighborhood' ELSE 'Planet' END"
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.expr(kind).alias("a"), F.expr(kind.replace("n_nationkey", "(n_nationkey DIV 3)")).alias("b"))
    return n.withColumn("relation", C.level_relation(F.col("a"), F.col("b")))


RELATIONS_SQL = """
WITH k AS (SELECT n_nationkey, n_nationkey % 7 AS x, n_nationkey // 3 % 7 AS y, ['Country', 'State', 'Region', 'District', 'City', 'Neighborhood', 'Planet'] AS names, [0, 1, 1, 2, 3, 4, NULL] AS levels FROM nation)
SELECT n_nationkey, names[x + 1] AS a, names[y + 1] AS b, CASE WHEN x = y AND x < 6 THEN 'same' WHEN levels[x + 1] > levels[y + 1] THEN 'below' WHEN levels[x + 1] < levels[y + 1] THEN 'above' END AS relation FROM k
"""


def cities_and_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("CASE n_nationkey % 5 WHEN 0 THEN concat('Köln', n_nationkey, ' /Österreich') WHEN 1 THEN n_name WHEN 2 THEN 'a / b / c' WHEN 3 THEN concat(n_name, ', x') ELSE concat(n_name, '/') END")
    city, country = X.city_and_country(raw)
    return table(spark, sf_dir, "nation").select("n_nationkey", city.alias("city"), country.alias("country"))


CITIES_SQL = "SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'Köln' || n_nationkey WHEN 1 THEN n_name END AS city, CASE WHEN n_nationkey % 5 = 0 THEN 'Österreich' END AS country FROM nation"


def strict_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of known start: adjacent ones merge, of others the first stays."""
    p = table(spark, sf_dir, "part").select("p_name", "p_brand").distinct()
    first, last = F.split("p_name", " ")[0], F.element_at(F.split("p_name", " "), -1)
    part = lambda label, x, start: F.struct(F.lit(label).alias("label"), x.alias("part"), start.cast("int").alias("start"))
    after = F.char_length("p_name") - F.char_length(last)
    parts = F.array(part("near", last, after), part("near", first, F.lit(0)), part("far", first, F.lit(0)), part("far", F.col("p_brand"), F.char_length("p_name") + 3))
    merged = spans.strictly_merged(F.concat_ws(" x ", "p_name", "p_brand"), parts)
    return p.select("p_name", "p_brand", merged["near"].alias("near"), merged["far"].alias("far"))


STRICT_SQL = "SELECT DISTINCT p_name, p_brand, p_name AS near, split_part(p_name, ' ', 1) AS far FROM part"


def prompt_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts from sections, one of which is missing at times."""
    items = F.array(F.concat(F.lit("in "), "r_name"), F.lit("short"))
    sections = {"Role": F.lit("clerk"), "Task": F.expr("CASE WHEN n_nationkey % 3 > 0 THEN concat('find ', n_name) END"), "Hints": prompts.item_list(items)}
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return places.select("n_nationkey", prompts.prompt(sections, ["Task", "Hints", "Role"]).alias("plain"), prompts.prompt(sections, ["Role", "Task"], markdown=True).alias("marked"))


SECTIONS_SQL = """
SELECT n_nationkey, concat_ws(chr(10), CASE WHEN n_nationkey % 3 > 0 THEN 'Task: find ' || n_name END, 'Hints: - in ' || r_name || chr(10) || '- short', 'Role: clerk') AS plain,
    concat_ws(chr(10) || chr(10), '## Role' || chr(10) || 'clerk', CASE WHEN n_nationkey % 3 > 0 THEN '## Task' || chr(10) || 'find ' || n_name END) AS marked FROM nation JOIN region ON n_regionkey = r_regionkey
"""


def few_shot_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with an example or two, or none, as objects and as pairs."""
    n = F.col("n_nationkey")
    shot = lambda address, labels: F.struct(address.alias("address"), labels.alias("labels"))
    one = shot(F.concat(F.lit("in "), "n_name"), F.create_map(F.lit("City"), F.col("n_name"), F.lit("Note"), F.lit('a "b"')))
    two = shot(F.lit("Ulm"), F.create_map(F.lit("City"), F.lit("Ulm"), F.lit("Note"), F.lit("ä")))
    examples = F.slice(F.array(one, two), 1, (n % 3).cast("int"))
    template = "100%% of fields.\n%(examples)sAddress: %(address)s"
    made = [prompts.few_shot_prompt(template, F.lower("n_name"), examples, as_pairs=pairs).alias(name) for name, pairs in (("objects", False), ("pairs", True))]
    return table(spark, sf_dir, "nation").select("n_nationkey", *made)


SHOTS_SQL = r"""
WITH e AS (SELECT *, 'Consider the following examples:' || chr(10) AS p, chr(10) AS nl FROM nation)
SELECT n_nationkey, '100% of fields.' || nl || CASE WHEN n_nationkey % 3 > 0 THEN p || 'Address: in ' || n_name || nl || '```json{"City": "' || n_name || '", "Note": "a \"b\""}```' || nl ELSE '' END
    || CASE WHEN n_nationkey % 3 = 2 THEN 'Address: Ulm' || nl || '```json{"City": "Ulm", "Note": "ä"}```' || nl ELSE '' END || 'Address: ' || lower(n_name) AS objects,
    '100% of fields.' || nl || CASE WHEN n_nationkey % 3 > 0 THEN p || 'Address: in ' || n_name || nl || '```json[["' || n_name || '", "City"], ["a \"b\"", "Note"]]```' || nl ELSE '' END
    || CASE WHEN n_nationkey % 3 = 2 THEN 'Address: Ulm' || nl || '```json[["Ulm", "City"], ["ä", "Note"]]```' || nl ELSE '' END || 'Address: ' || lower(n_name) AS pairs FROM e
"""


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    stored = c.groupBy("conv_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))).alias("conversation"))
    return I.turns(stored, "conv_id", "conversation").withColumn("turn", F.col("turn").cast("long"))


TURNS_SQL = "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, text AS content FROM conversations"


# sources and sinks


def tsv_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with tabs and stray quotes, zipped by gzip, and with comments between."""
    path = _folder(spark, "tsv")
    c = table(spark, sf_dir, "customer").select(F.concat_ws("\t", "c_custkey", F.concat(F.lit('"'), F.col("c_name")), "c_mktsegment").alias("value"))
    c.union(spark.createDataFrame([("  # none\tat all\t1",), ("",)], "value string")).write.option("compression", "gzip").text(path)
    return R.tsv_without_comments(spark, path, "c_custkey bigint, c_name string, c_mktsegment string")


TSV_SQL = "SELECT c_custkey, '\"' || c_name AS c_name, c_mktsegment FROM customer"


def csv_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All strings, with nulls, commas, quotes and leading zeros."""
    path = _folder(spark, "csv")
    odd = table(spark, sf_dir, "part").select(F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("key"), F.expr("CASE WHEN p_size % 4 > 0 THEN concat('a, \"', p_name, '\"') END").alias("name"))
    odd.write.option("header", True).option("escape", '"').option("nullValue", "").csv(path)
    return R.labelled_csv(spark, path, ["key", "name"])


CSV_SQL = "SELECT lpad(p_partkey::VARCHAR, 9, '0') AS key, CASE WHEN p_size % 4 > 0 THEN 'a, \"' || p_name || '\"' END AS name FROM part"


def json_lines_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows appended in two goes, in a folder for each field."""
    path = _folder(spark, "json")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.col("p_type").alias("field"))
    for half in (0, 1):
        R.append_by_field(p.where(F.col("p_partkey") % 2 == half), path)
    return R.records(spark, path, "p_partkey bigint, p_name string, field string")


JSON_SQL = "SELECT p_partkey, p_name, p_type AS field FROM part"


def prediction_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of two configurations stored apart, one of them replaced; a table that is there is not made again."""
    path = _folder(spark, "predictions")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    for config, noisy in (("a", False), ("b", False), ("b", True)):
        R.store_by_config(p.select(F.lit(config).alias("config_name"), "p_partkey", (F.upper("p_name") if noisy else F.col("p_name")).alias("name")), path)
    again = R.cached(lambda: p, spark, path)
    return R.by_config(spark, path, ["b"]).select("config_name", "p_partkey", "name").unionByName(again.where("config_name = 'a'").select("config_name", "p_partkey", "name"))


CACHE_SQL = "SELECT 'a' AS config_name, p_partkey, p_name AS name FROM part UNION ALL SELECT 'b', p_partkey, upper(p_name) FROM part"


def prediction_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON array of objects with free keys, its order kept."""
    path = _folder(spark, "array")
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.map_filter(F.create_map(F.lit("City"), F.col("n_name"), F.lit("No"), F.expr("CASE WHEN n_nationkey % 2 = 0 THEN string(n_nationkey) END")), lambda k, v: v.isNotNull()).alias("m"))
    n.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", F.to_json("m").alias("j")))), lambda x: F.from_json(x["j"], "map<string,string>"))).alias("value")).coalesce(1).write.text(path)  # 25 rows
    return R.predictions(spark, path).select(F.col("row").cast("long").alias("row"), F.col("prediction")["City"].alias("city"), F.col("prediction")["No"].alias("number"))


FILE_SQL = "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS row, n_name AS city, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey::VARCHAR END AS number FROM nation"


def linked_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements about suppliers: a type, a link into a gazetteer that some have wrong, names of two kinds."""
    path = _folder(spark, "triples")
    s = table(spark, sf_dir, "supplier")
    uri = F.concat(F.lit("<u:"), F.col("s_suppkey").cast("string"), F.lit("> "))
    line = lambda *parts: F.concat(uri, *[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit(" ."))
    key = F.col("s_suppkey")
    host = F.when(key % 5 == 0, "<https://other.example/").otherwise("<https://places.example/")
    number = F.when(key % 3 == 0, "none").otherwise((key * 2).cast("string"))
    lines = [
        s.select(line("<http://x/type> ", F.when(key % 7 == 0, "<u:Person>").otherwise("<u:Place>")).alias("value")), s.select(line("<http://x/sameAs> ", host, number, "/a.html>").alias("value")),
        s.select(line("<http://x/name> \"", F.col("s_name"), "\"@de").alias("value")), s.select(line("<http://x/note> \"none\"").alias("value")),
    ]
    lines[0].union(lines[1]).union(lines[2]).union(lines[3]).write.text(path)
    found = R.linked_names(R.triples(spark, path), "u:Place", "https://places.example/", ["http://x/name"])
    return found.select("uri", F.col("entity_id").cast("long").alias("entity_id"), "name", "property")


TRIPLES_SQL = "SELECT 'u:' || s_suppkey AS uri, s_suppkey * 2 AS entity_id, s_name AS name, 'http://x/name' AS property FROM supplier WHERE s_suppkey % 7 > 0 AND s_suppkey % 5 > 0 AND s_suppkey % 3 > 0"


def kept_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of labels without those that are not asked for and empty ones."""
    m = F.create_map(F.lit("City"), F.expr("CASE WHEN p_size % 2 = 0 THEN '' ELSE p_name END"), F.lit("State"), F.col("p_type"), F.lit("Odd"), F.col("p_brand"))
    kept = P.kept_fields(m, ["City", "State"])
    return table(spark, sf_dir, "part").select("p_partkey", kept["City"].alias("city"), kept["State"].alias("state"), F.size(kept).cast("long").alias("labels"))


KEPT_SQL = "SELECT p_partkey, CASE WHEN p_size % 2 > 0 THEN p_name END AS city, p_type AS state, (CASE WHEN p_size % 2 > 0 THEN 2 ELSE 1 END)::BIGINT AS labels FROM part"


def config_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = sorted(r[0] for r in table(spark, sf_dir, "region").select("r_name").collect())  # 5 rows
    return I.config_grid(spark, {"model": kinds, "prompt": ["p1", "p2"], "strategy": ["fixed", "similar", "pattern"]}, "%(model)s-%(prompt)s-%(strategy)s")


GRID_SQL = "SELECT r_name || '-' || prompt || '-' || strategy AS config_name, r_name AS model, prompt, strategy FROM region, (VALUES ('p1'), ('p2')) p(prompt), (VALUES ('fixed'), ('similar'), ('pattern')) s(strategy)"

QUERIES = {
    "other_columns": (other_columns, OTHER_SQL), "masked_rows": (masked_rows, MASKS_SQL), "aligned_rows": (aligned_rows, ALIGNED_SQL), "distinct_values": (distinct_values, DISTINCT_SQL), "tagged_union": (tagged_union, UNION_SQL),
    "level_relations": (level_relations, RELATIONS_SQL), "cities_and_countries": (cities_and_countries, CITIES_SQL), "strict_merge": (strict_merge, STRICT_SQL), "prompt_sections": (prompt_sections, SECTIONS_SQL),
    "conversation_turns": (conversation_turns, TURNS_SQL), "few_shot_prompts": (few_shot_prompts, SHOTS_SQL), "tsv_source": (tsv_source, TSV_SQL), "csv_source": (csv_source, CSV_SQL), "json_lines_by_field": (json_lines_by_field, JSON_SQL),
    "prediction_cache": (prediction_cache, CACHE_SQL), "prediction_file": (prediction_file, FILE_SQL), "linked_triples": (linked_triples, TRIPLES_SQL), "kept_labels": (kept_labels, KEPT_SQL), "config_grid": (config_grid, GRID_SQL),
}
