"""Queries that normalise records, replay and evaluate predictions, and rename labels and countries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import aliases as A
from ..operators import evaluate as E
from ..operators import normalize as N
from ..operators import parse as P
from .analytics import ALL_METRICS, CELLS, EVAL
from .linking import NOISY
from .tables import table

#: Addresses made from nations and regions: complete, without country, unparsable, misspelt, abbreviated, unknown, in small letters, empty.
_ADDRESS = (
    "CASE k % 8 WHEN 0 THEN '' WHEN 1 THEN concat(n_name, ' / ', r_name) WHEN 2 THEN n_name WHEN 3 THEN concat(n_name, ', old (', r_name, ')') "
    "WHEN 4 THEN concat(replace(n_name, 'TI', ''), '/', r_name) WHEN 5 THEN 'Ulm/ME' WHEN 6 THEN concat(n_name, '/ASA') ELSE concat(lower(n_name), ' / ', lower(r_name)) END"
)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf_dir, "customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    address = lambda k: F.expr(_ADDRESS.replace("k %", f"{k} %"))
    none = F.lit(None).cast("string")
    return c.select(
        F.col("c_custkey").cast("string").alias("filename"), address("c_custkey").alias("ApplicantBirthPlace"), address("(c_custkey DIV 8)").alias("ApplicantCurrentAddress"),
        none.alias("VictimBirthPlace"), none.alias("VictimDeathPlace"), none.alias("VictimCurrentAddress"),
    )


def _solved(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(F.lit("r"), "r_regionkey")
    region = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1000).alias("name_id"), F.col("r_name").alias("name"), code.alias("country"), F.lit("Country").alias("kind"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("name_id"), F.col("n_name").alias("name"), F.concat(F.lit("r"), "n_regionkey").alias("country"), F.lit("City").alias("kind"))
    names = region.union(nation).withColumn("entity_id", F.col("name_id"))
    return N.corrected(_records(spark, sf_dir), names)


def normalise_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["city_status", "city_match", "city_corrected", "city_final", "city_edit_distance", "country_status", "country_final", "country_edit_distance", "country_is_abbreviation", "city_in_same_country"]
    return _solved(spark, sf_dir).select("filename", "field", *columns)


_SOLVED = f"""
WITH r AS (SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
raws AS (SELECT c_custkey::VARCHAR AS filename, 'abp' AS field, {_ADDRESS.replace("k %", "c_custkey %")} AS raw FROM r
    UNION ALL SELECT c_custkey::VARCHAR, 'aca', {_ADDRESS.replace("k %", "(c_custkey // 8) %")} FROM r UNION ALL SELECT c_custkey::VARCHAR, unnest(['vbp', 'vdp', 'vca']), '' FROM r),
asked AS (SELECT *, nullif(regexp_extract(raw, '^(\\w+)(\\s*/\\s*(\\w+))?$', 1), '') AS city, nullif(regexp_extract(raw, '^(\\w+)(\\s*/\\s*(\\w+))?$', 3), '') AS country FROM raws),
pairs AS (SELECT DISTINCT country AS text, r_name AS name, 'r' || r_regionkey AS code, levenshtein(r_name, country) AS raw_d, levenshtein(lower(r_name), lower(country)) AS d,
    regexp_matches(country, '^[A-Z]{{1,4}}$') AND lower(r_name) LIKE array_to_string(list_transform(string_split(lower(country), ''), lambda x: x || '%'), ' ') AS abbr FROM asked, region WHERE country IS NOT NULL),
near AS (SELECT * FROM pairs WHERE d <= 3 OR abbr QUALIFY (d = 0) = max(d = 0) OVER (PARTITION BY text)),
ranked AS (SELECT * FROM near QUALIFY rank() OVER (PARTITION BY text ORDER BY CASE WHEN raw_d = 0 THEN 0 WHEN d = 0 THEN 1 WHEN abbr THEN 2 ELSE 3 END, raw_d, d) = 1),
countries AS (SELECT text, count(*) AS n, min(name) AS name, min(code) AS code, min(d) AS d, bool_or(abbr AND d > 0) AS abbr FROM ranked GROUP BY text),
hints AS (SELECT a.*, c.n AS c_n, c.name AS c_name, c.d AS c_d, c.abbr AS c_abbr, CASE WHEN c.n = 1 THEN c.code END AS hint FROM asked a LEFT JOIN countries c ON c.text = a.country),
cpairs AS (SELECT DISTINCT city AS text, hint, n_name AS name, 'r' || n_regionkey AS code, levenshtein(n_name, city) AS raw_d, levenshtein(lower(n_name), lower(city)) AS d FROM hints, nation WHERE city IS NOT NULL),
cnear AS (SELECT *, coalesce(code = hint, false) AS hinted FROM cpairs WHERE d <= 3 QUALIFY (d = 0) = max(d = 0) OVER (PARTITION BY text, hint)),
ctier AS (SELECT * FROM cnear QUALIFY hinted = max(hinted) OVER (PARTITION BY text, hint)),
cranked AS (SELECT * FROM ctier QUALIFY rank() OVER (PARTITION BY text, hint ORDER BY CASE WHEN raw_d = 0 THEN 0 WHEN d = 0 THEN 1 ELSE 3 END, raw_d, d) = 1),
cities AS (SELECT text, hint, count(*) AS n, min(name) AS name, min(code) AS code, min(d) AS d FROM cranked GROUP BY ALL),
solved AS (SELECT filename, field, raw,
    CASE WHEN t.n = 1 AND city = t.name THEN 'EXACT_MATCH' WHEN t.n = 1 AND t.d = 0 THEN 'EXACT_MATCH_CORRECTED' WHEN t.n = 1 THEN 'FUZZY_' || t.d || '_CORRECTED' WHEN t.n > 1 THEN 'AMBIGUOUS' WHEN raw = '' THEN 'NO_ADDRESS' WHEN city IS NULL THEN 'UNRESOLVED' ELSE 'REGEX_NO_MATCH' END AS city_status,
    CASE WHEN t.n = 1 THEN city END AS city_match, CASE WHEN t.n = 1 AND city <> t.name THEN t.name END AS city_corrected, CASE WHEN t.n = 1 THEN t.name END AS city_final, CASE WHEN t.n = 1 THEN t.d END AS city_edit_distance,
    CASE WHEN c_n = 1 AND country = c_name THEN 'EXACT_MATCH' WHEN c_n = 1 AND c_d = 0 THEN 'EXACT_MATCH_CORRECTED' WHEN c_n = 1 AND c_abbr THEN 'ABBREVIATION_MATCH_CORRECTED' WHEN c_n = 1 THEN 'FUZZY_' || c_d || '_CORRECTED' WHEN c_n > 1 THEN 'AMBIGUOUS' WHEN raw = '' THEN 'NO_ADDRESS' WHEN country IS NULL THEN 'UNRESOLVED' ELSE 'REGEX_NO_MATCH' END AS country_status,
    CASE WHEN c_n = 1 THEN c_name END AS country_final, CASE WHEN c_n = 1 THEN c_d END AS country_edit_distance, CASE WHEN c_n = 1 THEN c_abbr END AS country_is_abbreviation,
    CASE WHEN h.hint IS NOT NULL AND t.n = 1 THEN t.code = h.hint END AS city_in_same_country
    FROM hints h LEFT JOIN cities t ON t.text = h.city AND t.hint IS NOT DISTINCT FROM h.hint)
"""
NORMALISE_SQL = _SOLVED + "SELECT * EXCLUDE (raw) FROM solved"


def status_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.status_ratios(N.long_statuses(_solved(spark, sf_dir)))


RATIOS_SQL = _SOLVED + """,
l AS (SELECT field, 'City' AS entity_type, raw, city_status AS status, city_final AS final FROM solved UNION ALL SELECT field, 'Country', raw, country_status, country_final FROM solved),
t AS (SELECT coalesce(field, 'TOTAL') AS field, coalesce(entity_type, 'TOTAL') AS entity_type, count(*) AS n, count(*) FILTER (raw <> '') AS a, count(final) AS f FROM l GROUP BY CUBE (field, entity_type)),
s AS (SELECT coalesce(field, 'TOTAL') AS field, coalesce(entity_type, 'TOTAL') AS entity_type, status, count(*) AS cnt FROM l GROUP BY GROUPING SETS ((field, entity_type, status), (field, status), (entity_type, status), (status))),
p AS (SELECT field, entity_type, status, cnt, CASE WHEN status = 'NO_ADDRESS' THEN n ELSE a END AS whole FROM s JOIN t USING (field, entity_type)
    UNION ALL SELECT field, entity_type, 'input_fields_with_address', a, n FROM t UNION ALL SELECT field, entity_type, 'final_count', f, a FROM t)
SELECT field, entity_type, status, cnt, CASE WHEN whole > 0 THEN printf('%.1f%%', round_even(100 * cnt / whole, 1)) ELSE 'N/A' END AS share FROM p UNION ALL SELECT field, entity_type, 'input_rows', n, '—' FROM t
"""


def label_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by a parser's labels, two of which stand for one field."""
    part = table(spark, sf_dir, "part").select("p_name", "p_brand", "p_type").distinct()
    words = F.split("p_name", " ")
    text = F.concat_ws(", ", "p_name", "p_brand", "p_type")
    named = lambda label, x: F.struct(F.lit(label).alias("label"), x.alias("part"))
    found = P.fields_of(text, F.array(named("Country", words[0]), named("CountryCode", F.element_at(words, -1)), named("Municipality", F.col("p_brand")), named("Odd", F.col("p_type")), named("StreetNumber", F.lit(""))), P.TOKEN_LABELS)
    return part.select("p_name", "p_brand", "p_type", found["Country"].alias("country"), found["City"].alias("city"), found["Odd"].alias("odd"), F.size(found).cast("long").alias("fields"))


LABEL_SQL = "SELECT DISTINCT p_name, p_brand, p_type, p_name AS country, p_brand AS city, p_type AS odd, 3::BIGINT AS fields FROM part"


def resolved_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered tags with begin and inside marks as labels."""
    tags = {"LABEL_0": "B-Country", "LABEL_1": "B-CountryCode", "LABEL_2": "I-Municipality", "LABEL_3": "B-StreetNumber"}
    tag = F.concat(F.lit("LABEL_"), (F.col("event_id") % 6).cast("string"))
    return table(spark, sf_dir, "events").select(X.resolved_label(tag, tags, P.TOKEN_LABELS).alias("label")).groupBy("label").agg(F.count("*").alias("cnt"))


TAGS_SQL = "SELECT CASE event_id % 6 WHEN 0 THEN 'Country' WHEN 1 THEN 'Country' WHEN 2 THEN 'City' WHEN 3 THEN 'HouseNumber' ELSE 'LABEL_' || (event_id % 6) END AS label, count(*) AS cnt FROM events GROUP BY 1"

_COUNTRY = "CASE {k} % 9 WHEN 0 THEN 'polen' WHEN 1 THEN 'USA' WHEN 2 THEN 'öst.' WHEN 3 THEN 'ČSSR' WHEN 4 THEN 'Atlantis' WHEN 5 THEN NULL WHEN 6 THEN 'deutsche demokratische republik' WHEN 7 THEN 'POLAND' ELSE 'it.' END"


def country_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_COUNTRY.format(k="c_custkey")).alias("country"))
    return A.country_codes(c, "country").select("c_custkey", "country", "country_code")


COUNTRY_SQL = f"SELECT * FROM (SELECT c_custkey, {_COUNTRY.format(k='c_custkey')} AS country, CASE c_custkey % 9 WHEN 0 THEN 'PL' WHEN 1 THEN 'US' WHEN 2 THEN 'AT' WHEN 3 THEN 'CZ' WHEN 6 THEN 'DE' WHEN 7 THEN 'PL' WHEN 8 THEN 'IT' END AS country_code FROM customer) WHERE country_code IS NOT NULL"


def normalised_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.expr(_COUNTRY.format(k="c_custkey")).alias("country"))
    return A.normalised(c, "country", {"Polen": "Poland", "U.S.A.": "USA"}, "name").groupBy("name").agg(F.count("*").alias("cnt"))


VALUES_SQL = f"SELECT CASE WHEN c IS NULL THEN 'No Country' WHEN lower(c) IN ('polen', 'poland') THEN 'Poland' WHEN lower(c) = 'usa' THEN 'USA' ELSE c END AS name, count(*) AS cnt FROM (SELECT {_COUNTRY.format(k='c_custkey')} AS c FROM customer) GROUP BY 1"


# predictions


def replay_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored conversations whose last message holds a JSON block, loose lines, or nothing that can be read, after some thinking."""
    e = table(spark, sf_dir, "events")
    block = F.concat(F.lit("Sure.\n```json {\"k\": \""), F.get_json_object("props", "$.k"), F.lit("\", \"City\": \"\"}```"))
    loose = F.concat(F.lit("\"k\" : \""), F.get_json_object("props", "$.k"), F.lit("\"\n\"City\": \"Ulm\",\nso"))
    reply = F.when(F.col("event_id") % 3 == 0, block).when(F.col("event_id") % 3 == 1, loose).otherwise("no idea")
    messages = F.array(F.struct(F.lit("user").alias("role"), F.lit("Parse!").alias("content")), F.struct(F.lit("assistant").alias("role"), F.concat(F.lit("<think>\"k\": \"0\"\n</think>"), reply).alias("content")))
    stored = e.select("event_id", F.concat(F.lit("at "), F.get_json_object("props", "$.k")).alias("address"), F.to_json(messages).alias("conversation"))
    found = P.replayed(stored, "address", "conversation")
    return found.select("event_id", F.col("prediction")["k"].alias("k"), F.col("prediction")["City"].alias("city"), F.size("prediction").cast("long").alias("fields"))


REPLAY_SQL = """
SELECT event_id, CASE WHEN event_id % 3 < 2 THEN json_extract_string(props, '$.k') END AS k, CASE WHEN event_id % 3 = 1 THEN 'Ulm' END AS city, (CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END)::BIGINT AS fields FROM events
"""


def replay_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as lists of [part, label], of which Other goes, behind an assistant's mark."""
    o = table(spark, sf_dir, "orders")
    pairs = F.concat(F.lit("x<|assistant|>y<|assistant|>```json[[\""), "o_orderstatus", F.lit("\", \"State\"], [\""), "o_orderpriority", F.lit("\", \"Other\"], [\"#"), F.col("o_custkey").cast("string"), F.lit("\", \"HouseNumber\"]]```"))
    stored = o.select("o_orderkey", F.concat_ws(" ", "o_orderstatus", "o_orderpriority", "o_custkey").alias("address"), pairs.alias("answer"))
    found = P.replayed(stored, "address", "answer", as_pairs=True, marker="<|assistant|>")
    return found.select("o_orderkey", F.col("prediction")["State"].alias("state"), F.col("prediction")["HouseNumber"].alias("number"), F.size("prediction").cast("long").alias("fields"))


PAIRS_SQL = "SELECT o_orderkey, o_orderstatus AS state, '#' || o_custkey AS number, 2::BIGINT AS fields FROM orders"


class _Split:
    """A parser for the query below: two words are City and StreetName, and one text is too much for it."""

    def parse_addresses(self, texts: list[str]) -> list[dict]:
        if any(t == "large ring" for t in texts):
            raise ValueError("no rings")
        return [dict(zip(("City", "StreetName"), t.split(" "), strict=False)) for t in texts]


def parsed_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names through a parser in batches; a batch that fails has one wrong text."""
    found = P.parsed(table(spark, sf_dir, "part"), "p_partkey", "p_name", _Split)
    return found.select("p_partkey", F.col("prediction")["City"].alias("city"), F.col("prediction")["StreetName"].alias("street"), "error")


PARSED_SQL = """
SELECT p_partkey, CASE WHEN p_name <> 'large ring' THEN split_part(p_name, ' ', 1) END AS city, CASE WHEN p_name <> 'large ring' THEN split_part(p_name, ' ', 2) END AS street,
    CASE WHEN p_name = 'large ring' THEN 'ValueError: no rings' END AS error FROM part
"""


def _predictions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two configurations' predictions as maps, and labels: name, brand and type, of which no type is predicted, and something else is."""
    part = table(spark, sf_dir, "part")
    labels = part.select("p_partkey", F.col("p_name").alias("name"), F.when(F.col("p_size") > 10, F.col("p_brand")).alias("brand"), F.col("p_type").alias("type"))
    good = F.map_filter(F.create_map(F.lit("name"), F.expr(NOISY), F.lit("brand"), F.when(F.col("p_size") > 5, F.col("p_brand")), F.lit("extra"), F.when(F.col("p_size") > 40, F.lit("what"))), lambda k, v: v.isNotNull())
    poor = F.map_filter(F.create_map(F.lit("name"), F.when(F.col("p_size") % 9 != 0, F.upper("p_name"))), lambda k, v: v.isNotNull())
    error = F.when(F.col("p_size") % 9 == 0, "failed")
    predictions = part.select(F.lit("good").alias("config_name"), "p_partkey", good.alias("prediction"), F.lit(None).cast("string").alias("error"), "p_brand")
    return predictions.union(part.select(F.lit("poor"), "p_partkey", poor, error, "p_brand")), labels


_CONFIG_CELLS = f"""SELECT 'good' AS config_name, p_brand, * FROM ({CELLS.replace("SELECT p_partkey", "SELECT p_brand, p_size, p_partkey")})
    UNION ALL SELECT 'poor', p_brand, p_brand, p_size, p_partkey, 'name', CASE WHEN p_size % 9 <> 0 THEN upper(p_name) END, p_name, true FROM part
    UNION ALL SELECT 'poor', p_brand, p_brand, p_size, p_partkey, 'brand', NULL, CASE WHEN p_size > 10 THEN p_brand END, false FROM part
    UNION ALL SELECT 'poor', p_brand, p_brand, p_size, p_partkey, 'type', NULL, p_type, false FROM part"""
_FIELDS = ["name", "brand", "type"]


def _round(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in E.METRICS or c in more else F.col(c) for c in df.columns])


def config_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of configurations, of which one has no predictions."""
    predictions, labels = _predictions(spark, sf_dir)
    configs = spark.createDataFrame([("good", 20.0), ("poor", 50.0), ("broken", None)], "config_name string, deltatime double")
    out = E.config_metrics(configs, predictions, labels, "p_partkey", _FIELDS, 4_394_539)
    return _round(out, "rate", "estimated_total_time", "error_rate")


CONFIG_SQL = EVAL.format(cells=_CONFIG_CELLS, by="config_name, ", group="GROUP BY config_name") + f""",
k AS (SELECT * FROM (VALUES ('good', 20.0::DOUBLE), ('poor', 50.0::DOUBLE), ('broken', NULL)) t(config_name, deltatime)), p AS (SELECT count(*) AS rows, count(*) FILTER (p_size % 9 = 0) AS bad FROM part)
SELECT config_name, n, {ALL_METRICS}, deltatime, round(CASE WHEN n IS NOT NULL THEN rows / deltatime END, 6) AS rate, round(CASE WHEN n IS NOT NULL THEN 4394539 / (rows / deltatime) END, 6) AS estimated_total_time,
    CASE config_name WHEN 'good' THEN 0 WHEN 'poor' THEN bad ELSE rows END AS error, round(CASE config_name WHEN 'good' THEN 0.0 WHEN 'poor' THEN bad / rows ELSE 1.0 END, 6) AS error_rate
FROM k LEFT JOIN m USING (config_name), p
"""


def _config_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    predictions, labels = _predictions(spark, sf_dir)
    brands = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return E.map_cells(predictions, labels, "p_partkey", _FIELDS, ["config_name"]).join(brands, "p_partkey")


def eval_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass for metrics by configuration, by configuration and field, and by configuration and brand."""
    sets = [["config_name"], ["config_name", "field"], ["config_name", "p_brand"]]
    return _round(E.micro_metrics(_config_cells(spark, sf_dir), "config_name", "field", "p_brand", sets=sets))


SETS_SQL = EVAL.format(cells=_CONFIG_CELLS, by="config_name, field, p_brand, ", group="GROUP BY GROUPING SETS ((config_name), (config_name, field), (config_name, p_brand))") + f"SELECT config_name, field, p_brand, n, {ALL_METRICS} FROM m"


def eval_other_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was predicted for fields that do not exist counts as wrong predictions."""
    predictions, labels = _predictions(spark, sf_dir)
    good = predictions.where("config_name = 'good'")
    return _round(E.micro_metrics(E.map_cells(good, labels, "p_partkey", _FIELDS, ignore_other_fields=False)))


OTHER_FIELDS_SQL = EVAL.format(cells=f"{CELLS} UNION ALL SELECT p_partkey, 'extra', 'what', NULL, false FROM part WHERE p_size > 40", by="", group="") + f"SELECT n, {ALL_METRICS} FROM m"


def subset_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    subsets = {"required": ["name", "brand"], "name": ["name"], "all": _FIELDS}
    return _round(E.subset_metrics(_config_cells(spark, sf_dir), subsets, "config_name"))


SUBSET_SQL = (
    EVAL.format(cells=f"SELECT * FROM ({_CONFIG_CELLS}) JOIN (VALUES ('required', 'name'), ('required', 'brand'), ('name', 'name'), ('all', 'name'), ('all', 'brand'), ('all', 'type')) t(subset, f) ON field = f", by="config_name, subset, ", group="GROUP BY config_name, subset")
    + f"SELECT config_name, subset, n, {ALL_METRICS} FROM m"
)


def fold_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation over folds, of all cells, by field, and by kind of record."""
    cells = _config_cells(spark, sf_dir).withColumn("fold_idx", F.col("p_partkey") % 5).withColumnRenamed("config_name", "model")
    out = E.fold_metrics(cells.withColumn("kind", F.when(F.col("p_brand") == "Brand#1", "first")), part="kind").where("metric in ('accuracy', 'f1', 'average_levenshtein')")
    return out.select("model", "part", "metric", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


FOLD_EVAL_SQL = (
    EVAL.format(
        cells=f"SELECT config_name AS model, p_partkey % 5 AS fold, unnest(['all', 'entity:' || field, CASE WHEN p_brand = 'Brand#1' THEN 'field:first' END]) AS part, * FROM ({_CONFIG_CELLS})",
        by="model, fold, part, ", group="WHERE part IS NOT NULL GROUP BY model, fold, part",
    )
    + "SELECT model, part, metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM (SELECT model, part, unnest(['accuracy', 'f1', 'average_levenshtein']) AS metric, unnest([accuracy, f1, average_levenshtein]) AS value FROM m) GROUP BY ALL"
)

QUERIES = {
    "normalise_records": (normalise_records, NORMALISE_SQL), "status_ratios": (status_ratios, RATIOS_SQL), "label_rename": (label_rename, LABEL_SQL), "resolved_tags": (resolved_tags, TAGS_SQL),
    "country_alias": (country_alias, COUNTRY_SQL), "normalised_values": (normalised_values, VALUES_SQL), "replay_predictions": (replay_predictions, REPLAY_SQL), "replay_pairs": (replay_pairs, PAIRS_SQL),
    "parsed_addresses": (parsed_addresses, PARSED_SQL), "config_eval": (config_eval, CONFIG_SQL), "eval_grouping_sets": (eval_grouping_sets, SETS_SQL), "eval_other_fields": (eval_other_fields, OTHER_FIELDS_SQL),
    "subset_eval": (subset_eval, SUBSET_SQL), "fold_eval": (fold_eval, FOLD_EVAL_SQL),
}
