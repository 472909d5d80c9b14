"""Queries that link, clean and parse names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions import text as X
from ..operators import gazetteer as G
from ..operators import link as L
from ..operators.augment import augmented
from ..operators.normalize import status_cube
from .tables import table

#: A deterministic noisy copy of a part's name: as it is, without its third letter, shouted, or with two letters swapped.
NOISY = "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN concat(substring(p_name, 1, 2), substring(p_name, 4, 100)) WHEN 2 THEN concat(upper(p_name), '!') ELSE concat(substring(p_name, 1, 1), 'x', substring(p_name, 2, 100)) END"
CLEAN = "regexp_replace(lower({}), '[^\\w\\s]', '', 'g')"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("name_id"))
    return parts.select("name_id", F.col("name_id").alias("entity_id"), F.col("p_name").alias("name"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.expr(NOISY).alias("text"))


def fuzzy_link_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.link(_asked(spark, sf_dir), _names(spark, sf_dir), threshold=3, topk=2)
    return found.select("query_id", "text", "name", "raw_distance", "clean_distance", "rank")


_LINK = f"""
WITH names AS (SELECT p_name AS name, min(p_partkey) AS entity_id FROM part GROUP BY p_name),
asked AS (SELECT p_partkey AS query_id, {NOISY} AS text FROM part),
texts AS (SELECT DISTINCT text FROM asked),
scored AS (
    SELECT text, name, entity_id, levenshtein(name, text) AS raw_distance, levenshtein({CLEAN.format("name")}, {CLEAN.format("text")}) AS clean_distance
    FROM texts, names
),
near AS (SELECT *, clean_distance = 0 AS exact FROM scored WHERE clean_distance <= 3),
tiered AS (SELECT * FROM near QUALIFY exact = max(exact) OVER (PARTITION BY text)),
ranked AS (
    SELECT *, rank() OVER (PARTITION BY text ORDER BY CASE WHEN raw_distance = 0 THEN 0 WHEN exact THEN 1 ELSE 3 END, raw_distance, clean_distance) AS rank FROM tiered
)
"""
FUZZY_SQL = _LINK + "SELECT query_id, text, name, raw_distance, clean_distance, rank FROM asked JOIN ranked USING (text) WHERE rank <= 2"


#: Words of the documents as names; words of the benchmark, each with its third letter left out or its first two changed over, as queries.
_WORDS = r"[a-z]{5,}"
_NOISY_WORD = "CASE WHEN length(word) % 2 = 0 THEN concat(substring(word, 1, 2), substring(word, 4, 100)) ELSE concat(substring(word, 2, 1), substring(word, 1, 1), substring(word, 3, 100)) END"


def fuzzy_link_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lambda name: table(spark, sf_dir, name).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(_WORDS), F.lit(0))).alias("word")).distinct()
    names = words("documents").select(F.col("word").alias("name_id"), F.col("word").alias("entity_id"), F.col("word").alias("name"))
    asked = words("benchmark").select(F.col("word").alias("query_id"), F.expr(_NOISY_WORD).alias("text"))
    return L.link(asked, names, threshold=2, topk=2).select(F.col("query_id").alias("word"), "text", "name", "raw_distance", "rank")


WORDS_SQL = f"""
WITH names AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{_WORDS}')) AS name FROM documents),
asked AS (SELECT word, {_NOISY_WORD} AS text FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{_WORDS}')) AS word FROM benchmark)),
near AS (SELECT word, text, name, levenshtein(name, text) AS raw_distance FROM asked, names WHERE abs(length(name) - length(text)) <= 2 AND levenshtein(name, text) <= 2),
usable AS (SELECT * FROM near QUALIFY (raw_distance = 0) = max(raw_distance = 0) OVER (PARTITION BY word)),
ranked AS (SELECT *, rank() OVER (PARTITION BY word ORDER BY CASE WHEN raw_distance = 0 THEN 0 ELSE 3 END, raw_distance) AS rank FROM usable)
SELECT word, text, name, raw_distance, rank FROM ranked WHERE rank <= 2
"""


def any_type_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of economical parts first, then of all; the smaller half of a name's parts is preferred."""
    part = table(spark, sf_dir, "part")
    named = lambda df: df.groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("name_id")).select("name_id", F.col("name_id").alias("entity_id"), F.col("p_name").alias("name"), (F.col("name_id") % 2 == 0).alias("preferred"))
    found = L.link(_asked(spark, sf_dir), named(part.where("p_type = 'ECONOMY' AND p_size < 10")), threshold=1, topk=1, any_type=named(part))
    return found.groupBy("text").agg(F.countDistinct("query_id").alias("inputs"), F.min("tier").cast("long").alias("tier"), F.countDistinct("entity_id").alias("entities"), F.min("name").alias("name"))


ANY_TYPE_SQL = f"""
WITH every AS (SELECT p_name AS name, p_brand, min(p_partkey) AS id, false AS typed FROM part GROUP BY 1, 2 UNION ALL SELECT p_name, p_brand, min(p_partkey), true FROM part WHERE p_type = 'ECONOMY' AND p_size < 10 GROUP BY 1, 2),
asked AS (SELECT p_partkey AS query_id, {NOISY} AS text FROM part),
near AS (SELECT text, name, id, typed, levenshtein(name, text) AS raw, levenshtein({CLEAN.format("name")}, {CLEAN.format("text")}) AS d FROM (SELECT DISTINCT text FROM asked), every WHERE levenshtein({CLEAN.format("name")}, {CLEAN.format("text")}) <= 1),
typed AS (SELECT * FROM near QUALIFY typed = max(typed) OVER (PARTITION BY text)),
usable AS (SELECT *, CASE WHEN NOT typed THEN 7 WHEN d = 0 THEN 2 ELSE 6 END AS tier FROM typed QUALIFY (d = 0) = max(d = 0) OVER (PARTITION BY text)),
ranked AS (SELECT *, rank() OVER (PARTITION BY text ORDER BY CASE WHEN raw = 0 THEN 0 WHEN d = 0 THEN 1 ELSE 3 END, raw, d, CASE WHEN id % 2 = 0 THEN 0 ELSE 1 END) AS rank FROM usable)
SELECT text, count(DISTINCT query_id) AS inputs, min(tier)::BIGINT AS tier, count(DISTINCT id) AS entities, min(name) AS name FROM asked JOIN ranked USING (text) WHERE rank = 1 GROUP BY text
"""


def link_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some parts come from a text in which nothing was found, some from none."""
    asked = _asked(spark, sf_dir).withColumn("raw", F.expr("CASE WHEN query_id % 11 = 0 THEN ' ' ELSE concat('(', text, ')') END")).withColumn("text", F.expr("CASE WHEN query_id % 11 = 0 OR query_id % 13 = 0 THEN NULL WHEN query_id % 17 = 0 THEN 'nowhere at all' ELSE text END"))
    return L.status(L.link(asked, _names(spark, sf_dir), threshold=3, topk=1), asked).groupBy("status").agg(F.count("*").alias("cnt"))


STATUS_SQL = _LINK + """,
best AS (SELECT text, count(DISTINCT entity_id) AS n, min(raw_distance) AS raw, min(clean_distance) AS d FROM ranked WHERE rank = 1 GROUP BY text)
SELECT CASE WHEN query_id % 11 = 0 THEN 'NO_ADDRESS' WHEN query_id % 13 = 0 THEN 'UNRESOLVED' WHEN query_id % 17 = 0 OR n IS NULL THEN 'REGEX_NO_MATCH' WHEN n > 1 THEN 'AMBIGUOUS' WHEN raw = 0 THEN 'EXACT_MATCH' WHEN d = 0 THEN 'EXACT_MATCH_CORRECTED' ELSE 'FUZZY_' || d || '_CORRECTED' END AS status, count(*) AS cnt
FROM asked LEFT JOIN best USING (text) GROUP BY 1
"""


def cascade_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with a brand as country; each query hints at the brand of its own part."""
    part = table(spark, sf_dir, "part")
    names = part.groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("name_id")).select("name_id", F.col("name_id").alias("entity_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("country"), (F.col("p_brand") == "Brand#1").alias("reduced"))
    asked = part.select(F.col("p_partkey").alias("query_id"), F.expr(NOISY).alias("text"), F.array("p_brand").alias("hint"))
    found = L.link(asked, names, threshold=2, topk=1)
    return found.groupBy("query_id", "tier").agg(F.count("*").alias("n"), F.min("raw_distance").alias("raw_distance")).select("query_id", F.col("tier").cast("long").alias("tier"), "n", "raw_distance")


CASCADE_SQL = f"""
WITH names AS (SELECT p_name AS name, p_brand AS country, min(p_partkey) AS entity_id FROM part GROUP BY ALL),
asked AS (SELECT p_partkey AS query_id, {NOISY} AS text, p_brand AS hint FROM part),
scored AS (SELECT query_id, name, entity_id, country = hint AS hinted, country = 'Brand#1' AS reduced, levenshtein(name, text) AS raw_distance, levenshtein({CLEAN.format("name")}, {CLEAN.format("text")}) AS d FROM asked, names),
near AS (SELECT * FROM scored WHERE d <= 2),
usable AS (SELECT * FROM near QUALIFY (d = 0) = max(d = 0) OVER (PARTITION BY query_id)),
tiers AS (SELECT *, CASE WHEN d = 0 AND hinted THEN 1 WHEN d = 0 THEN 2 WHEN hinted THEN 4 WHEN reduced THEN 5 ELSE 6 END AS tier FROM usable),
best AS (SELECT * FROM tiers QUALIFY tier = min(tier) OVER (PARTITION BY query_id)),
ranked AS (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY CASE WHEN raw_distance = 0 THEN 0 WHEN d = 0 THEN 1 ELSE 3 END, raw_distance, d) AS rank FROM best)
SELECT query_id, tier::BIGINT AS tier, count(*) AS n, min(raw_distance) AS raw_distance FROM ranked WHERE rank = 1 GROUP BY query_id, tier
"""


def exact_clean_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _asked(spark, sf_dir).withColumn("clean", X.clean_key(F.col("text")))
    names = L.prepared_names(_names(spark, sf_dir))
    return asked.join(names.select("clean", "name"), "clean").select("query_id", "name")


EXACT_SQL = f"SELECT query_id, name FROM (SELECT p_partkey AS query_id, {NOISY} AS text FROM part) JOIN (SELECT DISTINCT p_name AS name FROM part) ON {CLEAN.format('text')} = {CLEAN.format('name')}"


def abbrev_like_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_name").distinct()
    initials = part.select(F.upper(F.concat(F.substring("p_name", 1, 1), F.lit("."), F.substring(F.element_at(F.split("p_name", " "), -1), 1, 1), F.lit("."))).alias("text")).distinct()
    asked = initials.select(F.col("text").alias("query_id"), "text")
    names = part.select(F.col("p_name").alias("name_id"), F.col("p_name").alias("clean"))
    return L.abbreviation_pairs(asked, names).select(F.col("query_id").alias("text"), F.col("name_id").alias("name"))


ABBREV_SQL = """
WITH names AS (SELECT DISTINCT p_name AS name FROM part),
asked AS (SELECT DISTINCT upper(name[1]) || '.' || upper(split_part(name, ' ', -1)[1]) || '.' AS text FROM names)
SELECT text, name FROM asked, names WHERE name LIKE lower(text[1]) || '% ' || lower(text[3]) || '%'
"""


def dedupe_then_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _asked(spark, sf_dir)
    found = L.link(asked, _names(spark, sf_dir), threshold=3, topk=1)
    return found.groupBy("text").agg(F.countDistinct("query_id").alias("inputs"), F.countDistinct("name").alias("names"))


DEDUPE_SQL = _LINK + "SELECT text, count(DISTINCT query_id) AS inputs, count(DISTINCT name) AS names FROM asked JOIN ranked USING (text) WHERE rank = 1 GROUP BY text"


def entity_type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    places = table(spark, sf_dir, "customer").join(F.broadcast(nation), "c_nationkey")  # nations: 25 rows
    code = F.when(F.col("n_regionkey") == 0, "PCLI").when(F.col("n_regionkey") == 1, "ADM1").when(F.col("n_regionkey") == 2, "RGNE").otherwise("PPL")
    typed = places.withColumn("entity_type_map", G.entity_types(F.when(code == "PPL", "P").otherwise("A"), code, F.when(F.col("c_mktsegment") == "BUILDING", "GB").otherwise("DE")))
    counts = [G.of_type(typed, k).agg(F.lit(k).alias("entity_type"), F.count("*").alias("cnt")) for k in G.ENTITY_LEVELS]
    return reduce(DataFrame.union, counts)


TYPES_SQL = """
WITH p AS (SELECT c_custkey, CASE n_regionkey WHEN 0 THEN 'PCLI' WHEN 1 THEN 'ADM1' WHEN 2 THEN 'RGNE' ELSE 'PPL' END AS code, c_mktsegment = 'BUILDING' AS gb FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT 'Country' AS entity_type, count(*) FILTER (code = 'PCLI' OR (code = 'ADM1' AND gb)) AS cnt FROM p
UNION ALL SELECT 'State', count(*) FILTER (code = 'ADM1') FROM p UNION ALL SELECT 'Region', count(*) FILTER (code = 'RGNE') FROM p
UNION ALL SELECT 'District', 0 UNION ALL SELECT 'City', count(*) FILTER (code = 'PPL') FROM p UNION ALL SELECT 'Neighborhood', count(*) FILTER (code = 'PPL') FROM p
"""


def address_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.address_pattern(F.col("text")).alias("pattern"))


PATTERN_SQL = r"""
WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '([\p{L}\p{Nl}\p{No}]+\.?|\p{Nd}+[a-zA-Z]?|[^\p{L}\p{N}_\s\p{Z}]|[\s\p{Z}]+)') AS tokens FROM documents),
k AS (SELECT doc_id, text, list_transform(tokens, lambda x: CASE
    WHEN regexp_matches(x, '^[\s\p{Z}]') THEN ' '
    WHEN regexp_matches(x, '^[\p{Nd}²³¹]') THEN 'NUM'
    WHEN lower(x) IN ('kr.', 'krs.', 'kreis', 'landkreis') THEN 'DIST'
    WHEN lower(x) IN ('reg.', 'bez.', 'regierungsbezirk') THEN 'REGBEZ'
    WHEN lower(x) IN ('i.', 'b.', 'bei', 'a.', 'an', 'am', 'v.', 'im', 'in', 'o.', 'ob', 'n.', 'nr.', 'nähe') THEN 'PREP'
    WHEN lower(x) IN ('straße', 'strasse', 'gasse', 'weg', 'allee', 'platz', 'ring', 'damm', 'chaussee', 'steig', 'stieg', 'pfad', 'trift', 'promenade', 'avenue', 'av.', 'str.') THEN 'STREET'
    WHEN regexp_matches(x, '^[\p{L}\x{80}-\x{10FFFF}]') THEN 'WORD' ELSE x END) AS kinds FROM t)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN trim(regexp_replace(coalesce(array_to_string(kinds, ''), ''), ' {2,}', ' ', 'g')) END AS pattern FROM k
"""


def clean_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.clean_key(F.col("text")).alias("clean"))


CLEAN_SQL = "SELECT doc_id, regexp_replace(lower(strip_accents(nfc_normalize(text))), '[^\\w\\s]', '', 'g') AS clean FROM documents"


def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.concat(F.lit("Here:\n```json"), "props", F.lit("```"))
    return table(spark, sf_dir, "events").select("event_id", X.parsed_object(answer)["k"].alias("k"))


JSON_SQL = "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events"


def conversation_last_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    last = c.groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
    return last.select("conv_id", X.without_thinking(F.concat(F.lit("<think>\nwhy\n</think> "), "text")).alias("reply"))


REPLY_SQL = "SELECT conv_id, trim(arg_max(text, turn)) AS reply FROM conversations WHERE role = 'assistant' GROUP BY conv_id"


def prompt_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples = table(spark, sf_dir, "benchmark").where("item_id < 3")
    lines = examples.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "text"))), lambda x: F.concat(F.lit("Example: "), x["text"])), "\n").alias("examples"))  # one row
    first = table(spark, sf_dir, "conversations").where("turn = 0")
    return first.join(F.broadcast(lines)).select("conv_id", F.concat_ws("\n", "examples", F.concat(F.lit("Address: "), "text")).alias("prompt"))


PROMPT_SQL = "SELECT conv_id, (SELECT string_agg('Example: ' || text, chr(10) ORDER BY item_id) FROM benchmark WHERE item_id < 3) || chr(10) || 'Address: ' || text AS prompt FROM conversations WHERE turn = 0"


def replace_token_augment(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.element_at(F.split("p_name", " "), 1).alias("word"), "p_type")
    pool = part.select("p_type", F.col("word").alias("value")).distinct()
    out = augmented(part, pool, "p_name", "word", "p_type", 2)
    return out.groupBy("is_augmented").agg(F.count("*").alias("cnt"), F.count(F.when(F.col("p_name").startswith(F.col("word")), 1)).alias("fits"))


AUGMENT_SQL = "SELECT false AS is_augmented, count(*) AS cnt, count(*) AS fits FROM part UNION ALL SELECT true, 2 * count(*), 2 * count(*) FROM part"


def format_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From parts of a second to years, with units of 1, and seconds that round up to the next minute."""
    seconds = F.expr("CASE event_id % 4 WHEN 0 THEN event_id * 86413D + user_id WHEN 1 THEN event_id / 10D WHEN 2 THEN 86400D * (1 + event_id % 31) + 59.75D ELSE 31104000D + 2592000D * (event_id % 3) + 0.25D END")
    return table(spark, sf_dir, "events").select("event_id", X.duration(seconds).alias("took"))


DURATION_SQL = """
WITH s AS (SELECT event_id, round_even(CASE event_id % 4 WHEN 0 THEN event_id * 86413.0::DOUBLE + user_id WHEN 1 THEN event_id / 10.0::DOUBLE WHEN 2 THEN 86400.0::DOUBLE * (1 + event_id % 31) + 59.75 ELSE 31104000.0::DOUBLE + 2592000.0::DOUBLE * (event_id % 3) + 0.25 END, 0)::BIGINT AS s FROM events),
p AS (SELECT event_id, s // 86400 // 360 AS y, s // 86400 % 360 // 30 AS m, s // 86400 % 30 AS d, s % 86400 AS r FROM s)
SELECT event_id, concat_ws(', ', CASE WHEN y = 1 THEN '1 year' WHEN y > 1 THEN y || ' years' END, CASE WHEN m = 1 THEN '1 month' WHEN m > 1 THEN m || ' months' END,
    CASE WHEN d = 1 THEN '1 day' WHEN d > 1 THEN d || ' days' END, printf('%d:%02d:%02d', r // 3600, r % 3600 // 60, r % 60)) AS took FROM p
"""


def partial_edit_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of noisy names, and nothing at all, looked for in names."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.expr("CASE WHEN p_size = 7 THEN '' ELSE p_name END").alias("name"), F.expr(f"CASE WHEN p_size = 8 THEN '' ELSE upper(substring({NOISY}, 2, 5)) END").alias("query"))
    distinct = part.select("name", "query").distinct()  # few of many rows
    found = distinct.select("name", "query", S.partial_distance(F.col("name"), F.col("query")).alias("s"))
    return part.join(found, ["name", "query"]).select("p_partkey", "s.*")


PARTIAL_SQL = f"""
WITH p AS (SELECT p_partkey, CASE WHEN p_size = 7 THEN '' ELSE p_name END AS name, CASE WHEN p_size = 8 THEN '' ELSE upper(substring({NOISY}, 2, 5)) END AS query FROM part),
d AS (SELECT DISTINCT name, query FROM p),
w AS (SELECT name, query, e, s, levenshtein(lower(substring(name, s + 1, e - s)), lower(query)) AS cost FROM (SELECT name, query, unnest(range(0, length(name) + 1)) AS e FROM d), range(0, 100) t(s) WHERE s <= e),
ends AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY name, query, e ORDER BY cost, s) = 1),
best AS (SELECT * FROM ends QUALIFY row_number() OVER (PARTITION BY name, query ORDER BY cost, s - e, e) = 1)
SELECT p_partkey, (CASE WHEN name = '' THEN length(query) WHEN query = '' THEN 0 ELSE cost END)::INTEGER AS distance, (CASE WHEN name = '' OR query = '' THEN 0 ELSE s END)::INTEGER AS start,
    (CASE WHEN name = '' OR query = '' THEN 0 ELSE e - 1 END)::INTEGER AS "end" FROM p JOIN best USING (name, query)
"""


def sequence_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(S.sequence_ratio(F.col("p_name"), F.expr(NOISY)), 6).alias("ratio"))


def merge_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that are equal, contained, adjacent, overlapping, apart and reserved."""
    words = F.split("p_name", " ")
    first, last = words[0], F.element_at(words, -1)
    part = lambda label, x: F.struct(F.lit(label).alias("label"), x.alias("part"))
    parts = F.array(
        part("beside", first), part("beside", last), part("same", first), part("same", first), part("inner", F.substring("p_name", 1, 2)), part("inner", first), part("outer", first), part("outer", F.substring("p_name", 2, 1)),
        part("lap", F.substring("p_name", 1, 4)), part("lap", F.substring("p_name", 3, 4)), part("apart", first), part("apart", F.col("p_brand")), part("error", first), part("___x", first), part("fullAddress", last), part("none", F.lit("")),
    )
    distinct = table(spark, sf_dir, "part").select("p_name", "p_brand").distinct()
    merged = distinct.select("p_name", "p_brand", S.merged(F.concat_ws(" x ", "p_name", "p_brand"), parts).alias("m"))
    columns = [F.col("m")[k].alias(k) for k in ("beside", "same", "inner", "outer", "lap", "apart")]
    return merged.select("p_name", "p_brand", *columns, F.col("m")["model-fullAddress"].alias("whole"), F.size("m").cast("long").alias("labels"))


MERGE_SQL = """
SELECT DISTINCT p_name, p_brand, p_name AS beside, split_part(p_name, ' ', 1) AS same, split_part(p_name, ' ', 1) AS inner, split_part(p_name, ' ', 1) AS outer, p_name[1:6] AS lap,
    split_part(p_name, ' ', 1) || '___' || p_brand AS apart, split_part(p_name, ' ', -1) AS whole, 7::BIGINT AS labels FROM part
"""


def find_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that overlap the one before, so that a later place counts, with white space around, and absent ones."""
    part = lambda label, x: F.struct(F.lit(label).alias("label"), x.alias("part"))
    parts = F.array(part("head", F.substring("p_name", 1, 3)), part("letter", F.substring("p_name", 2, 1)), part("last", F.concat(F.lit("  "), F.element_at(F.split("p_name", " "), -1), F.lit("\t"))), part("none", F.lit("§")), part("blank", F.lit(" ")), part("null", F.lit(None).cast("string")))
    distinct = table(spark, sf_dir, "part").select("p_name").distinct()
    found = distinct.select("p_name", F.explode(S.spans(F.col("p_name"), parts)).alias("s"))
    return found.select("p_name", F.col("s.label").alias("label"), F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("stop"))


SPANS_SQL = """
WITH n AS (SELECT DISTINCT p_name, p_name[2] AS letter, split_part(p_name, ' ', -1) AS last FROM part),
l AS (SELECT *, strpos(p_name[4:], letter) + 2 AS pos FROM n),
k AS (SELECT *, [i FOR i IN range(3, length(p_name)) IF p_name[i + 1:i + length(last)] = last AND (pos < 3 OR i + length(last) <= pos OR i > pos)] AS places FROM l)
SELECT p_name, 'head' AS label, 0::BIGINT AS start, 3::BIGINT AS stop FROM n UNION ALL SELECT p_name, 'letter', pos, pos + 1 FROM l WHERE pos >= 3
UNION ALL SELECT p_name, 'last', places[1], places[1] + length(last) FROM k WHERE len(places) > 0
"""


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = status_cube(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")
    return out.select("o_orderstatus", "o_orderpriority", "cnt", F.col("gid").cast("long").alias("gid"))


CUBE_SQL = "SELECT o_orderstatus, o_orderpriority, count(*) AS cnt, grouping_id(o_orderstatus, o_orderpriority)::BIGINT AS gid FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"

QUERIES = {
    "fuzzy_link_topk": (fuzzy_link_topk, FUZZY_SQL), "link_status": (link_status, STATUS_SQL), "fuzzy_link_words": (fuzzy_link_words, WORDS_SQL), "any_type_link": (any_type_link, ANY_TYPE_SQL), "cascade_link": (cascade_link, CASCADE_SQL), "exact_clean_link": (exact_clean_link, EXACT_SQL),
    "abbrev_like_link": (abbrev_like_link, ABBREV_SQL), "dedupe_then_link": (dedupe_then_link, DEDUPE_SQL), "entity_type_filter": (entity_type_filter, TYPES_SQL), "address_pattern": (address_pattern, PATTERN_SQL),
    "clean_keys": (clean_keys, CLEAN_SQL), "json_fields": (json_fields, JSON_SQL), "conversation_last_reply": (conversation_last_reply, REPLY_SQL), "prompt_assembly": (prompt_assembly, PROMPT_SQL),
    "replace_token_augment": (replace_token_augment, AUGMENT_SQL), "format_duration": (format_duration, DURATION_SQL), "partial_edit_span": (partial_edit_span, PARTIAL_SQL), "sequence_ratio": (sequence_ratio, None),
    "merge_parts": (merge_parts, MERGE_SQL), "find_spans": (find_spans, SPANS_SQL), "status_cube": (status_counts, CUBE_SQL),
}
