"""Gazetteer tables: names, hierarchy and merges of conflicting rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entity types with their level; State and Region share one and are not comparable.
ENTITY_LEVELS = {"Country": 0, "State": 1, "Region": 1, "District": 2, "City": 3, "Neighborhood": 4}
#: Feature codes of each entity type.
COUNTRY_CODES = ("PCLI", "PCLD", "PCLS", "PCLF", "PCL", "TERR")
STATE_CODES, DISTRICT_CODES, REGION_PREFIX = ("ADM1", "ADM1H"), ("ADM2", "ADM3", "ADM2H", "ADM3H"), "RGN"


def entity_types(feature_class: Column, feature_code: Column, country: Column) -> Column:
    """A map from entity type to whether a feature is of that type."""
    britain = (country == "GB") & (feature_code == "ADM1")
    of = {
        "Country": feature_code.isin(*COUNTRY_CODES) | britain,
        "State": feature_code.isin(*STATE_CODES),
        "Region": feature_code.startswith(REGION_PREFIX),
        "District": feature_code.isin(*DISTRICT_CODES),
        "City": (feature_class == "P") & (feature_code != "PPLX"),
        "Neighborhood": feature_class == "P",
    }
    return F.create_map(*[x for k, v in of.items() for x in (F.lit(k), F.coalesce(v, F.lit(False)))])


def of_type(df: DataFrame, entity_type: str | Column, types: str = "entity_type_map") -> DataFrame:
    return df.where(F.col(types)[F.lit(entity_type) if isinstance(entity_type, str) else entity_type])


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Distinct rows of all frames by column name; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).distinct()


def parents(hierarchy: DataFrame, entities: DataFrame, child: str, parent: str, entity: str) -> DataFrame:
    """(child, parents): sorted list of a child's parents that exist, for children that exist."""
    ids = entities.select(F.col(entity).alias("_id")).distinct()
    pairs = hierarchy.join(ids, hierarchy[child] == ids["_id"], "left_semi").join(ids, hierarchy[parent] == ids["_id"], "left_semi")
    return pairs.groupBy(child).agg(F.sort_array(F.collect_set(parent)).alias("parents"))


def level_pairs(places: DataFrame, key: str, codes: list[str]) -> DataFrame:
    """(parent, child, level): places of one chain of codes, for each level; a parent has no code below its level."""
    branches = []
    for level in range(1, len(codes) + 1):
        shared = codes[:level]
        parent, child = places, places.select(F.col(key).alias("child"), *[F.col(c).alias(f"_{c}") for c in shared])
        if level < len(codes):
            parent = parent.where(F.col(codes[level]).isNull())
        on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_{c}") for c in shared])
        branches.append(parent.join(child, on).where(F.col(key) != F.col("child")).select(F.col(key).alias("parent"), "child", F.lit(level).alias("level")))
    return reduce(DataFrame.union, branches)


#: Codes of a place, from the country down.
CODES = ["country_code", *(f"admin{i}_code" for i in range(1, 6))]


def informal_parents(hierarchy: DataFrame, places: DataFrame, kind: str) -> DataFrame:
    """(child, parents): lists of parents outside the administrative chain; ``kind``: city, region, or either.

    hierarchy: parent, child, type; places: id, feature_class, feature_code. Cities are places that are no part of another, regions those
    of land or administration. Links of type ADM count for regions only.
    """
    city = (F.col("feature_class") == "P") & (F.col("feature_code") != "PPLX")
    land = (F.col("feature_class") == "L") & F.col("feature_code").startswith(REGION_PREFIX)
    chosen = {"city": city, "region": land | ((F.col("feature_class") == "A") & F.col("feature_code").startswith("ADM")), "either": city | land}[kind]
    pairs = hierarchy if kind == "region" else hierarchy.where(~F.col("type").eqNullSafe(F.lit("ADM")))
    parent = places.where(chosen).select(F.col("id").alias("parent"))
    child = places.select(F.col("id").alias("child"))
    found = pairs.join(parent, "parent", "left_semi").join(child, "child", "left_semi")
    return found.groupBy("child").agg(F.sort_array(F.collect_list("parent")).alias("parents"))


def full_hierarchy(places: DataFrame, countries: DataFrame, informal: DataFrame | None = None, levels: int = 5) -> DataFrame:
    """Distinct (child, parent, level): the country, places of each administrative level with the child's codes, and an informal city.

    places: id, feature_class, feature_code and ``CODES``; countries: country_code, id; informal: child, parents, of which only single
    ones count.
    """
    child = places.select(F.col("id").alias("child"), *CODES)
    parts = [child.join(countries.select("country_code", F.col("id").alias("parent")), "country_code").select("child", "parent", F.lit("Country").alias("level"))]
    for i in range(1, levels + 1):
        keys = CODES[: i + 1]
        parent = places.where((F.col("feature_class") == "A") & F.col("feature_code").startswith(f"ADM{i}"))
        if i < levels:
            parent = parent.where(F.col(CODES[i + 1]).isNull())
        parts.append(child.join(parent.select(F.col("id").alias("parent"), *keys), keys).select("child", "parent", F.lit(f"ADM{i}").alias("level")))
    if informal is not None:
        parts.append(informal.where(F.size("parents") == 1).select("child", F.col("parents")[0].alias("parent"), F.lit("City").alias("level")))
    return reduce(DataFrame.union, parts).where("child <> parent").distinct()


def match_parents(matches: DataFrame) -> DataFrame:
    """(address, child, parent) among the matches of one address: a parent of another type shares the child's codes down to its level, or is listed.

    matches: address, id, entity_type, feature_class, feature_code, ``CODES``, parent_ids (array of informal parents). Matches of one
    address meet each other: an address has as many as its parts have candidates.
    """
    child = matches.select("address", F.col("id").alias("child"), F.col("entity_type").alias("_type"), F.col("parent_ids").alias("_ids"), *[F.col(c).alias(f"_{c}") for c in CODES])
    both = child.join(matches.drop("parent_ids"), "address").where((F.col("entity_type") != F.col("_type")) & (F.col("id") != F.col("child")))
    same = lambda n: reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_{c}") for c in CODES[:n]])
    area = F.col("feature_class") == "A"
    formal = area & (F.col("entity_type") == "Country") & same(1)
    for i in range(1, 6):
        formal = formal | (area & (F.col("entity_type") != "Country") & F.col("feature_code").startswith(f"ADM{i}") & same(i + 1))
    listed = F.coalesce(F.array_contains("_ids", F.col("id")), F.lit(False))
    return both.where(F.coalesce(formal, F.lit(False)) | listed).select("address", "child", F.col("id").alias("parent")).distinct()


def hierarchy_match_groups(matches: DataFrame) -> DataFrame:
    """(address, group, id, rank): each match that is no other's parent leads a group of itself and its parents.

    matches as for ``match_parents``, with rank. ``best_of_group`` ranks the groups.
    """
    pairs = match_parents(matches)
    ranks = matches.select("address", "id", "rank").distinct()
    leads = ranks.join(pairs.select("address", F.col("parent").alias("id")).distinct(), ["address", "id"], "left_anti").select("address", F.col("id").alias("group"), F.col("id"))
    members = leads.unionByName(leads.join(pairs.withColumnRenamed("child", "group"), ["address", "group"]).select("address", "group", F.col("parent").alias("id")))
    return members.distinct().join(ranks, ["address", "id"]).select("address", "group", "id", "rank")


def unlinked(entities: DataFrame, *links: DataFrame) -> DataFrame:
    """Entities (id) of another source that none of the link tables (id) has."""
    return reduce(lambda left, table: left.join(table.select("id"), "id", "left_anti"), links, entities)


def largest_places(places: DataFrame, country: str | None = None, n: int = 1000) -> DataFrame:
    """(country_code, name, place): names of populated places by country, largest first, up to ``n`` each; ties to the smaller name."""
    from pyspark.sql import Window

    some = places.where((F.col("feature_class") == "P") & F.col("name").isNotNull())
    some = some if country is None else some.where(F.col("country_code") == country)
    order = Window.partitionBy("country_code").orderBy(F.col("population").desc_nulls_last(), "name")
    return some.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= n).select("country_code", "name", "place")


def states(places: DataFrame, country: str) -> DataFrame:
    """Names of a country's divisions of the first level."""
    return places.where((F.col("country_code") == country) & (F.col("feature_class") == "A") & (F.col("feature_code") == "ADM1")).select("name")


def first_of_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first by ``order``: later ones of a key are ignored."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return first.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def simplified(places: DataFrame, cities: DataFrame, regions: DataFrame) -> DataFrame:
    """Places with the lists of their informal parent cities and regions, null without."""
    named = lambda t, name: t.select(F.col("child").alias("id"), F.col("parents").alias(name))
    return places.join(named(cities, "parent_city_ids"), "id", "left").join(named(regions, "parent_region_ids"), "id", "left")


def merged_flags(df: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """One row for each key; the flag holds if any row's does."""
    return df.groupBy(*keys).agg(F.bool_or(flag).alias(flag))


def updated(df: DataFrame, changes: DataFrame, key: str, column: str, value: str) -> DataFrame:
    """``df`` with ``column`` taken from ``changes`` where the key matches."""
    new = changes.select(F.col(key), F.col(value).alias("_new"), F.lit(True).alias("_hit"))
    return df.join(new, key, "left").withColumn(column, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(column))).drop("_new", "_hit")


def best_of_group(matches: DataFrame) -> DataFrame:
    """Matches (address, group, rank) to ranked groups: larger groups first, then smaller mean rank; ties share a rank."""
    from pyspark.sql import Window

    groups = matches.groupBy("address", "group").agg(F.count("*").alias("size"), F.avg("rank").alias("mean_rank"))
    return groups.withColumn("group_rank", F.rank().over(Window.partitionBy("address").orderBy(F.desc("size"), "mean_rank")))
