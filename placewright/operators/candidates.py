"""Candidate names for linking: which names count for a place, in which countries, and which match is taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_key
from .gazetteer import ENTITY_LEVELS

#: Languages that count everywhere, and the home countries of the reduced search.
LANGUAGES = ("en", "de", "abbr")
REDUCED_COUNTRIES, REDUCED_NEIGHBOUR = ("US", "IL", "DE"), "DE"


def language_fits(language: Column, spoken: Column) -> Column:
    """No language, one that counts everywhere (regions apart, as in de-AT), or one within the text of languages ``spoken``."""
    return language.isNull() | F.split(language, "-")[0].isin(*LANGUAGES) | F.coalesce(spoken.contains(language), F.lit(False))


def in_reduced_countries(country: Column, neighbours: Column) -> Column:
    return country.isin(*REDUCED_COUNTRIES) | F.coalesce(neighbours.contains(REDUCED_NEIGHBOUR), F.lit(False))


def candidate_names(names: DataFrame, places: DataFrame, countries: DataFrame) -> DataFrame:
    """Names to link against. names: entity_id, name, language; places: entity_id, country; countries: country, languages, neighbours.

    Names in languages that do not fit their country and names that clean to nothing go; ``reduced`` marks the small search.
    The joins are left to the optimizer, which sends the countries to all tasks while they are small.
    """
    full = names.join(places, "entity_id").join(countries, "country").withColumn("clean", clean_key(F.col("name")))
    fits = language_fits(F.col("language"), F.col("languages")) & (F.trim("clean") != "")
    return full.where(fits).select("entity_id", "name", "language", "country", "clean", in_reduced_countries(F.col("country"), F.col("neighbours")).alias("reduced"))


def country_hints(addresses: DataFrame, matches: DataFrame, name: str = "country_name", code: str = "code") -> DataFrame:
    """``addresses`` with ``hint``: sorted codes that the matches give for their country's name; null without a match."""
    codes = matches.groupBy(F.col(name).alias("_name")).agg(F.sort_array(F.collect_set(code)).alias("hint"))
    return addresses.join(codes, addresses[name] == codes["_name"], "left").drop("_name")


def level_relation(a: Column, b: Column) -> Column:
    """``below``, ``above``, ``same`` for two entity types; null where they cannot be compared: unknown, or two types of one level."""
    levels = F.create_map(*[F.lit(x) for pair in ENTITY_LEVELS.items() for x in pair])
    x, y = levels[a], levels[b]
    return F.when(a == b, F.when(x.isNotNull(), "same")).when(x > y, "below").when(x < y, "above")


def unless_tied(ranked: DataFrame, key: str, rank: str = "rank") -> DataFrame:
    """The row of rank 1 for each key; none for keys with several."""
    ones = ranked.where(F.col(rank) == 1).withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    return ones.where("_n = 1").drop("_n")


def redirected(ids: DataFrame, redirects: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """``ids`` with replaced ids; rows whose id is redirected to nothing go. ``old`` must be unique."""
    known = redirects.select(F.col(old).alias("_old"), F.col(new).alias("_new"))
    joined = ids.join(known, ids[column] == known["_old"], "left")
    kept = joined.where(F.col("_old").isNull() | F.col("_new").isNotNull())
    return kept.withColumn(column, F.when(F.col("_old").isNotNull(), F.col("_new")).otherwise(F.col(column))).drop("_old", "_new")
