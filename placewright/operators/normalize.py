"""Normalisation of card records: place fields are parsed, linked, corrected and counted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import city_and_country
from ..sources.shared import stored
from .link import link, status

#: The place fields of a record and their prefixes, and the statuses that a part can get.
FIELDS = {"ApplicantBirthPlace": "abp", "ApplicantCurrentAddress": "aca", "VictimBirthPlace": "vbp", "VictimDeathPlace": "vdp", "VictimCurrentAddress": "vca"}
NO_ADDRESS = "NO_ADDRESS"


def places(records: DataFrame, key: str = "filename", parser: Callable[[Column], tuple[Column, Column]] = city_and_country) -> DataFrame:
    """(key, field, raw, city, country): the parsed place fields of each record; a missing field is empty."""
    rows = F.array(*[F.struct(F.lit(p).alias("field"), F.coalesce(F.col(f), F.lit("")).alias("raw")) for f, p in FIELDS.items()])
    long = records.select(key, F.explode(rows).alias("r")).select(key, "r.field", "r.raw")
    city, country = parser(F.col("raw"))
    return long.withColumn("city", city).withColumn("country", country)


def corrected(records: DataFrame, names: DataFrame, key: str = "filename", threshold: int = 3, by_kind: bool = True) -> DataFrame:
    """(key, field, raw, city and country with status, match, corrected and final name, edit distance, is_abbreviation, and whether the city is in the country).

    A linked country is the hint for its city. names: name_id, entity_id, name, country, kind (Country, City or others); without ``by_kind``
    countries and cities are looked for among names of all kinds.
    """
    long = stored(places(records, key).withColumn("_q", F.concat_ws("|", F.col(key), "field")), "places")

    def solve(part: str, kind: str, hints: DataFrame | None) -> DataFrame:
        asked = long.select(F.col("_q").alias("query_id"), F.col(part).alias("text"), "raw")
        if hints is not None:
            asked = asked.join(hints, "query_id", "left")
        pool = names.where(F.col("kind") == kind) if by_kind else names
        return status(link(asked, pool.drop("kind"), threshold, reduced_tier=kind != "Country"), asked, threshold)

    countries = stored(solve("country", "Country", None), "countries")
    hint = countries.where("matched_country is not null").select("query_id", F.array("matched_country").alias("hint"))
    cities = solve("city", "City", hint)

    def columns(df: DataFrame, p: str, *more: Column) -> DataFrame:
        match = F.when(F.col("final").isNotNull(), F.col("text")).alias(f"{p}_match")
        named = [F.col(c).alias(f"{p}_{c}") for c in ("status", "corrected", "final", "edit_distance", "is_abbreviation")]
        return df.select(F.col("query_id").alias("_q"), match, *named, *more)

    same = F.when(F.col("hint").isNotNull() & F.col("edit_distance").isNotNull(), F.coalesce(F.array_contains("hint", F.col("matched_country")), F.lit(False))).alias("city_in_same_country")
    return long.join(columns(countries, "country"), "_q", "left").join(columns(cities, "city", same), "_q", "left").drop("_q")


def status_cube(df: DataFrame, *dims: str) -> DataFrame:
    """Counts for each combination of the dimensions and all totals (null)."""
    return df.cube(*dims).agg(F.count("*").alias("cnt"), F.grouping_id().alias("gid"))


def long_statuses(solved: DataFrame) -> DataFrame:
    """(field, entity_type, raw, status, final): the outcome of ``corrected``, one row for each field and entity type."""
    kinds = F.array(*[F.struct(F.lit(k).alias("entity_type"), F.col(f"{k.lower()}_status").alias("status"), F.col(f"{k.lower()}_final").alias("final")) for k in ("City", "Country")])
    return solved.select("field", "raw", F.explode(kinds).alias("k")).select("field", "raw", "k.*")


def percent(part: Column, whole: Column) -> Column:
    """``part`` of ``whole`` as 12.3%, or N/A of nothing."""
    return F.when(whole > 0, F.format_string("%.1f%%", F.bround(100 * part / whole, 1))).otherwise("N/A")


def status_ratios(rows: DataFrame) -> DataFrame:
    """(field, entity_type, status, cnt, share) with totals of both as TOTAL, from rows (field, entity_type, raw, status, final).

    NO_ADDRESS is a share of all rows, every other status of those with an address; ``input_rows``, ``input_fields_with_address`` (of all
    rows) and ``final_count`` (of those with an address) come as statuses too.
    """
    some = F.coalesce(F.col("raw"), F.lit("")) != ""
    sums = rows.cube("field", "entity_type").agg(F.count("*").alias("n"), F.sum(some.cast("long")).alias("a"), F.count("final").alias("f"))
    total = lambda c: F.coalesce(c, F.lit("TOTAL")).alias(c)
    sums = sums.select(total("field"), total("entity_type"), "n", "a", "f")
    counts = rows.where("status is not null").cube("field", "entity_type", "status").agg(F.count("*").alias("cnt")).where("status is not null")
    each = counts.select(total("field"), total("entity_type"), "status", "cnt").join(sums, ["field", "entity_type"])
    each = each.select("field", "entity_type", "status", "cnt", percent(F.col("cnt"), F.when(F.col("status") == NO_ADDRESS, F.col("n")).otherwise(F.col("a"))).alias("share"))
    made = F.array(
        F.struct(F.lit("input_rows").alias("status"), F.col("n").alias("cnt"), F.lit("—").alias("share")),
        F.struct(F.lit("input_fields_with_address").alias("status"), F.col("a").alias("cnt"), percent(F.col("a"), F.col("n")).alias("share")),
        F.struct(F.lit("final_count").alias("status"), F.col("f").alias("cnt"), percent(F.col("f"), F.col("a")).alias("share")),
    )
    return each.unionByName(sums.select("field", "entity_type", F.explode(made).alias("m")).select("field", "entity_type", "m.*"))
