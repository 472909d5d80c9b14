"""Names by which countries are known, and values that stand for others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The names and abbreviations under which a country is written, historical states among them, and its ISO code.
COUNTRY_CODES = {
    "DE": "DE", "AT": "AT", "CH": "CH", "PL": "PL", "FR": "FR",
    "GB": "GB", "US": "US", "RU": "RU", "HU": "HU", "RO": "RO",
    "BG": "BG", "CZ": "CZ", "SK": "SK", "HR": "HR", "RS": "RS",
    "UA": "UA", "BY": "BY", "LT": "LT", "LV": "LV", "EE": "EE",
    "NL": "NL", "BE": "BE", "IT": "IT", "ES": "ES", "PT": "PT",
    "GR": "GR", "TR": "TR", "IL": "IL",
    "Deutschland": "DE", "Germany": "DE", "Österreich": "AT", "Austria": "AT", "Schweiz": "CH", "Switzerland": "CH",
    "Polen": "PL", "Poland": "PL", "Frankreich": "FR", "France": "FR", "England": "GB", "Großbritannien": "GB", "Great Britain": "GB",
    "Ungarn": "HU", "Hungary": "HU", "Rumänien": "RO", "Romania": "RO", "Bulgarien": "BG", "Bulgaria": "BG",
    "Tschechien": "CZ", "Czechia": "CZ", "Czech Republic": "CZ", "Slowakei": "SK", "Slovakia": "SK", "Kroatien": "HR", "Croatia": "HR",
    "Serbien": "RS", "Serbia": "RS", "Ukraine": "UA", "Weißrussland": "BY", "Belarus": "BY", "Litauen": "LT", "Lithuania": "LT",
    "Lettland": "LV", "Latvia": "LV", "Estland": "EE", "Estonia": "EE", "Niederlande": "NL", "Netherlands": "NL", "Holland": "NL",
    "Belgien": "BE", "Belgium": "BE", "Italien": "IT", "Italy": "IT", "Spanien": "ES", "Spain": "ES", "Portugal": "PT",
    "Griechenland": "GR", "Greece": "GR", "Türkei": "TR", "Turkey": "TR", "Russland": "RU", "Russia": "RU", "Israel": "IL",
    "USA": "US", "United States": "US",
    "Dtschl.": "DE", "Dtschl": "DE", "Dtl.": "DE", "Dtl": "DE", "Öst.": "AT", "Öst": "AT", "Schw.": "CH", "Pol.": "PL", "Pol": "PL",
    "Ung.": "HU", "Ung": "HU", "Rum.": "RO", "Rum": "RO", "Bulg.": "BG", "Bulg": "BG", "Tsch.": "CZ", "Tsch": "CZ", "Jug.": "RS", "Jug": "RS",
    "Ukr.": "UA", "Ukr": "UA", "Lit.": "LT", "Lit": "LT", "Lett.": "LV", "Lett": "LV", "Niederl.": "NL", "Niederl": "NL",
    "Belg.": "BE", "Belg": "BE", "It.": "IT", "Span.": "ES", "Span": "ES", "Griech.": "GR", "Griech": "GR", "Türk.": "TR", "Türk": "TR",
    "Russ.": "RU", "Russ": "RU", "Isr.": "IL", "Isr": "IL",
    "CSR": "CZ", "ČSR": "CZ", "CSSR": "CZ", "ČSSR": "CZ", "Tschechoslowakei": "CZ", "Czechoslovakia": "CZ",
    "UdSSR": "RU", "UDSSR": "RU", "USSR": "RU", "SU": "RU", "Sowjetunion": "RU", "Soviet Union": "RU",
    "Jugoslawien": "RS", "Yugoslavia": "RS", "SFRJ": "RS", "Deutsches Reich": "DE", "DR": "DE", "DDR": "DE", "Deutsche Demokratische Republik": "DE",
    "Preußen": "DE", "Prussia": "DE", "Österreich-Ungarn": "AT", "Austria-Hungary": "AT",
}


def alias_table(spark: SparkSession, aliases: dict[str, str]) -> DataFrame:
    """(alias in lower case, value); of aliases that differ in case only, the last counts."""
    low = {k.lower(): v for k, v in aliases.items()}
    return spark.createDataFrame(sorted(low.items()), "alias string, value string")


def with_alias(df: DataFrame, column: str, aliases: dict[str, str], name: str, missing: str | None = None, unknown: Column | None = None) -> DataFrame:
    """``df`` with ``name``: what the column's value stands for, whatever its case; ``unknown`` for others, ``missing`` for nulls.

    The table of aliases is a constant, so it is sent to all tasks.
    """
    known = alias_table(df.sparkSession, aliases).withColumnsRenamed({"alias": "_alias", "value": "_value"})
    joined = df.join(F.broadcast(known), F.lower(F.col(column)) == F.col("_alias"), "left")
    other = F.lit(None).cast("string") if unknown is None else unknown
    return joined.withColumn(name, F.when(F.col(column).isNull(), F.lit(missing)).otherwise(F.coalesce("_value", other))).drop("_alias", "_value")


def normalised(df: DataFrame, column: str, aliases: dict[str, str], name: str, missing: str = "No Country") -> DataFrame:
    """Values under one name: aliases, and values themselves in any case, become the value; others stay; nulls are ``missing``."""
    return with_alias(df, column, aliases | {v: v for v in aliases.values()}, name, missing, F.col(column))


def country_codes(df: DataFrame, column: str, name: str = "country_code", more: dict[str, str] | None = None) -> DataFrame:
    """Rows whose country is known, with its ISO code; others go."""
    return with_alias(df, column, COUNTRY_CODES | (more or {}), name).where(F.col(name).isNotNull())
