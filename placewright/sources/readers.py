"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Columns of the dumps that a gazetteer is built from.
PLACES = (
    "geonameId int, name string, asciiname string, alternatenames string, latitude float, longitude float, feature_class string, feature_code string, country_code string, cc2 string, "
    "admin1_code string, admin2_code string, admin3_code string, admin4_code string, population bigint, elevation int, dem int, timezone string, modification_date date"
)
ALTERNATE_NAMES = "alternateNameId int, geonameId int, isolanguage string, alternateName string, isPreferredName string, isShortName string, isColloquial string, isHistoric string"
NAME_FLAGS = ("isPreferredName", "isShortName", "isColloquial", "isHistoric")
HIERARCHY = "parentId int, childId int, type string"
COUNTRIES = (
    "ISO string, ISO3 string, ISO_Numeric int, fips string, Country string, Capital string, Area float, Population int, Continent string, tld string, CurrencyCode string, "
    "CurrencyName string, Phone string, Postal_Code_Format string, Postal_Code_Regex string, Languages string, geonameid int, neighbours string, EquivalentFipsCode string"
)
FIFTH_LEVEL = "geonameId int, admin5_code string"


def places(spark: SparkSession, path: str, fifth_level: str | None = None) -> DataFrame:
    """The main gazetteer dump; ``admin5_code`` comes from a dump of its own, null without."""
    from ..operators.gazetteer import updated

    main = tsv(spark, path, PLACES).withColumn("admin5_code", F.lit(None).cast("string"))
    if fifth_level is None:
        return main
    return updated(main, tsv(spark, fifth_level, FIFTH_LEVEL), "geonameId", "admin5_code", "admin5_code")


def alternate_names(spark: SparkSession, path: str) -> DataFrame:
    """Alternate names; the dump has 1 or nothing for its flags, which become true or null."""
    raw = tsv(spark, path, ALTERNATE_NAMES)
    return raw.withColumns({f: F.when(F.col(f) == "1", True).when(F.col(f) == "0", False) for f in NAME_FLAGS})


def hierarchy(spark: SparkSession, path: str) -> DataFrame:
    return tsv(spark, path, HIERARCHY)


def countries(spark: SparkSession, path: str) -> DataFrame:
    return tsv_without_comments(spark, path, COUNTRIES)


def zip_member(spark: SparkSession, path: str, member: str, out: str, keep=None) -> str:
    """Writes the lines of one member of each zip archive at ``path`` as text files below ``out``; ``keep`` may choose among the lines.

    An archive is opened where it was read, one task for each, and its lines go on in batches.
    """
    import io
    import zipfile

    import pyarrow as pa

    def unpack(batches):
        for batch in batches:
            for content in batch.column("content"):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as archive, archive.open(member) as lines:
                    some = []
                    for line in io.TextIOWrapper(lines, encoding="utf-8", newline="\n"):
                        some.append(line.rstrip("\r\n"))
                        if len(some) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], names=["value"])
                            some = []
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], names=["value"])

    lines = spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpack, "value string")
    (lines if keep is None else lines.where(keep)).write.mode("overwrite").text(out)
    return out


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table without header and quotes, separated by tabs."""
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").csv(path)


def tsv_without_comments(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As ``tsv``, without lines that start with # after white space; a # within a field stays."""
    lines = spark.read.text(path).where(~F.ltrim("value").startswith("#") & (F.trim("value") != ""))
    return lines.select(F.from_csv("value", schema, {"sep": "\t", "quote": ""}).alias("r")).select("r.*")


def labelled_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A table with header, of strings only; the empty field is null and nothing else is."""
    return spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("header", True).option("escape", '"').option("emptyValue", None).csv(path)


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of objects with free keys, as (row, map): order and keys are kept."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", "array<map<string,string>>")).alias("row", "prediction"))


def triples(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o) of N-Triples lines."""
    pattern = r'^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:\S+|".*"(?:@\S+|\^\^\S+)?)\s*\.\s*$'
    part = lambda k: F.regexp_replace(F.regexp_extract("value", pattern, k), "^<|>$", "")
    return spark.read.text(path).where(F.col("value").rlike(pattern)).select(part(1).alias("s"), part(2).alias("p"), F.regexp_replace(part(3), r'^"(.*)"(@\S+|\^\^\S+)?$', "$1").alias("o"))


def linked_names(graph: DataFrame, kind: str, same_as_prefix: str, name_properties: list[str]) -> DataFrame:
    """(uri, entity_id, name, property) of subjects of a type with a link into a gazetteer: a join of three patterns."""
    typed = graph.where(F.col("p").endswith("type") & (F.col("o") == kind)).select("s")
    links = graph.where(F.col("p").endswith("sameAs") & F.col("o").startswith(same_as_prefix)).select("s", F.expr("try_cast(split(parse_url(o, 'PATH'), '/')[1] as int)").alias("entity_id")).where("entity_id is not null")
    names = graph.where(F.col("p").isin(*name_properties)).select("s", F.col("o").alias("name"), F.col("p").alias("property"))
    return typed.join(links, "s").join(names, "s").withColumnRenamed("s", "uri")


def turtle(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o) of Turtle files whose statements begin on a line of their own: prefixes, ``a``, and lists with ; and , are understood.

    Each file is read whole in one task; collections and nested blank nodes are not supported.
    """
    import pandas as pd

    from ..functions.turtle import statements

    def parse(frames):
        for frame in frames:
            for text in frame["value"]:
                rows = []
                for row in statements(text):
                    rows.append(row)
                    if len(rows) == 20_000:
                        yield pd.DataFrame(rows, columns=["s", "p", "o"])
                        rows = []
                yield pd.DataFrame(rows, columns=["s", "p", "o"])

    return spark.read.text(path, wholetext=True).mapInPandas(parse, "s string, p string, o string")


def template(spark: SparkSession, path: str) -> str:
    """The text of a prompt template, a small file."""
    return spark.read.text(path, wholetext=True).first()["value"]


def trials(spark: SparkSession, url: str, table: str, driver: str | None = None, **properties: str) -> DataFrame:
    """A table of a trial store by JDBC."""
    options = properties | ({"driver": driver} if driver else {})
    return spark.read.jdbc(url, table, properties=options)


def by_config(spark: SparkSession, path: str, configs: list[str] | None = None) -> DataFrame:
    """Stored predictions of configurations, of which only the folders asked for are read."""
    table = spark.read.parquet(path)
    return table if configs is None else table.where(F.col("config_name").isin(*configs))


def store_by_config(df: DataFrame, path: str) -> None:
    """Stores predictions, replacing those of the configurations in ``df`` and keeping all others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("config_name").parquet(path)


def rebuilt(spark: SparkSession, makers: dict[str, object], asked: list[str], needs: dict[str, list[str]], together: list[list[str]] | None = None) -> list[str]:
    """Makes the asked tables anew, and those that must be made together with them, each after the tables it needs. The order is given back.

    ``makers``: for each table a function without arguments that gives its DataFrame. Unknown names are an error before anything is made.
    """
    wanted = set(asked)
    for group in together or []:
        if wanted & set(group):
            wanted |= set(group)
    if wrong := sorted(wanted - set(makers)):
        raise ValueError(f"no such tables: {wrong}")
    order: list[str] = []

    def put(name: str, above: tuple[str, ...] = ()) -> None:
        if name in above:
            raise ValueError(f"{name} needs itself")
        for other in needs.get(name, []):
            if other in wanted:
                put(other, (*above, name))
        if name not in order:
            order.append(name)

    for name in sorted(wanted):
        put(name)
    for name in order:
        makers[name]().write.mode("overwrite").saveAsTable(name)
    return order


def append_by_field(df: DataFrame, path: str, field: str = "field") -> None:
    """Appends JSON lines, one folder for each value of a field."""
    df.write.mode("append").partitionBy(field).json(path)


def cached(df_of, spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path``, made by ``df_of()`` if it is not there yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        df_of().write.mode("ignore").parquet(path)
        return spark.read.parquet(path)
