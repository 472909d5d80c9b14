"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words in every contract here: space, tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where it is unset, a folder under the warehouse on one machine, as in tests; an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    This cuts the lineage: a lost executor costs the tasks it ran, not this table.
    Files stay until ``release`` or until the shared folder is cleaned, as checkpoints do.
    """
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes written tables that are no longer needed, and lets go of shuffle files of finished steps."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()


def unused(taken: DataFrame | list[str], *names: str) -> list[str]:
    """``names``, each with underscores put behind it until no column has it; columns are told apart without case."""
    known = {c.lower() for c in (taken if isinstance(taken, list) else taken.columns)}
    out = []
    for name in names:
        while name.lower() in known:
            name += "_"
        known.add(name.lower())
        out.append(name)
    return out


def column(name: str) -> Column:
    """The column of exactly this name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def _is_plain_scan(df: DataFrame) -> bool:
    """Whether ``df`` is one table of Parquet files, of which rows were chosen and columns computed."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        if not node.deterministic():
            return False
        node = node.children().head()
    return node.nodeName().startswith(("Relation", "LogicalRelation")) and "parquet" in node.toString().lower()


def with_row_keys(df: DataFrame, file: str, row: str) -> DataFrame:
    """``df`` with two longs that name a row alike in every scan, however the cluster splits the files: a hash of its file's path and its place there.

    Spark's ``_metadata`` gives both for Parquet tables. Anything else is first written to the shared folder, and read from there.
    """
    if not _is_plain_scan(df):
        df = written(df, "rows")
    place = df.metadataColumn("_metadata")
    return df.select("*", F.xxhash64(place["file_path"]).alias(file), place["row_index"].alias(row))


#: Keys that are too frequent to meet in one task each: no more than this are sent to all tasks.
SENT_KEYS, FREQUENT = 100_000, 1024


def joined_by_frequency(rows: DataFrame, known: DataFrame, keys: list[str], count: str, total: int | None = None) -> DataFrame:
    """``rows`` joined with ``known``, which has each combination of ``keys`` once and how many rows hold it as ``count``.

    Combinations with more rows than ``FREQUENT``, or than a share of 1 / ``SENT_KEYS`` of all, are fewer than ``SENT_KEYS``: their
    ``known`` is sent to the rows wherever they are. The others meet by a shuffle in which no key has more rows than that. Both
    tables are scanned twice and should be stored ones.
    """
    total = rows.count() if total is None else total
    limit = max(FREQUENT, -(-total // SENT_KEYS))
    frequent = known.where(F.col(count) > limit).drop(count)
    rare = known.where(F.col(count) <= limit).drop(count)
    if frequent.isEmpty():
        return rows.join(rare, keys)
    sent = F.broadcast(frequent)
    return rows.join(sent, keys).unionByName(rows.join(sent.select(*keys), keys, "left_anti").join(rare, keys))


#: What functions have kept in this Python worker, and the function that has run last.
_KEPT: dict[str, dict] = {}
_LAST: list[str] = []


def kept(function: str) -> dict:
    """A dictionary for what ``function`` keeps in a Python worker from one task to the next."""
    return _KEPT.setdefault(function, {})


def begin(function: str) -> None:
    """What a function calls where it begins its work in a Python worker.

    Workers are used again by later stages, beside the heap of an executor that has grown by then: what other functions have kept is
    dropped, and memory that is free goes back to the system.
    """
    if _LAST == [function]:
        return
    _LAST[:] = [function]
    for other, held in _KEPT.items():
        if other != function:
            held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


class WordCache:
    """What is known of words, in a worker's memory of bounded bytes: two generations, of which the older goes when the newer has half the bytes.

    Words that come again in time move to the newer one, so frequent words stay. One set of words that is asked for at once is kept
    whole, beyond the bytes if need be.
    """

    #: Bytes of an entry beside its characters and value: two objects and a place in a dictionary.
    ENTRY_BYTES = 190

    def __init__(self, most_bytes: int, learn: Callable[[list[str]], dict[str, bytes]]):
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held, self.most_bytes, self.learn = 0, most_bytes, learn

    def of(self, wanted: set[str]) -> dict[str, bytes]:
        """A dictionary that has all of ``wanted``."""
        missing = wanted.difference(self.new)
        if missing:
            if self.held + sum(map(len, missing)) + self.ENTRY_BYTES * len(missing) > self.most_bytes // 2:
                self.old, self.new, self.held = self.new, {}, 0
                missing = wanted
            found = {w: self.old[w] for w in missing if w in self.old}
            if len(found) < len(missing):
                found |= self.learn(list(missing.difference(found)))
            self.held += sum(map(len, found)) + sum(map(len, found.values())) + self.ENTRY_BYTES * len(found)
            self.new.update(found)
        return self.new


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text as a string; a null text counts as an empty one."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def id_remainder(column: Column, modulus: int) -> Column:
    """crc32(id as text) mod ``modulus``; null for a null id."""
    return F.crc32(column.cast("string")) % modulus
