"""Incremental normalisation: new record files are corrected as they come, statistics add up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.normalize import corrected


def normalise_files(spark: SparkSession, path: str, schema: str, names: DataFrame, out: str, checkpoint: str, files_at_once: int = 100) -> StreamingQuery:
    """Reads JSON-lines files below ``path`` as a stream and appends corrected places, by field, to ``out``."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(path)

    def step(batch: DataFrame, number: int) -> None:
        corrected(batch, names).withColumn("batch", F.lit(number)).write.mode("append").partitionBy("field").json(out)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def statistics(spark: SparkSession, out: str) -> DataFrame:
    """Counts by field and city status over all batches."""
    return spark.read.json(out).groupBy("field", "city_status").agg(F.count("*").alias("cnt"))
