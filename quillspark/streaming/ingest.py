"""Streaming ingest: JSON lines as they arrive, normalized, first record of an id, written by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators.normalize import normalize_works
from quillspark.schemas import CORRUPT, RAW_WORK


def stream_works(spark: SparkSession, path: str, files_a_batch: int = 50) -> DataFrame:
    fields = T.StructType([*T.StructType.fromDDL(RAW_WORK).fields, T.StructField(CORRUPT, T.StringType())])
    raw = spark.readStream.schema(fields).option("maxFilesPerTrigger", files_a_batch).option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return normalize_works(raw.where(F.col(CORRUPT).isNull()).drop(CORRUPT)).dropDuplicates(["id"])


def write_works(works: DataFrame, target: str, checkpoint: str):
    """Append to Parquet until all waiting files are read; a restart goes on from the checkpoint."""
    return works.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
