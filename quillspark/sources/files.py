"""File sources and sinks: JSON lines (permissive or strict), JSON arrays and run metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.schemas import CORRUPT, QRELS


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _parsed(schema: str) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines by an explicit schema. Blank lines are skipped; malformed ones too unless ``strict``,
    which raises. A missing path is an empty table."""
    fields = _parsed(schema)
    if not exists(spark, path):
        return spark.createDataFrame([], fields)
    if strict:
        return spark.read.schema(fields).option("mode", "FAILFAST").json(path)
    parsed = _lines(spark, path, fields)
    return parsed.where(F.col(f"x.{CORRUPT}").isNull()).select("x.*").drop(CORRUPT)


def _lines(spark: SparkSession, path: str, fields: T.StructType) -> DataFrame:
    """Parsed lines as struct ``x``; a malformed one has its text in the corrupt-record field."""
    with_corrupt = T.StructType([*fields.fields, T.StructField(CORRUPT, T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", with_corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("x"))


def corrupt_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The lines that ``read_jsonl`` skips, for a log."""
    return _lines(spark, path, _parsed(schema)).select(F.col(f"x.{CORRUPT}").alias("line")).where("line is not null")


def count_records(spark: SparkSession, path: str) -> int:
    """Lines that are not blank; 0 for a missing path."""
    return spark.read.text(path).where(F.trim("value") != "").count() if exists(spark, path) else 0


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(_parsed(schema)).option("multiLine", True).json(path)


def append_jsonl(df: DataFrame, path: str, compression: str = "none") -> None:
    """Append ``df`` as JSON lines; compressed ones are read again as any others."""
    df.write.mode("append").option("ignoreNullFields", False).option("compression", compression).json(path)


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """A small table of metrics as one JSON file."""
    metrics.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_batches(items: DataFrame, path: str) -> None:
    """Masked items as JSON lines, a folder a batch; other batches in ``path`` stay."""
    items.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", False).partitionBy("batch_id").json(path)


def run_metadata(spark: SparkSession, values: dict[str, str]) -> DataFrame:
    """One row: the values and ``timestamp_utc``."""
    columns = [F.lit(str(v)).alias(k) for k, v in values.items()]
    return spark.range(1).select(*columns, F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).alias("timestamp_utc"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Nested ``{query: {paper: relevance}}`` to long form."""
    nested = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,int>>").alias("m"))
    rows = nested.select(F.explode("m").alias("query_id", "papers")).select("query_id", F.explode("papers").alias("paper_id", "relevance"))
    return rows.to(T.StructType.fromDDL(QRELS))


def nested_qrels(qrels: DataFrame) -> DataFrame:
    """Long form to one JSON object a query."""
    papers = F.map_from_entries(F.sort_array(F.collect_list(F.struct("paper_id", "relevance"))))
    return qrels.groupBy("query_id").agg(F.to_json(papers).alias("judgments"))


def file_sha256(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
