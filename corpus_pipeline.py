"""The corpus pipeline: documents in, packed training sequences out.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame
that is written as Parquet and read again as the next one's docs. All but the last return the
columns of ``documents``. Every stage decides on all its predecessor kept:

1. quality_rules: documents that fail the rules go; boilerplate lines are cut from the others.
2. simhash_dedup: of each group of near duplicates (five-word shingles, similarity 0.8) one stays.
3. suffix_dedup: passages of 50 words or more that an earlier document has are cut.
4. secret_scans: secrets are replaced by their kind.
5. best_fit_packing: token pieces are placed in sequences of 4096.

Nulls, empty tables, repeated rows and extra columns are handled by the operators as their
docstrings say; extra columns travel along to the last stage. A stage removes the intermediate tables
of the stage before it, so a stage's result must be written before the next stage is called.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.packing import pack
from quillspark.llm.quality import keep_good
from quillspark.llm.secrets import mask_secrets
from quillspark.llm.simhash import keep_one
from quillspark.llm.suffix import keep_originals
from quillspark.runtime import MADE, discard, ship, stash


#: What a worker holds while packing: less than ``pack`` takes by itself, as executors are large after the stages before.
REMEMBERED, TEXT_BYTES = 96 << 20, 2 << 20
#: Bytes of an Arrow batch and rows of a batch that the Parquet reader decodes at once. Five stages run in the
#: same executors, and what the largest batch took of them (direct buffers, large arrays) is not given back.
BATCH_BYTES, READ_ROWS = 1 << 20, 512

#: Tables that a stage's last call left for its result to read, by thread, application, input and stage.
_LEFT: dict[tuple, list[str]] = {}


def _run(number: int, work, spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Run a stage. Its docs are the written result of the stage before, whose own tables go now."""
    ship(spark, BATCH_BYTES)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))
    key = (threading.get_ident(), spark.sparkContext.applicationId, sf_dir)
    discard(spark, *_LEFT.pop((*key, number - 1), []))
    before = len(MADE.paths)
    out = work(docs)
    _LEFT[(*key, number)] = MADE.paths[before:]
    del MADE.paths[before:]
    return out


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _run(0, keep_good, spark, docs, sf_dir)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _run(1, keep_one, spark, docs, sf_dir)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _run(2, keep_originals, spark, docs, sf_dir)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _run(3, mask_secrets, spark, docs, sf_dir)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _run(4, lambda kept: pack(kept, remembered=REMEMBERED, text_bytes=TEXT_BYTES), spark, docs, sf_dir)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("suffix_dedup", suffix_dedup),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the near-duplicate groups nor the packing; tests/llm hold the stages
#: against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of ``sf_dir``; every hand-over is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}").df
    return STAGES[-1][1](spark, docs, sf_dir)
