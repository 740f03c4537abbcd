"""The institution registry: eleven fields, most works first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.normalize import short_id


def registry(found: DataFrame) -> DataFrame:
    return found.select(
        short_id(F.col("id")).alias("id"), F.col("id").alias("openalex_id"), "ror", "display_name", "country_code", "type", "homepage_url",
        F.coalesce("works_count", F.lit(0)).alias("works_count"), F.coalesce("cited_by_count", F.lit(0)).alias("cited_by_count"), "geo", "lineage",
    ).orderBy(F.desc("works_count"), "id")


def ids(institutions: DataFrame, column: str = "id") -> DataFrame:
    """Ids (or with ``ror`` the ROR ids) that are present."""
    return institutions.where(F.coalesce(F.col(column) != "", F.lit(False))).select(column)
