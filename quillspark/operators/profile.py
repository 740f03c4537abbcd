"""Data-quality profiling: completeness, statistics, distributions, duplicates and anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import present, strip


def percent(part: Column, total: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(part * 100.0, total), F.lit(0.0)), 2)


def completeness(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """``field, total, present, missing, pct_present, pct_missing``: all fields in one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, c in enumerate(fields.values())))
    pairs = F.array(*(F.struct(F.lit(name).alias("field"), F.col(f"c{i}").alias("present")) for i, name in enumerate(fields)))
    rows = counts.select("total", F.explode(pairs).alias("x")).select("x.field", "total", "x.present")
    return rows.select("field", "total", "present", (F.col("total") - F.col("present")).alias("missing"), percent(F.col("present"), F.col("total")).alias("pct_present"), percent(F.col("total") - F.col("present"), F.col("total")).alias("pct_missing"))


def work_fields() -> dict[str, Column]:
    """The eighteen presence tests of a normalized work."""
    some = lambda c: F.size(c) > 0
    return {
        "OpenAlex ID": present("id"), "DOI": present("doi"), "Title": present("title"),
        "Publication Year": F.col("publication_year").isNotNull(), "Publication Date": present("publication_date"),
        "Work Type": present("type"), "Source / Journal": present("source_name"),
        "Abstract (Reconstructed)": F.col("abstract_available"), "Authors": some("authors"),
        "Author Identifiers": F.exists("authors", lambda a: present(a["id"])),
        "Institutions / Affiliations": some("institutions"), "Kenyan Institution Affiliation": F.col("has_ke_institution"),
        "Institution ROR ID": F.exists("institutions", lambda i: present(i["ror"])), "Primary Topic": present("primary_topic"),
        "Topics List": some("topics"), "Concepts List": some("concepts"), "Open Access Status": present("oa_status"),
        "Citations Count": F.col("cited_by_count").isNotNull(),
    }


def summary_stats(df: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """``measure, n, min, max, mean, median``; zeros where nothing is measured."""
    return _stats(df, measures, lambda v: [
        F.coalesce(F.min(v), F.lit(0.0)).alias("min"), F.coalesce(F.max(v), F.lit(0.0)).alias("max"),
        F.round(F.coalesce(F.avg(v), F.lit(0.0)), 2).alias("mean"), F.round(F.coalesce(F.percentile(v, 0.5), F.lit(0.0)), 2).alias("median"),
    ])


def detailed_stats(df: DataFrame, measures: dict[str, Column], digits: int = 2) -> DataFrame:
    """Adds quartiles, the 95th percentile (linear interpolation) and the population deviation."""
    q = lambda v, p: F.round(F.coalesce(F.percentile(v, p), F.lit(0.0)), digits)
    return _stats(df, measures, lambda v: [
        F.coalesce(F.min(v), F.lit(0.0)).alias("min"), F.coalesce(F.max(v), F.lit(0.0)).alias("max"),
        F.round(F.coalesce(F.avg(v), F.lit(0.0)), digits).alias("mean"), q(v, 0.5).alias("median"),
        q(v, 0.25).alias("p25"), q(v, 0.75).alias("p75"), q(v, 0.95).alias("p95"),
        F.round(F.coalesce(F.stddev_pop(v), F.lit(0.0)), digits).alias("std"),
    ])


def _stats(df: DataFrame, measures: dict[str, Column], aggregates) -> DataFrame:
    """One pass: every row gives one (measure, value) pair a measure, combined before the shuffle."""
    pairs = F.array(*(F.struct(F.lit(name).alias("measure"), c.cast("double").alias("v")) for name, c in measures.items()))
    return df.select(F.explode(pairs).alias("x")).select("x.*").groupBy("measure").agg(F.count("v").alias("n"), *aggregates(F.col("v")))


def value_distribution(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Counts of the values that are neither null nor empty, most frequent first, ties by value."""
    counts = df.where(present(F.col(column).cast("string"))).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(top) if top else counts


def duplicates(df: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """``key, value, n`` of the values that come more than once, for each key expression."""
    pairs = F.array(*(F.struct(F.lit(name).alias("key"), c.alias("value")) for name, c in keys.items()))
    rows = df.select(F.explode(pairs).alias("x")).select("x.key", "x.value").where(present("value"))
    return rows.groupBy("key", "value").agg(F.count("*").alias("n")).where("n > 1")


def work_keys() -> dict[str, Column]:
    return {"id": F.col("id"), "doi": F.lower("doi"), "title": strip(F.lower("title"))}


def anomalies(df: DataFrame, year: Column, first: int = 1960, last: int = 2027, domestic: Column | None = None) -> DataFrame:
    odd = year.isNotNull() & (year != 0) & ((year < first) | (year > last))
    no_home = F.count_if(~F.coalesce(domestic, F.lit(False))) if domestic is not None else F.lit(0).cast("long")
    return df.agg(F.count_if(odd).alias("anomalous_years"), no_home.alias("without_domestic"))


def collaboration(df: DataFrame, domestic: Column, international: Column) -> DataFrame:
    both = F.count_if(F.coalesce(domestic & international, F.lit(False)))
    counts = df.agg(F.count(F.lit(1)).alias("total"), both.alias("collaborations"))
    return counts.withColumn("pct", percent(F.col("collaborations"), F.col("total")))


def institution_counts(affiliations: DataFrame, home: str) -> DataFrame:
    """``kind, name, n, n_papers`` of ``affiliations(paper_id, name, country)``: affiliation occurrences
    and distinct papers, for domestic names, international "name (country)" and countries."""
    abroad = present("country") & (F.col("country") != home)
    rows = affiliations.where(present("name")).select("paper_id", F.explode(F.array(
        F.when(F.col("country") == home, F.struct(F.lit("domestic").alias("kind"), F.col("name").alias("name"))),
        F.when(abroad, F.struct(F.lit("international").alias("kind"), F.concat("name", F.lit(" ("), "country", F.lit(")")).alias("name"))),
        F.when(abroad, F.struct(F.lit("country").alias("kind"), F.col("country").alias("name"))),
    )).alias("x")).where("x is not null")
    return rows.groupBy("x.kind", "x.name").agg(F.count("*").alias("n"), F.countDistinct("paper_id").alias("n_papers"))


def missing_id_names(authors: DataFrame, top: int = 5) -> DataFrame:
    """The most frequent names among the instances without an id: ``name, n``."""
    gone = authors.where(~present("author_id") & present("name"))
    return gone.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(top)


def duplicate_samples(df: DataFrame, keys: dict[str, Column], top: int = 5) -> DataFrame:
    """The most frequent duplicates of each key expression: ``key, value, n``."""
    by = Window.partitionBy("key").orderBy(F.desc("n"), "value")
    return duplicates(df, keys).withColumn("place", F.row_number().over(by)).where(F.col("place") <= top).drop("place")


def missing_ids(authors: DataFrame) -> DataFrame:
    """Census of ``authors(author_id, name, orcid)`` instances that have no id."""
    gone = ~present("author_id")
    return authors.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(gone).alias("missing"), F.count_distinct(F.when(gone, F.col("name"))).alias("distinct_names"),
        F.count_if(present("orcid")).alias("with_orcid"),
    ).withColumn("pct_missing", percent(F.col("missing"), F.col("total")))


def name_collisions(nodes: DataFrame) -> DataFrame:
    """``name, n, ids`` of the names that several ids of ``nodes(id, name)`` share."""
    return nodes.groupBy("name").agg(F.count_distinct("id").alias("n"), F.array_join(F.sort_array(F.collect_set(F.col("id").cast("string"))), ",").alias("ids")).where("n > 1")
