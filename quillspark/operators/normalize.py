"""Nested works to flat records, search corpora and graph nodes: projections without UDFs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import none_if_empty, present, reconstruct, strip, word_count

#: The id prefix that is cut and the domestic country of the affiliation flags.
ID_PREFIX = "https://openalex.org/"
HOME = "KE"


def short_id(x: Column, default: str | None = None) -> Column:
    out = F.when(present(x), F.replace(x, F.lit(ID_PREFIX), F.lit("")))
    return F.coalesce(out, F.lit(default)) if default is not None else out


def normalize_works(raw: DataFrame, home: str = HOME) -> DataFrame:
    """31 columns of each nested work; nulls and missing fields alike become null."""
    authorships = F.coalesce("authorships", F.array().cast(raw.schema["authorships"].dataType))
    named = F.filter(authorships, lambda a: present(a["author"]["display_name"]))
    authors = F.transform(
        named,
        lambda a: F.struct(
            short_id(a["author"]["id"]).alias("id"),
            a["author"]["display_name"].alias("name"),
            F.coalesce(a["raw_affiliation_strings"], F.array().cast("array<string>")).alias("raw_affiliation_strings"),
        ),
    )
    affiliated = F.flatten(F.transform(authorships, lambda a: F.coalesce(a["institutions"], F.array().cast(raw.schema["authorships"].dataType.elementType["institutions"].dataType))))
    institutions = F.transform(
        F.filter(affiliated, lambda i: present(i["display_name"])),
        lambda i: F.struct(short_id(i["id"]).alias("id"), i["display_name"].alias("name"), i["country_code"].alias("country_code"), i["ror"].alias("ror")),
    )
    topics = F.transform(
        F.filter(F.coalesce("topics", F.array().cast(raw.schema["topics"].dataType)), lambda t: present(t["display_name"])),
        lambda t: F.struct(short_id(t["id"], "").alias("id"), t["display_name"].alias("name"), t["score"].alias("score")),
    )
    concepts = F.transform(
        F.filter(F.coalesce("concepts", F.array().cast(raw.schema["concepts"].dataType)), lambda c: present(c["display_name"])),
        lambda c: F.struct(short_id(c["id"], "").alias("id"), c["display_name"].alias("name"), c["level"].alias("level"), c["score"].alias("score")),
    )
    base = raw.withColumn("_abstract", reconstruct("abstract_inverted_index")).withColumns({"_authors": authors, "_institutions": institutions, "_all": affiliated, "_topics": topics, "_concepts": concepts})
    return base.select(
        short_id(F.col("id")).alias("id"),
        F.col("id").alias("raw_id"),
        "doi", "title", "publication_year", "publication_date", "type",
        F.col("primary_location.source.display_name").alias("source_name"),
        F.col("primary_location.source.issn_l").alias("source_issn"),
        F.coalesce("open_access.is_oa", F.lit(False)).alias("is_oa"),
        F.col("open_access.oa_status").alias("oa_status"),
        F.col("open_access.oa_url").alias("oa_url"),
        F.col("_abstract").isNotNull().alias("abstract_available"),
        F.col("_abstract").alias("abstract_text"),
        word_count("_abstract").alias("abstract_word_count"),
        search_text("title", F.col("_topics.name"), "_abstract").alias("search_text"),
        F.size("_authors").alias("authors_count"), F.col("_authors").alias("authors"),
        F.size("_institutions").alias("institutions_count"), F.col("_institutions").alias("institutions"),
        F.exists("_all", lambda i: i["country_code"].eqNullSafe(home)).alias("has_ke_institution"),
        F.exists("_all", lambda i: F.coalesce(i["country_code"] != home, F.lit(False))).alias("has_international_institution"),
        F.col("primary_topic.display_name").alias("primary_topic"),
        F.col("primary_topic.subfield.display_name").alias("primary_topic_subfield"),
        F.col("primary_topic.field.display_name").alias("primary_topic_field"),
        F.col("primary_topic.domain.display_name").alias("primary_topic_domain"),
        F.size("_topics").alias("topics_count"), F.col("_topics").alias("topics"),
        F.size("_concepts").alias("concepts_count"), F.col("_concepts").alias("concepts"),
        "cited_by_count",
    )


def search_text(title, topics: Column, abstract) -> Column:
    """Title, topic names and abstract, the non-empty ones, joined by '. '."""
    return F.concat_ws(". ", none_if_empty(title), none_if_empty(F.array_join(topics, ", ")), none_if_empty(abstract))


def retrieval_documents(works: DataFrame) -> DataFrame:
    """The search corpus, one row a work; works that repeat an id all stay."""
    return works.select(
        F.col("id").alias("paper_id"),
        F.coalesce(none_if_empty("title"), F.lit("Untitled")).alias("title"),
        F.coalesce(none_if_empty("search_text"), none_if_empty("title"), F.lit("")).alias("search_text"),
        F.col("abstract_text").alias("abstract"),
        F.col("topics.name").alias("topics"),
        F.coalesce("publication_year", F.lit(0)).alias("publication_year"),
        "doi",
        F.col("type").alias("work_type"),
        F.coalesce("is_oa", F.lit(False)).alias("is_oa"),
        "oa_status",
    )


def masked(candidates: DataFrame) -> DataFrame:
    """What a judge may see: no system, rank or score."""
    return candidates.select("query_id", "query_text", "paper_id", "title", "abstract")


def clean_title(x) -> Column:
    return F.lower(strip(x))
