"""Explicit schemas of every table; nothing is inferred at run time."""

RAW_WORK = """
id STRING, doi STRING, title STRING, publication_year INT, publication_date STRING, type STRING, cited_by_count INT,
primary_location STRUCT<source: STRUCT<display_name: STRING, issn_l: STRING>>,
open_access STRUCT<is_oa: BOOLEAN, oa_status: STRING, oa_url: STRING>,
abstract_inverted_index MAP<STRING, ARRAY<INT>>,
authorships ARRAY<STRUCT<
  author: STRUCT<id: STRING, display_name: STRING, orcid: STRING>,
  raw_affiliation_strings: ARRAY<STRING>,
  institutions: ARRAY<STRUCT<id: STRING, display_name: STRING, country_code: STRING, ror: STRING>>>>,
primary_topic STRUCT<display_name: STRING, subfield: STRUCT<display_name: STRING>, field: STRUCT<display_name: STRING>, domain: STRUCT<display_name: STRING>>,
topics ARRAY<STRUCT<id: STRING, display_name: STRING, score: DOUBLE>>,
concepts ARRAY<STRUCT<id: STRING, display_name: STRING, level: INT, score: DOUBLE>>
"""

INSTITUTION = """
id STRING, openalex_id STRING, ror STRING, display_name STRING, country_code STRING, type STRING, homepage_url STRING,
works_count INT, cited_by_count INT, geo MAP<STRING, STRING>, lineage ARRAY<STRING>
"""

QRELS = "query_id STRING, paper_id STRING, relevance INT"
EDGES = "source_type STRING, source_id STRING, target_type STRING, target_id STRING, rel_type STRING, score DOUBLE"
CORRECTIONS = "query_id STRING, paper_id STRING, relevance INT, rationale STRING"
RULES = "query_id STRING, priority INT, all_of ARRAY<ARRAY<STRING>>, label INT, note STRING"
EMBEDDING_META = "model_name STRING, dimension INT, corpus_size BIGINT, normalization STRING, similarity STRING"
CORRUPT = "_corrupt_record"
