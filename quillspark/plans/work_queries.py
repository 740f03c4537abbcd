"""Normalization, graph building and scans over nested works made of the test tables.

Orders are works and their lines are authorships, topics and concepts, sorted by line. Ids, names,
countries and places are left out by rules on the keys, some works come twice, and inverted
abstracts have gaps, shared and negative places. The SQL builds what must come out, flat.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import graph as G
from quillspark.operators import normalize as N
from quillspark.operators import profile as P
from quillspark.plans import tables as T
from quillspark.plans.registry import query
from quillspark.runtime import shared_path
from quillspark.schemas import RAW_WORK
from quillspark.sources.files import append_jsonl, corrupt_lines, count_records, read_jsonl

WORKS = """
w AS (
  SELECT o_orderkey AS o, CASE WHEN o_orderkey % 97 <> 5 THEN 'https://openalex.org/W' || o_orderkey END AS raw_id, CASE WHEN o_orderkey % 97 <> 5 THEN 'W' || o_orderkey END AS id,
    CASE WHEN o_orderkey % 3 = 0 THEN '10.1/' || o_orderkey END AS doi,
    CASE WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 11 <> 0 THEN 'Work ' || o_orderkey END AS title,
    CASE WHEN o_orderkey % 19 = 0 THEN 0 WHEN o_orderkey % 17 <> 0 THEN year(o_orderdate) END AS publication_year,
    strftime(o_orderdate, '%Y-%m-%d') AS publication_date, o_orderpriority AS type, o_orderkey % 100 AS cited_by_count,
    CASE WHEN o_orderkey % 7 <> 0 THEN 'Journal ' || (o_custkey % 5) END AS source_name, CASE WHEN o_orderkey % 7 <> 0 THEN 'ISSN' || (o_custkey % 5) END AS source_issn,
    o_orderkey % 5 <> 0 AND o_orderstatus = 'O' AS is_oa, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS oa_status,
    CASE o_orderkey % 6 WHEN 3 THEN 'a' || o_orderkey || ' b b' WHEN 4 THEN 'x    y' WHEN 5 THEN 'p q' END AS abstract_text,
    CASE o_orderkey % 6 WHEN 3 THEN 3 WHEN 4 THEN 2 WHEN 5 THEN 2 ELSE 0 END AS abstract_word_count
  FROM orders),
l AS (
  SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k,
    l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, p_name, p_brand, p_type, s_name, n_nationkey AS nk, l_discount AS score, l_tax AS tax, l_returnflag AS flag
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
a AS (SELECT o, k, CASE WHEN pk % 9 <> 0 THEN 'A' || pk END AS id, p_name || ' ' || (ln % 2) AS name, CASE WHEN ln <> 1 THEN s_name ELSE '' END AS affiliation FROM l WHERE ln <> 4),
i0 AS (SELECT o, k, CASE WHEN sk % 10 <> 3 THEN 'I' || sk END AS id, CASE WHEN ln <> 5 THEN s_name || ' ' || (ln % 2) END AS name,
  CASE WHEN nk = 0 THEN 'KE' WHEN nk % 8 <> 7 THEN 'N' || nk END AS country_code, CASE WHEN sk % 2 = 0 THEN 'ror' || sk END AS ror FROM l WHERE ln <> 6),
i AS (SELECT * FROM i0 WHERE name IS NOT NULL),
t AS (SELECT o, k, CASE WHEN ln <> 3 THEN 'T' || p_brand ELSE '' END AS id, p_brand || ' ' || p_type AS name, score FROM l WHERE ln <> 7),
c AS (SELECT o, k, 'C' || flag AS id, 'Concept ' || flag AS name, ln AS level, tax AS score FROM l WHERE ln <> 2),
pt AS (SELECT o, p_brand || ' ' || p_type AS primary_topic, p_type AS subfield, 'F' || (pk % 3) AS field FROM l WHERE k = 1 AND o % 23 <> 0),
n AS (
  SELECT w.*, w.abstract_text IS NOT NULL AS abstract_available,
    (SELECT count(*) FROM a WHERE a.o = w.o) AS authors_count, (SELECT count(*) FROM i WHERE i.o = w.o) AS institutions_count,
    EXISTS (SELECT 1 FROM i0 WHERE i0.o = w.o AND country_code = 'KE') AS has_ke_institution, EXISTS (SELECT 1 FROM i0 WHERE i0.o = w.o AND country_code <> 'KE') AS has_international_institution,
    primary_topic, subfield, field, CASE WHEN primary_topic IS NOT NULL THEN 'Domain' END AS domain,
    (SELECT count(*) FROM t WHERE t.o = w.o) AS topics_count, (SELECT count(*) FROM c WHERE c.o = w.o) AS concepts_count,
    concat_ws('. ', nullif(title, ''), (SELECT string_agg(name, ', ' ORDER BY k) FROM t WHERE t.o = w.o), abstract_text) AS search_text
  FROM w LEFT JOIN pt USING (o)),
m AS (
  SELECT *, 0 AS mention FROM n
  UNION ALL SELECT * REPLACE ('Second ' || o AS title, concat_ws('. ', 'Second ' || o, (SELECT string_agg(name, ', ' ORDER BY k) FROM t WHERE t.o = n.o), abstract_text) AS search_text, 1999 AS publication_year), 1 FROM n WHERE o % 40 = 0)
"""
#: Ids of works and their mentions in order, for the graph.
_IN_GRAPH = "g AS (SELECT *, 2 * o + mention AS ordinal FROM m WHERE id IS NOT NULL)"
_SYNTH = "'{0}_SYNTH_' || substr(sha256(lower(trim({1}))), 1, 12)"


def raw_works(spark, sf, mention: int = 0):
    """The nested works; those of mention 1 repeat every fortieth id with another title and year."""
    url = lambda kind, key: F.concat(F.lit(N.ID_PREFIX + kind), key.cast("string"))
    lines = T.read(spark, sf, "lineitem").join(T.read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    lines = lines.join(T.read(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(T.read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    columns = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "p_name", "p_brand", "p_type", "s_name", "n_nationkey", "l_discount", "l_tax", "l_returnflag"]
    rows = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("lines"))
    works = T.read(spark, sf, "orders").join(rows, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    if mention:
        works = works.where("o_orderkey % 40 = 0")
    o, odd = F.col("o_orderkey"), lambda x: x["l_linenumber"] % 2
    topic = lambda x: F.concat(x["p_brand"], F.lit(" "), x["p_type"])
    author = lambda x: F.struct(F.when(x["l_partkey"] % 9 != 0, url("A", x["l_partkey"])).alias("id"), F.when(x["l_linenumber"] == 4, "").otherwise(F.concat(x["p_name"], F.lit(" "), odd(x).cast("string"))).alias("display_name"), F.lit(None).cast("string").alias("orcid"))
    place = lambda x: F.struct(F.when(x["l_suppkey"] % 10 != 3, url("I", x["l_suppkey"])).alias("id"), F.when(x["l_linenumber"] != 5, F.concat(x["s_name"], F.lit(" "), odd(x).cast("string"))).alias("display_name"), F.when(x["n_nationkey"] == 0, "KE").when(x["n_nationkey"] % 8 != 7, F.concat(F.lit("N"), x["n_nationkey"].cast("string"))).alias("country_code"), F.when(x["l_suppkey"] % 2 == 0, F.concat(F.lit("ror"), x["l_suppkey"].cast("string"))).alias("ror"))
    authorship = lambda x: F.struct(author(x).alias("author"), F.when(x["l_linenumber"] != 1, F.array(x["s_name"])).alias("raw_affiliation_strings"), F.when(x["l_linenumber"] != 6, F.array(place(x))).alias("institutions"))
    first = F.get("lines", 0)
    ints = lambda *x: F.array(*map(F.lit, x)).cast("array<int>")
    abstract = (
        F.when(o % 6 == 1, F.create_map().cast("map<string,array<int>>")).when(o % 6 == 2, F.create_map(F.lit("test"), ints()))
        .when(o % 6 == 3, F.create_map(F.concat(F.lit("a"), o.cast("string")), ints(0), F.lit("b"), ints(1, 2)))
        .when(o % 6 == 4, F.create_map(F.lit("x"), ints(0), F.lit("y"), ints(4))).when(o % 6 == 5, F.create_map(F.lit("p"), ints(0, 1), F.lit("q"), ints(1), F.lit("n"), ints(-1)))
    )
    named = lambda x, name: F.struct(F.lit(x) if isinstance(x, str) else x).cast(f"struct<{name}: string>")
    main = F.struct(topic(first).alias("display_name"), named(first["p_type"], "display_name").alias("subfield"), named(F.concat(F.lit("F"), (first["l_partkey"] % 3).cast("string")), "display_name").alias("field"), named("Domain", "display_name").alias("domain"))
    source = F.struct(F.struct(F.concat(F.lit("Journal "), (F.col("o_custkey") % 5).cast("string")).alias("display_name"), F.concat(F.lit("ISSN"), (F.col("o_custkey") % 5).cast("string")).alias("issn_l")).alias("source"))
    access = F.struct((F.col("o_orderstatus") == "O").alias("is_oa"), F.col("o_orderstatus").alias("oa_status"), F.lit(None).cast("string").alias("oa_url"))
    title = F.concat(F.lit("Second "), o.cast("string")) if mention else F.when(o % 13 == 0, "").when(o % 11 != 0, F.concat(F.lit("Work "), o.cast("string")))
    year = F.lit(1999) if mention else F.when(o % 19 == 0, 0).when(o % 17 != 0, F.year("o_orderdate"))
    out = works.select(
        F.when(o % 97 != 5, url("W", o)).alias("id"), F.when(o % 3 == 0, F.concat(F.lit("10.1/"), o.cast("string"))).alias("doi"), title.alias("title"),
        year.alias("publication_year"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("publication_date"), F.col("o_orderpriority").alias("type"), (o % 100).cast("int").alias("cited_by_count"),
        F.when(o % 7 != 0, source).alias("primary_location"), F.when(o % 5 != 0, access).alias("open_access"), abstract.alias("abstract_inverted_index"),
        F.transform("lines", authorship).alias("authorships"), F.when((o % 23 != 0) & first.isNotNull(), main).alias("primary_topic"),
        F.transform("lines", lambda x: F.struct(F.when(x["l_linenumber"] != 3, F.concat(F.lit(N.ID_PREFIX + "T"), x["p_brand"])).alias("id"), F.when(x["l_linenumber"] != 7, topic(x)).alias("display_name"), x["l_discount"].alias("score"))).alias("topics"),
        F.transform("lines", lambda x: F.struct(F.concat(F.lit(N.ID_PREFIX + "C"), x["l_returnflag"]).alias("id"), F.when(x["l_linenumber"] != 2, F.concat(F.lit("Concept "), x["l_returnflag"])).alias("display_name"), x["l_linenumber"].alias("level"), x["l_tax"].alias("score"))).alias("concepts"),
        o.alias("o_orderkey"),
    )
    return out


def works(spark, sf, mention: int = 0):
    return N.normalize_works(raw_works(spark, sf, mention))


_FLAT = ["raw_id", "id", "doi", "title", "publication_year", "publication_date", "type", "cited_by_count", "source_name", "source_issn", "is_oa", "oa_status", "abstract_text", "abstract_word_count", "abstract_available", "authors_count", "institutions_count", "has_ke_institution", "has_international_institution", "primary_topic", "topics_count", "concepts_count", "search_text"]
_HIERARCHY = {"primary_topic_subfield": "subfield", "primary_topic_field": "field", "primary_topic_domain": "domain"}


@query("normalize_works", f"WITH {WORKS} SELECT {', '.join(_FLAT)}, {', '.join(f'{b} AS {a}' for a, b in _HIERARCHY.items())} FROM m")
def normalize_works(spark, sf):
    return works(spark, sf).unionByName(works(spark, sf, 1)).select(*_FLAT, *_HIERARCHY)


def _list(name: str, table: str, sql: str, *columns: str):
    @query(f"normalized_{name}", f"WITH {WORKS} SELECT raw_id, {sql} FROM {table} x JOIN w ON w.o = x.o WHERE raw_id IS NOT NULL")
    def run(spark, sf):
        rows = works(spark, sf).where("raw_id is not null").select("raw_id", F.explode(name).alias("x"))
        return rows.selectExpr("raw_id", *columns)


_list("authors", "a", "x.id, name, affiliation", "x.id", "x.name", "array_join(x.raw_affiliation_strings, ';') AS affiliation")
_list("institutions", "i", "x.id, name, country_code, ror", "x.id", "x.name", "x.country_code", "x.ror")
_list("topics", "t", "x.id, name, score", "x.id", "x.name", "x.score")
_list("concepts", "c", "x.id, name, level, score", "x.id", "x.name", "x.level", "x.score")

_TESTS = {
    "OpenAlex ID": "id <> ''", "DOI": "doi <> ''", "Title": "title <> ''", "Publication Year": "publication_year IS NOT NULL", "Publication Date": "publication_date <> ''", "Work Type": "type <> ''",
    "Source / Journal": "source_name <> ''", "Abstract (Reconstructed)": "abstract_available", "Authors": "authors_count > 0", "Author Identifiers": "o IN (SELECT o FROM a WHERE id <> '')",
    "Institutions / Affiliations": "institutions_count > 0", "Kenyan Institution Affiliation": "has_ke_institution", "Institution ROR ID": "o IN (SELECT o FROM i WHERE ror <> '')", "Primary Topic": "primary_topic <> ''",
    "Topics List": "topics_count > 0", "Concepts List": "concepts_count > 0", "Open Access Status": "oa_status <> ''", "Citations Count": "cited_by_count IS NOT NULL",
}


@query("work_completeness", f"WITH {WORKS}, f AS (" + " UNION ALL ".join(f"SELECT '{k}' AS field, count(*) AS total, count(*) FILTER (WHERE {v}) AS present FROM n" for k, v in _TESTS.items()) + ") SELECT field, total, present, total - present AS missing, round(present * 100.0 / total, 2) AS pct_present, round((total - present) * 100.0 / total, 2) AS pct_missing FROM f")
def work_completeness(spark, sf):
    return P.completeness(works(spark, sf), P.work_fields())


@query("search_corpus", f"""WITH {WORKS} SELECT id AS paper_id, coalesce(nullif(title, ''), 'Untitled') AS title, search_text, abstract_text AS abstract, coalesce((SELECT string_agg(name, '|' ORDER BY k) FROM t WHERE t.o = n.o), '') AS topics,
coalesce(publication_year, 0) AS publication_year, doi, type AS work_type, is_oa, oa_status FROM n""")
def search_corpus(spark, sf):
    return N.retrieval_documents(works(spark, sf)).withColumn("topics", F.array_join("topics", "|"))


def graph(spark, sf):
    ordinal = 2 * F.expr("cast(substr(id, 2) as long)")
    rows = works(spark, sf).withColumn("ordinal", ordinal).unionByName(works(spark, sf, 1).withColumn("ordinal", ordinal + 1))
    return G.build_graph(rows)


@query("graph_papers", f"""WITH {WORKS}, {_IN_GRAPH} SELECT id, coalesce(nullif(arg_min(coalesce(title, ''), ordinal), ''), 'Untitled') AS title, arg_min(struct_pack(y := publication_year), ordinal).y AS publication_year,
min(raw_id) AS openalex_url FROM g GROUP BY id""")
def graph_papers(spark, sf):
    return graph(spark, sf)["papers"].select("id", "title", "publication_year", "openalex_url")


@query("graph_researchers", f"""WITH {WORKS}, {_IN_GRAPH}, r AS (SELECT coalesce(a.id, {_SYNTH.format('AUTH', 'name')}) AS id, a.id AS known, name, row_number() OVER (PARTITION BY coalesce(a.id, {_SYNTH.format('AUTH', 'name')}) ORDER BY ordinal, k) AS nth FROM a JOIN g ON g.o = a.o)
SELECT id, name AS display_name, 'https://openalex.org/' || known AS openalex_url, starts_with(id, 'AUTH_SYNTH_') AS synthetic FROM r WHERE nth = 1""")
def graph_researchers(spark, sf):
    return graph(spark, sf)["researchers"].select("id", "display_name", "openalex_url", F.col("id").startswith("AUTH_SYNTH_").alias("synthetic"))


@query("graph_institutions", f"""WITH {WORKS}, {_IN_GRAPH}, r AS (SELECT coalesce(i.id, {_SYNTH.format('INST', 'name')}) AS id, i.id AS known, name, ror, country_code, row_number() OVER (PARTITION BY coalesce(i.id, {_SYNTH.format('INST', 'name')}) ORDER BY ordinal, k) AS nth FROM i JOIN g ON g.o = i.o)
SELECT id, name AS display_name, ror, country_code, 'https://openalex.org/' || known AS openalex_url FROM r WHERE nth = 1""")
def graph_institutions(spark, sf):
    return graph(spark, sf)["institutions"].select("id", "display_name", "ror", "country_code", "openalex_url")


@query("graph_topics", f"""WITH {WORKS}, {_IN_GRAPH}, r AS (SELECT t.id, name, name = primary_topic AS main, subfield, field, domain, row_number() OVER (PARTITION BY t.id ORDER BY ordinal, k) AS nth FROM t JOIN g ON g.o = t.o WHERE t.id <> '')
SELECT id, name AS display_name, CASE WHEN main THEN subfield END AS subfield, CASE WHEN main THEN field END AS field, CASE WHEN main THEN domain END AS domain FROM r WHERE nth = 1""")
def graph_topics(spark, sf):
    return graph(spark, sf)["topics"].select("id", "display_name", "subfield", "field", "domain")


@query("graph_years", f"WITH {WORKS}, {_IN_GRAPH} SELECT DISTINCT publication_year AS value FROM g WHERE publication_year <> 0")
def graph_years(spark, sf):
    return graph(spark, sf)["years"]


@query("graph_edges", f"""WITH {WORKS}, {_IN_GRAPH}, e AS (
  SELECT 'Researcher' AS source_type, coalesce(a.id, {_SYNTH.format('AUTH', 'name')}) AS source_id, 'Paper' AS target_type, g.id AS target_id, 'AUTHORED' AS rel_type, CAST(NULL AS DOUBLE) AS score, ordinal, k FROM a JOIN g ON g.o = a.o
  UNION ALL SELECT 'Paper', g.id, 'Institution', coalesce(i.id, {_SYNTH.format('INST', 'name')}), 'AFFILIATED_WITH', NULL, ordinal, k FROM i JOIN g ON g.o = i.o
  UNION ALL SELECT 'Paper', g.id, 'Topic', t.id, 'ABOUT', score, ordinal, k FROM t JOIN g ON g.o = t.o WHERE t.id <> ''
  UNION ALL SELECT 'Paper', id, 'Year', CAST(publication_year AS VARCHAR), 'PUBLISHED_IN', NULL, ordinal, 0 FROM g WHERE publication_year <> 0)
SELECT source_type, source_id, target_type, target_id, rel_type, score FROM (SELECT *, row_number() OVER (PARTITION BY source_type, source_id, target_type, target_id, rel_type ORDER BY ordinal, k) AS nth FROM e) WHERE nth = 1""")
def graph_edges(spark, sf):
    return graph(spark, sf)["edges"]


@query("node_upsert", """WITH inc AS (SELECT s_suppkey, s_name, row_number() OVER (PARTITION BY s_suppkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) AS nth, l_returnflag FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_suppkey % 3 <> 0)
SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, l_returnflag AS flag FROM inc WHERE nth = 1 UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'old', 'old' FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 2 = 0""")
def node_upsert(spark, sf):
    """Suppliers merged from every line that names them, in the order of lines: the last one wins."""
    suppliers = T.read(spark, sf, "supplier")
    old = suppliers.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").cast("string").alias("id"), F.lit("old").alias("name"), F.lit("old").alias("flag"))
    new = T.read(spark, sf, "lineitem").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).where("s_suppkey % 3 <> 0")
    new = new.select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), F.col("l_returnflag").alias("flag"), F.struct("l_orderkey", "l_linenumber", "l_extendedprice").alias("ordinal"))
    return G.upsert_nodes(old, new, ["id"], "ordinal")


@query("jsonl_scan", f"WITH {WORKS} SELECT id, title, search_text, authors_count, (SELECT count(*) FROM w) AS n_lines, 0 AS n_corrupt FROM n")
def jsonl_scan(spark, sf):
    """Works appended as JSON lines in two runs, counted, scanned by schema and normalized."""
    path = shared_path(spark, "works-jsonl")
    raw = raw_works(spark, sf)
    for part in (0, 1):
        append_jsonl(raw.where(F.col("o_orderkey") % 2 == part).drop("o_orderkey"), path, "lz4")
    found = N.normalize_works(read_jsonl(spark, path, RAW_WORK)).select("id", "title", "search_text", "authors_count")
    return found.withColumns({"n_lines": F.lit(count_records(spark, path)), "n_corrupt": F.lit(corrupt_lines(spark, path, RAW_WORK).count())})
