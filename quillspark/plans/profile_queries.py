"""Profiling queries over documents, orders, customers and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions.text import inverted, present, reconstruct, sha12, snippet, strip, tokenize, word_count
from quillspark.operators import profile as P
from quillspark.plans import tables as T
from quillspark.plans.registry import query
from quillspark.plans.sql import TOKENS

_FIELDS = ["text", "lang", "source"]
_COMPLETE = " UNION ALL ".join(
    f"SELECT '{f}' AS field, count(*) AS total, count(*) FILTER (WHERE {f} <> '') AS present, count(*) - count(*) FILTER (WHERE {f} <> '') AS missing, round(count(*) FILTER (WHERE {f} <> '') * 100.0 / count(*), 2) AS pct_present, round((count(*) - count(*) FILTER (WHERE {f} <> '')) * 100.0 / count(*), 2) AS pct_missing FROM documents"
    for f in _FIELDS
)


@query("completeness", _COMPLETE)
def completeness(spark, sf):
    return P.completeness(T.read(spark, sf, "documents"), {f: present(f) for f in _FIELDS})


_M = {"n_chars": ("documents", "n_chars"), "acctbal": ("customer", "c_acctbal"), "totalprice": ("orders", "o_totalprice")}


@query("summary_stats", " UNION ALL ".join(f"SELECT '{m}' AS measure, count({c}) AS n, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 2) AS mean, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 2) AS median FROM {t}" for m, (t, c) in _M.items()))
def summary_stats(spark, sf):
    out = None
    for m, (t, c) in _M.items():
        row = P.summary_stats(T.read(spark, sf, t), {m: F.col(c)})
        out = row if out is None else out.unionByName(row)
    return out


@query("value_distribution", "SELECT lang AS value, count(*) AS n FROM documents WHERE lang <> '' GROUP BY 1")
def value_distribution(spark, sf):
    return P.value_distribution(T.read(spark, sf, "documents"), "lang")


@query("value_distribution_top", "SELECT p_type AS value, count(*) AS n FROM part WHERE p_type <> '' GROUP BY 1 ORDER BY n DESC, value LIMIT 15")
def value_distribution_top(spark, sf):
    return P.value_distribution(T.read(spark, sf, "part"), "p_type", 15)


@query("years_by_text", "SELECT CAST(year(o_orderdate) AS VARCHAR) AS value, count(*) AS n FROM orders GROUP BY 1")
def years_by_text(spark, sf):
    return P.value_distribution(T.read(spark, sf, "orders").withColumn("y", F.year("o_orderdate")), "y").orderBy("value")


@query("duplicates", "SELECT 'title' AS key, substr(sha256(text), 1, 12) AS value, n FROM (SELECT lower(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS text, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1) WHERE text <> ''")
def duplicates(spark, sf):
    found = P.duplicates(T.read(spark, sf, "documents"), {"title": strip(F.lower("text"))})
    return found.select("key", F.substring(F.sha2("value", 256), 1, 12).alias("value"), "n")


@query("anomalies", "SELECT count(*) FILTER (WHERE year(o_orderdate) < 1993 OR year(o_orderdate) > 1997) AS anomalous_years, count(*) FILTER (WHERE NOT o_orderstatus = 'O') AS without_domestic FROM orders")
def anomalies(spark, sf):
    return P.anomalies(T.read(spark, sf, "orders"), F.year("o_orderdate"), 1993, 1997, F.col("o_orderstatus") == "O")


_FLAGS = "SELECT l_orderkey, bool_or(n_name = 'NATION_0') AS d, bool_or(n_name <> 'NATION_0') AS i FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1"


@query("collaboration", f"SELECT count(*) AS total, count(*) FILTER (WHERE d AND i) AS collaborations, round(count(*) FILTER (WHERE d AND i) * 100.0 / count(*), 2) AS pct FROM ({_FLAGS})")
def collaboration(spark, sf):
    at = T.read(spark, sf, "lineitem").select("l_orderkey", F.col("l_suppkey").cast("string").alias("institution_id")).join(T.institutions(spark, sf), "institution_id")
    flags = at.groupBy("l_orderkey").agg(F.bool_or(F.col("country") == T.HOME).alias("d"), F.bool_or(F.col("country") != T.HOME).alias("i"))
    return P.collaboration(flags, F.col("d"), F.col("i"))


@query("institution_counts", """WITH a AS (SELECT l_orderkey AS p, s_name AS name, n_name AS country FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
SELECT 'domestic' AS kind, name, count(*) AS n, count(DISTINCT p) AS n_papers FROM a WHERE country = 'NATION_0' GROUP BY 2
UNION ALL SELECT 'international', name || ' (' || country || ')', count(*), count(DISTINCT p) FROM a WHERE country <> 'NATION_0' GROUP BY 2
UNION ALL SELECT 'country', country, count(*), count(DISTINCT p) FROM a WHERE country <> 'NATION_0' GROUP BY 2""")
def institution_counts(spark, sf):
    at = T.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_suppkey").cast("string").alias("institution_id"))
    return P.institution_counts(at.join(T.institutions(spark, sf), "institution_id"), T.HOME)


@query("missing_ids", "SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS missing, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END) AS distinct_names, count(*) FILTER (WHERE o_orderpriority <> '') AS with_orcid, round(count(*) FILTER (WHERE o_orderstatus = 'F') * 100.0 / count(*), 2) AS pct_missing FROM orders")
def missing_ids(spark, sf):
    rows = T.read(spark, sf, "orders").select(F.when(F.col("o_orderstatus") != "F", F.col("o_orderkey").cast("string")).alias("author_id"), F.col("o_orderpriority").alias("name"), F.col("o_orderpriority").alias("orcid"))
    return P.missing_ids(rows)


@query("token_length_profile", f"WITH {TOKENS} SELECT count(*) AS n, max(dl) AS longest, round(avg(dl), 2) AS mean, round(quantile_cont(CAST(dl AS DOUBLE), 0.95), 2) AS p95, count(*) FILTER (WHERE dl > 512) AS over_limit, round(count(*) FILTER (WHERE dl > 512) * 100.0 / count(*), 2) AS pct_over FROM (SELECT len(words) AS dl FROM tokens)")
def token_length_profile(spark, sf):
    dl = T.corpus(spark, sf).select(F.size(tokenize("search_text")).alias("dl"))
    out = dl.agg(F.count("*").alias("n"), F.max("dl").alias("longest"), F.round(F.avg("dl"), 2).alias("mean"), F.round(F.percentile("dl", 0.95), 2).alias("p95"), F.count_if(F.col("dl") > 512).alias("over_limit"))
    return out.withColumn("pct_over", P.percent(F.col("over_limit"), F.col("n")))


@query("word_counts", "SELECT doc_id, len([x FOR x IN regexp_split_to_array(text, '\\s+') IF x <> '']) AS n_words FROM documents")
def word_counts(spark, sf):
    return T.read(spark, sf, "documents").select("doc_id", word_count("text").alias("n_words"))


@query("invert_abstract", "SELECT doc_id, substr(sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), 1, 12) AS digest FROM documents")
def invert_abstract(spark, sf):
    """Texts inverted to word positions and put together again."""
    docs = inverted(T.read(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")
    # A text without words has none to put together; it is empty, not missing.
    back = docs.select("doc_id", F.when(F.col("inverted").isNotNull(), F.coalesce(reconstruct("inverted"), F.lit(""))).alias("text"))
    return back.select("doc_id", F.substring(F.sha2("text", 256), 1, 12).alias("digest"))


@query("snippets", "SELECT doc_id, CASE WHEN text <> '' THEN substr(text, 1, 200) || '...' ELSE source END AS snippet FROM documents")
def snippets(spark, sf):
    return T.read(spark, sf, "documents").select("doc_id", snippet("text", "source").alias("snippet"))


@query("text_digests", "SELECT doc_id, substr(sha256(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))), 1, 12) AS digest FROM documents")
def text_digests(spark, sf):
    return T.read(spark, sf, "documents").select("doc_id", sha12("text").alias("digest"))


@query("event_properties", "SELECT event_type, count(*) AS n, CAST(sum(CAST(props->>'k' AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def event_properties(spark, sf):
    """Nested JSON by an explicit schema."""
    props = F.from_json("props", "k bigint")
    return T.read(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(props["k"]).alias("total"))


@query("missing_id_names", "SELECT o_orderpriority AS name, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 ORDER BY n DESC, name LIMIT 5")
def missing_id_names(spark, sf):
    rows = T.read(spark, sf, "orders").select(F.when(F.col("o_orderstatus") != "F", F.col("o_orderkey").cast("string")).alias("author_id"), F.col("o_orderpriority").alias("name"))
    return P.missing_id_names(rows)


@query("duplicate_samples", "SELECT * FROM (SELECT 'name' AS key, p_name AS value, count(*) AS n FROM part GROUP BY 2 HAVING count(*) > 1 ORDER BY n DESC, value LIMIT 5) UNION ALL SELECT * FROM (SELECT 'brand', p_brand, count(*) AS n FROM part GROUP BY 2 HAVING count(*) > 1 ORDER BY n DESC, p_brand LIMIT 5)")
def duplicate_samples(spark, sf):
    return P.duplicate_samples(T.read(spark, sf, "part"), {"name": F.col("p_name"), "brand": F.col("p_brand")})
