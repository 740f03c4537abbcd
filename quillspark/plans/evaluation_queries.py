"""Evaluation and judgment queries.

Three systems answer the benchmark passages: keyword search over documents, cosine search from the
vector with the passage's number, and its hybrid. Labels of the pooled documents serve as judgments.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions.text import excerpt
from quillspark.operators import evaluation as E
from quillspark.operators import judgments as J
from quillspark.operators import search as S
from quillspark.plans import tables as T
from quillspark.plans.registry import ORACLES, query
from quillspark.plans.search_queries import entities, index
from quillspark.plans.sql import BM25, ENTITIES, VECTORS, cosine_top, hybrid, overlaps
from quillspark.runtime import kept, stash

PAIRS = [("A", "B"), ("B", "C"), ("A", "C")]

_RESULTS = f"""{BM25}, {VECTORS}, q AS (SELECT item_id, e FROM benchmark JOIN unit ON vec_id = item_id),
cand AS ({cosine_top('q', 'item_id', 20)}), {ENTITIES}, {overlaps('cand')}, {hybrid("('default', 0.7::DOUBLE)")},
results AS (SELECT 'A' AS system, query_id, rank, paper_id FROM bm25_top UNION ALL SELECT 'B', query_id, rank, paper_id FROM cand WHERE rank <= 10 UNION ALL SELECT 'C', query_id, rank, paper_id FROM hyb)
"""
_POOL = f"""{_RESULTS}, pool AS (SELECT query_id, paper_id, string_agg(system, ',' ORDER BY system) AS retrieved_by, string_agg(system || '=' || rank, ',' ORDER BY system) AS source_ranks FROM results GROUP BY 1, 2)"""
_QRELS = f"""{_POOL}, qrels AS (SELECT query_id, paper_id, CASE WHEN quality = 1 AND toxic = 0 THEN 2 WHEN quality = 1 THEN 1 ELSE 0 END AS relevance FROM pool JOIN labels ON doc_id = paper_id)"""
_METRICS = f"""{_QRELS},
got AS (
  SELECT system, query_id, count(*) FILTER (WHERE rank <= 5 AND relevance >= 1) AS h5, count(*) FILTER (WHERE rank <= 10 AND relevance >= 1) AS h10, min(rank) FILTER (WHERE relevance >= 1) AS first,
    coalesce(sum((2 ** relevance - 1) / log2(rank + 1)) FILTER (WHERE rank <= 5), 0) AS dcg5, coalesce(sum((2 ** relevance - 1) / log2(rank + 1)) FILTER (WHERE rank <= 10), 0) AS dcg10, count(relevance) AS judged
  FROM results LEFT JOIN qrels USING (query_id, paper_id) GROUP BY 1, 2),
ideal AS (
  SELECT query_id, count(*) FILTER (WHERE relevance >= 1) AS relevant, sum(CASE WHEN k <= 5 THEN (2 ** relevance - 1) / log2(k + 1) ELSE 0 END) AS i5, sum(CASE WHEN k <= 10 THEN (2 ** relevance - 1) / log2(k + 1) ELSE 0 END) AS i10
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, paper_id) AS k FROM qrels) GROUP BY 1),
metrics AS (
  SELECT s.system, b.item_id AS query_id, round(coalesce(h5, 0) / 5.0, 4) AS p_at_5, round(coalesce(h10, 0) / 10.0, 4) AS p_at_10,
    round(CASE WHEN relevant > 0 THEN coalesce(h10, 0) / relevant ELSE 0 END, 4) AS recall_at_10, round(coalesce(1.0 / first, 0), 4) AS mrr,
    round(CASE WHEN i5 > 0 THEN least(1.0, coalesce(dcg5, 0) / i5) ELSE 0 END, 4) AS ndcg_at_5, round(CASE WHEN i10 > 0 THEN least(1.0, coalesce(dcg10, 0) / i10) ELSE 0 END, 4) AS ndcg_at_10, coalesce(judged, 0) AS judged_hits_at_10
  FROM benchmark b CROSS JOIN (VALUES ('A'), ('B'), ('C')) s(system) LEFT JOIN got g ON g.system = s.system AND g.query_id = b.item_id LEFT JOIN ideal i ON i.query_id = b.item_id)"""
_MEANS = ", ".join(f"round(avg({m}) + 1e-9, 4) AS {m}" for m in E.METRICS)
_DIFFS = f"""{_METRICS}, long AS (UNPIVOT metrics ON {', '.join(E.METRICS)} INTO NAME metric VALUE value),
diffs AS (SELECT p.b || ' vs ' || p.a AS pair, x.metric, x.query_id, y.value - x.value AS diff FROM (VALUES ('A', 'B'), ('B', 'C'), ('A', 'C')) p(a, b) JOIN long x ON x.system = p.a JOIN long y ON y.system = p.b AND y.query_id = x.query_id AND y.metric = x.metric)"""


_INPUTS = ("documents", "benchmark", "embeddings", "lineitem", "part", "orders")


def results(spark, sf):
    """Top ten of the three systems; written once, as every metric of every query reads it."""
    return kept(spark, "results", [f"{sf}/{name}.parquet" for name in _INPUTS], lambda: _results(spark, sf))


def _results(spark, sf):
    questions = T.questions(spark, sf)
    a = S.bm25_search(index(spark, sf), questions)
    asked = questions.join(T.vectors(spark, sf), F.col("query_id") == F.col("paper_id")).select("query_id", F.col("embedding").alias("query_vector"))
    candidates = stash(S.cosine_search(T.vectors(spark, sf), asked, S.CANDIDATES), "candidates").df
    c = S.rerank(candidates, entities(spark, sf))
    keep = lambda df, name: df.select(F.lit(name).alias("system"), "query_id", "rank", "paper_id")
    return keep(a, "A").unionByName(keep(candidates.where("rank <= 10"), "B")).unionByName(keep(c, "C"))


def judged(spark, sf, found):
    labels = T.read(spark, sf, "labels").withColumn("relevance", F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).when(F.col("quality") == 1, 1).otherwise(0))
    return E.pool(found).select("query_id", "paper_id").join(labels.select(F.col("doc_id").alias("paper_id"), "relevance"), "paper_id").select("query_id", "paper_id", "relevance")


def metrics(spark, sf):
    found = results(spark, sf)
    return E.per_query(found, T.questions(spark, sf), stash(judged(spark, sf, found), "qrels").df)


@query("pool", f"WITH {_POOL} SELECT * FROM pool")
def pool(spark, sf):
    rows = E.pool(results(spark, sf))
    ranks = F.transform(F.array_sort(F.map_entries("source_ranks")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return rows.select("query_id", "paper_id", F.array_join("retrieved_by", ",").alias("retrieved_by"), F.array_join(ranks, ",").alias("source_ranks"))


@query("pool_summary", f"WITH {_POOL} SELECT 'domain_' || item_id % 4 AS domain, count(*) AS n_queries, CAST(sum(n) AS BIGINT) AS total, round(avg(n), 2) AS mean, min(n) AS min, max(n) AS max FROM (SELECT item_id, count(paper_id) AS n FROM benchmark LEFT JOIN pool ON query_id = item_id GROUP BY 1) GROUP BY 1")
def pool_summary(spark, sf):
    return E.pool_summary(E.pool(results(spark, sf)), T.questions(spark, sf))


@query("ir_metrics_per_query", f"WITH {_METRICS} SELECT * FROM metrics")
def ir_metrics_per_query(spark, sf):
    return metrics(spark, sf)


@query("ir_metrics_summary", f"WITH {_METRICS} SELECT system, count(*) AS n_queries, {_MEANS} FROM metrics GROUP BY 1")
def ir_metrics_summary(spark, sf):
    return E.summarize(metrics(spark, sf))


@query("ir_metrics_by_domain", f"WITH {_METRICS} SELECT system, 'domain_' || query_id % 4 AS domain, count(*) AS n_queries, {_MEANS} FROM metrics GROUP BY 1, 2")
def ir_metrics_by_domain(spark, sf):
    return E.summarize(metrics(spark, sf).join(T.questions(spark, sf).select("query_id", "domain"), "query_id"), "domain")


@query("ir_deltas", f"WITH {_METRICS} SELECT query_id, max(ndcg_at_10) FILTER (WHERE system = 'A') AS \"A\", max(ndcg_at_10) FILTER (WHERE system = 'B') AS \"B\", max(ndcg_at_10) FILTER (WHERE system = 'C') AS \"C\" FROM metrics GROUP BY 1")
def ir_deltas(spark, sf):
    return E.deltas(metrics(spark, sf), ["A", "B", "C"])


def _diffs(spark, sf):
    return E.paired(stash(metrics(spark, sf), "metrics").df, PAIRS)


@query("paired_ttest", f"""WITH {_DIFFS}, s AS (SELECT pair, metric, count(*) AS n, avg(diff) AS mean, coalesce(stddev_samp(diff), 0) AS sd FROM diffs GROUP BY 1, 2)
SELECT pair, metric, n, round(mean + 1e-9, 6) AS mean_diff, round(sd, 6) AS std_diff,
CASE WHEN sd < 1e-12 AND abs(mean) < 1e-12 THEN 0 WHEN sd < 1e-12 THEN sign(mean) * 'inf'::DOUBLE ELSE round(mean / (sd / sqrt(n)), 4) END AS t_stat, CASE WHEN sd < 1e-12 THEN 0 ELSE round(mean / sd, 4) END AS cohens_d FROM s""")
def paired_ttest(spark, sf):
    return E.t_test(_diffs(spark, sf)).drop("t")


#: Two-tailed p of Student's t for whole degrees of freedom v, a finite series in the angle atan(t / sqrt(v)).
_T_P = f"""WITH {_DIFFS}, s AS (SELECT pair, metric, count(*) AS n, avg(diff) AS mean, coalesce(stddev_samp(diff), 0) AS sd FROM diffs GROUP BY 1, 2),
x AS (SELECT *, n - 1 AS v, CASE WHEN sd < 1e-12 AND abs(mean) < 1e-12 THEN 0 WHEN sd < 1e-12 THEN sign(mean) * 'inf'::DOUBLE ELSE mean / (sd / sqrt(n)) END AS t FROM s),
y AS (SELECT *, CASE WHEN isinf(t) THEN pi() / 2 ELSE atan(abs(t) / sqrt(v)) END AS angle FROM x),
c AS (SELECT j, exp(sum(CASE WHEN j > 0 THEN ln(2 * j / (2 * j + 1)) ELSE 0 END) OVER (ORDER BY j)) AS odd, exp(sum(CASE WHEN j > 0 THEN ln((2 * j - 1) / (2 * j)) ELSE 0 END) OVER (ORDER BY j)) AS even FROM (SELECT CAST(unnest(generate_series(0, 2000)) AS DOUBLE) AS j)),
a AS (SELECT y.*, CASE WHEN v % 2 = 1 THEN 2 / pi() * (angle + sin(angle) * coalesce((SELECT sum(odd * cos(angle) ** (2 * j + 1)) FROM c WHERE 2 * j <= v - 3), 0)) ELSE sin(angle) * (SELECT sum(even * cos(angle) ** (2 * j)) FROM c WHERE 2 * j <= v - 2) END AS inside FROM y)
SELECT pair, metric, n, round(mean + 1e-9, 6) AS mean_diff, round(sd, 6) AS std_diff, CASE WHEN isinf(t) THEN t ELSE round(t, 4) END AS t_stat, CASE WHEN sd < 1e-12 THEN 0 ELSE round(mean / sd, 4) END AS cohens_d, abs(round(1 - inside, 6)) AS p_value FROM a"""


@query("paired_ttest_p", _T_P)
def paired_ttest_p(spark, sf):
    return E.with_t_p_value(E.t_test(_diffs(spark, sf)))


@query("wilcoxon", f"""WITH {_DIFFS}, d AS (SELECT pair, metric, round(diff, 8) AS d FROM diffs), t AS (SELECT pair, metric, count(*) AS n_total FROM d GROUP BY 1, 2),
r AS (SELECT pair, metric, d, count(*) OVER (PARTITION BY pair, metric, abs(d)) AS ties, rank() OVER (PARTITION BY pair, metric ORDER BY abs(d)) + (count(*) OVER (PARTITION BY pair, metric, abs(d)) - 1) / 2.0 AS place FROM d WHERE abs(d) > 1e-9),
s AS (SELECT t.pair, t.metric, n_total, count(d) AS n, coalesce(sum(place) FILTER (WHERE d > 0), 0) AS plus, coalesce(sum(place) FILTER (WHERE d < 0), 0) AS minus, coalesce(sum(ties * ties - 1), 0) AS tied FROM t LEFT JOIN r ON r.pair = t.pair AND r.metric = t.metric GROUP BY 1, 2, 3),
stat AS (SELECT *, least(plus, minus) AS w, n * (n + 1) * (2 * n + 1) / 24.0 - tied / 48.0 AS variance, n * (n + 1) / 4.0 AS mid FROM s)
SELECT pair, metric, n_total, n AS n_nonzero, round(CAST(w AS DOUBLE), 2) AS w_stat, round(CAST(plus AS DOUBLE), 2) AS w_plus, round(CAST(minus AS DOUBLE), 2) AS w_minus,
CASE WHEN variance <= 0 THEN 0 WHEN w < mid THEN round((w - mid + 0.5) / sqrt(variance), 4) WHEN w > mid THEN round((w - mid - 0.5) / sqrt(variance), 4) ELSE 0 END AS z_stat,
CASE WHEN plus + minus > 0 THEN round((plus - minus) / (plus + minus), 4) ELSE 0 END AS rank_biserial_r FROM stat""")
def wilcoxon(spark, sf):
    return E.wilcoxon(_diffs(spark, sf)).drop("z")


#: Two-tailed p of the normal distribution by its power series.
_Z_P = ORACLES["wilcoxon"].replace("SELECT pair, metric, n_total, n AS n_nonzero", """, zs AS (SELECT *, CASE WHEN variance <= 0 THEN 0 WHEN w < mid THEN (w - mid + 0.5) / sqrt(variance) WHEN w > mid THEN (w - mid - 0.5) / sqrt(variance) ELSE 0 END AS z FROM stat),
c AS (SELECT j, sum(ln(2 * j + 1)) OVER (ORDER BY j) AS ln_odds FROM (SELECT CAST(unnest(generate_series(0, 400)) AS DOUBLE) AS j))
SELECT pair, metric, n_total, n AS n_nonzero""").replace(" FROM stat", ", abs(round(CASE WHEN z = 0 THEN 1 ELSE 1 - 2 * exp(-z * z / 2) / sqrt(2 * pi()) * (SELECT sum(exp((2 * j + 1) * ln(abs(z)) - ln_odds)) FROM c) END, 6)) AS p_value FROM zs").replace(", abs(round(CASE WHEN z = 0 THEN 1 ELSE 1 - 2 * exp(-z * z / 2) / sqrt(2 * pi()) * (SELECT sum(exp((2 * j + 1) * ln(abs(z)) - ln_odds)) FROM c) END, 6)) AS p_value FROM zs)", " FROM stat)", 1)


@query("wilcoxon_p", _Z_P)
def wilcoxon_p(spark, sf):
    return E.with_z_p_value(E.wilcoxon(_diffs(spark, sf)))


_DIVERSITY = f"""{_RESULTS}, c AS (SELECT system, query_id, kind, entity_id, count(*) AS c FROM results JOIN entities USING (paper_id) GROUP BY ALL),
s AS (SELECT system, query_id, kind, count(*) AS n_unique, sum(c) AS n, sum(c * log2(c)) AS clog, sum(c * c) AS sq FROM c GROUP BY 1, 2, 3),
diversity AS (SELECT y.system, b.item_id AS query_id, k.kind, coalesce(n_unique, 0) AS n_unique, round(greatest(0.0, coalesce(log2(n) - clog / n, 0)), 4) AS entropy, CASE WHEN coalesce(n, 0) <= 1 THEN 0 ELSE round(1 - sq / (n * n), 4) END AS simpson
  FROM benchmark b CROSS JOIN (VALUES ('A'), ('B'), ('C')) y(system) CROSS JOIN (VALUES ('topic'), ('author'), ('institution')) k(kind) LEFT JOIN s ON s.system = y.system AND s.query_id = b.item_id AND s.kind = k.kind)"""


def diversity(spark, sf):
    """Only what belongs to the results is made distinct, and it is written, as counts and joins read it."""
    found = results(spark, sf)
    near = entities(spark, sf).join(found.select("paper_id").distinct(), "paper_id", "left_semi").distinct()
    return E.diversity(found, stash(near, "result-entities").df, T.questions(spark, sf), kinds=S.KINDS)


@query("diversity_per_query", f"WITH {_DIVERSITY} SELECT * FROM diversity")
def diversity_per_query(spark, sf):
    return diversity(spark, sf)


@query("diversity_macro", f"WITH {_DIVERSITY} SELECT system, kind, round(avg(n_unique) + 1e-9, 2) AS n_unique, round(avg(entropy) + 1e-9, 4) AS entropy, round(avg(simpson) + 1e-9, 4) AS simpson FROM diversity GROUP BY 1, 2")
def diversity_macro(spark, sf):
    return E.diversity_means(diversity(spark, sf))


# --- judgments: documents stand for candidates, their language for the query ------------------

_ITEMS = "items AS (SELECT 'batch_' || lang AS batch_id, lang AS query_id, d.doc_id AS paper_id, source AS title, text AS abstract, quality AS relevance FROM documents d LEFT JOIN labels USING (doc_id))"


def items(spark, sf):
    docs = T.read(spark, sf, "documents").select(F.col("lang").alias("query_id"), F.concat(F.lit("query "), "lang").alias("query_text"), F.col("doc_id").alias("paper_id"), F.col("source").alias("title"), F.col("text").alias("abstract"))
    earlier = T.read(spark, sf, "labels").join(T.read(spark, sf, "documents").select("doc_id", "lang"), "doc_id").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("paper_id"), F.col("quality").alias("relevance"), F.lit("").alias("notes"))
    batches = docs.select("query_id").distinct().withColumn("batch_id", F.concat(F.lit("batch_"), "query_id"))
    return J.init_batches(docs, batches, earlier)


@query("masked_batches", f"WITH {_ITEMS} SELECT batch_id, count(*) AS total, count(relevance) AS completed, count(*) - count(relevance) AS missing FROM items GROUP BY 1")
def masked_batches(spark, sf):
    return J.batch_stats(items(spark, sf))


#: What was asked for, and what came back: lacking, unasked, repeated and invalid labels among it.
_JUDGED = """expected AS (SELECT lang AS query_id, doc_id AS paper_id FROM documents WHERE doc_id % 10 <> 3),
judged AS (
  SELECT query_id, paper_id, CASE WHEN paper_id % 31 = 0 THEN 5 ELSE relevance END AS relevance FROM items WHERE paper_id % 10 <> 7
  UNION ALL SELECT query_id, paper_id, 1 FROM items WHERE paper_id % 20 = 0),
valid AS (SELECT DISTINCT query_id, paper_id FROM judged WHERE relevance IS NOT NULL)"""


def _expected(spark, sf):
    return T.read(spark, sf, "documents").where("doc_id % 10 <> 3").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("paper_id"))


def _judged(spark, sf):
    rows = items(spark, sf).select("query_id", "paper_id", "relevance")
    first = rows.where("paper_id % 10 <> 7").withColumn("relevance", F.when(F.col("paper_id") % 31 == 0, 5).otherwise(F.col("relevance")))
    return first.unionByName(rows.where("paper_id % 20 = 0").withColumn("relevance", F.lit(1)))


@query("judgment_audit", f"""WITH {_ITEMS}, {_JUDGED} SELECT (SELECT count(*) FROM expected) AS expected_pairs, (SELECT count(*) FROM valid) AS recorded,
(SELECT count(*) FROM (SELECT * FROM expected EXCEPT SELECT * FROM valid)) AS missing, (SELECT count(*) FROM (SELECT * FROM valid EXCEPT SELECT * FROM expected)) AS unexpected,
(SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) - 1 AS n FROM judged GROUP BY query_id, paper_id HAVING count(relevance) > 0)) AS duplicates,
(SELECT count(*) FROM judged WHERE relevance NOT IN (0, 1, 2)) AS invalid, false AS is_ready""")
def judgment_audit(spark, sf):
    return J.validate(_expected(spark, sf), _judged(spark, sf))


@query("judgment_progress", f"WITH {_ITEMS}, {_JUDGED} SELECT query_id, count(*) AS n_expected, count(v.paper_id) AS n_judged, count(*) = count(v.paper_id) AS complete FROM expected LEFT JOIN valid v USING (query_id, paper_id) GROUP BY 1")
def judgment_progress(spark, sf):
    return J.query_progress(_expected(spark, sf), _judged(spark, sf))


@query("qrels_compile", f"WITH {_ITEMS} SELECT query_id, paper_id, CASE WHEN paper_id % 4 = 0 THEN (relevance + paper_id // 4) % 3 ELSE relevance END AS relevance FROM items WHERE relevance IS NOT NULL")
def qrels_compile(spark, sf):
    """Every fourth judgment is made anew; the last one of a pair counts."""
    done = items(spark, sf).where("relevance is not null").select("query_id", "paper_id", "relevance", F.lit(1).alias("turn"))
    again = done.where("paper_id % 4 = 0").withColumn("relevance", ((F.col("relevance") + F.floor(F.col("paper_id") / 4)) % 3).cast("int")).withColumn("turn", F.lit(2))
    return J.compile_qrels(done, again.unionByName(done), "turn")


@query("label_histogram", f"WITH {_ITEMS} SELECT relevance, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS pct FROM items WHERE relevance IS NOT NULL GROUP BY 1")
def label_histogram(spark, sf):
    return J.label_histogram(items(spark, sf).where("relevance is not null"))


RULES = [
    ("en", 1, [["license", "licensed"], ["apache", "mit", "version"]], 2, "license text"),
    ("en", 2, [["the "], ["and "]], 1, "common words"),
    ("fr", 1, [["eau"], ["que", "qui"]], 1, "common syllables"),
    ("de", 1, [["und"]], 1, "common word"),
]
_RULE = """CASE WHEN lang = 'en' AND (t LIKE '%license%' OR t LIKE '%licensed%') AND (t LIKE '%apache%' OR t LIKE '%mit%' OR t LIKE '%version%') THEN 2
WHEN lang = 'en' AND t LIKE '%the %' AND t LIKE '%and %' THEN 1 WHEN lang = 'fr' AND t LIKE '%eau%' AND (t LIKE '%que%' OR t LIKE '%qui%') THEN 1 WHEN lang = 'de' AND t LIKE '%und%' THEN 1 ELSE 0 END"""


@query("rule_labels", f"SELECT doc_id AS paper_id, {_RULE} AS relevance, CASE WHEN length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) < 50 THEN 'no_text' WHEN {_RULE} = 1 THEN 'middle_label' END AS audit_reason FROM (SELECT *, lower(source || ' ' || text) AS t FROM documents)")
def rule_labels(spark, sf):
    rules = spark.createDataFrame(RULES, "query_id string, priority int, all_of array<array<string>>, label int, note string")
    return J.flag_uncertain(J.apply_rules(items(spark, sf), rules)).select("paper_id", "relevance", "audit_reason")


@query("corrections_merge", f"WITH {_ITEMS} SELECT i.paper_id, CASE WHEN toxic = 1 THEN 0 ELSE relevance END AS relevance, CASE WHEN toxic = 1 THEN '[HUMAN_CORRECTED: was ' || relevance || '] toxic' ELSE '' END AS notes FROM items i LEFT JOIN labels ON doc_id = paper_id")
def corrections_merge(spark, sf):
    toxic = T.read(spark, sf, "labels").where("toxic = 1").join(T.read(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    fixes = toxic.select(F.col("lang").alias("query_id"), F.col("doc_id").alias("paper_id"), F.lit(0).alias("relevance"), F.lit("toxic").alias("rationale"))
    return J.apply_corrections(items(spark, sf), fixes).select("paper_id", "relevance", "notes")


@query("item_numbers", f"WITH {_ITEMS} SELECT query_id, paper_id, row_number() OVER (PARTITION BY query_id ORDER BY paper_id) AS item, CASE WHEN length(abstract) > 250 THEN substr(abstract, 1, 250) || '...' WHEN abstract <> '' THEN abstract ELSE '(No abstract)' END AS excerpt FROM items")
def item_numbers(spark, sf):
    return J.number_items(items(spark, sf).select("query_id", "paper_id", excerpt("abstract").alias("excerpt"))).select("query_id", "paper_id", "item", "excerpt")


@query("pool_set_difference", f"WITH {_RESULTS} SELECT query_id, count(*) FILTER (WHERE b.paper_id IS NULL) AS only_a, count(*) FILTER (WHERE a.paper_id IS NULL) AS only_b FROM (SELECT query_id, paper_id FROM results WHERE system = 'A') a FULL JOIN (SELECT query_id, paper_id FROM results WHERE system = 'B') b USING (query_id, paper_id) GROUP BY 1")
def pool_set_difference(spark, sf):
    found = results(spark, sf)
    a, b = (found.where(F.col("system") == s).select("query_id", "paper_id") for s in "AB")
    sides = a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))
    counts = sides.groupBy("query_id").agg(F.count_if(F.col("side") == "a").alias("only_a"), F.count_if(F.col("side") == "b").alias("only_b"))
    return found.where("system in ('A', 'B')").select("query_id").distinct().join(counts, "query_id", "left").fillna(0)


@query("pool_documents", f"WITH {_POOL} SELECT p.query_id, p.paper_id, coalesce(source, 'found ' || p.paper_id) AS title, substr(sha256(text), 1, 12) AS digest FROM pool p LEFT JOIN documents ON doc_id = p.paper_id AND doc_id % 3 <> 0")
def pool_documents(spark, sf):
    """The corpus lacks every third document: those keep the title they were found with."""
    found = results(spark, sf)
    docs = T.read(spark, sf, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("paper_id"), F.col("source").alias("title"), F.col("text").alias("abstract"))
    rows = E.pool_documents(E.pool(found), found.withColumn("title", F.concat(F.lit("found "), F.col("paper_id").cast("string"))), docs)
    return rows.select("query_id", "paper_id", "title", F.substring(F.sha2("abstract", 256), 1, 12).alias("digest"))
