"""SQL fragments shared by the checks of search and evaluation queries."""

from quillspark.functions.text import STOPWORDS

_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS if "'" not in w) + "]"


def words(text: str) -> str:
    return f"[x FOR x IN regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+') IF length(x) > 1 AND NOT list_contains({_STOP}, x)]"


TOKENS = f"tokens AS (SELECT doc_id, {words('text')} AS words FROM documents)"
BM25 = f"""{TOKENS},
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(words) AS term FROM tokens) GROUP BY ALL),
dl AS (SELECT doc_id, len(words) AS dl FROM tokens),
size AS (SELECT count(*) AS n, avg(dl) AS mean FROM dl),
raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, size GROUP BY term),
terms AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
asked AS (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest({words('text')}) AS term FROM benchmark) GROUP BY ALL),
bm25 AS (
  SELECT item_id, tf.doc_id, sum(qf * idf * (tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / mean)))) AS score
  FROM asked JOIN terms USING (term) JOIN tf USING (term) JOIN dl ON dl.doc_id = tf.doc_id, size GROUP BY 1, 2 HAVING score > 0),
bm25_top AS (
  SELECT item_id AS query_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 10) DESC, doc_id) AS rank, doc_id AS paper_id, round(score, 4) AS score
  FROM bm25 QUALIFY rank <= 10)
"""

VECTORS = "v AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS raw, label FROM embeddings), unit AS (SELECT vec_id, label, [x / greatest(sqrt(list_sum([y * y FOR y IN raw])), 1e-12) FOR x IN raw] AS e FROM v)"


def cosine_top(asked: str, key: str, k: int) -> str:
    """``query_id, rank, paper_id, score`` of the k vectors nearest to each of ``asked``."""
    return f"""SELECT q.{key} AS query_id, row_number() OVER (PARTITION BY q.{key} ORDER BY round(list_dot_product(q.e, u.e), 10) DESC, u.vec_id) AS rank,
  u.vec_id AS paper_id, round(list_dot_product(q.e, u.e), 4) AS score FROM {asked} q, unit u QUALIFY rank <= {k}"""


ENTITIES = """entities AS (
  SELECT DISTINCT l_orderkey AS paper_id, 'topic' AS kind, p_brand AS entity_id FROM lineitem JOIN part ON l_partkey = p_partkey
  UNION ALL SELECT DISTINCT l_orderkey, 'author', CAST(l_partkey AS VARCHAR) FROM lineitem
  UNION ALL SELECT DISTINCT l_orderkey, 'institution', CAST(l_suppkey AS VARCHAR) FROM lineitem)"""


def overlaps(candidates: str) -> str:
    """Normalized overlaps of the candidates as ``lap``."""
    sums = ", ".join(f"coalesce(sum(others) FILTER (WHERE kind = '{k}'), 0) AS raw_{k}" for k in ("topic", "author", "institution"))
    norm = ", ".join(f"round(CASE WHEN max(raw_{k}) OVER w > 0 THEN raw_{k} / max(raw_{k}) OVER w ELSE 0 END, 6) AS o_{k}" for k in ("topic", "author", "institution"))
    return f"""mine AS (SELECT c.query_id, c.paper_id, kind, entity_id FROM {candidates} c JOIN entities USING (paper_id)),
shared AS (SELECT query_id, kind, entity_id, count(*) - 1 AS others FROM mine GROUP BY ALL),
sums AS (SELECT c.query_id, c.paper_id, c.rank, c.score, {sums} FROM {candidates} c LEFT JOIN (mine JOIN shared USING (query_id, kind, entity_id)) m ON m.query_id = c.query_id AND m.paper_id = c.paper_id GROUP BY 1, 2, 3, 4),
lap AS (SELECT *, {norm} FROM sums WINDOW w AS (PARTITION BY query_id))"""


def hybrid(alphas: str, top: int = 10) -> str:
    """``hyb``: reranked rows for each (setting, alpha) of ``alphas``."""
    return f"""graphed AS (SELECT *, round(0.5 * o_topic + 0.25 * o_author + 0.25 * o_institution, 6) AS graph_score FROM lap),
mixed AS (SELECT o_topic, o_author, o_institution, raw_topic, raw_author, raw_institution, setting, alpha, query_id, paper_id, rank AS semantic_rank, score AS semantic_score, graph_score, round(alpha * score + (1 - alpha) * graph_score + 1e-10, 6) AS hybrid_score FROM graphed, (VALUES {alphas}) s(setting, alpha)),
hyb AS (SELECT *, row_number() OVER (PARTITION BY setting, query_id ORDER BY hybrid_score DESC, paper_id) AS rank FROM mixed QUALIFY rank <= {top})"""
