"""Graph queries over orders, parts, suppliers and brands."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions.text import synthetic_id
from quillspark.operators import graph as G
from quillspark.operators import profile as P
from quillspark.plans import tables as T
from quillspark.plans.registry import query

EDGES = """
edges AS (
  SELECT DISTINCT 'Researcher' AS source_type, CAST(l_partkey AS VARCHAR) AS source_id, 'Paper' AS target_type, CAST(l_orderkey AS VARCHAR) AS target_id, 'AUTHORED' AS rel_type FROM lineitem
  UNION ALL SELECT DISTINCT 'Paper', CAST(l_orderkey AS VARCHAR), 'Institution', CAST(l_suppkey AS VARCHAR), 'AFFILIATED_WITH' FROM lineitem
  UNION ALL SELECT DISTINCT 'Paper', CAST(l_orderkey AS VARCHAR), 'Topic', p_brand, 'ABOUT' FROM lineitem JOIN part ON l_partkey = p_partkey
  UNION ALL SELECT 'Paper', CAST(o_orderkey AS VARCHAR), 'Year', CAST(year(o_orderdate) AS VARCHAR), 'PUBLISHED_IN' FROM orders),
nodes AS (
  SELECT 'Paper' AS node_type, CAST(o_orderkey AS VARCHAR) AS node_id FROM orders
  UNION ALL SELECT 'Researcher', CAST(p_partkey AS VARCHAR) FROM part
  UNION ALL SELECT 'Institution', CAST(s_suppkey AS VARCHAR) FROM supplier
  UNION ALL SELECT DISTINCT 'Topic', p_brand FROM part
  UNION ALL SELECT DISTINCT 'Year', CAST(year(o_orderdate) AS VARCHAR) FROM orders),
ends AS (SELECT source_type AS node_type, source_id AS node_id, rel_type FROM edges UNION ALL SELECT target_type, target_id, rel_type FROM edges),
degrees AS (SELECT n.node_type, n.node_id, count(e.rel_type) AS degree FROM nodes n LEFT JOIN ends e ON n.node_type = e.node_type AND n.node_id = e.node_id GROUP BY ALL),
paper_degrees AS (
  SELECT o.o_orderkey, coalesce(r, 0) AS n_researchers, coalesce(i, 0) AS n_institutions, coalesce(t, 0) AS n_topics FROM orders o
  LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_partkey) AS r, count(DISTINCT l_suppkey) AS i, count(DISTINCT p_brand) AS t FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) x ON x.l_orderkey = o.o_orderkey)
"""


@query("graph_census", f"WITH {EDGES} SELECT node_type AS kind, count(*) AS n FROM nodes GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM nodes")
def graph_census(spark, sf):
    return G.census(T.nodes(spark, sf), "node_type")


@query("edge_counts", f"WITH {EDGES} SELECT rel_type AS kind, count(*) AS n FROM edges GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM edges")
def edge_counts(spark, sf):
    return G.census(T.edges(spark, sf), "rel_type")


@query("degree_stats", f"WITH {EDGES} SELECT node_type AS measure, count(*) AS n, CAST(min(degree) AS DOUBLE) AS min, CAST(max(degree) AS DOUBLE) AS max, round(avg(degree), 2) AS mean, round(quantile_cont(degree, 0.5), 2) AS median FROM degrees GROUP BY 1")
def degree_stats(spark, sf):
    d = G.degrees(T.nodes(spark, sf), T.edges(spark, sf))
    v = F.col("degree").cast("double")
    return d.groupBy(F.col("node_type").alias("measure")).agg(F.count("*").alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.round(F.avg(v), 2).alias("mean"), F.round(F.percentile(v, 0.5), 2).alias("median"))


_DETAIL = " UNION ALL ".join(
    f"SELECT '{m}' AS measure, count(*) AS n, CAST(min({m}) AS DOUBLE) AS min, CAST(max({m}) AS DOUBLE) AS max, round(avg({m}), 2) AS mean, round(quantile_cont({m}, 0.5), 2) AS median, round(quantile_cont({m}, 0.25), 2) AS p25, round(quantile_cont({m}, 0.75), 2) AS p75, round(quantile_cont({m}, 0.95), 2) AS p95, round(stddev_pop({m}), 2) AS std FROM paper_degrees"
    for m in ("n_researchers", "n_institutions", "n_topics")
)


@query("degree_stats_detailed", f"WITH {EDGES} {_DETAIL}")
def degree_stats_detailed(spark, sf):
    d = G.paper_degrees(T.papers(spark, sf), T.edges(spark, sf))
    return P.detailed_stats(d, {m: F.col(m) for m in ("n_researchers", "n_institutions", "n_topics")})


@query("paper_degrees", f"WITH {EDGES} SELECT CAST(o_orderkey AS VARCHAR) AS paper_id, n_researchers, n_institutions, n_topics FROM paper_degrees")
def paper_degrees(spark, sf):
    return G.paper_degrees(T.papers(spark, sf), T.edges(spark, sf))


@query("top_hubs", f"WITH {EDGES} SELECT * FROM degrees WHERE node_type = 'Researcher' ORDER BY degree DESC, node_id LIMIT 15")
def top_hubs(spark, sf):
    return G.hubs(T.nodes(spark, sf), T.edges(spark, sf), "Researcher")


@query("outlier_papers", f"WITH {EDGES} SELECT CAST(o_orderkey AS VARCHAR) AS paper_id, n_researchers, n_institutions, n_topics FROM paper_degrees ORDER BY n_researchers DESC, paper_id LIMIT 3")
def outlier_papers(spark, sf):
    return G.paper_degrees(T.papers(spark, sf), T.edges(spark, sf)).orderBy(F.desc("n_researchers"), "paper_id").limit(3)


@query("isolates", f"WITH {EDGES} SELECT node_type, node_id FROM nodes n WHERE node_type IN ('Paper', 'Institution') AND NOT EXISTS (SELECT 1 FROM edges e WHERE rel_type = 'AFFILIATED_WITH' AND CAST(target_id AS BIGINT) % 7 < 3 AND ((n.node_type = 'Paper' AND e.source_id = n.node_id) OR (n.node_type = 'Institution' AND e.target_id = n.node_id)))")
def isolates(spark, sf):
    """Papers and institutions that no edge to three sevenths of the institutions reaches."""
    nodes, edges = G.subgraph(T.nodes(spark, sf), T.edges(spark, sf), ["Paper", "Institution"], [G.AFFILIATED])
    return G.isolates(nodes, edges.where(F.col("target_id").cast("long") % 7 < 3))


@query("isolated_customers", "SELECT 'Researcher' AS node_type, CAST(c_custkey AS VARCHAR) AS node_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def isolated_customers(spark, sf):
    return G.isolates(*T.customer_graph(spark, sf))


@query("integrity", f"""WITH {EDGES}
SELECT 'duplicate_node_ids' AS "check", (SELECT count(*) FROM (SELECT 1 FROM nodes GROUP BY node_type, node_id HAVING count(*) > 1)) AS violations
UNION ALL SELECT 'dangling_edge_ends', (SELECT count(*) FROM ends e WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.node_type = e.node_type AND n.node_id = e.node_id))
UNION ALL SELECT 'duplicate_edges', (SELECT count(*) FROM (SELECT 1 FROM edges GROUP BY source_type, source_id, target_type, target_id, rel_type HAVING count(*) > 1))
UNION ALL SELECT 'papers_without_year', (SELECT count(*) FROM nodes n WHERE node_type = 'Paper' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.rel_type = 'PUBLISHED_IN' AND e.source_id = n.node_id))
UNION ALL SELECT 'papers_without_researchers', (SELECT count(*) FROM paper_degrees WHERE n_researchers = 0)
UNION ALL SELECT 'papers_without_institutions', (SELECT count(*) FROM paper_degrees WHERE n_institutions = 0)
UNION ALL SELECT 'papers_without_topics', (SELECT count(*) FROM paper_degrees WHERE n_topics = 0)""")
def integrity(spark, sf):
    return G.integrity(T.nodes(spark, sf), T.papers(spark, sf), T.edges(spark, sf))


def _components(nodes: str, edges: str) -> str:
    """Components by the smallest reachable label."""
    return f"""WITH RECURSIVE n AS ({nodes}), e AS ({edges}), twice AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
cc(id, c) USING KEY (id) AS (
  SELECT k AS id, k AS c FROM n
  UNION SELECT q.id, q.c FROM (SELECT b.v AS id, min(cc.c) AS c FROM cc JOIN twice b ON b.u = cc.id GROUP BY b.v) q JOIN recurring.cc AS r ON r.id = q.id WHERE q.c < r.c)
"""


_CUSTOMERS = _components(
    "SELECT 'Researcher:' || c_custkey AS k FROM customer UNION ALL SELECT 'Paper:' || o_orderkey FROM orders",
    "SELECT 'Researcher:' || o_custkey AS u, 'Paper:' || o_orderkey AS v FROM orders",
)
_SUMMARY = "SELECT count(*) AS n_components, CAST(sum(size) AS BIGINT) AS n_nodes, max(size) AS largest, count(*) FILTER (WHERE size = 1) AS isolates, round(max(size) * 100.0 / sum(size), 2) AS largest_pct FROM (SELECT c, count(*) AS size FROM cc {where} GROUP BY c)"


@query("components_customers", _CUSTOMERS + "SELECT c AS component, count(*) AS size FROM cc GROUP BY c")
def components_customers(spark, sf):
    return G.component_sizes(*T.customer_graph(spark, sf))


def _typed(types: tuple[str, ...], rels: tuple[str, ...]) -> str:
    body = EDGES.split("ends AS")[0].rstrip().rstrip(",")
    return _components(
        f"WITH {body} SELECT node_type || ':' || node_id AS k FROM nodes WHERE node_type IN {types}",
        f"WITH {body} SELECT source_type || ':' || source_id AS u, target_type || ':' || target_id AS v FROM edges WHERE rel_type IN {rels}",
    )


_ALL = ("Paper", "Researcher", "Institution", "Topic", "Year")
_CONFIGS = {
    "components_full": (_ALL, (G.AUTHORED, G.AFFILIATED, G.ABOUT, G.PUBLISHED), None),
    "components_no_year": (_ALL[:4], (G.AUTHORED, G.AFFILIATED, G.ABOUT), None),
    "components_core": (_ALL[:3], (G.AUTHORED, G.AFFILIATED), None),
    "components_coauthor": (_ALL[:2], (G.AUTHORED, "-"), "Researcher"),
}


def _config(name, types, rels, count_type):
    where = f"WHERE id LIKE '{count_type}:%'" if count_type else ""

    @query(name, _typed(types, rels) + _SUMMARY.format(where=where))
    def run(spark, sf):
        nodes, edges = G.subgraph(T.nodes(spark, sf), T.edges(spark, sf, repeats=True), list(types), list(rels))
        return G.component_summary(G.component_sizes(nodes, edges, count_type, named=False))


for _name, _args in _CONFIGS.items():
    _config(_name, *_args)


@query("coauthor_pairs", "WITH w AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS r, l_orderkey AS p FROM lineitem) SELECT x.r AS a, y.r AS b, count(*) AS n_shared FROM w x JOIN w y ON x.p = y.p AND x.r < y.r GROUP BY 1, 2 ORDER BY n_shared DESC, a, b LIMIT 20")
def coauthor_pairs(spark, sf):
    return G.coauthors(T.edges(spark, sf)).orderBy(F.desc("n_shared"), "a", "b").limit(20)


@query("coauthor_census", "WITH w AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS r, l_orderkey AS p FROM lineitem), e AS (SELECT x.r AS a, y.r AS b, count(*) AS n FROM w x JOIN w y ON x.p = y.p AND x.r < y.r GROUP BY 1, 2) SELECT count(*) AS n_edges, CAST(sum(n) AS BIGINT) AS n_shared, max(n) AS most_shared FROM e")
def coauthor_census(spark, sf):
    return G.coauthors(T.edges(spark, sf)).agg(F.count("*").alias("n_edges"), F.sum("n_shared").alias("n_shared"), F.max("n_shared").alias("most_shared"))


@query("cross_inst_collab", "WITH place AS (SELECT DISTINCT l_orderkey AS p, CAST(l_suppkey AS VARCHAR) AS i FROM lineitem), home AS (SELECT CAST(s_suppkey AS VARCHAR) AS i FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_0') SELECT x.i AS a, y.i AS b, count(*) AS n FROM place x JOIN home USING (i) JOIN place y ON x.p = y.p AND x.i < y.i GROUP BY 1, 2 ORDER BY n DESC, a, b LIMIT 20")
def cross_inst_collab(spark, sf):
    return G.institution_pairs(T.edges(spark, sf), T.institutions(spark, sf), T.HOME)


@query("papers_by_institution", "SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS paper_id FROM lineitem WHERE l_suppkey = 7 ORDER BY paper_id LIMIT 20")
def papers_by_institution(spark, sf):
    return G.papers_by_institution(T.edges(spark, sf), "7")


@query("topic_neighbors", "WITH a AS (SELECT DISTINCT l_orderkey AS p, p_brand AS t FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT CAST(y.p AS VARCHAR) AS paper_id, count(*) AS n_shared FROM a x JOIN a y ON x.t = y.t WHERE x.p = 1 AND y.p <> 1 GROUP BY 1 ORDER BY n_shared DESC, paper_id LIMIT 50")
def topic_neighbors(spark, sf):
    return G.topic_neighbours(T.edges(spark, sf), "1")


@query("neighborhood_1hop", """WITH l AS (SELECT CAST(l_orderkey AS VARCHAR) AS p, p_brand AS t, CAST(l_partkey AS VARCHAR) AS a, CAST(l_suppkey AS VARCHAR) AS i FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT CAST(o_orderkey AS VARCHAR) AS paper_id, coalesce((SELECT string_agg(t, ',' ORDER BY t) FROM (SELECT DISTINCT t FROM l WHERE l.p = CAST(o_orderkey AS VARCHAR))), '') AS topics,
coalesce((SELECT string_agg(a, ',' ORDER BY a) FROM (SELECT DISTINCT a FROM l WHERE l.p = CAST(o_orderkey AS VARCHAR))), '') AS authors,
coalesce((SELECT string_agg(i, ',' ORDER BY i) FROM (SELECT DISTINCT i FROM l WHERE l.p = CAST(o_orderkey AS VARCHAR))), '') AS institutions FROM orders""")
def neighborhood_1hop(spark, sf):
    found = G.neighbourhood(T.papers(spark, sf), T.edges(spark, sf))
    return found.select("paper_id", *(F.array_join(c, ",").alias(c) for c in ("topics", "authors", "institutions")))


@query("synthetic_ids", "SELECT c_custkey, 'AUTH_SYNTH_' || substr(sha256(lower(trim(c_name))), 1, 12) AS author_id FROM customer")
def synthetic_ids(spark, sf):
    return T.read(spark, sf, "customer").select("c_custkey", synthetic_id("AUTH", "c_name").alias("author_id"))


@query("entity_resolution_audit", """SELECT
(SELECT count(*) FROM (SELECT p_brand FROM part GROUP BY p_brand HAVING count(DISTINCT p_name) > 1)) AS ids_with_variants,
(SELECT count(DISTINCT p_brand) FROM part) AS unique_ids,
(SELECT count(*) FROM (SELECT lower(p_name) FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1)) AS names_with_ids,
(SELECT count(*) FROM part WHERE p_brand IS NULL OR p_brand = '') AS missing_instances""")
def entity_resolution_audit(spark, sf):
    return G.resolution_audit(T.read(spark, sf, "part").select(F.col("p_brand").alias("id"), F.col("p_name").alias("name")))


@query("name_collisions", "SELECT p_name AS name, count(DISTINCT p_partkey) AS n, string_agg(DISTINCT CAST(p_partkey AS VARCHAR), ',' ORDER BY CAST(p_partkey AS VARCHAR)) AS ids FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1")
def name_collisions(spark, sf):
    return P.name_collisions(T.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))


@query("graph_upsert_edges", """WITH a AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS source_id, p_brand AS target_id FROM lineitem JOIN part ON l_partkey = p_partkey),
d AS (SELECT CAST(l_orderkey AS VARCHAR) AS source_id, p_brand AS target_id, arg_max(l_discount, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS score FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey % 2 = 0 GROUP BY 1, 2)
SELECT a.source_id, a.target_id, CASE WHEN d.score IS NOT NULL THEN d.score WHEN CAST(a.source_id AS BIGINT) % 5 = 0 THEN -1.0 END AS score FROM a LEFT JOIN d USING (source_id, target_id)""")
def graph_upsert_edges(spark, sf):
    """Topic edges get the score of the last line that draws them; dangling ones are left out."""
    about = T.edges(spark, sf).where(F.col("rel_type") == G.ABOUT).withColumn("score", F.when(F.col("source_id").cast("long") % 5 == 0, -1.0))
    lines = T.read(spark, sf, "lineitem").join(T.read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).where("l_orderkey % 2 = 0")
    turn = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("turn")
    new = lines.select(*G.edge("Paper", F.col("l_orderkey"), "Topic", F.col("p_brand"), G.ABOUT, F.col("l_discount")), turn)
    new = new.unionByName(lines.select(*G.edge("Paper", F.col("l_orderkey"), "Topic", F.lit("gone"), G.ABOUT, F.col("l_discount")), turn))
    return G.upsert_edges(about, new, T.nodes(spark, sf), "turn").select("source_id", "target_id", "score")


@query("entity_variants", "SELECT id, n, names FROM (SELECT p_brand AS id, count(DISTINCT p_name) AS n, string_agg(DISTINCT p_name, '|' ORDER BY p_name) AS names FROM part GROUP BY 1) WHERE n > 1 ORDER BY n DESC, id LIMIT 5")
def entity_variants(spark, sf):
    return G.variants(T.read(spark, sf, "part").select(F.col("p_brand").alias("id"), F.col("p_name").alias("name"))).withColumn("names", F.array_join("names", "|"))


@query("entity_homonyms", "SELECT lower(p_name) AS name, count(DISTINCT p_brand) AS n, string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS ids FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1 ORDER BY n DESC, name LIMIT 5")
def entity_homonyms(spark, sf):
    return G.homonyms(T.read(spark, sf, "part").select(F.col("p_brand").alias("id"), F.col("p_name").alias("name"))).withColumn("ids", F.array_join("ids", "|"))
