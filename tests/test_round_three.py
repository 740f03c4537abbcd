"""Odd rows and larger groups that the queries once got wrong or held in one place."""

import re

from pyspark.sql import functions as F

from quillspark.operators import components as C
from quillspark.operators import evaluation as E
from quillspark.operators import graph as G
from quillspark.operators import judgments as J
from quillspark.operators import search as S
from quillspark.plans import profile_queries, search_queries
from quillspark.plans import tables as T
from quillspark.runtime import size
from quillspark.sources.files import append_jsonl, count_records, read_jsonl


def save(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"file://{folder}/{name}.parquet")
    return f"file://{folder}"


def test_inverted_texts_stay_rows(spark, tmp_path):
    rows = [(1, "b a b"), (1, "other"), (2, ""), (3, " \t "), (4, None), (5, "  x  y ")]
    sf = save(spark, tmp_path, "documents", rows, "doc_id long, text string")
    found = profile_queries.invert_abstract(spark, sf).collect()
    digest = lambda t: spark.range(1).select(F.substring(F.sha2(F.lit(t), 256), 1, 12)).first()[0]
    assert sorted((r.doc_id, r.digest or "") for r in found) == sorted([(1, digest("b a b")), (1, digest("other")), (2, digest("")), (3, digest("")), (4, ""), (5, digest("x  y"))])


def test_fallback_keeps_the_semantic_top(spark, tmp_path):
    import math

    # Places 10 and 11 differ behind the fourth digit only, and the eleventh has the lower number.
    cosines = [1.0] + [0.9 - i / 100 for i in range(8)] + [0.500031, 0.500022, 0.4]
    ids = [100, *range(201, 209), 250, 150, 260]
    rows = [(i, [c, math.sqrt(1 - c * c)], 0) for i, c in zip(ids, cosines)]
    sf = save(spark, tmp_path, "embeddings", rows, "vec_id long, embedding array<double>, label int")
    for run in (search_queries.hybrid_fallback, search_queries.hybrid_unreachable):
        found = {r.rank: r.paper_id for r in run(spark, sf).collect()}
        assert found == {1: 100, **{i + 2: 201 + i for i in range(8)}, 11: 250}


def plain_components(edges):
    to = {}

    def top(x):
        while to.setdefault(x, x) != x:
            x = to[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        to[max(a, b)] = min(a, b)
    return {x: top(x) for x in to}


def test_components_in_blocks(spark):
    """Blocks of eight edges: several levels, as with edges beyond one block."""
    import random

    rng = random.Random(3)
    edges = [(f"n{rng.randrange(400)}", f"n{rng.randrange(400)}") for _ in range(300)] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(150)]
    edges = [e for e in edges if e[0] != e[1]]
    df = spark.createDataFrame(edges, "u string, v string").repartition(3)
    found = {r.node: r.component for r in C.connected_components(df, block=8).collect()}
    assert found == plain_components(edges)


def test_components_with_a_shared_hash(spark, monkeypatch):
    """Keys that share the first hash under the first salt: found, and done again with the next."""
    real, salts = C.hashes, []

    def hashes(salt, *key):
        salts.append(salt)
        h, h2 = real(salt, *key)
        return (h % 3 if salt == 0 else h), h2

    monkeypatch.setattr(C, "hashes", hashes)
    edges = [(f"a{i}", f"b{i}") for i in range(20)]
    for block in (4, 1 << 21):
        salts.clear()
        found = {r.node: r.component for r in C.connected_components(spark.createDataFrame(edges, "u string, v string"), block=block).collect()}
        assert found == plain_components(edges) and 1 in salts


def test_component_sizes_by_hash(spark):
    nodes = spark.createDataFrame([("P", "1"), ("P", "2"), ("R", "1"), ("R", "9"), ("P", "9")], "node_type string, node_id string")
    edges = spark.createDataFrame([("R", "1", "P", "1", "x", None), ("R", "1", "P", "2", "x", None), ("R", None, "P", "9", "x", None)], "source_type string, source_id string, target_type string, target_id string, rel_type string, score double")
    assert sorted(r.size for r in G.component_sizes(nodes, edges.unionByName(edges), named=False).collect()) == [1, 1, 3]
    assert sorted(r.size for r in G.component_sizes(nodes, edges, "R", named=False).collect()) == [1, 1]


def test_bm25_sends_the_best_of_each_block_only(spark, monkeypatch):
    """Scores as by a plain loop, ties by number, and a few rows a block instead of one a match."""
    import math
    import random

    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    docs = {i: [rng.choice(words[: rng.randrange(1, 30)]) for _ in range(rng.randrange(12))] for i in range(400)}
    asked = {"a": "w1 w2 w2 w25", "b": "w0", "c": "nothing", "d": " "}
    monkeypatch.setattr(S, "CELLS", 64)
    index = S.build_index(spark.createDataFrame([(i, " ".join(t)) for i, t in docs.items()], "paper_id long, search_text string").repartition(2))
    queries = spark.createDataFrame(list(asked.items()), "query_id string, query_text string")
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {w: sum(w in t for t in docs.values()) for w in words}
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items() if c}
    idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
    want = set()
    for q, text in asked.items():
        scores = {i: sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in text.split() if w in t) for i, t in docs.items()}
        top = sorted((-round(s, 10), i) for i, s in scores.items() if s > 0)[:10]
        want |= {(q, k + 1, i, round(-s, 4)) for k, (s, i) in enumerate(top)}
    assert {(r.query_id, r.rank, r.paper_id, r.score) for r in S.bm25_search(index, queries).collect()} == want
    monkeypatch.setattr(S, "CELLS", 1 << 23)
    assert S.bm25_best(index, queries, 3).count() < 3 * 2 * 2 + 20


def test_diversity_has_all_kinds(spark):
    """Entities of the results alone may lack a kind, which still has its zeros."""
    results = spark.createDataFrame([("A", "q", 1, 1)], "system string, query_id string, rank int, paper_id int")
    entities = spark.createDataFrame([(1, "topic", "x")], "paper_id int, kind string, entity_id string")
    found = E.diversity(results, entities, results.select("query_id"), kinds=S.KINDS).collect()
    assert {(r.kind, r.n_unique) for r in found} == {("topic", 1), ("author", 0), ("institution", 0)}


def test_entities_are_read_without_a_shuffle(spark, tmp_path):
    save(spark, tmp_path, "lineitem", [(1, 2, 3), (1, 2, 3)], "l_orderkey long, l_partkey long, l_suppkey long")
    save(spark, tmp_path, "orders", [(1, None)], "o_orderkey long, o_orderdate timestamp")
    sf = save(spark, tmp_path, "part", [(2, "b")], "p_partkey long, p_brand string")
    plan = search_queries.entities(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Aggregate" not in plan


def test_item_numbers_over_ranges(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else small ranges are read together
    try:
        items = spark.createDataFrame([("q", i) for i in range(500)] + [("r", i) for i in range(0, 60, 3)], "query_id string, paper_id int").withColumns({"title": F.lit("t"), "abstract": F.lit(None).cast("string")}).repartition(3)
        found = {(r.query_id, r.paper_id): r.item for r in J.number_items(items).collect()}
        assert found == {("q", i): i + 1 for i in range(500)} | {("r", 3 * i): i + 1 for i in range(20)}
        plan = J.number_items(items)._jdf.queryExecution().executedPlan().toString()
        assert "Window [row_number() windowspecdefinition(query_id#" not in plan.split("_part")[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_rules_do_not_gather_a_query(spark):
    """The first rule by priority, with no shuffle of the items by their query."""
    items = spark.createDataFrame([("q", 1, "a", "b c"), ("q", 2, None, "c"), ("q", 3, "x", None), ("r", 4, "a", "b")], "query_id string, paper_id int, title string, abstract string")
    rules = spark.createDataFrame([("q", 2, [["c"]], 1, "late"), ("q", 1, [["a"], ["x", "b"]], 2, "early"), ("q", None, [["x"]], 2, "no place")], "query_id string, priority int, all_of array<array<string>>, label int, note string")
    for batches in (None, items.select("query_id", F.concat(F.lit("b"), "query_id").alias("batch_id")).distinct()):
        rows = items if batches is None else J.init_batches(items.withColumn("query_text", F.lit("t")), batches)
        out = J.apply_rules(rows, rules)
        assert {r.paper_id: (r.relevance, r.notes) for r in out.collect()} == {1: (2, "early"), 2: (1, "late"), 3: (0, "no rule"), 4: (0, "no rule")}
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_integrity_counts_each_fault(spark):
    nodes = spark.createDataFrame([("Paper", "1"), ("Paper", "1"), ("Paper", "2"), ("Researcher", "1"), ("Paper", None)], "node_type string, node_id string")
    papers = spark.createDataFrame([("1",), ("2",), ("3",)], "paper_id string")
    rows = [("Researcher", "1", "Paper", "1", "AUTHORED")] * 2 + [("Paper", "1", "Year", "1990", "PUBLISHED_IN"), ("Paper", "2", "Topic", None, "ABOUT"), ("Paper", "3", "Institution", "1", "AFFILIATED_WITH")]
    edges = spark.createDataFrame(rows, "source_type string, source_id string, target_type string, target_id string, rel_type string")
    found = {r.check: r.violations for r in G.integrity(nodes, papers, edges).collect()}
    assert found == {"duplicate_node_ids": 1, "dangling_edge_ends": 4, "duplicate_edges": 1, "papers_without_year": 2, "papers_without_researchers": 2, "papers_without_institutions": 2, "papers_without_topics": 2}
    assert {r.check: r.violations for r in G.integrity(nodes, papers, edges.limit(0)).collect()}["dangling_edge_ends"] == 0
    plan = G.integrity(nodes, papers, edges)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan


def test_parts_of_distinct_edges_follow_the_table(spark, tmp_path, monkeypatch):
    save(spark, tmp_path, "lineitem", [(i % 50, i % 7, i % 3) for i in range(1000)], "l_orderkey long, l_partkey long, l_suppkey long")
    save(spark, tmp_path, "orders", [(i, None) for i in range(50)], "o_orderkey long, o_orderdate timestamp")
    sf = save(spark, tmp_path, "part", [(i, f"b{i % 2}") for i in range(7)], "p_partkey long, p_brand string")
    counts = lambda: {r.rel_type: r["count"] for r in T.edges(spark, sf).groupBy("rel_type").count().collect()}
    want = counts()
    assert want == {"AUTHORED": 350, "AFFILIATED_WITH": 150, "ABOUT": 100, "PUBLISHED_IN": 50}
    monkeypatch.setattr(T, "PART_BYTES", 500)
    assert counts() == want
    plan = T.edges(spark, sf)._jdf.queryExecution().executedPlan().toString()
    asked = [int(x) for x in re.findall(r"hashpartitioning\(l_orderkey#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan)]
    assert len(asked) == 3 and min(asked) > 4


def test_edges_are_drawn_in_one_pass(spark):
    """The first mention's score wins, null or not, and works are read once for all kinds of edges."""
    topic = "array<struct<id: string, name: string, score: double>>"
    person = "array<struct<id: string, name: string, raw_affiliation_strings: array<string>>>"
    place = "array<struct<id: string, name: string, country_code: string, ror: string>>"
    text = ("title", "doi", "publication_date", "type", "source_name", "oa_status", "abstract_text", "search_text", "raw_id", "primary_topic", "primary_topic_subfield", "primary_topic_field", "primary_topic_domain")
    schema = f"id string, publication_year int, is_oa boolean, cited_by_count int, authors {person}, institutions {place}, topics {topic}, ordinal int, " + ", ".join(f"{c} string" for c in text)
    rest = (None,) * len(text)
    rows = [
        ("W1", 0, None, None, [("A1", "n", None), (None, "N. ", None)], None, [("T1", "t", 0.5), ("T1", "t", 0.1), ("", "u", 1.0)], 2, *rest),
        ("W1", 1990, None, None, [], [(None, None, None, None)], [("T2", "v", 0.7), ("T1", "t", None)], 1, *rest),
        (None, 1991, None, None, [("A1", "n", None)], None, None, 0, *rest),
    ]
    found = G.build_graph(spark.createDataFrame(rows, schema))["edges"]
    got = sorted((r.source_id, r.target_id, r.rel_type, r.score) for r in found.collect())
    assert [x for x in got if "_SYNTH_" not in x[0] + x[1]] == [("A1", "W1", "AUTHORED", None), ("W1", "1990", "PUBLISHED_IN", None), ("W1", "T1", "ABOUT", None), ("W1", "T2", "ABOUT", 0.7)]
    assert len(got) == 6 and found.columns == ["source_type", "source_id", "target_type", "target_id", "rel_type", "score"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and "SortAggregate" not in plan


def test_compressed_lines_are_read_again(spark, tmp_path):
    path = f"file://{tmp_path}/lines"
    rows = spark.createDataFrame([(f"q{i}", "same text " * 50, None) for i in range(200)], "query_id string, paper_id string, relevance int")
    for _ in range(2):
        append_jsonl(rows, path, "lz4")
    assert count_records(spark, path) == 400
    assert read_jsonl(spark, path, "query_id string, paper_id string, relevance int").distinct().count() == 200
    assert size(spark, path) < 400 * 500 / 4
