"""Hand-computed values of the engine's operators."""

import hashlib
import json
import urllib.parse

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.functions.pvalues import normal_two_tailed, t_two_tailed
from quillspark.operators import evaluation as E
from quillspark.operators import graph as G
from quillspark.operators import judgments as J
from quillspark.operators import profile as P
from quillspark.operators import search as S
from quillspark.operators.components import connected_components
from quillspark.operators.normalize import normalize_works, retrieval_documents
from quillspark.plans.reports import markdown_table, report
from quillspark.schemas import QRELS, RAW_WORK
from quillspark.sources.files import append_jsonl, count_records, file_sha256, nested_qrels, read_json_array, read_jsonl, read_qrels, run_metadata, write_batches, write_metrics
from quillspark.sources.rest import HttpError, RestClient


def one(df):
    return df.collect()[0]


def test_tokenize_and_strip(spark):
    row = one(spark.createDataFrame([("The Mobile-money in Kenya, 2024! don't é", " \t\nx y ")], "a string, b string").select(X.tokenize("a").alias("t"), X.strip("b").alias("s")))
    assert row.t == ["mobile", "money", "kenya", "2024", "don"]
    assert row.s == "x y"


@pytest.mark.parametrize(
    "index, text",
    [
        (None, None), ({}, None), ({"nothing": []}, None), ({"lost": [-3]}, None), ({" ": [0]}, None),
        ({"goats": [1], "Two": [0], "graze.": [2]}, "Two goats graze."), ({"first": [0], "sixth": [5]}, "first     sixth"),
        ({"old": [0, 1], "new": [1]}, "old new"), ({"late": [2], "also": [2, 4], "gone": [-1]}, "also  also"),
    ],
)
def test_reconstruct(spark, index, text):
    # By JSON, as it arrives: a map made from Python would lose the order of its entries.
    row = spark.createDataFrame([(json.dumps(index),)], "j string").select(F.from_json("j", "map<string,array<int>>").alias("m"))
    assert one(row.select(X.reconstruct("m").alias("t"))).t == text


RAW = {
    "id": "https://openalex.org/W77", "doi": "10.5/x", "title": "Salt marsh birds", "publication_year": 1987, "cited_by_count": 0, "type": "article",
    "abstract_inverted_index": {"Terns": [0], "nest": [1, 3], "and": [2]},
    "primary_location": {"source": {"display_name": "Shore Notes", "issn_l": None}}, "open_access": {"is_oa": None, "oa_status": "closed"},
    "authorships": [
        {"author": {"id": None, "display_name": "Q. Reed"}, "raw_affiliation_strings": None, "institutions": None},
        {"author": None, "raw_affiliation_strings": ["lost"], "institutions": [{"id": "https://openalex.org/I5", "display_name": "Coast Lab", "country_code": "KE", "ror": None}]},
        {"author": {"id": "https://openalex.org/A31", "display_name": "Wren Oduor"}, "raw_affiliation_strings": ["Bay House"], "institutions": [{"id": None, "display_name": "Bay House", "country_code": None, "ror": "r9"}, {"id": "https://openalex.org/I5", "display_name": "Coast Laboratory", "country_code": "KE", "ror": "r5"}]},
    ],
    "primary_topic": {"display_name": "Shore birds", "subfield": None, "field": {"display_name": "Zoology"}},
    "topics": [{"id": None, "display_name": "Tides", "score": 0.25}, {"id": "https://openalex.org/T8", "display_name": "Shore birds", "score": None}, {"id": "https://openalex.org/T9", "display_name": "", "score": 0.5}],
    "concepts": None,
}


def works(spark, tmp_path, *rows):
    path = tmp_path / "raw.jsonl"
    path.write_text("\n".join([json.dumps(r) for r in rows] + ["", "{broken"]))
    return normalize_works(read_jsonl(spark, f"file://{path}", RAW_WORK)), f"file://{path}"


def test_normalize(spark, tmp_path):
    df, path = works(spark, tmp_path, RAW, {"id": None, "title": ""})
    rows = {r.raw_id: r for r in df.collect()}
    row, bare = rows[RAW["id"]], rows[None]
    assert len(df.columns) == 31 and count_records(spark, path) == 3
    assert (row.id, row.source_name, row.source_issn, row.is_oa, row.oa_status) == ("W77", "Shore Notes", None, False, "closed")
    assert (row.abstract_text, row.abstract_word_count, row.abstract_available) == ("Terns nest and nest", 4, True)
    assert row.search_text == "Salt marsh birds. Tides, Shore birds. Terns nest and nest"
    assert [(a.id, a.name, a.raw_affiliation_strings) for a in row.authors] == [(None, "Q. Reed", []), ("A31", "Wren Oduor", ["Bay House"])]
    assert [(i.id, i.name, i.ror) for i in row.institutions] == [("I5", "Coast Lab", None), (None, "Bay House", "r9"), ("I5", "Coast Laboratory", "r5")]
    assert row.has_ke_institution and not row.has_international_institution and row.primary_topic_subfield is None and row.primary_topic_field == "Zoology"
    assert [(t.id, t.name) for t in row.topics] == [("", "Tides"), ("T8", "Shore birds")] and row.concepts == []
    assert (bare.id, bare.authors_count, bare.search_text, bare.abstract_available, bare.topics) == (None, 0, "", False, [])
    assert {r.title for r in retrieval_documents(df).collect()} == {"Salt marsh birds", "Untitled"}
    with pytest.raises(Exception):
        read_jsonl(spark, path, RAW_WORK, strict=True).collect()
    assert read_jsonl(spark, path + "-none", RAW_WORK).count() == 0


def test_graph(spark, tmp_path):
    again = RAW | {"title": "Salt marsh birds, second look", "publication_year": 0}
    other = RAW | {"id": "https://openalex.org/W78", "title": None, "primary_topic": None, "authorships": RAW["authorships"][:1]}
    df, _ = works(spark, tmp_path, RAW, again, other)
    order = F.when(F.col("title") == RAW["title"], 0).when(F.col("id") == "W77", 1).otherwise(2)
    graph = G.build_graph(df.withColumn("ordinal", order))
    assert {k: v.count() for k, v in graph.items()} == {"papers": 2, "researchers": 2, "institutions": 2, "topics": 1, "years": 1, "edges": 9}
    assert {r.id: r.title for r in graph["papers"].collect()} == {"W77": "Salt marsh birds", "W78": "Untitled"}
    assert graph["researchers"].where(F.col("id").startswith("AUTH_SYNTH_")).count() == 1
    assert {(r.display_name, r.ror) for r in graph["institutions"].collect()} == {("Coast Lab", None), ("Bay House", "r9")}
    assert (one(graph["topics"]).field, one(graph["topics"]).subfield, one(graph["topics"]).openalex_url) == ("Zoology", None, "https://openalex.org/T8")


def test_upserts_take_the_last_value(spark):
    old = spark.createDataFrame([("a", "A", 1), ("b", "B", 2)], "id string, name string, n int")
    new = spark.createDataFrame([("a", "A2", None, 1), ("a", "A3", None, 3), ("a", None, 7, 2), ("c", "C", None, 1)], "id string, name string, n int, k int")
    assert sorted(map(tuple, G.upsert_nodes(old, new, ["id"], "k").collect())) == [("a", "A3", 7), ("b", "B", 2), ("c", "C", None)]


def test_sinks(spark, tmp_path):
    items = spark.createDataFrame([("b1", "q", 1, None), ("b2", "q", 2, 1)], "batch_id string, query_id string, paper_id int, relevance int")
    path = f"file://{tmp_path}/batches"
    write_batches(items, path)
    write_batches(items.where("batch_id = 'b2'").withColumn("relevance", F.lit(2)), path)
    assert sorted(map(tuple, spark.read.json(path).select("batch_id", "paper_id", "relevance").collect())) == [("b1", 1, None), ("b2", 2, 2)]
    write_metrics(spark.createDataFrame([("total", 3)], "name string, value int"), f"file://{tmp_path}/metrics")
    assert spark.read.json(f"file://{tmp_path}/metrics").collect()[0].value == 3
    append_jsonl(items, f"file://{tmp_path}/lines")
    append_jsonl(items, f"file://{tmp_path}/lines")
    assert count_records(spark, f"file://{tmp_path}/lines") == 4
    (tmp_path / "array.json").write_text(json.dumps([{"query_id": "q", "paper_id": "7", "relevance": 1}, {"query_id": "r"}]))
    assert sorted((r.query_id, r.relevance) for r in read_json_array(spark, f"file://{tmp_path}/array.json", QRELS).collect()) == [("q", 1), ("r", None)]
    digest = file_sha256(spark, f"file://{tmp_path}/array.json").collect()[0].sha256
    assert digest == hashlib.sha256((tmp_path / "array.json").read_bytes()).hexdigest()
    meta = run_metadata(spark, {"works": "2"}).collect()[0]
    assert meta.works == "2" and meta.timestamp_utc is not None


def test_reports(spark):
    table = markdown_table(spark.range(5), most=3)
    assert table.count("\n| ") == 3 and "first 3 rows" in table and "first" not in markdown_table(spark.range(3), most=3)
    assert report("T", {"S": spark.range(1)}).startswith("# T\n\n## S\n\n| id |")


def test_point_update_and_export(spark):
    items = spark.createDataFrame([("q", 2, "B", None, 0, ""), ("q", 1, "A", "text", 0, "")], "query_id string, paper_id int, title string, abstract string, relevance int, notes string")
    fixed = J.point_update(items, "q", 2, 1, "seen").orderBy("paper_id").collect()
    assert [(r.relevance, r.notes) for r in fixed] == [(0, ""), (1, "seen")]
    assert one(J.markdown_export(items)).markdown == "### 1. A\n\ntext\n\n### 2. B\n\n(No abstract)\n"


def test_latency_and_sweeps(spark):
    row = one(E.latency_summary(spark.createDataFrame([("q", float(x)) for x in (10, 20, 30, 40)], "query string, ms double")))
    assert (row.n, row.mean_ms, row.median_ms, row.p95_ms) == (4, 25.0, 25.0, 38.5)
    assert one(spark.createDataFrame([("x",)], "t string").select(S.prefixed("t").alias("p"))).p.endswith(": x")
    assert S.non_blank(spark.createDataFrame([("\t\n ",), ("a",), (None,)], "query_text string")).count() == 1


def test_embedding_store(spark, tmp_path):
    docs = spark.createDataFrame([(1, "aa b"), (2, None)], "paper_id int, search_text string")
    path = f"file://{tmp_path}/store"
    count = lambda texts: [[1.0 + t.count("a"), 1.0] for t in texts]
    first = S.load_or_encode(docs, count, path, "m", 2).collect()
    refuse = lambda texts: 1 / 0
    assert sorted(S.load_or_encode(docs, refuse, path, "m", 2).collect()) == sorted(first)
    with pytest.raises(Exception):
        S.load_or_encode(docs, refuse, path, "another model", 2).collect()


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(40, 41), (41, 42), (50, 50), (None, 3)], "u long, v long")
    found = {r.node: r.component for r in connected_components(edges).collect()}
    assert found == {**{i: 0 for i in range(21)}, 40: 40, 41: 40, 42: 40}
    assert connected_components(edges.limit(0)).count() == 0


def test_profile(spark):
    df = spark.createDataFrame([(10.0, "a"), (20.0, ""), (30.0, "b"), (40.0, None), (50.0, "a ")], "v double, s string")
    stats = one(P.detailed_stats(df, {"v": F.col("v")}))
    assert (stats.min, stats.max, stats["mean"], stats["median"], stats.p25, stats.p95, stats["std"]) == (10, 50, 30, 30, 20, 48, 14.14)
    row = one(P.completeness(df, {"s": X.present("s")}))
    assert (row.present, row.pct_present) == (3, 60.0)
    assert one(P.duplicates(df, {"s": X.strip("s")})).n == 2
    empty = one(P.summary_stats(df.limit(0).unionByName(df.where("v < 0")), {"v": F.col("v")})) if P.summary_stats(df.limit(0), {"v": F.col("v")}).count() else None
    assert empty is None


def test_metrics(spark):
    results = spark.createDataFrame([("A", "q", i + 1, p) for i, p in enumerate("abcde")], "system string, query_id string, rank int, paper_id string")
    qrels = spark.createDataFrame([("q", "b", 2), ("q", "d", 1), ("q", "x", 1), ("q", "y", 1), ("q", "a", 0)], "query_id string, paper_id string, relevance int")
    queries = spark.createDataFrame([("q",), ("none",)], "query_id string")
    rows = {r.query_id: r for r in E.per_query(results, queries, qrels).collect()}
    assert (rows["q"].p_at_5, rows["q"].p_at_10, rows["q"].recall_at_10, rows["q"].mrr) == (0.4, 0.2, 0.5, 0.5)
    assert rows["none"].ndcg_at_10 == 0 and rows["none"].judged_hits_at_10 == 0
    assert rows["q"].judged_hits_at_10 == 3


def test_paired_tests(spark):
    diffs = spark.createDataFrame([("p", "m", i, d) for i, d in enumerate((0.1, 0.2, 0.3, 0.4, 0.5))], "pair string, metric string, query_id int, diff double")
    w = one(E.with_z_p_value(E.wilcoxon(diffs)))
    assert (w.w_plus, w.w_minus, w.rank_biserial_r) == (15, 0, 1)
    t = one(E.with_t_p_value(E.t_test(diffs)))
    assert t.t_stat == 4.2426 and abs(t.p_value - 0.013236) < 1e-5
    assert abs(t_two_tailed(2.228, 10) - 0.05) < 1e-4 and abs(normal_two_tailed(1.96) - 0.05) < 1e-4


def test_diversity(spark):
    results = spark.createDataFrame([("A", "q", 1, 1), ("A", "q", 2, 2)], "system string, query_id string, rank int, paper_id int")
    entities = spark.createDataFrame([(1, "topic", "x"), (2, "topic", "y")], "paper_id int, kind string, entity_id string")
    row = one(E.diversity(results, entities, results.select("query_id").distinct()))
    assert (row.n_unique, row.entropy, row.simpson) == (2, 1.0, 0.5)


def test_rerank(spark):
    cand = spark.createDataFrame([("q", 1, 1, 0.9), ("q", 2, 2, 0.8), ("q", 3, 3, 0.7)], "query_id string, rank int, paper_id int, score double")
    entities = spark.createDataFrame([(2, "topic", "t"), (3, "topic", "t"), (1, "author", "a")], "paper_id int, kind string, entity_id string")
    order = lambda **k: [r.paper_id for r in S.rerank(cand, entities, **k).orderBy("rank").collect()]
    assert order(alpha=1.0) == [1, 2, 3] and order(alpha=0.0) == [2, 3, 1]
    assert S.rerank(cand, entities, top_k=0).count() == 0
    assert all(r.fallback_used and r.score == r.semantic_score for r in S.rerank(cand, None).collect())
    for bad in ({"topic": 1.0}, {"topic": -1, "author": 1, "institution": 1}, {"topic": 0, "author": 0, "institution": 0}):
        with pytest.raises(ValueError):
            S.check_weights(bad)
    with pytest.raises(ValueError):
        S.rerank(cand, entities, alpha=2.0)


def test_judgments(spark):
    items = spark.createDataFrame([("q", 1, 2, ""), ("q", 2, None, ""), ("r", 3, 0, "")], "query_id string, paper_id int, relevance int, notes string")
    audit = one(J.validate(items, items))
    assert (audit.missing, audit.is_ready) == (1, False)
    with pytest.raises(ValueError):
        J.compile_qrels(items, items)
    fixed = J.apply_corrections(items, spark.createDataFrame([("q", 2, 1, "why")], "query_id string, paper_id int, relevance int, rationale string"))
    assert one(fixed.where("paper_id = 2")).notes == "[HUMAN_CORRECTED: was None] why"
    assert J.compile_qrels(items, fixed).count() == 3


def test_qrels_round_trip(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"Q1": {"W1": 2, "W2": 0}}))
    qrels = read_qrels(spark, f"file://{tmp_path}/q.json")
    assert sorted(map(tuple, qrels.collect())) == [("Q1", "W1", 2), ("Q1", "W2", 0)]
    assert json.loads(one(nested_qrels(qrels)).judgments) == {"W1": 2, "W2": 0}


def test_rest_client():
    calls, waits = [], []
    pages = {"*": {"results": ["u", "v"], "meta": {"next_cursor": "k2"}}, "k2": {"results": [], "meta": {"next_cursor": "k3"}}, "k3": {"results": ["w"], "meta": {"next_cursor": None}}}

    def get(url):
        calls.append(url)
        if len(calls) == 2:
            raise HttpError(503)
        return pages[urllib.parse.parse_qs(urllib.parse.urlparse(url).query)["cursor"][0]]

    client = RestClient("http://somewhere", get, per_second=1e9, sleep=waits.append)
    # An empty page is the last one, whatever its cursor says; the refused call is made again.
    assert list(client.pages("items", {})) == ["u", "v"] and len(calls) == 3 and waits
    assert list(client.pages("items", {}, most=1)) == ["u"]

    def refuse(url):
        raise HttpError(404)

    with pytest.raises(HttpError):
        RestClient("http://somewhere", refuse, sleep=waits.append).get("a", {})


def test_rest_rate_limit():
    waits = []
    client = RestClient("http://somewhere", lambda url: {"results": [], "meta": {}}, per_second=4, sleep=waits.append)
    for _ in range(4):
        client.get("items", {})
    assert len(waits) >= 3 and all(0 < x <= 0.25 for x in waits[-3:])
