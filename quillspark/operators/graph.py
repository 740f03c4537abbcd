"""The scholarly property graph: building, entity resolution, topology and patterns.

Nodes are five tables, edges one: ``source_type, source_id, target_type, target_id, rel_type, score``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import none_if_empty, present, synthetic_id
from quillspark.operators.components import connected_components, hashes, roots
from quillspark.operators.normalize import ID_PREFIX
from quillspark.runtime import stash

AUTHORED, AFFILIATED, ABOUT, PUBLISHED = "AUTHORED", "AFFILIATED_WITH", "ABOUT", "PUBLISHED_IN"
#: What a paper should have, and by which edge.
KINDS_OF = {"researchers": AUTHORED, "institutions": AFFILIATED, "topics": ABOUT, "year": PUBLISHED}
EDGE_KEY = ["source_type", "source_id", "target_type", "target_id", "rel_type"]


def edge(source_type: str, source: Column, target_type: str, target: Column, rel: str, score: Column | None = None) -> list[Column]:
    return [
        F.lit(source_type).alias("source_type"), source.cast("string").alias("source_id"),
        F.lit(target_type).alias("target_type"), target.cast("string").alias("target_id"),
        F.lit(rel).alias("rel_type"), (F.lit(None) if score is None else score).cast("double").alias("score"),
    ]


def first_by(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key by an explicit ordinal: an aggregation, not a sort."""
    rest = [c for c in df.columns if c not in (*key, order)]
    if len(rest) == 1:  # a plain value by a plain ordinal is aggregated in a hash table
        return df.groupBy(*key).agg(F.min_by(rest[0], F.col(order)).alias(rest[0]))
    picked = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("row"))
    return picked.select(*key, *(F.col(f"row.{c}").alias(c) for c in rest))


def build_graph(works: DataFrame, ordinal: str = "ordinal") -> dict[str, DataFrame]:
    """Canonical nodes and edges of normalized works; first wins by ``ordinal`` for nodes and edges.

    Authors and institutions without an id get a synthetic one from their name; topics without id
    or name are skipped; a topic has its hierarchy only if it is the primary topic of the first
    work that mentions it.
    """
    o = F.col(ordinal)
    address = lambda c: F.when(present(c), F.concat(F.lit(ID_PREFIX), c)).alias("openalex_url")
    papers = works.where(present("id"))
    paper = first_by(papers.select(
        "id", F.coalesce(none_if_empty("title"), F.lit("Untitled")).alias("title"), "doi", "publication_year", "publication_date",
        F.col("type").alias("work_type"), "source_name", "is_oa", "oa_status", F.col("abstract_text").alias("abstract"), "search_text",
        "cited_by_count", F.col("raw_id").alias("openalex_url"), o.alias("o"),
    ), ["id"], "o")
    authors = papers.select("id", o.alias("o"), F.posexplode("authors").alias("k", "a")).select(
        F.col("id").alias("paper"), F.struct("o", "k").alias("o"),
        known(F.col("a"), "AUTH", "Unknown Author").alias("id"),
        F.coalesce(none_if_empty("a.name"), F.lit("Unknown Author")).alias("display_name"), F.lit(None).cast("string").alias("orcid"), address("a.id"),
    )
    places = papers.select("id", o.alias("o"), F.posexplode("institutions").alias("k", "i")).select(
        F.col("id").alias("paper"), F.struct("o", "k").alias("o"),
        known(F.col("i"), "INST", "Unknown Institution").alias("id"),
        F.coalesce(none_if_empty("i.name"), F.lit("Unknown Institution")).alias("display_name"), F.col("i.ror").alias("ror"),
        F.col("i.country_code").alias("country_code"), F.lit(None).cast("string").alias("type"), address("i.id"),
    )
    main = lambda c: F.when(F.col("t.name") == F.col("primary_topic"), F.col(f"primary_topic_{c}")).alias(c)
    topics = papers.select("id", o.alias("o"), "primary_topic", "primary_topic_subfield", "primary_topic_field", "primary_topic_domain", F.posexplode("topics").alias("k", "t")).where(present("t.id") & present("t.name")).select(
        F.col("id").alias("paper"), F.struct("o", "k").alias("o"), F.col("t.id").alias("id"), F.col("t.name").alias("display_name"), main("subfield"), main("field"), main("domain"), address("t.id"), F.col("t.score").alias("score"),
    )
    years = papers.where(F.coalesce(F.col("publication_year") != 0, F.lit(False)))
    return {
        "papers": paper,
        "researchers": first_by(authors.drop("paper"), ["id"], "o"),
        "institutions": first_by(places.drop("paper"), ["id"], "o"),
        "topics": first_by(topics.drop("paper", "score"), ["id"], "o"),
        "years": years.select(F.col("publication_year").alias("value")).distinct(),
        "edges": first_by(_drawn(papers, ordinal), EDGE_KEY, "o"),
    }


def _drawn(papers: DataFrame, ordinal: str) -> DataFrame:
    """All edges of every mention of a paper with their place ``o``, of the four kinds in one pass over the works.

    The place is the mention's ordinal and the place in its list: of a whole-number ordinal one number."""
    o, whole = F.col(ordinal), dict(papers.dtypes)[ordinal] in ("tinyint", "smallint", "int", "bigint")
    at = lambda k: (F.struct(o.alias("o"), k.alias("k")) if not whole else o.cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + k.cast("decimal(10,0)")).alias("o")

    def edges(items: str, ends) -> Column:
        rows = F.transform(F.coalesce(items, F.array().cast(papers.schema[items].dataType)), lambda x, k: F.struct(*ends(x), at(k)))
        return F.filter(rows, lambda r: r["source_id"].isNotNull() & r["target_id"].isNotNull()) if items == "topics" else rows

    author = lambda a: known(a, "AUTH", "Unknown Author")
    place = lambda i: known(i, "INST", "Unknown Institution")
    topic = lambda t: F.when(present(t["id"]) & present(t["name"]), t["id"])
    year = F.when(F.coalesce(F.col("publication_year") != 0, F.lit(False)), F.array(F.struct(*edge("Paper", F.col("id"), "Year", F.col("publication_year"), PUBLISHED), at(F.lit(0)))))
    every = F.concat(
        edges("authors", lambda a: edge("Researcher", author(a), "Paper", F.col("id"), AUTHORED)),
        edges("institutions", lambda i: edge("Paper", F.col("id"), "Institution", place(i), AFFILIATED)),
        edges("topics", lambda t: edge("Paper", F.col("id"), "Topic", topic(t), ABOUT, t["score"])),
        F.coalesce(year, F.array()),
    )
    return papers.select(F.explode(every).alias("x")).select("x.*")


def known(x: Column, kind: str, nobody: str) -> Column:
    """The id of an author or institution, or a synthetic one from the name."""
    return F.when(present(x["id"]), x["id"]).otherwise(synthetic_id(kind, F.coalesce(none_if_empty(x["name"]), F.lit(nobody))))


def resolution_audit(mentions: DataFrame) -> DataFrame:
    """One row of counts over ``mentions(id, name)``, the raw author or institution instances."""
    known = mentions.where(present("id"))
    variants = known.groupBy("id").agg(F.count_distinct("name").alias("n")).agg(F.count_if(F.col("n") > 1).alias("ids_with_variants"), F.count("*").alias("unique_ids"))
    homonyms = known.where(present("name")).groupBy(F.lower("name").alias("name")).agg(F.count_distinct("id").alias("n")).agg(F.count_if(F.col("n") > 1).alias("names_with_ids"))
    missing = mentions.agg(F.count_if(~present("id")).alias("missing_instances"))
    return variants.crossJoin(homonyms).crossJoin(missing)  # one row each


def variants(mentions: DataFrame, top: int = 5) -> DataFrame:
    """Samples of ids with several names, most names first: ``id, n, names``."""
    named = mentions.where(present("id") & present("name")).groupBy("id").agg(F.sort_array(F.collect_set("name")).alias("names"))
    return named.select("id", F.size("names").alias("n"), "names").where("n > 1").orderBy(F.desc("n"), "id").limit(top)


def homonyms(mentions: DataFrame, top: int = 5) -> DataFrame:
    """Samples of names, letter case aside, that several ids share, most ids first: ``name, n, ids``."""
    found = mentions.where(present("id") & present("name")).groupBy(F.lower("name").alias("name")).agg(F.sort_array(F.collect_set("id")).alias("ids"))
    return found.select("name", F.size("ids").alias("n"), "ids").where("n > 1").orderBy(F.desc("n"), "name").limit(top)


def ends(edges: DataFrame) -> DataFrame:
    """Both ends of every edge as ``node_type, node_id, rel_type``; a node's key is its type and id."""
    both = F.array(F.struct(F.col("source_type").alias("node_type"), F.col("source_id").alias("node_id")), F.struct(F.col("target_type").alias("node_type"), F.col("target_id").alias("node_id")))
    return edges.select("rel_type", F.explode(both).alias("x")).select("x.*", "rel_type")


def census(df: DataFrame, column: str) -> DataFrame:
    """Counts by type with a total row."""
    return df.rollup(column).agg(F.count("*").alias("n")).select(F.coalesce(column, F.lit("total")).alias("kind"), "n")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node_type, node_id, degree`` of all nodes in the undirected multigraph, isolates with 0."""
    counts = ends(edges).groupBy("node_type", "node_id").agg(F.count("*").alias("degree"))
    return nodes.select("node_type", "node_id").join(counts, ["node_type", "node_id"], "left").select("node_type", "node_id", F.coalesce("degree", F.lit(0)).alias("degree"))


def paper_degrees(papers: DataFrame, edges: DataFrame) -> DataFrame:
    """Researchers, institutions and topics of every paper, zeros included."""
    each = edges.where(F.col("rel_type").isin(AUTHORED, AFFILIATED, ABOUT)).select(F.when(F.col("rel_type") == AUTHORED, F.col("target_id")).otherwise(F.col("source_id")).alias("paper_id"), "rel_type")
    count = lambda rel, name: F.count_if(F.col("rel_type") == rel).alias(name)
    counts = each.groupBy("paper_id").agg(count(AUTHORED, "n_researchers"), count(AFFILIATED, "n_institutions"), count(ABOUT, "n_topics"))
    return papers.select("paper_id").join(counts, "paper_id", "left").fillna(0, ["n_researchers", "n_institutions", "n_topics"])


def isolates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(ends(edges), ["node_type", "node_id"], "left_anti")


def hubs(nodes: DataFrame, edges: DataFrame, node_type: str, top: int = 15) -> DataFrame:
    return degrees(nodes.where(F.col("node_type") == node_type), edges.where((F.col("source_type") == node_type) | (F.col("target_type") == node_type))).orderBy(F.desc("degree"), "node_id").limit(top)


def repeated_edges(edges: DataFrame) -> DataFrame:
    """``n``: keys of edges that come more than once. Only edges that share a hash are compared by their keys."""
    hashed = edges.withColumn("_hash", F.xxhash64(*EDGE_KEY))
    suspects = stash(hashed.groupBy("_hash").agg(F.count("*").alias("n")).where("n > 1").select("_hash"), "edge-hashes").df
    if not suspects.limit(1).count():
        return suspects.agg(F.count("*").alias("n"))
    return hashed.join(suspects, "_hash", "left_semi").groupBy(*EDGE_KEY).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("n"))


def integrity(nodes: DataFrame, papers: DataFrame, edges: DataFrame) -> DataFrame:
    """``check, violations``, all computed: keys, ends of edges and what papers lack.

    Ends, nodes and papers are counted together by type and id, in one aggregation; a null id is no node's.
    """
    flags = ("node", "paper", "end", *KINDS_OF)
    row = lambda kind, i, **set_: F.struct(F.col(kind).alias("node_type") if kind else F.lit("Paper").alias("node_type"), F.col(i).cast("string").alias("node_id"), *((set_.get(f) if f in set_ else F.lit(0)).cast("int").alias(f) for f in flags))
    is_ = lambda rel: F.when(F.col("rel_type") == rel, 1).otherwise(0)
    one = F.lit(1)
    source = row("source_type", "source_id", end=one, **{k: is_(rel) for k, rel in KINDS_OF.items() if rel != AUTHORED})
    target = row("target_type", "target_id", end=one, researchers=is_(AUTHORED))
    rows = edges.select(F.explode(F.array(source, target)).alias("x")).select("x.*")
    rows = rows.unionByName(nodes.select(row("node_type", "node_id", node=one).alias("x")).select("x.*"))
    rows = rows.unionByName(papers.select(row(None, "paper_id", paper=one).alias("x")).select("x.*"))
    counts = rows.groupBy("node_type", "node_id").agg(*(F.sum(f).alias(f) for f in flags))
    lost = F.col("node_type").isNull() | F.col("node_id").isNull()
    without = lambda k: F.sum(F.when((F.col(k) == 0) | lost, F.col("paper")).otherwise(0))
    found = counts.agg(
        F.count_if(F.col("node") > 1).alias("duplicate_node_ids"), F.sum(F.when((F.col("node") == 0) | lost, F.col("end")).otherwise(0)).alias("dangling_edge_ends"),
        *(without(k).alias(f"papers_without_{k}") for k in KINDS_OF),
    )
    pairs = F.array(*(F.struct(F.lit(c).alias("check"), F.coalesce(c, F.lit(0)).alias("violations")) for c in found.columns))
    repeated = repeated_edges(edges).select(F.lit("duplicate_edges").alias("check"), F.col("n").alias("violations"))
    return found.select(F.explode(pairs).alias("x")).select("x.*").unionByName(repeated)


def subgraph(nodes: DataFrame, edges: DataFrame, node_types: list[str], rel_types: list[str]) -> tuple[DataFrame, DataFrame]:
    return nodes.where(F.col("node_type").isin(node_types)), edges.where(F.col("rel_type").isin(rel_types))


def coauthors(edges: DataFrame) -> DataFrame:
    """``a, b, n_shared``: the co-author projection, a < b, with the papers they share."""
    wrote = edges.where(F.col("rel_type") == AUTHORED).select(F.col("source_id").alias("r"), F.col("target_id").alias("p")).distinct()
    left, right = wrote.select(F.col("r").alias("a"), "p"), wrote.select(F.col("r").alias("b"), "p")
    return left.join(right, "p").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n_shared"))


def component_sizes(nodes: DataFrame, edges: DataFrame, count_type: str | None = None, named: bool = True) -> DataFrame:
    """``component, size`` of the undirected graph; isolates are components of one.

    With ``count_type`` only nodes of that type count: researchers who share a paper are connected
    through it, so the co-author projection need not be built to count its components. A component's
    name is its smallest node; who needs sizes alone goes without, ``named=False``.
    """
    if named:
        key = lambda t, i: F.concat(t, F.lit(":"), i)
        links = edges.select(key("source_type", "source_id").alias("u"), key("target_type", "target_id").alias("v"))
        found = connected_components(links)
        every = nodes.select(key("node_type", "node_id").alias("node"), "node_type").join(found, "node", "left")
        by = [F.coalesce("component", "node").alias("component")]
    else:
        found, salt = roots(edges, ["source_type", "source_id"], ["target_type", "target_id"])
        h, h2 = hashes(salt, "node_type", "node_id")
        every = nodes.withColumns({"u": h, "u2": h2}).join(found, ["u", "u2"], "left")
        by = ["root", F.when(F.col("root").isNull(), F.col("node_type")).alias("t"), F.when(F.col("root").isNull(), F.col("node_id")).alias("i")]
    if count_type:
        every = every.where(F.col("node_type") == count_type)
    return every.groupBy(*by).agg(F.count("*").alias("size")).select(*(["component", "size"] if named else ["size"]))


def component_summary(sizes: DataFrame) -> DataFrame:
    """Components, nodes, the largest component and its share, and isolates."""
    out = sizes.agg(F.count("*").alias("n_components"), F.sum("size").alias("n_nodes"), F.max("size").alias("largest"), F.count_if(F.col("size") == 1).alias("isolates"))
    return out.withColumn("largest_pct", F.round(F.coalesce(F.try_divide(F.col("largest") * 100.0, F.col("n_nodes")), F.lit(0.0)), 2))


def papers_by_institution(edges: DataFrame, institution: str, top: int = 20) -> DataFrame:
    hit = (F.col("rel_type") == AFFILIATED) & (F.col("target_id") == institution)
    return edges.where(hit).select(F.col("source_id").alias("paper_id")).orderBy("paper_id").limit(top)


def institution_pairs(edges: DataFrame, institutions: DataFrame, home: str, top: int = 20) -> DataFrame:
    """``a, b, n``: institutions that share papers, a < b and a at home, most papers first."""
    at = edges.where(F.col("rel_type") == AFFILIATED).select(F.col("source_id").alias("p"), F.col("target_id").alias("i")).distinct()
    domestic = at.join(institutions.where(F.col("country") == home).select(F.col("institution_id").alias("i")), "i", "left_semi")
    pairs = domestic.select(F.col("i").alias("a"), "p").join(at.select(F.col("i").alias("b"), "p"), "p").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "a", "b").limit(top)


def topic_neighbours(edges: DataFrame, paper: str, top: int = 50) -> DataFrame:
    """Papers that share topics with ``paper``, most shared first."""
    about = edges.where(F.col("rel_type") == ABOUT).select(F.col("source_id").alias("paper_id"), F.col("target_id").alias("t"))
    own = about.where(F.col("paper_id") == paper).select("t").distinct()
    return about.where(F.col("paper_id") != paper).join(own, "t").groupBy("paper_id").agg(F.count("*").alias("n_shared")).orderBy(F.desc("n_shared"), "paper_id").limit(top)


def neighbourhood(papers: DataFrame, edges: DataFrame) -> DataFrame:
    """``paper_id, topics, authors, institutions``: sorted ids one step away, empty where there is none.

    Every kind is aggregated before it is joined, so three kinds never multiply.
    """
    near = edges.where(F.col("rel_type").isin(AUTHORED, AFFILIATED, ABOUT)).select(
        F.when(F.col("rel_type") == AUTHORED, F.col("target_id")).otherwise(F.col("source_id")).alias("paper_id"), "rel_type",
        F.when(F.col("rel_type") == AUTHORED, F.col("source_id")).otherwise(F.col("target_id")).alias("entity"),
    )
    near = near.join(papers.select("paper_id").distinct(), "paper_id", "left_semi")
    ids = lambda rel, name: F.sort_array(F.collect_set(F.when(F.col("rel_type") == rel, F.col("entity")))).alias(name)
    found = near.groupBy("paper_id").agg(ids(ABOUT, "topics"), ids(AUTHORED, "authors"), ids(AFFILIATED, "institutions"))
    empty = F.array().cast("array<string>")
    return papers.select("paper_id").distinct().join(found, "paper_id", "left").select("paper_id", *(F.coalesce(c, empty).alias(c) for c in ("topics", "authors", "institutions")))


def upsert_nodes(existing: DataFrame, incoming: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """MERGE: incoming non-null properties overwrite, others stay.

    Of incoming rows with one key the last by ``order`` wins, property by property; without ``order``
    they must agree, and the greatest value of each property is taken.
    """
    rest = [c for c in existing.columns if c not in key]
    given = [c for c in rest if c in incoming.columns]
    last = [(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))) if order else F.max(c)).alias(c) for c in given]
    new = incoming.groupBy(*key).agg(*last) if last else incoming.select(*key).distinct()
    old = existing.select(*key, *(F.col(c).alias(f"_old_{c}") for c in rest))
    return old.join(new, key, "full").select(*key, *(F.coalesce(F.col(c) if c in given else F.lit(None), F.col(f"_old_{c}")).alias(c) for c in rest))


def upsert_edges(existing: DataFrame, incoming: DataFrame, nodes: DataFrame, order: str | None = None) -> DataFrame:
    """MERGE of edges; one whose ends do not both exist is dropped."""
    for side in ("source", "target"):
        known = nodes.select(F.col("node_type").alias(f"{side}_type"), F.col("node_id").alias(f"{side}_id"))
        incoming = incoming.join(known, [f"{side}_type", f"{side}_id"], "left_semi")
    return upsert_nodes(existing, incoming, EDGE_KEY, order)
