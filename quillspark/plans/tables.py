"""The test tables in the roles of a scholarly corpus.

Documents are papers with text and benchmark passages are queries; orders are papers of the graph,
parts their researchers, suppliers their institutions, brands their topics. Nation 0 is home.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import graph as G
from quillspark.runtime import size

#: Bytes of the lines whose edges one task makes distinct.
PART_BYTES = 8 << 20
HOME = "NATION_0"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), F.col("text").alias("search_text"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "benchmark")
    return rows.select(F.col("item_id").alias("query_id"), F.concat(F.lit("domain_"), (F.col("item_id") % 4).cast("string")).alias("domain"), F.col("text").alias("query_text"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("paper_id"), "embedding", "label")


def vector_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector asks all others and itself."""
    return read(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def edges(spark: SparkSession, sf_dir: str, repeats: bool = False) -> DataFrame:
    """Each edge once, or with ``repeats`` as often as a line draws it, for who only asks what is connected.

    A paper's lines are made distinct together, in as many parts as the table's size asks for: what a
    task holds does not grow with the table."""
    parts_of = max(1, -(-size(spark, f"{sf_dir}/lineitem.parquet") // PART_BYTES))
    once = (lambda df: df) if repeats else (lambda df: df.repartition(parts_of, "l_orderkey").distinct())
    lines = read(spark, sf_dir, "lineitem")
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    orders = read(spark, sf_dir, "orders")
    wrote = once(lines.select("l_partkey", "l_orderkey")).select(*G.edge("Researcher", F.col("l_partkey"), "Paper", F.col("l_orderkey"), G.AUTHORED))
    at = once(lines.select("l_orderkey", "l_suppkey")).select(*G.edge("Paper", F.col("l_orderkey"), "Institution", F.col("l_suppkey"), G.AFFILIATED))
    about = once(lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_brand")).select(*G.edge("Paper", F.col("l_orderkey"), "Topic", F.col("p_brand"), G.ABOUT))
    year = orders.select(*G.edge("Paper", F.col("o_orderkey"), "Year", F.year("o_orderdate"), G.PUBLISHED))
    return wrote.unionByName(at).unionByName(about).unionByName(year)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(name: str, column, kind: str) -> DataFrame:
        return read(spark, sf_dir, name).select(F.lit(kind).alias("node_type"), column.cast("string").alias("node_id"))

    return (
        of("orders", F.col("o_orderkey"), "Paper")
        .unionByName(of("part", F.col("p_partkey"), "Researcher"))
        .unionByName(of("supplier", F.col("s_suppkey"), "Institution"))
        .unionByName(of("part", F.col("p_brand"), "Topic").distinct())
        .unionByName(of("orders", F.year("o_orderdate"), "Year").distinct())
    )


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("paper_id"))


def institutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation")
    return read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").cast("string").alias("institution_id"), F.col("s_name").alias("name"), F.col("n_name").alias("country"))


def customer_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers and their orders: a graph of many components, with isolates."""
    orders = read(spark, sf_dir, "orders")
    links = orders.select(*G.edge("Researcher", F.col("o_custkey"), "Paper", F.col("o_orderkey"), G.AUTHORED))
    customers = read(spark, sf_dir, "customer").select(F.lit("Researcher").alias("node_type"), F.col("c_custkey").cast("string").alias("node_id"))
    return customers.unionByName(orders.select(F.lit("Paper").alias("node_type"), F.col("o_orderkey").cast("string").alias("node_id"))), links
