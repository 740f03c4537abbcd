"""Command line: ``python -m quillspark ingest|graph|query|list``.

``ingest`` fetches works page by page (unless told to skip it), normalizes them, profiles them and
writes metrics and a report; ``graph`` builds nodes and edges of normalized works; ``query`` runs a
registered query over a folder of tables.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.graph import build_graph
from quillspark.operators.normalize import normalize_works
from quillspark.operators.profile import completeness, work_fields
from quillspark.plans.registry import QUERIES
from quillspark.plans.reports import report
from quillspark.runtime import ship
from quillspark.schemas import RAW_WORK
from quillspark.sources.files import append_jsonl, overwrite, read_jsonl, run_metadata, write_metrics


def _fetch(spark: SparkSession, base: str, endpoint: str, filter_: str, most: int, per_page: int) -> DataFrame:
    from quillspark.sources.rest import RestSource

    spark.dataSource.register(RestSource)
    options = {"base": base, "endpoint": endpoint, "filter": filter_, "max_records": str(most), "per_page": str(per_page)}
    pages = spark.read.format("rest_pages").options(**options).load()
    return pages.select(F.from_json("record", RAW_WORK).alias("x")).select("x.*")


def ingest(spark: SparkSession, args) -> None:
    raw = f"{args.out}/raw"
    if not args.skip_fetch:
        append_jsonl(_fetch(spark, args.base, args.endpoint, args.filter, args.max_works, args.page_size), raw)
    overwrite(normalize_works(read_jsonl(spark, raw, RAW_WORK)), f"{args.out}/works")
    fields = completeness(spark.read.parquet(f"{args.out}/works"), work_fields())
    write_metrics(fields, f"{args.out}/metrics")
    write_metrics(run_metadata(spark, {"source": args.base, "max_works": args.max_works}), f"{args.out}/run")
    text = report("Data quality", {"Completeness": spark.read.json(f"{args.out}/metrics").select(*fields.columns)})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{args.out}/report")


def graph(spark: SparkSession, args) -> None:
    works = spark.read.parquet(f"{args.out}/works").withColumn("ordinal", F.struct("raw_id", "title"))
    for name, table in build_graph(works).items():
        overwrite(table, f"{args.out}/graph/{name}")


def query(spark: SparkSession, args) -> None:
    found = QUERIES[args.name](spark, args.tables)
    if args.out:
        overwrite(found, args.out)
    else:
        found.show(args.rows, truncate=False)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillspark", description=__doc__.splitlines()[0])
    commands = top.add_subparsers(dest="command", required=True)
    one = commands.add_parser("ingest", help="fetch, normalize and profile works")
    one.add_argument("--out", required=True)
    one.add_argument("--base", default="")
    one.add_argument("--endpoint", default="works")
    one.add_argument("--filter", default="")
    one.add_argument("--max-works", type=int, default=1000)
    one.add_argument("--page-size", type=int, default=100)
    one.add_argument("--skip-fetch", action="store_true", help="profile what was fetched before")
    two = commands.add_parser("graph", help="build the graph of normalized works")
    two.add_argument("--out", required=True)
    three = commands.add_parser("query", help="run a registered query")
    three.add_argument("name", choices=sorted(QUERIES))
    three.add_argument("tables", help="folder of the Parquet tables")
    three.add_argument("--out", help="folder for the result; shown if left out")
    three.add_argument("--rows", type=int, default=20)
    commands.add_parser("list", help="names of the registered queries")
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(QUERIES)))
        return
    spark = SparkSession.builder.appName("quillspark").getOrCreate()
    ship(spark)
    {"ingest": ingest, "graph": graph, "query": query}[args.command](spark, args)


if __name__ == "__main__":
    main()
