"""Retrieval evaluation: pools, metrics, summaries, sweeps, paired tests and diversity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.pvalues import t_p_value, z_p_value

#: Added to means of rounded values, so that decimal halves do not fall with the last bit of a sum.
HALF = 1e-9
METRICS = ("p_at_5", "p_at_10", "recall_at_10", "mrr", "ndcg_at_5", "ndcg_at_10")


def pool(results: DataFrame, top_k: int = 10) -> DataFrame:
    """Union of the systems' top results, one row a query and paper, with who found it and where.

    ``results(system, query_id, rank, paper_id)``; of ranks of one system the best counts.
    """
    best = results.where(F.col("rank") <= top_k).groupBy("query_id", "paper_id", "system").agg(F.min("rank").alias("rank"))
    found = F.sort_array(F.collect_list(F.struct("system", "rank"))).alias("found")
    rows = best.groupBy("query_id", "paper_id").agg(found)
    return rows.select("query_id", "paper_id", F.col("found.system").alias("retrieved_by"), F.map_from_entries("found").alias("source_ranks"))


def pool_documents(pooled: DataFrame, results: DataFrame, documents: DataFrame) -> DataFrame:
    """The pool with ``title`` and ``abstract`` of ``documents(paper_id, title, abstract)``; a paper that the
    corpus lacks keeps the title it was found with in ``results(query_id, paper_id, title)``."""
    found = results.groupBy("query_id", "paper_id").agg(F.min("title").alias("_found"))
    rows = pooled.join(found, ["query_id", "paper_id"], "left").join(documents.select("paper_id", "title", "abstract", F.lit(True).alias("_known")), "paper_id", "left")
    return rows.withColumn("title", F.when(F.col("_known"), F.col("title")).otherwise(F.col("_found"))).drop("_found", "_known")


def latency_summary(readings: DataFrame) -> DataFrame:
    """``query, n, mean_ms, median_ms, p95_ms`` of ``readings(query, ms)``."""
    ms = lambda p: F.round(F.percentile("ms", p), 2)
    return readings.groupBy("query").agg(F.count("*").alias("n"), F.round(F.avg("ms"), 2).alias("mean_ms"), ms(0.5).alias("median_ms"), ms(0.95).alias("p95_ms"))


def pool_summary(pooled: DataFrame, queries: DataFrame) -> DataFrame:
    """Pool sizes by domain."""
    sizes = pooled.groupBy("query_id").agg(F.count("*").alias("n"))
    rows = queries.select("query_id", "domain").join(sizes, "query_id", "left").fillna(0, ["n"])
    return rows.groupBy("domain").agg(F.count("*").alias("n_queries"), F.sum("n").alias("total"), F.round(F.avg("n"), 2).alias("mean"), F.min("n").alias("min"), F.max("n").alias("max"))


def _gain(rel):
    return F.pow(F.lit(2.0), rel) - 1


def per_query(results: DataFrame, queries: DataFrame, qrels: DataFrame, threshold: int = 1) -> DataFrame:
    """All metrics for each system and query; a query without results counts as zeros.

    Unjudged papers count as not relevant; ``judged_hits_at_10`` tells how many were judged.
    """
    rel = F.coalesce("relevance", F.lit(0))
    hit = F.when(rel >= threshold, 1).otherwise(0)
    at = lambda k, x: F.sum(F.when(F.col("rank") <= k, x).otherwise(0))
    gain = _gain(rel) / F.log2(F.col("rank") + 1.0)
    judged = results.select("system", "query_id", "rank", "paper_id").join(qrels, ["query_id", "paper_id"], "left")
    got = judged.groupBy("system", "query_id").agg(
        at(5, hit).alias("h5"), at(10, hit).alias("h10"), F.min(F.when(rel >= threshold, F.col("rank"))).alias("first"),
        at(5, gain).alias("dcg5"), at(10, gain).alias("dcg10"), at(10, F.when(F.col("relevance").isNotNull(), 1).otherwise(0)).alias("judged"),
    )
    by = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "paper_id")
    ideal = qrels.withColumn("k", F.row_number().over(by)).groupBy("query_id").agg(
        F.count_if(F.col("relevance") >= threshold).alias("relevant"),
        *(F.sum(F.when(F.col("k") <= k, _gain(F.col("relevance")) / F.log2(F.col("k") + 1.0)).otherwise(0)).alias(f"idcg{k}") for k in (5, 10)),
    )
    asked = queries.select("query_id").crossJoin(results.select("system").distinct())  # a handful of systems
    rows = asked.join(got, ["system", "query_id"], "left").join(ideal, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    share = lambda a, b: F.round(F.when(zero(b) > 0, F.least(F.lit(1.0), zero(a) / b)).otherwise(0.0), 4)
    return rows.select(
        "system", "query_id",
        F.round(zero("h5") / 5.0, 4).alias("p_at_5"), F.round(zero("h10") / 10.0, 4).alias("p_at_10"),
        share(F.col("h10"), F.col("relevant")).alias("recall_at_10"),
        F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 4).alias("mrr"),
        share(F.col("dcg5"), F.col("idcg5")).alias("ndcg_at_5"), share(F.col("dcg10"), F.col("idcg10")).alias("ndcg_at_10"),
        zero("judged").cast("long").alias("judged_hits_at_10"),
    )


def summarize(metrics: DataFrame, *by: str) -> DataFrame:
    """Means of the rounded per-query metrics, by system and whatever else is named."""
    return metrics.groupBy("system", *by).agg(F.count("*").alias("n_queries"), *(F.round(F.avg(m) + HALF, 4).alias(m) for m in METRICS))


def long_form(metrics: DataFrame) -> DataFrame:
    return metrics.unpivot(["system", "query_id"], list(METRICS), "metric", "value")


def paired(metrics: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``pair, metric, query_id, diff``: B minus A of the same query."""
    rows = long_form(metrics)
    wanted = metrics.sparkSession.createDataFrame(pairs, "a string, b string")
    left = rows.select(F.col("system").alias("a"), "query_id", "metric", F.col("value").alias("va"))
    right = rows.select(F.col("system").alias("b"), "query_id", "metric", F.col("value").alias("vb"))
    joined = left.join(wanted, "a").join(right, ["b", "query_id", "metric"])
    return joined.select(F.concat("b", F.lit(" vs "), "a").alias("pair"), "metric", "query_id", (F.col("vb") - F.col("va")).alias("diff"))


def t_test(diffs: DataFrame) -> DataFrame:
    """Paired t statistics and Cohen's d by pair and metric."""
    rows = diffs.groupBy("pair", "metric").agg(F.count("*").alias("n"), F.avg("diff").alias("mean"), F.coalesce(F.stddev_samp("diff"), F.lit(0.0)).alias("sd"))
    flat = F.col("sd") < 1e-12
    still = F.abs("mean") < 1e-12
    t = F.when(F.col("n") < 2, 0.0).when(flat & still, 0.0).when(flat, F.signum("mean") * float("inf")).otherwise(F.col("mean") / (F.col("sd") / F.sqrt("n")))
    out = rows.withColumn("t", t).withColumn("cohens_d", F.when(flat | (F.col("n") < 2), 0.0).otherwise(F.col("mean") / F.col("sd")))
    return out.select("pair", "metric", "n", F.round(F.col("mean") + HALF, 6).alias("mean_diff"), F.round("sd", 6).alias("std_diff"), F.round("t", 4).alias("t_stat"), F.round("cohens_d", 4).alias("cohens_d"), "t")


def with_t_p_value(tests: DataFrame) -> DataFrame:
    p = F.when(F.col("n") < 2, 1.0).otherwise(F.round(t_p_value("t", (F.col("n") - 1).cast("double")), 6))
    return tests.withColumn("p_value", p).drop("t")


def wilcoxon(diffs: DataFrame) -> DataFrame:
    """Signed-rank statistics by pair and metric; zero differences are dropped, ties share a rank."""
    rows = diffs.withColumn("d", F.round("diff", 8)).withColumn("size", F.abs("d"))
    totals = rows.groupBy("pair", "metric").agg(F.count("*").alias("n_total"))
    key = Window.partitionBy("pair", "metric")
    moved = rows.where("size > 1e-9").withColumn("low", F.rank().over(key.orderBy("size"))).withColumn("ties", F.count("*").over(Window.partitionBy("pair", "metric", "size")))
    moved = moved.withColumn("place", F.col("low") + (F.col("ties") - 1) / 2.0)
    # A tie group of t rows adds t^3 - t once, so each of its rows adds t^2 - 1.
    sums = moved.groupBy("pair", "metric").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("place")).otherwise(0.0)).alias("plus"),
        F.sum(F.when(F.col("d") < 0, F.col("place")).otherwise(0.0)).alias("minus"), F.sum(F.col("ties") * F.col("ties") - 1).alias("tied"),
    )
    out = totals.join(sums, ["pair", "metric"], "left").fillna(0, ["n", "tied"]).fillna(0.0, ["plus", "minus"])
    n, w = F.col("n"), F.least("plus", "minus")
    variance = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("tied") / 48.0
    mid = n * (n + 1) / 4.0
    z = F.when(variance <= 0, 0.0).when(w < mid, (w - mid + 0.5) / F.sqrt(variance)).when(w > mid, (w - mid - 0.5) / F.sqrt(variance)).otherwise(0.0)
    r = F.when(F.col("plus") + F.col("minus") > 0, (F.col("plus") - F.col("minus")) / (F.col("plus") + F.col("minus"))).otherwise(0.0)
    return out.select("pair", "metric", "n_total", n.cast("long").alias("n_nonzero"), F.round(w, 2).alias("w_stat"), F.round("plus", 2).alias("w_plus"), F.round("minus", 2).alias("w_minus"), F.round(z, 4).alias("z_stat"), F.round(r, 4).alias("rank_biserial_r"), z.alias("z"))


def with_z_p_value(tests: DataFrame) -> DataFrame:
    return tests.withColumn("p_value", F.round(z_p_value("z"), 6)).drop("z")


def deltas(metrics: DataFrame, systems: list[str], metric: str = "ndcg_at_10") -> DataFrame:
    """One row a query with the metric of every system."""
    return metrics.groupBy("query_id").pivot("system", systems).agg(F.round(F.first(metric), 4))


def diversity(results: DataFrame, entities: DataFrame, queries: DataFrame, top_k: int = 10, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """``system, query_id, kind, n_unique, entropy, simpson`` of the entities of each result list;
    a query without results has zeros. ``entities(paper_id, kind, entity_id)`` keeps repeats; ``kinds``
    are those of the entities unless given."""
    top = results.where(F.col("rank") <= top_k).select("system", "query_id", "paper_id")
    counts = top.join(entities, "paper_id").groupBy("system", "query_id", "kind", "entity_id").agg(F.count("*").alias("c"))
    # Both measures from sums of c, c log c and c squared, so no total has to be joined back.
    sums = counts.groupBy("system", "query_id", "kind").agg(F.count("*").alias("n_unique"), F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("clog"), F.sum(F.col("c") * F.col("c")).alias("sq"))
    n = F.col("n")
    entropy = F.round(F.greatest(F.lit(0.0), F.log2(n) - F.col("clog") / n), 4)
    simpson = F.when(n <= 1, 0.0).otherwise(F.round(1 - F.col("sq") / (n * n), 4))
    kind = entities.sparkSession.createDataFrame([(k,) for k in kinds], "kind string") if kinds else entities.select("kind").distinct()
    every = queries.select("query_id").crossJoin(results.select("system").distinct()).crossJoin(kind)  # systems and kinds: a handful
    found = sums.select("system", "query_id", "kind", "n_unique", entropy.alias("entropy"), simpson.alias("simpson"))
    return every.join(found, ["system", "query_id", "kind"], "left").fillna(0, ["n_unique"]).fillna(0.0, ["entropy", "simpson"])


def diversity_means(rows: DataFrame) -> DataFrame:
    return rows.groupBy("system", "kind").agg(F.round(F.avg("n_unique") + HALF, 2).alias("n_unique"), F.round(F.avg("entropy") + HALF, 4).alias("entropy"), F.round(F.avg("simpson") + HALF, 4).alias("simpson"))
