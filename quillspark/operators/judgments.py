"""The judgment workflow: masked batches, rule labels, corrections, validation and qrels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import strip
from quillspark.runtime import stash

BRIEF = 50


def init_batches(candidates: DataFrame, batches: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """Masked items of ``candidates(query_id, query_text, paper_id, title, abstract)`` in the batch of
    their query (``batches(query_id, batch_id)``); earlier labels and notes are kept.

    The list of batches goes to the items: a query's texts never meet in one task."""
    items = candidates.select("query_id", "query_text", "paper_id", "title", "abstract").join(F.broadcast(batches), "query_id")
    if earlier is None:
        return items.select("batch_id", *candidates.columns, F.lit(None).cast("int").alias("relevance"), F.lit("").alias("notes"))
    return items.join(earlier.select("query_id", "paper_id", "relevance", "notes"), ["query_id", "paper_id"], "left").withColumn("notes", F.coalesce("notes", F.lit("")))


def apply_rules(items: DataFrame, rules: DataFrame, default: int = 0) -> DataFrame:
    """Label ``items(query_id, title, abstract)`` by the first rule whose every group has a word in the text.

    A rule is data: ``query_id, priority, all_of`` (groups of alternatives), ``label, note``. Items
    no rule fits get ``default``. The rules of a query go to its items as one list, by priority, so
    no text is shuffled.
    """
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))))
    lists = rules.where("priority is not null").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("priority", "label", "note", "all_of"))).alias("_rules"))
    rows = items.drop("relevance", "notes").withColumn("_text", text).join(F.broadcast(lists), "query_id", "left")
    fits = lambda rule: F.forall(rule["all_of"], lambda group: F.exists(group, lambda word: F.contains(F.col("_text"), word)))
    out = rows.withColumn("_hit", F.get(F.filter("_rules", fits), 0))
    return out.withColumns({"relevance": F.coalesce("_hit.label", F.lit(default)), "notes": F.coalesce("_hit.note", F.lit("no rule"))}).drop("_hit", "_rules", "_text")


def flag_uncertain(items: DataFrame, reasons: tuple[str, str] = ("no_text", "middle_label")) -> DataFrame:
    """Mark items to be audited with the code of the reason: a missing or brief abstract, else a label of 1."""
    brief = F.char_length(F.coalesce(strip("abstract"), F.lit(""))) < BRIEF
    reason = F.when(brief, reasons[0]).when(F.col("relevance") == 1, reasons[1])
    return items.withColumn("audit_reason", reason).withColumn("notes", F.when(reason.isNotNull(), F.concat(F.lit("[AUDIT_FLAG: "), reason, F.lit("] "), F.coalesce("notes", F.lit("")))).otherwise(F.col("notes")))


def apply_corrections(items: DataFrame, corrections: DataFrame) -> DataFrame:
    """Upsert ``corrections(query_id, paper_id, relevance, rationale)``; the note keeps the old label."""
    new = corrections.select("query_id", "paper_id", F.col("relevance").alias("_new"), "rationale")
    rows = items.join(new, ["query_id", "paper_id"], "left")
    note = F.concat(F.lit("[HUMAN_CORRECTED: was "), F.coalesce(F.col("relevance").cast("string"), F.lit("None")), F.lit("] "), F.coalesce("rationale", F.lit("")))
    return rows.withColumn("notes", F.when(F.col("_new").isNotNull(), note).otherwise(F.col("notes"))).withColumn("relevance", F.coalesce("_new", "relevance")).drop("_new", "rationale")


def point_update(items: DataFrame, query_id, paper_id, relevance: int, notes: str) -> DataFrame:
    hit = (F.col("query_id") == query_id) & (F.col("paper_id") == paper_id)
    return items.withColumns({"relevance": F.when(hit, relevance).otherwise(F.col("relevance")), "notes": F.when(hit, notes).otherwise(F.col("notes"))})


def validate(expected: DataFrame, items: DataFrame) -> DataFrame:
    """One row: counts of the audit and whether the judgments are complete."""
    judged = items.where(F.col("relevance").isNotNull())
    pairs = judged.select("query_id", "paper_id").distinct()
    want = expected.select("query_id", "paper_id").distinct()
    both = want.withColumn("e", F.lit(1)).join(pairs.withColumn("j", F.lit(1)), ["query_id", "paper_id"], "full")
    counts = both.agg(F.count("e").alias("expected_pairs"), F.count("j").alias("recorded"), F.count_if(F.col("j").isNull()).alias("missing"), F.count_if(F.col("e").isNull()).alias("unexpected"))
    # An item after an earlier judged one of its pair is a duplicate; without file order: all but one.
    repeats = items.groupBy("query_id", "paper_id").agg((F.count("*") - 1).alias("n"), F.count("relevance").alias("judged")).where("judged > 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicates"))
    invalid = judged.agg(F.count_if(~F.col("relevance").isin(0, 1, 2)).alias("invalid"))
    out = counts.crossJoin(repeats).crossJoin(invalid)  # one row each
    ready = (F.col("recorded") == F.col("expected_pairs")) & (F.col("missing") == 0) & (F.col("invalid") == 0) & (F.col("duplicates") == 0)
    return out.withColumn("is_ready", ready)


def query_progress(expected: DataFrame, items: DataFrame) -> DataFrame:
    judged = items.where(F.col("relevance").isNotNull()).select("query_id", "paper_id").distinct().withColumn("j", F.lit(1))
    rows = expected.select("query_id", "paper_id").distinct().join(judged, ["query_id", "paper_id"], "left")
    return rows.groupBy("query_id").agg(F.count("*").alias("n_expected"), F.count("j").alias("n_judged")).withColumn("complete", F.col("n_expected") == F.col("n_judged"))


def batch_stats(items: DataFrame) -> DataFrame:
    valid = F.coalesce(F.col("relevance").isin(0, 1, 2), F.lit(False))
    return items.groupBy("batch_id").agg(F.count("*").alias("total"), F.count_if(valid).alias("completed"), F.count_if(F.col("relevance").isNull()).alias("missing"))


def compile_qrels(expected: DataFrame, items: DataFrame, order: str | None = None) -> DataFrame:
    """Qrels of complete judgments; raises while the audit is not ready. With ``order`` the last of
    repeated judgments wins instead of blocking."""
    rows = items
    if order:
        last = items.where(F.col("relevance").isNotNull()).groupBy("query_id", "paper_id").agg(F.max_by("relevance", order).alias("relevance"))
        rows = last
    audit = validate(expected, rows).first()
    if not audit["is_ready"]:
        raise ValueError(f"judgments are not ready: {audit.asDict()}")
    return rows.select("query_id", "paper_id", F.col("relevance").cast("int").alias("relevance"))


def label_histogram(qrels: DataFrame) -> DataFrame:
    from quillspark.operators.profile import percent

    counts = qrels.groupBy("relevance").agg(F.count("*").alias("n"))
    total = qrels.agg(F.count("*").alias("total"))
    return counts.crossJoin(total).select("relevance", "n", percent(F.col("n"), F.col("total")).alias("pct"))  # one total


def number_items(items: DataFrame) -> DataFrame:
    """Items with their number in the query, by paper_id; the ids are numbered alone and the texts joined back.

    The ids are dealt out by ranges and each range is numbered by itself, from the count of those before it.
    """
    parts = stash(items.select("query_id", "paper_id").distinct().repartitionByRange("query_id", "paper_id").withColumn("_part", F.spark_partition_id()), "item-ranges").df
    earlier = Window.partitionBy("query_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy("query_id", "_part").agg(F.count("*").alias("n")).select("query_id", "_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("query_id", "_part").orderBy("paper_id"))
    numbers = parts.withColumn("item", within).join(F.broadcast(counts), ["query_id", "_part"]).select("query_id", "paper_id", (F.col("item") + F.col("_before")).cast("int").alias("item"))
    return items.join(numbers, ["query_id", "paper_id"])


def markdown_export(items: DataFrame) -> DataFrame:
    """One Markdown text a query: its numbered, masked items."""
    line = F.concat(F.lit("### "), F.col("item").cast("string"), F.lit(". "), F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("abstract", F.lit("(No abstract)")), F.lit("\n"))
    rows = number_items(items).withColumn("line", F.struct("item", line.alias("text")))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("line")), lambda x: x["text"]), "\n").alias("markdown"))
