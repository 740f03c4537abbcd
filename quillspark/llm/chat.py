"""Chat formatting with cumulative-snapshot collapse.

Loggers often write a conversation anew after every turn, so a log holds many conversations that
are prefixes of longer ones. Every turn gets two 64-bit hashes of its place, role and text; their
running xor over a conversation's turns is the hash of the prefix that ends there (places make the
xor depend on the order). A conversation whose whole hash is the prefix hash of a longer one is a
snapshot, and anti-joins keep the maximal conversations, which are then rendered.

DataFrame functions only. Both sides of the joins are aggregated to one row a hash first, so a
first turn or a conversation that a third of all logs share costs a task one row. Running values
are computed within blocks of turns and carried over between blocks, so a conversation with a third
of all turns is sorted by many tasks; it is rendered in parts of so many turns, one row a part,
so no cell holds an unbounded text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import table
from quillspark.runtime import stash

#: Turn numbers that make up one block.
BLOCK = 64


def _numbered(turns: DataFrame) -> DataFrame:
    """Distinct turns with their place in the conversation (from 0), block by block."""
    distinct = turns.select("conv_id", "turn", "role", "text").distinct()
    blocked = distinct.withColumn("block", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / BLOCK))
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    blocked = stash(blocked.withColumn("k", F.row_number().over(inside) - 1), "chat-turns").df
    sizes = blocked.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = stash(sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), "chat-bases").df
    placed = blocked.join(bases, (blocked["conv_id"].eqNullSafe(bases["conv_id"])) & (blocked["block"] == bases["block"]))
    return placed.select(blocked["conv_id"], blocked["block"], (F.col("k") + F.col("base")).alias("place"), "role", "text")


def _prefixes(placed: DataFrame) -> DataFrame:
    """``(conv_id, block, place, h1, h2)``: the hash of the prefix that ends at each place."""
    one = placed.select(
        "conv_id", "block", "place",
        F.xxhash64(F.lit(1), "place", F.col("role").isNull(), "role", F.col("text").isNull(), "text").alias("a"),
        F.xxhash64(F.lit(2), "text", F.col("text").isNull(), "role", F.col("role").isNull(), "place").alias("b"),
    )
    inside = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rolled = stash(one.select("conv_id", "block", "place", F.bit_xor("a").over(inside).alias("a"), F.bit_xor("b").over(inside).alias("b")), "chat-rolled").df
    last = F.max(F.struct("place", "a", "b")).alias("last")
    ends = rolled.groupBy("conv_id", "block").agg(last).select("conv_id", "block", "last.a", "last.b")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("conv_id", "block", F.coalesce(F.bit_xor("a").over(before), F.lit(0)).alias("ca"), F.coalesce(F.bit_xor("b").over(before), F.lit(0)).alias("cb"))
    carried = stash(carried, "chat-carried").df
    both = rolled.join(carried, (rolled["conv_id"].eqNullSafe(carried["conv_id"])) & (rolled["block"] == carried["block"]))
    return both.select(rolled["conv_id"], "place", F.col("a").bitwiseXOR(F.col("ca")).alias("h1"), F.col("b").bitwiseXOR(F.col("cb")).alias("h2"))


def maximal(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns with their places, and ``(conv_id, n_turns, n_copies, n_snapshots)`` of each
    conversation that no longer one continues; of equal ones that with the smallest conv_id stays."""
    placed = stash(_numbered(turns), "chat-placed").df
    prefixes = stash(_prefixes(placed), "chat-prefixes").df
    lengths = prefixes.groupBy("conv_id").agg(F.max(F.struct("place", "h1", "h2")).alias("end"))
    whole = lengths.select("conv_id", "end.place", "end.h1", "end.h2")
    least = F.min(F.struct(F.col("conv_id").isNull().alias("no_id"), "conv_id")).alias("least")
    groups = stash(whole.groupBy("place", "h1", "h2").agg(least, F.count("*").alias("n_copies")), "chat-groups").df
    # Prefixes that end before their conversation does: all rows of a hash but the whole conversations.
    seen = prefixes.groupBy("place", "h1", "h2").agg(F.count("*").alias("n_seen"))
    longer = seen.join(groups, ["place", "h1", "h2"]).where(F.col("n_seen") > F.col("n_copies")).select("place", "h1", "h2")
    top = groups.join(longer, ["place", "h1", "h2"], "left_anti")
    return placed, stash(top.select(F.col("least.conv_id").alias("conv_id"), (F.col("place") + 1).alias("n_turns"), "n_copies"), "chat-maximal").df


def render(turns: DataFrame, part_turns: int = BLOCK) -> DataFrame:
    """Render the maximal conversations of ``turns(conv_id, turn, role, text)``.

    One row for each part of up to ``part_turns`` turns: ``conv_id, part, n_turns`` (of the whole
    conversation), ``n_copies`` (equal conversations, itself included) and ``rendered``, the turns
    as ``<|role|>\\ntext\\n``. Turns are ordered by turn number, then role and text; a null role is
    ``unknown`` and a null text empty; a null conv_id is one conversation. Rows that repeat in all
    four columns count once. Extra columns are ignored; an empty table gives an empty result.
    """
    placed, top = maximal(turns)
    kept = placed.join(top, placed["conv_id"].eqNullSafe(top["conv_id"])).drop(placed["conv_id"])
    said = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    parts = kept.withColumn("part", F.floor(F.col("place") / part_turns)).withColumn("said", F.struct("place", said.alias("line")))
    grouped = parts.groupBy("conv_id", "n_turns", "n_copies", "part").agg(F.sort_array(F.collect_list("said")).alias("lines"))
    return grouped.select("conv_id", "part", "n_turns", "n_copies", F.array_join(F.col("lines.line"), "").alias("rendered"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(table(spark, sf_dir, "conversations"))


#: Maximal conversations by comparing whole prefixes, rendered in the same parts.
ORACLE_SQL = """
WITH d AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
p AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS place,
         '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) AS line
  FROM d),
w AS (SELECT conv_id, count(*) AS n_turns, string_agg(line, '' ORDER BY place) AS whole FROM p GROUP BY conv_id),
u AS (SELECT min(conv_id) AS conv_id, any_value(n_turns) AS n_turns, count(*) AS n_copies, whole FROM w GROUP BY whole),
x AS (SELECT place + 1 AS n, string_agg(line, '') OVER (PARTITION BY conv_id ORDER BY place) AS prefix, conv_id FROM p),
longer AS (SELECT DISTINCT x.prefix FROM x JOIN w ON w.conv_id = x.conv_id WHERE x.n < w.n_turns),
m AS (SELECT * FROM u WHERE whole NOT IN (SELECT prefix FROM longer))
SELECT m.conv_id, CAST(floor(p.place / 64) AS BIGINT) AS part, m.n_turns, m.n_copies, string_agg(p.line, '' ORDER BY p.place) AS rendered
FROM m JOIN p ON p.conv_id = m.conv_id GROUP BY ALL
"""
