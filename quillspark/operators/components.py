"""Connected components by local contraction.

Łącki, Mirrokni and Włodarczyk, "Connected Components at Scale via Local Contractions" (2018). Nodes
are the 64-bit hashes of their keys, so their order is a random one. Edges first meet in blocks, as
they are read: a block leaves a star for each of its components. Then every node goes over to its
least neighbour and the edges are drawn anew between those, in one aggregation and two equi-joins,
until the rest fits one block; the nodes' ways are followed back by one join a level. What a level
leaves is written to the shared folder, which cuts the lineage.

A second hash of the key tells whether two keys share the first one; then all is done again with
another salt. A hub's links share a join key: they are spread over tasks only by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.runtime import discard, stash

#: Edges that meet in a block, and that one task may finish.
BLOCK = 1 << 21
_EDGE = "u long, v long, u2 long, v2 long"


def _least(size: int, a, b):
    """For each of ``size`` numbers the least one that the edges a, b lead to."""
    import numpy as np

    to = np.arange(size)
    while len(a):
        np.minimum.at(to, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(nxt := to[to], to):
            to = nxt
        a, b = to[a], to[b]
        a, b = a[open_ := a != b], b[open_]
    return to


def _stars(block: int):
    import numpy as np
    import pyarrow as pa

    names = ["u", "v", "u2", "v2"]

    def star(batches):
        u, v, u2, v2 = (np.concatenate([b.column(n).to_numpy() for b in batches]) for n in names)
        keys, first, place = np.unique(np.concatenate([u, v]), return_index=True, return_inverse=True)
        other = np.concatenate([u2, v2])
        if (other[first][place] == other).all():
            to = _least(len(keys), place[: len(u)], place[len(u) :])
            leaf = np.nonzero(to != np.arange(len(keys)))[0]
            second = other[first]
            u, v, u2, v2 = keys[leaf], keys[to[leaf]], second[leaf], second[to[leaf]]
        # Else two keys share a hash: the edges stay as they are, for the level that looks at them.
        for i in range(0, len(u), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)]) for x in (u, v, u2, v2)], names)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= block:
                yield from star(held)
                held, size = [], 0
        if size:
            yield from star(held)

    return run


def contracted(edges: DataFrame, block: int = BLOCK, max_levels: int = 60) -> DataFrame | None:
    """``u, u2, root`` of every node of ``edges(u, v, u2, v2)``, hashes of keys; none if two keys share ``u``."""
    levels = []
    now = stash(edges.where("u <> v or u2 <> v2").mapInArrow(_stars(block), _EDGE), "cc")
    for _ in range(max_levels):
        if (left := now.df.count()) <= block:
            break
        both = now.df.select("u", "v", "u2").unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("v2").alias("u2")))
        near = both.groupBy("u").agg(F.min("u2").alias("u2"), F.max("u2").alias("most"), F.least(F.min("v"), F.col("u")).alias("m"))
        near = stash(near, "cc-level")
        if near.df.where("u2 <> most").limit(1).count():
            return None
        levels.append(near.df.select("u", "u2", "m"))
        # Further levels have one second hash: all keys have been looked at.
        to = near.df.select("u", "m")
        moved = now.df.select("u", "v").join(to, "u").select(F.col("m").alias("a"), "v")
        moved = moved.join(to.withColumnRenamed("u", "v"), "v").select(F.col("a").alias("u"), F.col("m").alias("v")).where("u <> v")
        nxt = stash(moved.select("u", "v", F.lit(0).cast("long").alias("u2"), F.lit(0).cast("long").alias("v2")).mapInArrow(_stars(block), _EDGE), "cc")
        discard(edges.sparkSession, now)
        now = nxt
    else:
        raise RuntimeError("connected components did not settle")
    # A star's block is one task's: what is left meets once more, and every leaf has its root.
    last = stash(now.df.coalesce(1).mapInArrow(_stars(left + 1), _EDGE), "cc-last").df
    discard(edges.sparkSession, now)
    found = last.select("u", "u2", F.col("v").alias("root")).unionByName(last.select(F.col("v").alias("u"), F.col("v2").alias("u2"), F.col("v").alias("root")).distinct())
    if not levels and found.groupBy("u").count().where("count > 1").limit(1).count():
        return None
    for level in reversed(levels):
        roots = found.select(F.col("u").alias("m"), "root")
        found = level.join(roots, "m", "left").select("u", "u2", F.coalesce("root", "m").alias("root"))
    return found


def hashes(salt: int, *key: str) -> tuple:
    """Two hashes of a key of one or more columns."""
    return F.xxhash64(F.lit(salt), *key), F.xxhash64(F.lit(~salt), *reversed(key), F.lit(salt))


def roots(edges: DataFrame, src: list[str], dst: list[str], block: int = BLOCK) -> tuple[DataFrame, int]:
    """``u, u2, root`` for every node with an edge, and the salt of its ``hashes``; edges with a null end are ignored."""
    rows = edges.dropna(subset=[*src, *dst])
    for salt in range(4):
        (u, u2), (v, v2) = hashes(salt, *src), hashes(salt, *dst)
        found = contracted(rows.select(u.alias("u"), v.alias("v"), u2.alias("u2"), v2.alias("v2")), block)
        if found is not None:
            return found, salt
    raise RuntimeError("nodes share hashes with every salt")


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v", block: int = BLOCK) -> DataFrame:
    """Return ``(node, component)`` for every node with an edge; component is its smallest node.

    Null ends and self-loops are ignored; repeated edges count once. An empty edge table gives an
    empty result.
    """
    both = edges.select(F.array(src, dst).alias("e"))  # of one type
    rows = both.select(F.get("e", 0).alias("u"), F.get("e", 1).alias("v"))
    found, salt = roots(rows, ["u"], ["v"], block)
    nodes = rows.dropna().where("u <> v").select(F.explode(F.array("u", "v")).alias("node")).distinct()
    h, h2 = hashes(salt, "node")
    rooted = stash(nodes.withColumns({"u": h, "u2": h2}).join(found, ["u", "u2"]).select("node", "root"), "cc-nodes").df
    return rooted.join(rooted.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "component")
