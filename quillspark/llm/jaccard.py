"""Near duplicates by the exact Jaccard similarity of five-word shingles: 0.8 or more links two texts.

Two searches give the pairs to confirm. First the caller's over fingerprints (SimHash by pigeonring,
see ``simhash``), which finds most. A fingerprint only estimates the similarity, so the pairs that it
has not brought into one group are then searched completely, by prefix filtering. Put the shingles of every text in one global order; two
sets of sizes n and m with a similarity of t share t * max(n, m) shingles at least, so the first
shingle they share is among the first n - ceil(t * n) + 1 of one and the first m - ceil(t * m) + 1
of the other. Those shingles are a text's keys. Any global order will do; here shingles that a
sample finds frequent come last, so a common line makes no bucket unless a text is made of it.

The texts of a key are led by that with the least row number, and keys with the same leader make up
one bucket: two texts that share a key still meet, and copies that share all their keys meet once
instead of once a key. In a bucket pairs are dropped by odd sketches: of each class of shingles one
bit, whether a set has an odd number of them. Sketches differ in no more bits than their sets in
shingles, and similar sets differ in (n + m) / 9 at most, so no link is lost. Sketches grow with the
sets and are folded to the shorter one. A pair becomes a link only by its exact similarity, computed
from both sets (64-bit hashes of shingles). Texts with equal sets are one row throughout.

So that a large group does not have all its pairs checked, confirmed links are joined to groups and only
pairs in two groups are checked further: every text against its leaders, then the pairs of a bucket; where they are many, first a spanning forest of the nearest, and once its links are joined,
all pairs that are still in two groups: none is left out. A bucket beyond ``limit`` rows is cut into blocks and each block is paired
with each other one and itself, so a task holds two blocks. Keys that the sample finds in more than a
thousandth of the rows find their leaders by an aggregation with map-side combination, the others by
a window of narrow rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import blocks, majority, pick, shingle_hashes
from quillspark.operators.components import connected_components
from quillspark.runtime import discard, stash

WORDS = 5
#: Least similarity, as a fraction.
OVER, UNDER = 4, 5
#: Rows of a bucket that meet in one task.
BUCKET_LIMIT = 65_536
#: Rows sampled for the order, frequent shingles it tells apart, and from how many rows of the sample a
#: key counts as hot: none changes the result.
SAMPLE, FREQUENT, HOT = 20_000, 500_000, 20
#: Bits of the shortest sketch. Pairs a row of a bucket that are checked at once.
BITS, FEW = 512, 4


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(text, WORDS))


def sketch(found: np.ndarray) -> bytes:
    """Odd sketch of a set, of half a bit a shingle or more."""
    bits = BITS
    while 2 * bits < len(found):
        bits *= 2
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(cell: bytes, bits: int = BITS) -> np.ndarray:
    """A sketch as it would be with fewer ``bits``."""
    return np.bitwise_xor.reduce(np.frombuffer(cell, np.uint64).reshape(-1, bits // 64), axis=0)


def apart(a: bytes, b: bytes) -> int:
    """Differing bits of two sketches: a lower bound on the differing shingles of their sets."""
    bits = 8 * min(len(a), len(b))
    return int(np.bitwise_count(folded(a, bits) ^ folded(b, bits)).sum())


def prefix(found: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a set, its first shingles by (count in the sample, hash), and which of them are hot."""
    hashes, counts = frequent
    n = len(found)
    if not n:
        return found, np.empty(0, bool)
    seen = np.zeros(n, np.int64)
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
        seen = np.where(hashes[at] == found, counts[at], 0)
    first = np.argsort(seen, kind="stable")[: n - -(-OVER * n // UNDER) + 1]
    return found[first], seen[first] >= HOT


def _frequent(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the shingles that are frequent in a sample of the rows."""
    share = SAMPLE / max(1, rows.count())
    sample = rows if share >= 1 else rows.where(F.pmod(F.xxhash64("rid"), F.lit(1 << 30)) < int((1 << 30) * share))

    def run(batches):
        for batch in blocks(batches):
            sets = [shingle_set(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["key"])

    counts = sample.select("text").mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 2")
    found = counts.orderBy(F.desc("n"), "key").limit(FREQUENT).toArrow()
    hashes = found.column("key").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], found.column("n").to_numpy()[order]


def _described(shared):
    def run(batches):
        for batch in blocks(batches):
            sets = [shingle_set(x) for x in batch.column("text").to_pylist()]
            names = np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets])
            keys = [(k.view(np.int64), hot) for k, hot in (prefix(s, shared.value) for s in sets)]
            lists = [pa.array([k[h == side] for k, h in keys], pa.list_(pa.int64())) for side in (False, True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int32()), pa.array(names[:, 0]), pa.array(names[:, 1]), *lists, pa.array([sketch(s) for s in sets], pa.binary()), pa.array([majority(s).tobytes() for s in sets], pa.binary())],
                ["rid", "doc_id", "n", "s0", "s1", "keys", "hot_keys", "sketch", "print"],
            )

    return run


def _sets(batches):
    for batch in blocks(batches):
        yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array([shingle_set(x).tobytes() for x in batch.column("text").to_pylist()], pa.binary())], ["id", "found"])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets (sorted, distinct) have the least similarity."""
    both = len(a) + len(b) - len(np.union1d(a, b))
    return UNDER * both >= OVER * (len(a) + len(b) - both)


def _confirm(batches):
    for batch in batches:
        left, right = batch.column("a"), batch.column("b")
        ok = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(left, right)]
        yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs ``(u, v)`` whose sets have the least similarity."""
    ids = pairs.select(F.explode(F.array("u", "v")).alias("id"))
    sets = stash(pick(docs.select("rid", "text"), "rid", ids).mapInArrow(_sets, "id long, found binary"), "jaccard-sets")
    both = pairs.join(sets.df.select(F.col("id").alias("u"), F.col("found").alias("a")), "u")
    both = both.join(sets.df.select(F.col("id").alias("v"), F.col("found").alias("b")), "v")
    links = stash(both.select("u", "v", "a", "b").mapInArrow(_confirm, "u long, v long"), "jaccard-links").df
    discard(docs.sparkSession, sets)
    return links


def buckets(rows: DataFrame) -> DataFrame:
    """``(lead, id)`` of the distinct texts ``rows(id, keys, hot_keys)`` that share a key with another one."""
    keys = rows.select(F.explode("keys").alias("key"), "id")
    of_key = Window.partitionBy("key")
    led = keys.select("id", F.min("id").over(of_key).alias("lead"), F.max("id").over(of_key).alias("last")).where("lead < last").select("lead", "id")
    hot = rows.select(F.explode("hot_keys").alias("key"), "id")
    heads = hot.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead < last").select("key", "lead")
    # One row a hot key, FREQUENT of them at most.
    return led.unionByName(hot.join(F.broadcast(heads), "key").select("lead", "id")).distinct()


def fit(n, m):
    """Whether sets of these sizes can have the least similarity."""
    return UNDER * np.minimum(n, m) >= OVER * np.maximum(n, m)


def _near(n, m, bits):
    return (UNDER + OVER) * bits <= (UNDER - OVER) * (n + m)


def _stars(batches):
    """Texts beside their leaders in, pairs that may be links out."""
    for batch in batches:
        n, m = (batch.column(x).to_numpy().astype(np.int64) for x in ("n", "m"))
        cells = zip(batch.column("sketch").to_pylist(), batch.column("lead_sketch").to_pylist(), fit(n, m).tolist())
        bits = np.array([apart(a, b) if fit else 1 << 40 for a, b, fit in cells], np.int64)
        yield batch.select(["u", "v"]).filter(pa.array(_near(n, m, bits), pa.bool_()))


def bucket_pairs(ids: np.ndarray, sizes: np.ndarray, parts: np.ndarray, block: np.ndarray, sketches: list[bytes], across: bool):
    """Pairs of a bucket in two groups (and two blocks, if ``across``) that may be links by size and sketch."""
    _, inverse, counts = np.unique(parts, return_inverse=True, return_counts=True)
    rest = inverse != counts.argmax()  # a pair of two groups has a row outside the largest
    few = np.flatnonzero(rest)
    short = np.stack([folded(x) for x in sketches])
    step = max(1, (1 << 20) // len(ids))
    for at in range(0, len(few), step):
        a = few[at : at + step]
        ok = (inverse[a][:, None] != inverse[None, :]) & fit(sizes[a][:, None], sizes[None, :]) & (~rest[None, :] | (ids[a][:, None] < ids[None, :]))
        if across:
            ok &= block[a][:, None] != block[None, :]
        i, j = np.nonzero(ok)
        i = a[i]
        for start in range(0, len(i), 1 << 18):
            u, v = i[start : start + (1 << 18)], j[start : start + (1 << 18)]
            near = _near(sizes[u], sizes[v], np.bitwise_count(short[u] ^ short[v]).sum(axis=1, dtype=np.int64))
            u, v = u[near], v[near]
            long = [len(sketches[x]) > BITS // 8 < len(sketches[y]) and not _near(sizes[x], sizes[y], apart(sketches[x], sketches[y])) for x, y in zip(u.tolist(), v.tolist())]
            u, v = u[~np.array(long, bool)], v[~np.array(long, bool)]
            if len(u):
                yield np.stack([u, v, np.bitwise_count(short[u] ^ short[v]).sum(axis=1, dtype=np.int64)], axis=1)


def spanning(pairs: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Of ``pairs`` (two rows and their distance) the nearest that join the groups as all of them would."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    kept = []
    order = np.argsort(pairs[:, 2], kind="stable")
    for k, a, b in zip(order.tolist(), parts[pairs[order, 0]].tolist(), parts[pairs[order, 1]].tolist()):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append(k)
    return pairs[kept]


def chosen(chunks, parts: np.ndarray) -> tuple[np.ndarray, bool]:
    """All pairs of a bucket if they are few; else a spanning forest of them, and that it is one."""
    held, forest = np.empty((0, 3), np.int64), False
    for chunk in chunks:
        held = np.concatenate([held, chunk])
        if len(held) > FEW * len(parts):
            held, forest = spanning(held, parts), True
    return held, forest


def _pairs(sparse: bool, search: Callable):
    """Rows sorted by (lead, lower, upper) in, pairs out; holds one bucket, or two blocks of one, and a batch.

    If ``sparse``, dense buckets give a spanning forest of their pairs and their leader with a null.
    """
    names = ["lead", "lower", "upper", "id", "n", "part", "block"]

    def work(rows, cells, starts, ends):
        u, v, dense = [], [], []
        for s, e in zip(starts, ends):
            lead, lower, upper = rows[s, :3].tolist()
            ids = rows[s:e, 3]
            chunks = search(ids, rows[s:e, 4], rows[s:e, 5], rows[s:e, 6], cells[s:e], lower != upper)
            if sparse:
                chunk, forest = chosen(chunks, rows[s:e, 5])
                dense += [lead] if forest else []
                chunks = [chunk]
            for chunk in chunks:
                a, b = ids[chunk[:, 0]], ids[chunk[:, 1]]
                u.append(np.minimum(a, b))
                v.append(np.maximum(a, b))
                if sum(map(len, u)) > 500_000:
                    yield out(np.concatenate(u), np.concatenate(v))
                    u, v = [], []
        if u:
            yield out(np.concatenate(u), np.concatenate(v))
        if dense:
            yield out(np.array(dense), [None] * len(dense))

    def out(u, v):
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    def run(batches):
        held: list[tuple[np.ndarray, list[bytes]]] = []

        def whole():
            return np.concatenate([x for x, _ in held]), [c for _, cells in held for c in cells]

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(x).to_numpy().astype(np.int64) for x in names], axis=1)
            held.append((rows, batch.column("sketch").to_pylist()))
            if (held[0][0][0, :3] == rows[-1, :3]).all():
                continue
            rows, cells = whole()
            cuts = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
            last = int(cuts[-1])
            held = [(rows[last:].copy(), cells[last:])]
            yield from work(rows, cells, [0, *cuts[:-1].tolist()], cuts.tolist())
        if held:
            rows, cells = whole()
            yield from work(rows, cells, [0], [len(rows)])

    return run


def bucketed_pairs(rows: DataFrame, limit: int, sparse: bool, search: Callable = bucket_pairs) -> DataFrame:
    """Pairs of two groups of ``rows(lead, id, n, sketch, part)`` that share a bucket and may be links
    by ``search``: all of them, once each, or if ``sparse`` as ``_pairs`` says."""
    sizes = rows.groupBy("lead").agg(F.count("*").alias("size"), F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("lead", "size")
    n = F.ceil(F.col("size") / F.lit(limit)).cast("int")
    rows = rows.join(sizes, "lead").withColumn("block", F.pmod(F.xxhash64("id"), n).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    rows = rows.select("lead", F.least("block", "other").alias("lower"), F.greatest("block", "other").alias("upper"), "id", "n", "part", "block", "sketch")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, "lead", "lower", "upper").sortWithinPartitions("lead", "lower", "upper")
    return rows.mapInArrow(_pairs(sparse, search), "u long, v long").distinct()


def near_groups(docs: DataFrame, search: Callable[[DataFrame, int], DataFrame], limit: int = BUCKET_LIMIT) -> DataFrame:
    """``(rid, doc_id, node)`` for every row of ``docs(rid, doc_id, text)``; rows of a group share the node, a rid of theirs.

    ``search`` gives pairs ``(u, v)`` that may be links of the distinct texts ``(id, n, print)`` by their
    fingerprints. Texts without words are copies of each other. A null doc_id is nothing special.
    """
    spark = docs.sparkSession
    shared_order = spark.sparkContext.broadcast(_frequent(docs))
    kind = dict(docs.dtypes)["doc_id"]
    described = docs.select("rid", "doc_id", "text").mapInArrow(
        _described(shared_order), f"rid long, doc_id {kind}, n int, s0 long, s1 long, keys array<long>, hot_keys array<long>, sketch binary, print binary"
    )
    rows = stash(described, "jaccard-rows").df
    distinct = stash(rows.groupBy("s0", "s1").agg(F.min("rid").alias("id")), "jaccard-distinct").df
    pairs = stash(search(pick(rows.where("n > 0").select(F.col("rid").alias("id"), "n", "print"), "id", distinct), limit), "jaccard-ring")
    links = confirmed(pairs.df, docs)
    discard(spark, pairs)
    led = stash(buckets(pick(rows.select(F.col("rid").alias("id"), "keys", "hot_keys"), "id", distinct)), "jaccard-buckets")
    texts = pick(rows.select(F.col("rid").alias("id"), "n", "sketch"), "id", led.df)
    shared = stash(led.df.join(texts, "id"), "jaccard-shared")
    rest = shared.df
    for step in ("stars", "sparse", "all"):
        parts = connected_components(links).select(F.col("node").alias("id"), F.col("component").alias("part"))
        grouped = stash(rest.join(parts, "id", "left").withColumn("part", F.coalesce("part", "id")), "jaccard-grouped")
        if step == "stars":
            leaders = grouped.df.where("id = lead").select("lead", F.col("n").alias("m"), F.col("sketch").alias("lead_sketch"), F.col("part").alias("lead_part"))
            stars = grouped.df.where("id <> lead").join(leaders, "lead").where("part <> lead_part").select(F.col("lead").alias("u"), F.col("id").alias("v"), "n", "m", "sketch", "lead_sketch")
            found = stash(stars.mapInArrow(_stars, "u long, v long").distinct(), "jaccard-pairs")
        else:
            found = stash(bucketed_pairs(grouped.df, limit, step == "sparse"), "jaccard-pairs")
        links = links.unionByName(confirmed(found.df.where("v is not null"), docs))
        dense = stash(found.df.where("v is null").select(F.col("u").alias("lead")).distinct(), "jaccard-dense").df if step == "sparse" else None
        discard(spark, grouped, found)
        if dense is not None:
            if dense.isEmpty():
                break
            rest = shared.df.join(dense, "lead", "left_semi")
    discard(spark, led, shared)
    nodes = distinct.join(connected_components(links).withColumnRenamed("node", "id"), "id", "left")
    return rows.select("rid", "doc_id", "s0", "s1").join(nodes.select("s0", "s1", F.coalesce("component", "id").alias("node")), ["s0", "s1"]).select("rid", "doc_id", "node")
