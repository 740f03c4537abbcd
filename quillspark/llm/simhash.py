"""SimHash near-dedup with pigeonring filtering.

A fingerprint is cut into ``m`` segments on a ring. If two fingerprints differ in at most ``d``
bits, some start exists from which every chain of ``l`` consecutive segments differs in at most
``l * d / m`` bits (Qin and Xiao, "Pigeonring", 2018). The index key takes the first two links of
such a chain: with four segments and d = 2 the first segment is equal (budget 0) and the second
differs in at most one bit (budget 1), so three of its four nibbles are equal. One key per start
and left-out nibble gives 16 keys of 28 bits. Inside a bucket the whole distance is checked at
once, without emitting its pairs: it implies the longer chains, so running them after it filters nothing.

Fingerprints are made distinct first, so copies cost one row. A bucket's rows arrive sorted and
are linked as a spanning forest: a leader takes all within reach, only pairs between leaders'
groups are compared in numpy blocks. A bucket beyond ``bucket_limit`` goes another exact way:
fingerprints equal but for two given bits differ in at most two, so each of the 2016 masked
values is a clique whose members all link to its least one - an aggregation with map-side
combination, linear in the group.

The pipeline's stage of this name (``keep_one``) takes the majority bits of a text's set of five-word
shingles and searches at 7 differing bits with eight segments of a byte: from some start every chain of
``l`` segments differs in l * 7 / 8 bits at most, so the first segment is equal and the second differs
in one bit at most. A bucket is a start and its first segment; inside, only rows whose second segments
are within one bit meet, then the longer chains are tested one by one, up to the whole ring. What it
finds is confirmed by the exact Jaccard similarity, and ``jaccard`` searches the pairs that are still in
two groups completely, as two texts at a similarity of 0.8 differ in 10 of 64 bits on average.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import blocks, documents, majority, pick, shingle_hashes, unused
from quillspark.llm.jaccard import BUCKET_LIMIT as JACCARD_LIMIT
from quillspark.llm.jaccard import bucketed_pairs, fit, near_groups
from quillspark.operators.components import connected_components
from quillspark.runtime import stash

#: Rows of one bucket that a task links in memory; larger buckets take the masked way.
BUCKET_LIMIT = 65_536
#: Most differing bits of a link.
MOST = 2
#: The same for the pipeline's stage, whose fingerprints are eight segments of a byte.
RING_MOST, SEGMENTS = 7, 8
#: Rows of a bucket from which leaders are looked for, and the least share of it that one takes.
LED, LEAST_LED = 512, 16

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mixed(hashes: np.ndarray, part: int) -> np.ndarray:
    """Independent 64 bits for each further part of a fingerprint (splitmix64 finaliser)."""
    if part == 0:
        return hashes
    with np.errstate(over="ignore"):
        z = hashes + _GOLDEN * np.uint64(part)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def fingerprint(text: str | None, size: int = 3, parts: int = 1) -> list[int]:
    """SimHash of ``parts`` times 64 bits; a bit is 1 if set in over half the hashes."""
    hashes = shingle_hashes(text, size)
    return [int(majority(_mixed(hashes, part))) for part in range(parts)]


def _fingerprints(size: int, parts: int):
    def run(batches):
        for batch in blocks(batches):
            prints = np.array([fingerprint(x, size, parts) for x in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("doc_id"), *(pa.array(prints[:, p]) for p in range(parts))],
                ["rid", "doc_id", *(f"f{p}" for p in range(parts))],
            )

    return run


@lru_cache
def _nibble_masks() -> list[tuple[int, int]]:
    """(start, mask) of the chain keys for 64 bits in four segments: one segment and three nibbles of the next."""
    masks = []
    for start in range(4):
        nxt = (start + 1) % 4
        for left_out in range(4):
            mask = 0xFFFF << (16 * start)
            mask |= (0xFFFF & ~(0xF << (4 * left_out))) << (16 * nxt)
            masks.append((start, mask))
    return masks


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def chain_keys(f: str) -> list:
    """The 16 exact chain keys of a 64-bit fingerprint column, as struct(which, value)."""
    return [F.struct(F.lit(i).alias("which"), F.col(f).bitwiseAND(F.lit(_signed(mask))).alias("value")) for i, (_, mask) in enumerate(_nibble_masks())]


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def spanning_links(prints: np.ndarray, most: int, block: int = 512) -> list[tuple[int, int]]:
    """Links (row pairs within ``most`` bits) that join whatever all such links of the bucket join.

    A leader takes every free row within reach. Then rows of different leaders' groups are compared
    in blocks; a link is kept if it joins two groups that are not joined yet.
    """
    n = len(prints)
    group = np.full(n, -1, np.int64)
    links: list[tuple[int, int]] = []
    free = np.arange(n)
    while len(free):
        lead = free[0]
        near = _distance(prints[free], prints[lead]) <= most
        near[0] = True
        taken = free[near]
        group[taken] = lead
        links += [(int(lead), int(x)) for x in taken[1:]]
        free = free[~near]
    leaders = np.unique(group)
    if len(leaders) < 2:
        return links
    parent = {int(x): int(x) for x in leaders}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    order = np.argsort(group, kind="stable")
    rows, of = prints[order], group[order]
    for at in range(0, n, block):
        left, left_of = rows[at : at + block], of[at : at + block]
        for other in range(at, n, block * 8):
            right, right_of = rows[other : other + block * 8], of[other : other + block * 8]
            near = np.zeros((len(left), len(right)), np.int64)
            for part in range(prints.shape[1]):
                near += np.bitwise_count(left[:, None, part] ^ right[None, :, part])
            i, j = np.nonzero((near <= most) & (left_of[:, None] != right_of[None, :]))
            if not len(i):
                continue
            for x, y in zip(i.tolist(), j.tolist()):
                a, b = find(int(left_of[x])), find(int(right_of[y]))
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    links.append((int(order[at + x]), int(order[other + y])))
    return links


def _link_buckets(parts: int, most: int, limit: int):
    """Rows sorted by key in, links and rows of over-large buckets (v null) out; holds one bucket at most."""
    names = [f"f{p}" for p in range(parts)]

    def small(prints, ids):
        """Buckets of two, all at once."""
        ok = _distance(prints[:-1:2], prints[1::2]) <= most
        return ids[:-1:2][ok], ids[1::2][ok]

    def run(batches):
        held: list[tuple] = []  # pieces of the open bucket
        open_key, over = None, False
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

        def out(u, v):
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(u, np.int64)), pa.array(v, pa.int64())], schema=schema)

        def close():
            ids = np.concatenate([x[0] for x in held])
            prints = np.concatenate([x[1] for x in held])
            held.clear()
            pairs = spanning_links(prints, most) if len(ids) > 1 else []
            return ids[[a for a, _ in pairs]] if pairs else ids[:0], ids[[b for _, b in pairs]] if pairs else ids[:0]

        for batch in batches:
            if not batch.num_rows:
                continue
            which = batch.column("which").to_numpy()
            value = batch.column("value").to_numpy()
            ids = batch.column("id").to_numpy()
            prints = np.stack([batch.column(x).to_numpy() for x in names], axis=1).view(np.uint64)
            cuts = np.flatnonzero((which[1:] != which[:-1]) | (value[1:] != value[:-1])) + 1
            starts = np.concatenate([[0], cuts])
            ends = np.concatenate([cuts, [len(ids)]])
            found_u, found_v = [], []
            last = len(starts) - 1
            sizes = ends - starts
            first_open = open_key is not None and open_key == (which[0], value[0])
            middle = np.ones(len(starts), bool)
            middle[0] = not first_open
            middle[last] = False
            if open_key is not None and not first_open:
                if held and not over:
                    u, v = close()
                    found_u.append(u), found_v.append(v)
                held.clear()
                over = False
            twos = starts[middle & (sizes == 2)]
            if len(twos):
                pick = np.stack([twos, twos + 1], axis=1).ravel()
                u, v = small(prints[pick], ids[pick])
                found_u.append(u), found_v.append(v)
            for k in np.flatnonzero(middle & (sizes > 2)):
                held.append((ids[starts[k] : ends[k]], prints[starts[k] : ends[k]]))
                u, v = close()
                found_u.append(u), found_v.append(v)
            if first_open and last > 0:
                held.append((ids[: ends[0]], prints[: ends[0]]))
                if over:
                    yield out(ids[: ends[0]], [None] * int(ends[0]))
                    held.clear()
                else:
                    u, v = close()
                    found_u.append(u), found_v.append(v)
                over = False
            piece = (ids[starts[last] :].copy(), prints[starts[last] :].copy())
            open_key = (which[-1], value[-1])
            held.append(piece)
            if over or sum(len(x[0]) for x in held) > limit:
                over = True
                for part_ids, _ in held:
                    yield out(part_ids, [None] * len(part_ids))
                held.clear()
            if found_u:
                yield out(np.concatenate(found_u), np.concatenate(found_v))
        if held and not over:
            yield out(*close())

    return run


def _masked(ids_and_prints: DataFrame) -> DataFrame:
    """Links between fingerprints that differ in two bits at most, by masked values; linear in their number."""
    pairs = [(i, j) for i in range(64) for j in range(i)]
    masks = F.array(*(F.lit(_signed(~((1 << i) | (1 << j)) & ((1 << 64) - 1))) for i, j in pairs))
    rows = ids_and_prints.select("id", "f0", F.posexplode(masks).alias("which", "mask"))
    rows = rows.select("id", "which", F.col("f0").bitwiseAND(F.col("mask")).alias("value"))
    least = rows.groupBy("which", "value").agg(F.min("id").alias("v"), F.max("id").alias("top")).where("v < top")
    return rows.join(least, ["which", "value"]).where("id > v").select(F.col("id").alias("u"), "v").distinct()


def near_links(prints: DataFrame, limit: int = BUCKET_LIMIT) -> DataFrame:
    """Links ``(u, v)`` between the rows of ``prints(id, f0)``, distinct fingerprints, at ``MOST`` bits."""
    rows = prints.select("id", "f0", F.explode(F.array(*chain_keys("f0"))).alias("key")).select("key.which", "key.value", "id", "f0")
    shuffled = rows.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "which", "value").sortWithinPartitions("which", "value")
    found = stash(shuffled.mapInArrow(_link_buckets(1, MOST, limit), "u long, v long"), "simhash-links").df
    links = found.where("v is not null")
    over = found.where("v is null").select(F.col("u").alias("id")).distinct()
    if over.isEmpty():
        return links
    return links.unionByName(_masked(prints.join(over, "id", "left_semi")))


def near_duplicates(docs: DataFrame, limit: int = BUCKET_LIMIT) -> DataFrame:
    """``(rid, doc_id, f0, component)`` for every row of ``docs(doc_id, text)``.

    ``component`` is the smallest doc_id (over the component's rows with one) reachable by links of
    fingerprints at two differing bits. A null or empty text, or one of white space alone, has
    the fingerprint zero and links like any other. Repeated rows and copies share a fingerprint and
    so a component. A row with a null doc_id takes part and keeps its component. Extra columns are
    ignored; an empty table gives an empty result.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    rows = stash(numbered.mapInArrow(_fingerprints(3, 1), f"rid long, doc_id {dict(docs.dtypes)['doc_id']}, f0 long"), "simhash").df
    # A fingerprint names itself.
    prints = stash(rows.groupBy("f0").agg(F.min("doc_id").alias("least"), F.col("f0").alias("id")), "simhash-distinct").df
    parts_of = connected_components(near_links(prints.select("id", "f0"), limit))
    joined = prints.join(parts_of.withColumnRenamed("node", "id"), "id")
    heads = joined.groupBy("component").agg(F.min("least").alias("head"))
    heads = stash(joined.select("component", "f0").join(heads, "component").select("f0", "head"), "simhash-heads").df
    table = prints.select("f0", "least").join(heads, "f0", "left").select("f0", F.coalesce("head", "least").alias("component"))
    table = stash(table, "simhash-components").df
    return rows.join(table, "f0")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def _leaders(prints: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group of every row of a large bucket, named by its leader, and the links to it: of eight free rows the
    one with the most free rows in reach takes them, as long as they are many."""
    group, links = np.arange(len(prints)), [np.empty((0, 3), np.int64)]
    free = group.copy()
    while len(free) > LED:
        tried = free[np.linspace(0, len(free) - 1, 8).astype(np.int64)]
        bits = np.bitwise_count(prints[tried][:, None] ^ prints[free][None, :])
        near = (bits <= RING_MOST) & fit(sizes[tried][:, None], sizes[free][None, :])
        best = near.sum(axis=1).argmax()
        taken = near[best]
        if LEAST_LED * taken.sum() < len(prints):
            break
        group[free[taken]] = tried[best]
        links.append(np.stack([np.full(taken.sum(), tried[best]), free[taken], bits[best][taken]], axis=1, dtype=np.int64, casting="unsafe"))
        free = free[~taken]
    links = np.concatenate(links)
    return group, links[links[:, 0] != links[:, 1]]


def ring_pairs(ids: np.ndarray, sizes: np.ndarray, parts: np.ndarray, block: np.ndarray, prints: list[bytes], across: bool):
    """Pairs of a bucket within ``RING_MOST`` bits whose chains from its start keep their budgets. Prints begin with
    that start. Rows that share a leader are linked to it only, and not paired with each other."""
    prints = np.frombuffer(b"".join(prints), "<u8")
    parts, links = _leaders(prints, sizes)
    yield links
    second = (prints >> np.uint64(8) & np.uint64(255)).astype(np.int64)
    order = np.argsort(second, kind="stable")
    first = np.searchsorted(second[order], np.arange(257))
    names, counts = np.unique(parts, return_counts=True)
    rest = parts != names[counts.argmax()] if counts.max() > 1 else np.ones(len(parts), bool)
    left = np.flatnonzero(rest)
    near = second[left][:, None] ^ np.array([0, *(1 << k for k in range(8))])
    low, n = first[near], first[near + 1] - first[near]
    total = np.cumsum(n.sum(axis=1))
    at = 0
    while at < len(left):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 20), "right")))
        many = n[at:stop].ravel()
        i = np.repeat(left[at:stop], n[at:stop].sum(axis=1))
        j = order[np.arange(many.sum()) + np.repeat(low[at:stop].ravel() - (np.cumsum(many) - many), many)]
        at = stop
        for length in range(3, SEGMENTS + 1):
            chain = np.bitwise_count((prints[i] ^ prints[j]) << np.uint64(64 - 8 * length))
            ok = chain <= length * RING_MOST // SEGMENTS
            i, j = i[ok], j[ok]
        ok = (parts[i] != parts[j]) & fit(sizes[i], sizes[j]) & (~rest[j] | (ids[i] < ids[j]))
        if across:
            ok &= block[i] != block[j]
        i, j = i[ok], j[ok]
        yield np.stack([i, j, np.bitwise_count(prints[i] ^ prints[j])], axis=1, dtype=np.int64, casting="unsafe")


def ring_links(prints: DataFrame, limit: int = JACCARD_LIMIT) -> DataFrame:
    """Pairs ``(u, v)`` of ``prints(id, n, print)`` within ``RING_MOST`` bits: all of a bucket, or where they are
    many such as join whatever all of them join."""
    start = F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))).alias("start")
    rows = prints.select("id", "n", "print", start)
    turned = F.expr(f"concat(substring(print, start + 1, {SEGMENTS}), substring(print, 1, start))")
    lead = F.expr("start * 256L + cast(conv(hex(substring(print, start + 1, 1)), 16, 10) as int)")
    rows = rows.select(lead.alias("lead"), "id", "n", turned.alias("sketch"), F.col("id").alias("part"))
    return bucketed_pairs(rows, limit, True, ring_pairs).where("v is not null")


def keep_one(docs: DataFrame, limit: int = JACCARD_LIMIT) -> DataFrame:
    """The rows of ``docs`` without near duplicates (SimHash by pigeonring, confirmed and completed by the
    exact Jaccard similarity, see ``jaccard``): of each group the row with the smallest doc_id (then the first such row) stays; rows without words are
    copies of each other, null and empty texts too. A null doc_id comes last in its group and is
    otherwise nothing special; of repeated rows one stays. All columns stay, whatever their names; an
    empty table gives an empty result."""
    rid = unused(docs.columns, "row_number")
    rows = stash(docs.withColumn(rid, F.monotonically_increasing_id()), "jaccard-docs").df
    found = near_groups(rows.select(F.col(rid).alias("rid"), "doc_id", "text"), ring_links, limit)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")).alias("first")
    stay = found.groupBy("node").agg(first).select(F.col("first.rid").alias("id"))
    return pick(rows, rid, stay).select(*docs.columns)
