"""Embedding near-dedup by product quantisation.

Vectors are normalised in double precision and exact copies collapse to one row first. Coarse
centroids (k-means) and residual codebooks are fitted on a bounded sample; every vector is indexed
in the inverted list of its nearest centroid with one byte a subspace and the length of its
quantisation error. A vector probes the lists that can hold a partner: its distance to the plane
between its own centroid's cell and another cell bounds how near a vector of that cell can be, and
every list within the bound is probed. Table look-ups then give the inner product with the coded
vector; as the error's length is known, the triangle inequality rules a vector out only if its true
distance is too large. What is left gets its exact cosine in double precision. Neither the probes nor
the codes lose a link, so recall is 1 whatever the data.

The index lies in the shared folder: the vectors, in the order of their lists, are cut into blocks of
bounded size, one file each, with a catalogue of the lists in every block and of the lists its
vectors probe. A task loads a block and, one after the other, the blocks that hold a probed list
(each pair of blocks is met by one task), so vectors are not copied through a shuffle, a list with a third of all
vectors is shared by many tasks, and a task that is run again reads the same files. Links inside a
block are joined to groups when it is written; a pair of blocks emits one link for two groups that
meet, and one count a vector, never all pairs.
"""

from __future__ import annotations

import hashlib
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import table
from quillspark.operators.components import connected_components
from quillspark.runtime import shared_path, stash

SIMILAR = 0.95
#: Most coarse lists; sample rows a list; dimensions of a subspace; codewords of a subspace.
MOST_LISTS, SAMPLE_A_LIST, SUBSPACE, CODEWORDS = 4096, 16, 8, 256
#: Most bytes of the sample, most vectors and bytes of a block, blocks that are met in one go.
SAMPLE_BYTES, BLOCK, BLOCK_BYTES, RUN = 32 << 20, 2048, 4 << 20, 8
#: Vectors that are looked up together, and what a bound may be off by rounding.
STEP, SLACK = 256, 1e-5


class Quantiser(NamedTuple):
    centroids: np.ndarray  # lists x dimensions
    books: list[np.ndarray]  # for each subspace codewords x its dimensions
    edges: np.ndarray  # bounds of the subspaces

    def coarse(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to the centroids."""
        return np.maximum(0, (x * x).sum(axis=1)[:, None] - 2 * x @ self.centroids.T + (self.centroids**2).sum(axis=1))

    def encode(self, residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and lengths of the quantisation errors."""
        codes = np.empty((len(residuals), len(self.books)), np.uint8)
        error = np.zeros(len(residuals))
        for m, book in enumerate(self.books):
            part = residuals[:, self.edges[m] : self.edges[m + 1]]
            apart = (part * part).sum(axis=1)[:, None] - 2 * part @ book.T + (book * book).sum(axis=1)
            codes[:, m] = apart.argmin(axis=1)
            error += ((part - book[codes[:, m]]) ** 2).sum(axis=1)
        return codes, np.sqrt(error)

    def coded(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors that the codes stand for."""
        return self.centroids[lists] + np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], axis=1)


def nearest(x: np.ndarray, centroids: np.ndarray, step: int = 2048) -> np.ndarray:
    norms = (centroids**2).sum(axis=1)
    return np.concatenate([(-2 * x[a : a + step] @ centroids.T + norms).argmin(axis=1) for a in range(0, len(x), step)])


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        counts = np.bincount(own, minlength=len(centroids))
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return centroids


def fit(sample: np.ndarray, lists: int) -> Quantiser:
    centroids = kmeans(sample, lists)
    edges = np.append(np.arange(0, sample.shape[1], SUBSPACE), sample.shape[1])
    own = nearest(sample, centroids)
    residuals = sample - centroids[own]
    books = [kmeans(residuals[:, a:b], CODEWORDS) for a, b in zip(edges[:-1], edges[1:])]
    return Quantiser(centroids, books, edges)


def _unit(values) -> np.ndarray | None:
    """The normalised vector, or null if it can link with nothing."""
    if values is None or not len(values) or any(v is None for v in values):
        return None
    x = np.asarray(values, np.float64)
    if not np.isfinite(x).all():
        return None
    scale = np.abs(x).max()
    if scale == 0:
        return None
    x = x / scale
    return x / np.sqrt(x @ x)


def _normalise(batches):
    for batch in batches:
        units = [_unit(v) for v in batch.column("embedding").to_pylist()]
        raw = [None if u is None else u.tobytes() for u in units]
        keys = [None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in raw]
        sizes = pa.array([None if u is None else len(u) for u in units], pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("vec_id"), pa.array(keys, pa.binary()), sizes, pa.array(raw, pa.binary())], ["rid", "vec_id", "key", "size", "unit"])


def _matrix(column) -> np.ndarray:
    cells = column.to_pylist()
    return np.frombuffer(b"".join(cells), np.float64).reshape(len(cells), -1)


class Block(NamedTuple):
    """Vectors of neighbouring lists; ``group`` is the first row that a row's links inside the block lead to."""

    id: np.ndarray
    copies: np.ndarray
    list: np.ndarray
    code: np.ndarray
    error: np.ndarray
    unit: np.ndarray
    group: np.ndarray

    def write(self, path: str) -> None:
        cells = lambda x: pa.FixedSizeBinaryArray.from_buffers(pa.binary(x[0].nbytes), len(x), [None, pa.py_buffer(np.ascontiguousarray(x).tobytes())])
        columns = [pa.array(self.id), pa.array(self.copies), pa.array(self.list), cells(self.code), pa.array(self.error), cells(self.unit), pa.array(self.group)]
        batch = pa.RecordBatch.from_arrays(columns, list(self._fields))
        fs, name = pafs.FileSystem.from_uri(path)
        fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(name, compression=None) as out, pa.ipc.new_file(out, batch.schema) as writer:
            writer.write_batch(batch)


def read_block(path: str) -> Block:
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(name) as file:
        batch = pa.ipc.open_file(file).get_batch(0)
    numbers = lambda x: batch.column(x).to_numpy()
    cells = lambda x, kind: np.frombuffer(batch.column(x).buffers()[1], kind).reshape(batch.num_rows, -1)
    return Block(numbers("id"), numbers("copies"), numbers("list"), cells("code", np.uint8), numbers("error"), cells("unit", np.float64), numbers("group"))


def probes(quantiser: Quantiser, x: np.ndarray, reach: float) -> np.ndarray:
    """Lists that can hold a vector within ``reach`` of one of ``x``."""
    found = np.zeros(len(quantiser.centroids), bool)
    for start in range(0, len(x), STEP):
        apart = quantiser.coarse(x[start : start + STEP])
        own = apart.argmin(axis=1)
        between = np.sqrt(quantiser.coarse(quantiser.centroids[own]))
        plane = (apart - apart[np.arange(len(own)), own][:, None]) / np.maximum(2 * between, 1e-12)
        found |= ((plane <= reach + SLACK) | (np.arange(apart.shape[1]) == own[:, None])).any(axis=0)
    return np.flatnonzero(found)


def matches(quantiser: Quantiser, left: Block, right: Block, similar: float):
    """Rows of two blocks whose cosine is ``similar`` or more, so many rows of ``left`` at a time."""
    reach = float(np.sqrt(2 - 2 * similar))
    coded = quantiser.coded(right.list, right.code)
    # |q - coded| - error <= reach, in terms of the inner product.
    least = ((1 + (coded * coded).sum(axis=1) - (reach + right.error) ** 2) / 2 - SLACK).astype(np.float32)
    lists, column = np.unique(right.list, return_inverse=True)
    for start in range(0, len(left.id), STEP):
        q = left.unit[start : start + STEP]
        product = (quantiser.centroids[lists] @ q.T).astype(np.float32)[column]
        for m, book in enumerate(quantiser.books):
            product += (book @ q[:, quantiser.edges[m] : quantiser.edges[m + 1]].T).astype(np.float32)[right.code[:, m]]
        at, row = np.nonzero(product >= least[:, None])
        if len(at) > len(q) * len(right.id) // 16:
            ok = (right.unit @ q.T)[at, row] >= similar
        else:
            parts = range(0, len(at), 1 << 14)
            ok = np.concatenate([np.einsum("ij,ij->i", q[row[a : a + (1 << 14)]], right.unit[at[a : a + (1 << 14)]]) for a in parts] or [np.empty(0)]) >= similar
        if ok.any():
            yield row[ok] + start, at[ok]


def joined(pairs, group: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Pairs of groups that join what all ``pairs`` of rows join, and the joined groups."""
    parent, links = np.arange(len(group)), []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def unite(a: np.ndarray, b: np.ndarray) -> None:
        for x, y in np.unique(np.stack([a, b], axis=1), axis=0).tolist():
            s, t = find(x), find(y)
            if s != t:
                parent[max(s, t)] = min(s, t)
                links.append((x, y))

    def flat() -> np.ndarray:
        nonlocal parent
        while (up := parent[parent] != parent).any():
            parent = np.where(up, parent[parent], parent)
        return parent[group]

    now = group
    for i, j in pairs:
        # Each row's first partner, then whatever that leaves apart.
        for first in (True, False):
            apart = np.flatnonzero(now[i] != now[j])
            if first:
                apart = apart[np.unique(i[apart], return_index=True)[1]]
            if len(apart):
                unite(group[i[apart]], group[j[apart]])
                now = flat()
    return links, now


def _write_blocks(shared, folder: str, similar: float):
    reach = float(np.sqrt(2 - 2 * similar))

    def run(batches):
        quantiser: Quantiser = shared.value
        held: list = []

        def close(batch):
            x = _matrix(batch.column("unit"))
            lists = batch.column("list").to_numpy()
            code, error = quantiser.encode(x - quantiser.centroids[lists])
            block = Block(batch.column("id").to_numpy(), batch.column("copies").to_numpy(), lists, code, error, x, np.arange(len(x)))
            block = block._replace(group=joined(matches(quantiser, block, block, similar), block.group)[1])
            path = f"{folder}/{uuid.uuid4().hex}.arrow"
            block.write(path)
            columns = [pa.array([path]), pa.array([np.unique(lists)], pa.list_(pa.int32())), pa.array([probes(quantiser, x, reach)], pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays(columns, ["path", "lists", "probes"])

        rows = 0
        for batch in batches:
            while batch.num_rows:
                most = max(1, min(BLOCK, BLOCK_BYTES // len(batch.column("unit")[0].as_py())))
                part = batch.slice(0, most - rows)
                held.append(part)
                rows += part.num_rows
                batch = batch.slice(part.num_rows)
                if rows == most:
                    yield close(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held, rows = [], 0
        if held:
            yield close(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


def _meet(shared, similar: float):
    """Pairs of blocks ``(a, b)`` in, links of groups and counts of linked rows out."""

    def out(u, v, n):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (u, v, n)], ["u", "v", "n"])

    def run(batches):
        quantiser: Quantiser = shared.value
        name, left = None, None
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                if a != name:
                    name, left = a, read_block(a)
                right = left if a == b else read_block(b)
                # Rows of the right block are numbered on from those of the left one.
                base = 0 if a == b else len(left.id)
                ids = left.id if a == b else np.concatenate([left.id, right.id])
                counts = np.zeros(len(ids), np.int64)

                def pairs(left=left, right=right, base=base, counts=counts):
                    for i, j in matches(quantiser, left, right, similar):
                        if base == 0:
                            i, j = i[i != j], j[i != j]
                        np.add.at(counts, i, right.copies[j])
                        if base:
                            np.add.at(counts, j + base, left.copies[i])
                        yield i, j + base

                group = np.arange(len(ids)) if a == b else np.concatenate([left.group, right.group + base])
                links, _ = joined(pairs(), group)
                some = np.flatnonzero(counts)
                if len(some):
                    yield out(ids[some], [None] * len(some), counts[some])
                if links:
                    yield out(ids[[x for x, _ in links]], ids[[y for _, y in links]], [0] * len(links))

    return run


def _links(reps: DataFrame, similar: float) -> DataFrame:
    """Of distinct vectors of one size ``(u, v, n)``: links that join what all links join (n is 0), and
    with a null ``v`` in ``n`` parts of the rows linked with u."""
    spark = reps.sparkSession
    total, bytes_ = reps.agg(F.count("*"), F.max(F.octet_length("unit"))).first()
    most = max(1, min(SAMPLE_BYTES // bytes_, MOST_LISTS * SAMPLE_A_LIST))
    lists = int(max(1, min(MOST_LISTS, 2 * round(total**0.5), most // SAMPLE_A_LIST)))
    most = lists * SAMPLE_A_LIST
    sample = reps if total <= most else reps.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * most / total))
    quantiser = fit(_matrix(sample.orderBy("id").select("unit").toArrow().column("unit").combine_chunks()), lists)
    shared = spark.sparkContext.broadcast(quantiser)

    def listed(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.append_column("list", pa.array(nearest(_matrix(batch.column("unit")), shared.value.centroids), pa.int32()))

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = reps.select("id", "copies", "unit").mapInArrow(listed, "id long, copies long, unit binary, list int")
    rows = rows.repartitionByRange(n, "list", "id").sortWithinPartitions("list", "id")
    written = rows.mapInArrow(_write_blocks(shared, shared_path(spark, "embedding-blocks"), similar), "path string, lists array<int>, probes array<int>")
    catalogue = stash(written, "embedding-catalogue").df
    has = catalogue.select(F.col("path").alias("b"), F.explode("lists").alias("list"))
    wants = catalogue.select(F.col("path").alias("a"), F.explode("probes").alias("list"))
    # The bound holds from either end, so each pair is met by one of its blocks: which one alternates.
    pairs = wants.join(has, "list").select("a", "b").distinct()
    pairs = pairs.where((F.col("a") == F.col("b")) | ((F.col("a") < F.col("b")) == ((F.xxhash64("a").bitwiseXOR(F.xxhash64("b")) % 2) == 0)))
    pairs = stash(pairs, "embedding-pairs").df.withColumn("run", F.pmod(F.xxhash64("b"), F.lit(max(1, catalogue.count() // RUN))))
    pairs = pairs.repartition(n, "a", "run").sortWithinPartitions("a", "b")
    return pairs.mapInArrow(_meet(shared, similar), "u long, v long, n long")


def near_vectors(embeddings: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``embeddings(vec_id, embedding)``.

    ``n_links`` counts the other rows linked directly, copies included; ``component_id`` is the
    smallest vec_id reachable, itself included. Vectors that are null, empty, all zero or hold a
    null or non-finite component link with nothing, nor do vectors of different sizes with each
    other. Repeated rows are copies. A null vec_id takes part; its component is named by the others.
    Extra columns (labels too) are ignored; an empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    numbered = embeddings.select(F.monotonically_increasing_id().alias("rid"), "vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    kind = dict(embeddings.dtypes)["vec_id"]
    rows = stash(numbered.mapInArrow(_normalise, f"rid long, vec_id {kind}, key binary, size int, unit binary"), "embedding").df
    valid = rows.where("key is not null")
    reps = valid.groupBy("key").agg(F.min("rid").alias("id"), F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("unit").alias("unit"), F.first("size").alias("size"))
    reps = stash(reps, "embedding-distinct").df
    sizes = [r["size"] for r in reps.select("size").distinct().collect()]
    links = spark.createDataFrame([], "u long, v long, n long")
    for size in sizes:
        links = links.unionByName(_links(reps.where(F.col("size") == size), similar))
    links = stash(links, "embedding-links").df
    counts = links.groupBy("u").agg(F.sum("n").alias("n"))
    parts = connected_components(links.where("v is not null"))
    joined = reps.select("key", "id", "least", "copies").join(parts.withColumnRenamed("node", "id"), "id", "left")
    joined = joined.withColumn("component", F.coalesce("component", "id")).join(counts.withColumnRenamed("u", "id"), "id", "left")
    joined = stash(joined, "embedding-joined").df
    heads = joined.groupBy("component").agg(F.min("least").alias("head"))
    named = joined.join(heads, "component").select("key", "head", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("links"))
    named = stash(named, "embedding-named").df
    out = rows.select("vec_id", "key").join(named, "key", "left").withColumn("component_id", F.coalesce("head", "vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
