"""What the operators share: reading tables, words, and streaming Arrow batches through Python."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.runtime import stash

SEED = 42
#: Texts that go through one vectorised step together: a bound on bytes, not on rows.
BLOCK_BYTES = 4 << 20
#: Most bitmaps of row numbers that are broadcast: 64 MB.
MOST_BITMAPS = 16_384


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*(columns or ("doc_id", "text")))


def unused(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column of the table has it (Spark's names know no case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def words(text: str | None) -> list[bytes]:
    r"""Words ``[^\x20\x09-\x0D]+`` as UTF-8; ``bytes.split`` splits at just these six bytes."""
    return text.encode().split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased (``bytes.lower`` touches ASCII letters only)."""
    return text.encode().lower().split() if text else []


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each ``size``-word shingle, repeats included; empty for a text without words."""
    tokens = lower_words(text)
    if not tokens:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= size:
        return np.array([digest(b" ".join(tokens), SEED)], np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(tokens) - size + 1].tolist(), ends[size - 1 :].tolist())
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(tokens) - size + 1)


def majority(hashes: np.ndarray) -> np.uint64:
    """SimHash of 64-bit hashes: a bit is 1 if set in over half of them."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 16_384):
        counts += np.unpackbits(hashes[at : at + 16_384].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits((2 * counts > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0]


class Memo:
    """Remembered results within ``most`` bytes (an estimate), in two generations.

    When the young generation has half the bytes it becomes the old one, and the old one goes; what
    is asked for again moves to the young one. All keys that ``missing`` has been asked for are in
    ``young`` until the next ``turn``, once those it returned are added.
    """

    #: Bytes of an entry besides its key's and value's contents.
    ENTRY = 150

    def __init__(self, most: int):
        self.most, self.bytes = most, 0
        self.young: dict = {}
        self.old: dict = {}

    def turn(self) -> None:
        if 2 * self.bytes > self.most:
            self.old, self.young, self.bytes = self.young, {}, 0

    def missing(self, keys: set) -> set:
        away = keys.difference(self.young)
        # Not away.intersection(self.old), which would walk the whole old generation.
        back = {k: self.old[k] for k in away if k in self.old}
        self.add(back)
        return away.difference(back)

    def add(self, items: dict) -> None:
        self.young.update(items)
        self.bytes += sum(map(len, items)) + sum(map(len, filter(None, items.values()))) + self.ENTRY * len(items)


_HELD: dict = {}
_HELD_BY: list = [None]


def _turn_over() -> None:
    context = TaskContext.get()
    stage = context.stageId() if context else None
    if stage != _HELD_BY[0]:
        _HELD.clear()
        pa.default_memory_pool().release_unused()
        _HELD_BY[0] = stage


def held(key, make):
    """What ``make()`` gives, which a worker keeps for its tasks of one stage and drops with the first task of another."""
    _turn_over()
    if key not in _HELD:
        _HELD[key] = make()
    return _HELD[key]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` of each holds about ``most`` bytes, and one row at least."""
    _turn_over()
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = np.asarray(batch.column(column).fill_null("").cast(pa.large_binary()).to_numpy(zero_copy_only=False), dtype=object)
        ends = np.cumsum([len(x) for x in lengths])
        start = 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def retext(batch: pa.RecordBatch, texts: list[str | None], drop: tuple[str, ...] = ()) -> pa.RecordBatch:
    """``batch`` without ``drop`` and with new texts; ``n_chars`` follows where a text changed."""
    old = batch.column("text").to_pylist()
    batch = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, batch.column("text").type))
    if (at := batch.schema.get_field_index("n_chars")) >= 0:
        sizes = [n if a == b else len(b) for a, b, n in zip(old, texts, batch.column(at).to_pylist())]
        batch = batch.set_column(at, "n_chars", pa.array(sizes, pa.int64()).cast(batch.schema.field(at).type))
    return batch.select([c for c in batch.schema.names if c not in drop])


def _marked(rows: DataFrame, rid: str, ids: DataFrame, kept: bool) -> DataFrame:
    bucket, held = unused(rows.columns, "bitmap_bucket"), unused(rows.columns, "bitmap")
    maps = ids.groupBy(F.bitmap_bucket_number("id").alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias(held))
    maps = stash(maps, "bitmap").df
    maps = F.broadcast(maps) if maps.count() <= MOST_BITMAPS else maps
    bit = f"bitmap_bit_position({rid})"
    found = F.expr(f"shiftright(cast(conv(hex(substring({held}, cast({bit} div 8 as int) + 1, 1)), 16, 10) as int), cast({bit} % 8 as int)) & 1 = 1")
    same = F.bitmap_bucket_number(rid) == F.col(bucket)
    if kept:
        return rows.join(maps, same).where(found).select(*rows.columns)
    return rows.join(maps, same, "left").where(~F.coalesce(found, F.lit(False))).select(*rows.columns)


def pick(rows: DataFrame, rid: str, ids: DataFrame) -> DataFrame:
    """The rows whose ``rid`` is among ``ids(id)``, by bitmaps of one bit a row. They are broadcast, so that
    no text is shuffled, if they take ``MOST_BITMAPS`` of 4 KB at most; beyond that they are joined by bucket."""
    return _marked(rows, rid, ids, True)


def leave(rows: DataFrame, rid: str, ids: DataFrame) -> DataFrame:
    """The rows that ``pick`` leaves out."""
    return _marked(rows, rid, ids, False)
