"""Passages of 50 words or more that repeat across documents, by a sparse suffix array.

Suffixes are kept only at minimisers: of every 43 consecutive 8-word grams the one with the least
hash. A passage of 50 words holds 43 such grams, so two copies of it keep a suffix at the same
place, whatever surrounds them. The suffixes are sorted and each is compared with its neighbours:
the common prefixes of neighbours tell, for any number of words, which runs of suffixes go on alike.
The words to the left of each suffix are sorted and compared in the same way, nearest word first. A
suffix stays only if the longest matches to both sides add up to 50 words; then, for each number of
words to the left, suffixes in one run on the left and in one run on the right are copies of 50
words, and these chain to the longest passage. Of equal passages the first (smallest doc_id, then
row, then place) is the original and the others are repeats. Words are compared as 32 bits of
their hash, the first eight of a suffix also by the gram's 64 bits.

Plan: pass one hashes the grams at minimisers and counts them (aggregation with map-side
combination); grams seen twice set bits in a filter of fixed size, the only thing broadcast. Pass
two sends the surviving suffixes with the words around them, at most 92 of 4 bytes, to tasks by
gram, in sorted order. The counts of pass one also tell which grams have more than ``run_limit``
suffixes; these set bits in a second filter of the same size, and their 50-word windows are
counted by an aggregation with map-side combination instead, exactly and without gathering a
group, so no task gets more than ``run_limit`` suffixes of a gram. Equal windows have the same
minimiser and so go the same way. False hits of the filters only cost rows. Texts are never
shuffled.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import blocks, documents, leave, pick, retext, unused, words
from quillspark.runtime import stash

#: Least words of a passage, words of a gram, grams a minimiser stands for.
PASSAGE, GRAM = 50, 8
SPAN = PASSAGE - GRAM + 1
#: Bits of the filters of repeated and of hot grams: 8 MB each, whatever the input.
FILTER_BITS = 26
#: Most suffixes of one gram that are sorted and compared in one task.
RUN_LIMIT = 65_536

_M = np.uint64(0x9FB21C651E98DF25)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def word_hashes(text: str | None) -> np.ndarray:
    tokens = words(text)
    return np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))


def _scramble(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _M
        return x ^ (x >> np.uint64(29))


def gram_hashes(hashes: np.ndarray, size: int = GRAM) -> np.ndarray:
    n = max(len(hashes) - size + 1, 0)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            out = out * _M + hashes[j : j + n]
    return _scramble(out)


def minimisers(grams: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places that are the (leftmost) minimum of some window of ``span`` grams, with the first and
    last start of those windows."""
    if len(grams) < span:
        return (np.empty(0, np.int64),) * 3
    starts = np.arange(len(grams) - span + 1)
    least = np.lib.stride_tricks.sliding_window_view(grams, span).argmin(axis=1) + starts
    places, first, count = np.unique(least, return_index=True, return_counts=True)
    return places, starts[first], starts[first] + count - 1


def _count_grams(batches):
    for batch in blocks(batches):
        found = [np.empty(0, np.uint64)]
        for text in batch.column("text").to_pylist():
            grams = gram_hashes(word_hashes(text))
            found.append(grams[minimisers(grams)[0]])
        h, n = np.unique(np.concatenate(found), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])


def _bitmap(counts: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """Bitmap of the grams ``h``; of fixed size, built by aggregation."""
    slot = F.col("h").bitwiseAND((1 << bits) - 1)
    one = F.expr("shiftleft(1L, cast(h & 63 as int))")
    cells = counts.select(F.shiftright(slot, 6).cast("int").alias("cell"), one.alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(1 << (bits - 6), np.int64)
    got = cells.toArrow()
    out[got.column("cell").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint8)


def _has(bitmap: np.ndarray, grams: np.ndarray, bits: int) -> np.ndarray:
    slot = grams & np.uint64((1 << bits) - 1)
    return (bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _suffixes(repeated, hot, bits: int):
    """Suffixes of repeated grams with the words around them, without those of hot grams."""

    def run(batches):
        seen = np.frombuffer(repeated.value, np.uint8) & ~np.frombuffer(hot.value, np.uint8)
        for batch in blocks(batches):
            rid, doc = batch.column("rid"), batch.column("doc_id")
            rows, h, place, low, high, left, right = [], [], [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                hashes = word_hashes(text)
                grams = gram_hashes(hashes)
                at, first, last = minimisers(grams)
                if not len(at):
                    continue
                keep = _has(seen, grams[at], bits)
                at, first, last = at[keep], first[keep], last[keep]
                short = (hashes >> np.uint64(32)).astype("<u4")
                rows += [i] * len(at)
                h.append(grams[at])
                place.append(at)
                low.append(at - last)
                high.append(at - first)
                left += [short[a:b][::-1].tobytes() for a, b in zip(first.tolist(), at.tolist())]
                right += [short[a:b].tobytes() for a, b in zip(at.tolist(), (last + PASSAGE).tolist())]
            if not rows:
                continue
            take = pa.array(rows, pa.int64())
            numbers = [pa.array(np.concatenate(x).astype(t)) for x, t in ((place, np.int64), (low, np.int32), (high, np.int32))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(h).view(np.int64)), rid.take(take), doc.take(take), *numbers, pa.array(left, pa.binary()), pa.array(right, pa.binary())],
                ["h", "rid", "doc_id", "place", "low", "high", "left", "right"],
            )

    return run


def _hot_windows(hot, bits: int):
    """Every 50-word window whose minimiser is a hot gram: its row, place and hash."""

    def run(batches):
        seen = np.frombuffer(hot.value, np.uint8)
        for batch in blocks(batches):
            rows, start, window = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                hashes = word_hashes(text)
                grams = gram_hashes(hashes)
                at, first, last = minimisers(grams)
                keep = _has(seen, grams[at], bits)
                if not keep.any():
                    continue
                inside = np.concatenate([np.arange(a, b + 1) for a, b in zip(first[keep].tolist(), last[keep].tolist())])
                inside.sort()
                rows.append(np.full(len(inside), i))
                start.append(inside)
                window.append(gram_hashes(hashes, PASSAGE)[inside].view(np.int64))
            if not rows:
                continue
            rows, start, window = map(np.concatenate, (rows, start, window))
            for a in range(0, len(rows), 65_536):
                take = pa.array(rows[a : a + 65_536])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rid").take(take), batch.column("doc_id").take(take), pa.array(start[a : a + 65_536]), pa.array(window[a : a + 65_536])],
                    ["rid", "doc_id", "start", "window"],
                )

    return run


def _matrix(cells: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """One row of ``width`` words for each cell, zero beyond its end, and how many it has."""
    out = np.zeros((len(cells), width), np.uint32)
    lengths = np.fromiter(map(len, cells), np.int64, len(cells)) // 4
    row = np.repeat(np.arange(len(cells)), lengths)
    column = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, column] = np.frombuffer(b"".join(cells), "<u4")
    return out, lengths


def neighbours(h: np.ndarray, cells: list[bytes], width: int) -> np.ndarray:
    """Of sorted suffixes the words each has in common with the one before, -1 if the gram differs."""
    matrix, lengths = _matrix(cells, width)
    common = np.full(len(h), -1, np.int64)
    for at in range(1, len(h), 65_536):
        rows = slice(at, min(at + 65_536, len(h)))
        before = slice(rows.start - 1, rows.stop - 1)
        differ = np.concatenate([matrix[rows] != matrix[before], np.ones((rows.stop - rows.start, 1), bool)], axis=1)
        found = np.minimum(differ.argmax(axis=1), np.minimum(lengths[rows], lengths[before]))
        common[rows] = np.where(h[rows] == h[before], found, -1)
    return common


def longest(common: np.ndarray) -> np.ndarray:
    """Words that each suffix has in common with one of its neighbours."""
    return np.maximum(common, np.append(common[1:], -1))


MATCH = ["rid", "doc_id", "start", "stop", "first_rid", "first_doc_id", "later"]


def _matches(h, rid, doc, doc_null, place, low, high, left, right, within: bool):
    """Copies of 50 words among suffixes sorted by (gram, words ahead), chained while they follow each
    other with the same original."""
    ahead = neighbours(h, right, PASSAGE)
    able = np.flatnonzero(longest(ahead) + high >= PASSAGE)
    if not len(able):
        return None
    behind_order = np.array(sorted(range(len(able)), key=lambda k: (h[able[k]], left[able[k]])), np.int64)
    behind = neighbours(h[able[behind_order]], [left[k] for k in able[behind_order]], SPAN - 1)
    reach = np.empty(len(able), np.int64)
    reach[behind_order] = longest(behind)
    right_reach, low, high = longest(ahead)[able], low[able], high[able]
    by_document = np.lexsort((place[able], rid[able], doc[able], doc_null[able]))
    row, start, first = [], [], []
    for extension in range(SPAN):
        has = (low <= extension) & (extension <= high) & (reach >= extension) & (right_reach >= PASSAGE - extension)
        has = by_document[has[by_document]]
        if len(has) < 2:
            continue
        run_right = np.cumsum(ahead < PASSAGE - extension)[able]
        run_left = np.empty(len(able), np.int64)
        run_left[behind_order] = np.cumsum(behind < extension)
        key = run_right[has] * (len(able) + 1) + run_left[has]
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        if not same.any():
            continue
        new = np.concatenate([[True], ~same])
        head = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
        member = ~new | np.concatenate([same, [False]])
        if not within:
            starts, rows = np.flatnonzero(new), rid[able[has[by]]]
            member &= np.repeat(np.minimum.reduceat(rows, starts) < np.maximum.reduceat(rows, starts), np.diff([*starts, len(by)]))
            if not member.any():
                continue
        row.append(able[has[by[member]]])
        first.append(able[has[by[head[member]]]])
        start.append(place[row[-1]] - extension)
    if not row:
        return None
    row, start, first = map(np.concatenate, (row, start, first))
    later = row != first
    by = np.lexsort((start, first, later, row))
    row, start, first, later = row[by], start[by], first[by], later[by]
    cut = np.concatenate([[True], (row[1:] != row[:-1]) | (first[1:] != first[:-1]) | (start[1:] != start[:-1] + 1)])
    at = np.flatnonzero(cut)
    stop = start[np.concatenate([at[1:], [len(cut)]]) - 1] + PASSAGE
    row, first = row[at], first[at]
    null = lambda x, m: pa.array(x, pa.int64(), mask=m.astype(bool))
    return pa.RecordBatch.from_arrays(
        [pa.array(rid[row]), null(doc[row], doc_null[row]), pa.array(start[at]), pa.array(stop), pa.array(rid[first]), null(doc[first], doc_null[first]), pa.array(later[at])],
        MATCH,
    )


def _numbers(batch):
    doc = batch.column("doc_id").cast(pa.int64())
    get = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
    return [get("h"), get("rid"), doc.fill_null(0).to_numpy(zero_copy_only=False), doc.is_null().to_numpy(zero_copy_only=False), get("place"), get("low"), get("high")]


def _compare(within: bool):
    """Matches of the suffixes, sorted by gram; holds a batch and the last gram's suffixes before it."""

    def finish(pieces):
        whole = pa.Table.from_batches(pieces).combine_chunks().to_batches()[0]
        found = _matches(*_numbers(whole), whole.column("left").to_pylist(), whole.column("right").to_pylist(), within)
        return [found] if found is not None else []

    def run(batches):
        held: list = []  # batches whose last gram may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            h = batch.column("h").to_numpy()
            last = int(np.flatnonzero(h != h[-1])[-1]) + 1 if h[0] != h[-1] else 0
            if last or (held and held[-1].column("h")[-1].as_py() != h[0]):
                yield from finish([*held, batch.slice(0, last)] if last else held)
                held = []
            held.append(batch.slice(last))
        if held:
            yield from finish(held)

    return run


def repeated_passages(docs: DataFrame, rid: str | None = None, run_limit: int = RUN_LIMIT, filter_bits: int = FILTER_BITS, within: bool = False) -> DataFrame:
    """Passages of ``docs(doc_id, text)`` that occur in another row; ``within`` adds those that repeat in one row alone.

    Returns ``rid, doc_id, start, stop, first_rid, first_doc_id, later``: words ``start`` to
    ``stop`` (exclusive) of the row; ``later`` is false for the original and true for repeats, which
    name the original's row and document. Pieces may overlap; every 50-word window with an equal one
    is inside some piece of its row. doc_id must be an integer and may be null (then ordered last).
    Null, empty and shorter texts have no passage. Repeated rows repeat each other. Extra columns
    are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    numbered = docs.select(F.col(rid).alias("rid") if rid else F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    grams = docs.select("text").mapInArrow(_count_grams, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    counts = stash(grams.where("n > 1"), "suffix-grams").df
    too_many = _bitmap(counts.where(F.col("n") > run_limit), filter_bits)
    if rid is None and too_many.any():  # two scans need the same row numbers
        numbered = stash(numbered, "suffix-numbered").df
    repeated = spark.sparkContext.broadcast(_bitmap(counts, filter_bits).tobytes())
    hot = spark.sparkContext.broadcast(too_many.tobytes())
    schema = "h long, rid long, doc_id long, place long, low int, high int, left binary, right binary"
    suffixes = numbered.mapInArrow(_suffixes(repeated, hot, filter_bits), schema)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    suffixes = suffixes.repartition(n, "h").sortWithinPartitions("h", "right")
    out = "rid long, doc_id long, start long, stop long, first_rid long, first_doc_id long, later boolean"
    near = stash(suffixes.mapInArrow(_compare(within), out), "suffix-matches").df
    if not too_many.any():
        return near
    far = stash(numbered.mapInArrow(_hot_windows(hot, filter_bits), "rid long, doc_id long, start long, window long"), "suffix-windows").df
    who = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "rid", "start")
    heads = far.groupBy("window").agg(F.min(who).alias("head"), F.count("*").alias("n"), F.min("rid").alias("low"), F.max("rid").alias("high"))
    heads = heads.where("n > 1" if within else "low < high").select("window", "head")
    heads = stash(heads, "suffix-heads").df
    far = far.join(heads, "window").withColumn("stop", F.col("start") + PASSAGE)
    later = (F.col("rid") != F.col("head.rid")) | (F.col("start") != F.col("head.start"))
    return near.unionByName(far.select("rid", "doc_id", "start", "stop", F.col("head.rid").alias("first_rid"), F.col("head.doc_id").alias("first_doc_id"), later.alias("later")))


def merged(pieces: DataFrame, *keys: str) -> DataFrame:
    """Union of overlapping or touching pieces that share ``keys``, one row a passage."""
    by = Window.partitionBy(*keys).orderBy("start", "stop")
    reach = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = pieces.select(*keys, "start", "stop", F.when(F.col("start") <= reach, 0).otherwise(1).alias("new"))
    numbered = marked.withColumn("passage", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "passage").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("passage")


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each repeated passage: its document and words, its original and whether it is a repeat.

    A passage's ``first_doc_id`` is its own document at the original.
    """
    found = merged(repeated_passages(documents(spark, sf_dir)), "rid", "doc_id", "first_doc_id", "later")
    return found.select("doc_id", F.col("start").alias("start_word"), F.col("stop").alias("end_word"), (F.col("stop") - F.col("start")).alias("n_words"), F.col("later").alias("is_repeat"), "first_doc_id")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and the white space that follows each of them."""
    raw = text.encode()
    at = [m.start() for m in _WORD.finditer(raw)] + [len(raw)]
    gone = sorted(spans)
    out, done = [], 0
    for start, stop in gone:
        out.append(raw[done : max(done, at[start])])
        done = max(done, at[stop])
    out.append(raw[done:])
    return b"".join(out).decode()


def _cut(spans: str):
    def run(batches):
        for batch in blocks(batches):
            pairs = list(zip(batch.column("text").to_pylist(), batch.column(spans).to_pylist()))
            texts = [cut_words(text, [(s["start"], s["stop"]) for s in found]) if found else text for text, found in pairs]
            gone = pa.array([not words(t) for t in texts], pa.bool_())
            yield retext(batch, texts, (spans,)).filter(pc.invert(gone))

    return run


def keep_originals(docs: DataFrame) -> DataFrame:
    """``docs`` with every repeat of a passage cut out of its text; the originals stay.

    ``n_chars`` is set anew where a text changes. A row whose text has no word left goes; rows
    without words from the start stay. All columns stay, whatever their names. Only the texts that
    hold a repeat are shuffled; the others are told apart by a bitmap of one bit a row.
    """
    rid, cuts = unused(docs.columns, "row_number"), unused(docs.columns, "cut_spans")
    rows = stash(docs.withColumn(rid, F.monotonically_increasing_id()), "suffix-rows").df
    repeats = merged(repeated_passages(rows, rid).where("later"), "rid")
    spans = stash(repeats.groupBy("rid").agg(F.collect_list(F.struct("start", "stop")).alias(cuts)).withColumnRenamed("rid", rid), "suffix-spans").df
    ids = spans.select(F.col(rid).alias("id"))
    touched = stash(pick(rows, rid, ids).join(spans, rid).select(*docs.columns, cuts), "suffix-touched").df
    return leave(rows, rid, ids).select(*docs.columns).unionByName(touched.mapInArrow(_cut(cuts), docs.schema))
