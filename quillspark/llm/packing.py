"""Best-fit packing by exact-complement hashing.

Texts become token ids, texts of over 4096 ids are cut into pieces of 4096, and the pieces are
packed into as few sequences of 4096 as the plan finds. The plan works on counts by length alone,
so its size is bounded by the sequence length (at most a few patterns a length), not by the
corpus. From the longest piece down, the gap that it leaves is looked up in indexes of the lengths,
of their pair sums and of their triple sums; a combination that fills the gap exactly is consumed
as often as its scarcest length allows, and combinations whose lengths are used up leave the index.
What no exact complement fits is packed best fit, again in whole counts.

Plan: one Arrow pass writes a narrow row for each piece with its number among the pieces of its
length in its task. Counts by task and length give every piece a global number in its length by
a window over tasks, not over pieces; the plan then maps (length, number) to a sequence and an
offset by binary search. Only the plan is broadcast. Ids are not carried along, only their checksums.
"""

from __future__ import annotations

import unicodedata
import zlib
from bisect import bisect_left
from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import BLOCK_BYTES, Memo, blocks, documents, held
from quillspark.runtime import stash

LENGTH, END = 4096, 1
#: Bits of a piece's number among those of its length.
NUMBERS = 44
VOCABULARY = "word_bpe_49k.json"
#: Bytes of chunks and words that a worker remembers.
REMEMBERED = 128 << 20

_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: White space to str.split() that is none to the tokenizer, and a letter whose lower case depends on its place.
_ODD = "\x1c\x1d\x1e\x1fΣ"


def _split(chunk: str) -> list[str] | tuple[str, ...]:
    """A chunk's words; letters alone, or letters and one mark, need no pattern."""
    if chunk.isalpha():
        return (chunk,)
    if chunk[:-1].isalpha() and chunk[-1] in ".,;:!?":
        return chunk[:-1], chunk[-1]
    return _PIECES.findall(chunk)


class WordTokenizer:
    """Ids of whole texts as little-endian bytes, by a public tokenizer that drops white space.

    The tokenizer splits a text into words first and never merges across them, so words are encoded
    once and remembered. Texts with a character that only matters in context or with an added token
    (``<|endoftext|>``) go to it whole.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        names = self.tokenizer.get_vocab()
        self.last = np.zeros(max(names.values()) + 1, bool)
        self.last[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.known = Memo(remembered)

    def _learn(self, texts: list[list[str]]) -> None:
        """Encode the chunks of ``texts`` that are not known yet."""
        self.known.turn()
        split = {c: _split(c) for c in self.known.missing(set().union(*texts))}
        fresh = list(self.known.missing(set().union(*split.values())))
        for at in range(0, len(fresh), 512):
            part = fresh[at : at + 512]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(part):
                whole = ids.tobytes()
                cuts = [0, *(4 * ends).tolist()]
                self.known.add({w: whole[a:b] for w, a, b in zip(part, cuts, cuts[1:])})
            else:
                self.known.add({w: self._whole(w) for w in part})
        known = self.known.young.__getitem__
        self.known.add({chunk: b"".join(map(known, pieces)) for chunk, pieces in split.items() if pieces != (chunk,)})

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        odd_parts = (*_ODD, *self.added)
        odd = [any(x in t for x in odd_parts) for t in texts]
        plain = {i: unicodedata.normalize("NFC", t).lower().split() for i, t in enumerate(texts) if not odd[i]}
        self._learn(list(plain.values()))
        known = self.known.young.__getitem__
        return [b"".join(map(known, plain[i])) if i in plain else self._whole(t) for i, t in enumerate(texts)]


def _cut(path: str, length: int, remembered: int, text_bytes: int):
    end = END.to_bytes(4, "little")

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        numbers: dict[int, int] = defaultdict(int)
        tokenizer = held(("words", path, remembered), lambda: WordTokenizer(path, remembered))
        for batch in blocks(batches, most=text_bytes):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows, piece, start, size, crc, number = [], [], [], [], [], []
            for i, ids in enumerate(tokenizer.encode(texts)):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    n = len(part) // 4
                    rows.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    size.append(n)
                    crc.append(zlib.crc32(part))
                    number.append(numbers[n])
                    numbers[n] += 1
            doc = batch.column("doc_id").take(pa.array(rows, pa.int64()))
            columns = [doc, pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc, number)), pa.array([task] * len(rows), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "number", "task"])

    return run


class Sums:
    """Indexes of the available lengths by their pair and triple sums.

    A sum's combinations are listed when it is first looked up, long parts first, and lose those whose
    lengths are used up; lengths never come back, so every combination is looked at once or twice.
    """

    def __init__(self, left: dict[int, int]):
        self.left = left
        self.pairs: dict[int, list[tuple[int, int]]] = {}
        self.triples: dict[int, list[int]] = {}

    def has(self, *parts: int) -> bool:
        return all(self.left.get(n, 0) >= parts.count(n) for n in parts)

    def pair(self, total: int, most: int, *others: int) -> tuple[int, int] | None:
        """Two available lengths of at most ``most`` that sum to ``total``, beside ``others``."""
        if total not in self.pairs:
            self.pairs[total] = [(a, total - a) for a in sorted(self.left) if 2 * a >= total and total - a in self.left]
        found = self.pairs[total]
        while found and not self.has(*found[-1]):
            found.pop()
        return next((p for p in reversed(found) if p[0] <= most and self.has(*p, *others)), None)

    def triple(self, total: int, most: int, *others: int) -> tuple[int, int, int] | None:
        """Three available lengths of at most ``most`` that sum to ``total``, beside ``others``."""
        if total not in self.triples:
            self.triples[total] = [a for a in sorted(self.left) if 3 * a >= total and a <= total - 2]
        firsts = self.triples[total]
        while firsts and not self.left.get(firsts[-1]):
            firsts.pop()
        for a in reversed(firsts):
            if a <= most and self.has(a, *others) and (rest := self.pair(total - a, a, a, *others)):
                return a, *rest
        return None


def plan(counts: dict[int, int], capacity: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """Patterns ``(lengths, times)`` that pack ``counts`` (pieces by length) into bins of ``capacity``."""
    left = {n: c for n, c in counts.items() if c > 0}
    made: list[tuple[tuple[int, ...], int]] = []

    def use(pattern: tuple[int, ...]) -> None:
        need: dict[int, int] = defaultdict(int)
        for n in pattern:
            need[n] += 1
        times = min(left[n] // k for n, k in need.items())
        made.append((pattern, times))
        for n, k in need.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]

    if left.get(capacity):
        use((capacity,))
    sums = Sums(left)
    # Exact complements, longest first: a single, a pair or a triple that fills the gap.
    lookups = (lambda gap, n: (gap,) if gap <= n and sums.has(n, gap) else None, lambda gap, n: sums.pair(gap, n, n), lambda gap, n: sums.triple(gap, n, n))
    for lookup in lookups:
        for first in sorted(left, reverse=True):
            while left.get(first) and (found := lookup(capacity - first, first)):
                use((first, *found))
    # Residuals, best fit: the longest piece that fits, as long as one does.
    order = sorted(left)
    while order:
        pattern, gap = [], capacity
        spare = dict(left)
        while True:
            at = bisect_left(order, gap + 1) - 1
            while at >= 0 and not spare[order[at]]:
                at -= 1
            if at < 0:
                break
            n = order[at]
            pattern.append(n)
            spare[n] -= 1
            gap -= n
        use(tuple(pattern))
        order = [n for n in order if n in left]
    return made


class Places(NamedTuple):
    """The plan as ranges of the pieces of a length: (length, first number), sequence and offsets."""

    keys: np.ndarray  # length << NUMBERS | first number, sorted
    sequence: np.ndarray
    slots: np.ndarray  # pieces of the length in each sequence of the range
    starts: np.ndarray  # of the range's offsets
    offsets: np.ndarray

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces by length and number."""
        at = np.searchsorted(self.keys, (length << NUMBERS) | number, "right") - 1
        k = number - (self.keys[at] & ((1 << NUMBERS) - 1))
        return self.sequence[at] + k // self.slots[at], self.offsets[self.starts[at] + k % self.slots[at]]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> Places:
    rows, done, sequence = [], defaultdict(int), 0
    for pattern, times in patterns:
        offset, slots = 0, defaultdict(list)
        for n in pattern:
            slots[n].append(offset)
            offset += n
        for n, offsets in slots.items():
            rows.append((n << NUMBERS | done[n], sequence, offsets))
            done[n] += times * len(offsets)
        sequence += times
    rows.sort()
    slots = np.array([len(r[2]) for r in rows], np.int64)
    flat = np.array([x for r in rows for x in r[2]], np.int64)
    return Places(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), slots, np.cumsum(slots) - slots, flat)


def _place(shared):
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                found = shared.value.find(batch.column("length").to_numpy(), batch.column("at").to_numpy())
                yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), *map(pa.array, found)], [*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str | None = None, length: int = LENGTH, remembered: int = REMEMBERED, text_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pack every row of ``docs(doc_id, text)``; one row a piece with its place.

    A null or empty text is the end id alone. Repeated rows are packed each. doc_id may be null.
    Extra columns are ignored; an empty table gives an empty result. Only texts longer than a
    sequence are cut; their last piece may be shorter. ``remembered`` and ``text_bytes`` bound what a
    worker holds, at the price of time; the result does not depend on them.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path(VOCABULARY)
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, number long, task long"
    pieces = stash(docs.select("doc_id", "text").mapInArrow(_cut(tokenizer_path, length, remembered, text_bytes), schema), "packing").df
    # Not written: the narrow rows are counted again where the counts are needed.
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    by = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("task", "length", F.coalesce(F.sum("n").over(by), F.lit(0)).alias("base"))
    # At most one row a length: the plan's input and output are bounded by the sequence length.
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(places(plan(totals, length)))
    placed = pieces.join(bases, ["task", "length"]).withColumn("at", F.col("number") + F.col("base"))
    placed = placed.select("doc_id", "piece", "start", "length", "ids_crc32", "at")
    return placed.mapInArrow(_place(shared), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
