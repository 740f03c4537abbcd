"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Texts are taken in blocks. The words of a block that are new (matches of the split pattern, each
once, however often it occurs) form a small corpus whose merges are replayed together: an
inverted index from pair to word positions, keyed by the rank of the merged token, is worked off
in rank order; a merge touches only its two neighbours, whose new pairs enter the index. A merge
that brings up a lower rank is followed at once, as encoding word by word would. Since ranks are
fixed, a word's ids do not depend on the block, so blocks are independent and tasks remember
words between them, within a bound on bytes.

A narrow map: no shuffle, nothing broadcast but the path of the vocabulary.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.common import Memo, blocks, documents, held

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Bytes of words, and of chunks, that a worker remembers.
REMEMBERED = 64 << 20
#: New words replayed together: few enough for the index to stay in a CPU's cache.
AT_ONCE = 1000
#: Ids decoded together: a bound on the index of their bytes.
DECODED = 65_536


class MergeReplay:
    """Ids of words under fixed ranks, many words at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # Rank of the token that a pair merges to, for every pair that merges to one.
        self.pairs = {
            ranks[token[:k]] << 32 | ranks[token[k:]]: rank
            for token, rank in ranks.items()
            for k in range(1, len(token))
            if token[:k] in ranks and token[k:] in ranks
        }
        # The same for two single bytes, the first times 256 plus the second; -1 where they merge to none.
        self.first = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int64)

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word; words that are tokens themselves need no merge."""
        ranks, rank = self.ranks, self.pairs.get
        out: list[list[int]] = [[ranks[w]] if w in ranks else [] for w in words]
        # All other words end to end; -1 before and after each keeps merges inside.
        rest = [k for k, word in enumerate(words) if not out[k] and word]
        sizes = np.array([len(words[k]) for k in rest], np.int64)
        ends = np.cumsum(sizes + 1)
        where = zip(rest, (ends - sizes).tolist(), sizes.tolist())
        flat = np.frombuffer(b"\0" + b"".join([words[k] + b"\0" for k in rest]), np.uint8).astype(np.int64)
        codes = self.single[flat]
        codes[0], codes[ends] = -1, -1
        symbols: list[int] = codes.tolist()
        nxt = list(range(1, len(symbols) + 1))
        prv = list(range(-1, len(symbols) - 1))
        index: dict[int, list[int]] = {}
        if rest:
            found = np.where((codes[:-1] >= 0) & (codes[1:] >= 0), self.first[flat[:-1] << 8 | flat[1:]], -1)
            order = np.argsort(found, kind="stable")
            order = order[np.searchsorted(found[order], 0) :]
            cuts = np.flatnonzero(np.diff(found[order])) + 1
            index = {int(found[x[0]]): x.tolist() for x in np.split(order, cuts) if len(x)}
        # A pair with -1 or -2 in it is in no table, so the ends of words need no test.
        queue = list(index)
        heapify(queue)
        gone = -2
        while queue:
            r = heappop(queue)
            places = index.pop(r, None)
            if places is None:
                continue
            places.sort()
            for k, at in enumerate(places):
                right = nxt[at]
                if rank(symbols[at] << 32 | symbols[right]) != r:
                    continue
                after, before = nxt[right], prv[at]
                symbols[at], symbols[right] = r, gone
                nxt[at] = after
                prv[after] = at
                lower = False
                if (n := rank(symbols[before] << 32 | r)) is not None:
                    if n in index:
                        index[n].append(before)
                    else:
                        index[n] = [before]
                        heappush(queue, n)
                    lower = n < r
                if (n := rank(r << 32 | symbols[after])) is not None:
                    if n in index:
                        index[n].append(at)
                    else:
                        index[n] = [at]
                        heappush(queue, n)
                    lower = lower or n < r
                if lower and k + 1 < len(places):
                    index.setdefault(r, []).extend(places[k + 1 :])
                    heappush(queue, r)
                    break
        for k, at, size in where:
            out[k] = [x for x in symbols[at : at + size] if x >= 0]
        return out


class Encoder:
    """Whole texts to ids, written in decimal, and back to bytes."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.replay = MergeReplay(ranks)
        self.find = regex.compile(pattern).findall
        self.edge = regex.compile(r"^\s|\s$|^$").search
        # Bytes of all tokens end to end, and the start and size of each.
        tokens = [self.replay.tokens.get(i, b"") for i in range(max(self.replay.tokens) + 1)]
        self.flat, self.sizes = np.frombuffer(b"".join(tokens), np.uint8), np.array(list(map(len, tokens)), np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.words, self.first, self.spaced = Memo(REMEMBERED), Memo(REMEMBERED // 4), Memo(REMEMBERED)

    def _learn_words(self, words: set[str]) -> None:
        fresh = list(self.words.missing(words))
        for at in range(0, len(fresh), AT_ONCE):
            part = fresh[at : at + AT_ONCE]
            replayed = self.replay.encode([w.encode() for w in part])
            self.words.add({word: b"".join([b" %d" % i for i in ids]) for word, ids in zip(part, replayed)})

    def _spaced_words(self, chunk: str) -> list[str] | None:
        """Words of a chunk behind a space; letters, or letters and one mark, need no pattern."""
        if chunk.isalpha():
            return [" " + chunk]
        if chunk[:-1].isalpha() and chunk[-1] in ".,;:!?":
            return [" " + chunk[:-1], chunk[-1]]
        return None if self.edge(chunk) else self.find(" " + chunk)

    def _learn(self, texts: list[list[str]]) -> None:
        for known in (self.words, self.first, self.spaced):
            known.turn()
        heads = self.first.missing({chunks[0] for chunks in texts})
        tails = self.spaced.missing(set().union(*(chunks[1:] for chunks in texts)))
        # Between single spaces a chunk splits alike wherever it stands, unless white space is at its edge.
        split = {(c, False): None if self.edge(c) else self.find(c) for c in heads}
        split.update({(c, True): self._spaced_words(c) for c in tails})
        self._learn_words(set().union(*(x for x in split.values() if x)))
        known = self.words.young.__getitem__
        for memo, side in ((self.first, False), (self.spaced, True)):
            memo.add({chunk: None if words is None else b"".join(map(known, words)) for (chunk, spaced), words in split.items() if spaced == side})

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, every one with a space before it."""
        cut = [t.split(" ") for t in texts]
        self._learn(cut)
        out: list[bytes] = []
        spaced = self.spaced.young.__getitem__
        for text, chunks in zip(texts, cut):
            head = self.first.young[chunks[0]]
            try:
                out.append(head + b"".join(map(spaced, chunks[1:])))
            except TypeError:  # white space that the split at spaces would treat wrongly
                words = self.find(text)
                self._learn_words(set(words))
                out.append(b"".join(map(self.words.young.__getitem__, words)))
        return out

    def decode(self, ids: bytes) -> bytes:
        numbers = np.fromstring(ids, np.int64, sep=" ") if ids else np.empty(0, np.int64)
        return b"".join(self._bytes(numbers[at : at + DECODED]) for at in range(0, len(numbers), DECODED))

    def _bytes(self, numbers: np.ndarray) -> bytes:
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[numbers] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes()


def encoder(path: str, pattern: str) -> Encoder:
    return held(("bytes", path, pattern), lambda: Encoder(path, pattern))


def _rows(path: str, pattern: str):
    def run(batches):
        coder = encoder(path, pattern)
        for batch in blocks(batches):
            encoded = coder.encode([t or "" for t in batch.column("text").to_pylist()])
            counts = pa.array([x.count(b" ") for x in encoded], pa.int64())
            ids = pa.array([hashlib.sha256(x[1:]).hexdigest() for x in encoded])
            back = pa.array([hashlib.sha256(coder.decode(x)).hexdigest() for x in encoded])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), counts, ids, back], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(path: str, pattern: str):
    def run(batches):
        coder = encoder(path, pattern)
        for batch in blocks(batches):
            ids = [list(map(int, x.split())) for x in coder.encode([t or "" for t in batch.column("text").to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def _public(path: str | None, pattern: str | None) -> tuple[str, str]:
    if path and pattern:
        return path, pattern
    import public_tokenizers

    return path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(doc_id, ids)`` of every row of ``docs(doc_id, text)``; a null or empty text has no ids.

    Repeated rows give repeated rows, a null doc_id stays null. Extra columns are ignored, whatever
    their names; an empty table gives an empty result.
    """
    return docs.select("doc_id", "text").mapInArrow(_ids(*_public(path, pattern)), f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Token count and digests of the ids and of the bytes decoded from them, one row a document.

    A null text counts as empty: no ids, the digests of nothing. Repeated rows give repeated rows.
    Extra columns are ignored; an empty table gives an empty result.
    """
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(_rows(*_public(path, pattern)), schema)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))
