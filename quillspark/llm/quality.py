"""Quality rules with cross-document line frequency.

A document's lines are normalised (trimmed, ASCII lower-cased, inner white space folded, digits
folded to 0) and hashed together with their host. A line's frequency is the number of distinct
documents (by doc_id) of one host that contain it; lines above the limits count as boilerplate and
are removed, and a document that loses too large a part of its words to them is rejected. The base
rules (repeated words, too few words) come from the text alone.

Plan: one Arrow pass over the texts gives one hash a distinct line; lines are counted by hash
aggregations, first by line and document (so a line in a third of all rows is spread over all
tasks), then by line with map-side combination. For verdicts the frequent lines are joined to the
narrow rows. For the cut texts (``keep_good``) they are broadcast as 64-bit keys, if their counted
number is within ``MOST_SHIPPED``, and a second pass over the texts decides and cuts at once: no text
is shuffled or copied. Beyond that number verdicts are joined to the texts by row number.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import blocks, documents, retext, unused
from quillspark.runtime import discard, stash

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: A line is boilerplate if more documents of a host hold it than this and than this share of the host's documents.
LINE_LIMIT = 20
LINE_SHARE = 0.02
#: A document is depleted if fewer words than MIN_WORDS or less than this share of its words remain.
MIN_KEPT_SHARE = 0.3
#: Most frequent lines that are broadcast (8 bytes each).
MOST_SHIPPED = 2_000_000
SYMBOLS = b"#*$%&|<>"

_DIGITS = re.compile(rb"[0-9]")
_OTHERS = bytes(x for x in range(256) if x not in SYMBOLS)
_SPACES = bytes([0x20, *range(0x09, 0x0E)])

_LINES = pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int32())]))


def host_seed(source) -> int:
    """Seed of a host's line keys; rows with a null source are a host of their own."""
    return 0 if source is None else xxhash.xxh64_intdigest(str(source).encode(), 1)


def line_key(line: bytes, seed: int = 0) -> int:
    """Signed 64-bit hash of a line's normal form on a host."""
    form = _DIGITS.sub(b"0", b" ".join(line.lower().split()))
    value = xxhash.xxh64_intdigest(form, seed)
    return value - (1 << 64) if value >> 63 else value


def repeated_words(tokens: list[bytes], size: int = WINDOW) -> int:
    """Words covered by windows of ``size`` words that occur twice or more in the text."""
    windows = list(zip(*(tokens[i:] for i in range(size))))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered = end = 0
    for start, window in enumerate(windows):
        if counts[window] > 1:
            covered += start + size - max(start, end)
            end = start + size
    return covered


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """``(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)`` of one text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode()
    tokens = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip(_SPACES)]
    return (
        len(tokens),
        len(text) - (len(raw) - len(raw.translate(None, _SPACES))),
        len(raw.translate(None, _OTHERS)),
        len(lines) - len(set(lines)),
        repeated_words(tokens),
    )


def distinct_lines(text: str | None, seed: int = 0) -> dict[int, int]:
    """Line key to words on all its occurrences in the text."""
    found: dict[int, int] = {}
    if text:
        for line in text.encode().split(b"\n"):
            if n := len(line.split()):
                key = line_key(line, seed)
                found[key] = found.get(key, 0) + n
    return found


IDENTITY = ("rid", "doc_id", "source")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _scan(batches):
    for batch in blocks(batches):
        texts, seeds = batch.column("text").to_pylist(), [host_seed(x) for x in batch.column("source").to_pylist()]
        counts = [base_counts(x) for x in texts]
        lines = [[{"h": h, "n": n} for h, n in distinct_lines(x, s).items()] for x, s in zip(texts, seeds)]
        columns = [*(batch.column(x) for x in IDENTITY), pa.array(map(_signed, seeds), pa.int64()), *(pa.array(x, pa.int64()) for x in zip(*counts)), pa.array(lines, _LINES)]
        yield pa.RecordBatch.from_arrays(columns, [*IDENTITY, "host", *COUNTS, "lines"])


def _lines(batches):
    for batch in blocks(batches):
        seeds = [host_seed(x) for x in batch.column("source").to_pylist()]
        keys = [list(distinct_lines(x, s)) for x, s in zip(batch.column("text").to_pylist(), seeds)]
        columns = [*(batch.column(x) for x in IDENTITY), pa.array(map(_signed, seeds), pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, [*IDENTITY, "host", "h"])


def _numbered(docs: DataFrame, rid: str | None) -> DataFrame:
    return docs.select(F.col(rid).alias("rid") if rid else F.monotonically_increasing_id().alias("rid"), "doc_id", "source", "text")


def frequent_lines(lines: DataFrame, limit: int = LINE_LIMIT, share: float = LINE_SHARE) -> DataFrame:
    """``(h)``: keys of the lines that more than ``limit`` documents and more than ``share`` of the
    documents of a host hold, of ``lines(rid, doc_id, host, h array)``. Rows that repeat a doc_id are
    one document; each row with a null doc_id is one of its own."""
    one = lines.select("host", "h", "doc_id", F.when(F.col("doc_id").isNull(), F.col("rid")).alias("alone"))
    hosts = one.select("host", "doc_id", "alone").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    docs = one.select("host", F.explode("h").alias("h"), "doc_id", "alone").distinct().groupBy("host", "h").agg(F.count("*").alias("docs"))
    return docs.where(F.col("docs") > limit).join(hosts, "host").where(F.col("docs") > F.col("host_docs") * share).select("h")


def scan(docs: DataFrame, rid: str | None = None) -> DataFrame:
    """Base counts and distinct line keys of every row, written to the shared folder."""
    numbered = _numbered(docs, rid)
    kinds = dict(numbered.dtypes)
    schema = f"rid long, doc_id {kinds['doc_id']}, source {kinds['source']}, host long, {', '.join(f'{c} long' for c in COUNTS)}, lines array<struct<h: long, n: int>>"
    return stash(numbered.mapInArrow(_scan, schema), "quality").df


def judge(scanned: DataFrame, frequent: DataFrame, min_kept: float = MIN_KEPT_SHARE) -> DataFrame:
    """Verdict and frequent lines (``gone``) of every scanned row."""
    lost = (
        scanned.select("rid", F.explode("lines").alias("line"))
        .select("rid", F.col("line.h").alias("h"), F.col("line.n").alias("n"))
        .join(frequent, "h")
        .groupBy("rid")
        .agg(F.sum("n").alias("lost"), F.collect_list("h").alias("gone"))
    )
    judged = scanned.drop("lines", "host").join(lost, "rid", "left").withColumn("n_frequent_words", F.coalesce("lost", F.lit(0).cast("long")))
    left = F.col("n_words") - F.col("n_frequent_words")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    depleted = (F.col("n_frequent_words") > 0) & ((left < MIN_WORDS) | (left < F.col("n_words") * min_kept))
    return judged.drop("lost").withColumns({"n_words_left": left, "base_failed": failed, "depleted": depleted, "kept": ~failed & ~depleted})


def quality(docs: DataFrame, limit: int = LINE_LIMIT, share: float = LINE_SHARE, min_kept: float = MIN_KEPT_SHARE) -> DataFrame:
    """Judge every row of ``docs(doc_id, text, source)``.

    Returns ``rid, doc_id, source`` with the base counts, ``n_frequent_words`` (words on boilerplate lines),
    ``gone`` (keys of those lines), ``n_words_left``, ``base_failed``, ``depleted`` and ``kept``.

    Null and empty texts have no words and fail the base rules. Rows with a null source belong to
    one host of their own. Repeated rows are judged alike, each for itself, and count as one
    document; each row with a null doc_id counts as one. Extra columns are ignored. An empty table
    gives an empty result.
    """
    scanned = scan(docs)
    lines = scanned.select("rid", "doc_id", "host", F.col("lines.h").alias("h"))
    return judge(scanned, stash(frequent_lines(lines, limit, share), "quality-lines").df, min_kept)


def keep_good(docs: DataFrame, limit: int = LINE_LIMIT, share: float = LINE_SHARE, min_kept: float = MIN_KEPT_SHARE, most_shipped: int = MOST_SHIPPED) -> DataFrame:
    """The rows of ``docs`` that pass, with boilerplate lines removed from their texts and
    ``n_chars`` set anew; all columns of ``docs`` stay, whatever their names. Rows are judged as by
    ``quality``; an empty table gives an empty result."""
    numbered = _numbered(docs, None)
    kinds = dict(docs.dtypes)
    lines = stash(numbered.mapInArrow(_lines, f"rid long, doc_id {kinds['doc_id']}, source {kinds['source']}, host long, h array<long>").drop("source"), "quality-hosts")
    frequent = stash(frequent_lines(lines.df, limit, share), "quality-lines").df
    discard(docs.sparkSession, lines)
    if frequent.count() <= most_shipped:
        keys = docs.sparkSession.sparkContext.broadcast(frequent.toArrow().column("h").to_numpy())
        return docs.mapInArrow(_decide(keys, min_kept), docs.schema)
    rid, gone = unused(docs.columns, "row_number"), unused(docs.columns, "gone_lines")
    rows = stash(docs.withColumn(rid, F.monotonically_increasing_id()), "quality-rows").df
    verdict = judge(scan(rows, rid), frequent, min_kept).where("kept").select(F.col("rid").alias(rid), F.col("gone").alias(gone))
    joined = stash(rows.join(verdict, rid), "quality-joined").df
    return joined.select(*docs.columns, gone).mapInArrow(_strip(gone), docs.schema)


def without_lines(text: str | None, gone, seed: int = 0) -> str | None:
    """``text`` without the lines whose keys are in ``gone``; other lines stay as they are."""
    if not text or not gone:
        return text
    return "\n".join(x for x in text.split("\n") if not (raw := x.encode()).strip(_SPACES) or line_key(raw, seed) not in gone)


def verdict(text: str | None, frequent, seed: int, min_kept: float) -> tuple[bool, set[int]]:
    """Whether a text passes, and its frequent lines."""
    n_words, _, _, _, n_repeat = base_counts(text)
    if n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words:
        return False, set()
    gone = {h: n for h, n in distinct_lines(text, seed).items() if h in frequent}
    left = n_words - sum(gone.values())
    return not gone or (left >= MIN_WORDS and left >= n_words * min_kept), set(gone)


def _decide(shared, min_kept: float):
    def run(batches):
        frequent = set(shared.value.tolist())
        for batch in blocks(batches):
            texts, seeds = batch.column("text").to_pylist(), [host_seed(x) for x in batch.column("source").to_pylist()]
            found = [verdict(t, frequent, s, min_kept) for t, s in zip(texts, seeds)]
            cut = [without_lines(t, gone, s) if ok else t for t, (ok, gone), s in zip(texts, found, seeds)]
            yield retext(batch, cut).filter(pa.array([ok for ok, _ in found], pa.bool_()))

    return run


def _strip(gone: str):
    def run(batches):
        for batch in blocks(batches):
            rows = zip(*(batch.column(x).to_pylist() for x in ("text", gone, "source")))
            yield retext(batch, [without_lines(t, set(g or ()), host_seed(s)) for t, g, s in rows], (gone,))

    return run


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality(documents(spark, sf_dir, "doc_id", "text", "source"))
    return judged.select("doc_id", *COUNTS, "base_failed", "kept", "n_frequent_words")
