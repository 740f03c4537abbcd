"""Language identification by error-correcting output codes.

Every language gets a codeword of bits, and every bit a binary n-gram classifier that tells the
languages with a 1 from those with a 0: a multinomial model whose weight for a hashed byte n-gram
is the log ratio of its frequency on the two sides, languages weighted alike. A text's mean
weights are the margins of its bits; decoding adds up each codeword's logistic loss, weighted by
how well the bit's classifier did in training, and takes the nearest codeword. The score is the
softmax of the losses; a text whose two nearest codewords lie close together is flagged ambiguous.

Fitting reads a bounded sample of labelled rows (about ``train_rows``, by a hash of doc_id) and
gathers counts by language and n-gram, a table bounded by the languages times 2^14. Prediction is
a narrow map over whole texts.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import blocks, documents

#: Hashed n-grams, expected rows of the training sample, weight of smoothing.
FEATURES = 1 << 14
TRAIN_ROWS = 20_000
SMOOTH = 0.5
#: Steepness of the losses, and the least gap of scores between the two nearest codewords.
STEEP = 12.0
AMBIGUOUS = 0.2
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_FORM = bytes(x if x >= 128 or chr(x).isalpha() else 32 for x in range(256))


class Model(NamedTuple):
    languages: tuple[str, ...]
    codes: np.ndarray  # languages x bits, +1 and -1
    weights: np.ndarray  # n-grams x bits
    trust: np.ndarray  # bits


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """Codewords of ``n`` languages: all splits for up to seven, else the best of seeded random codes."""
    if n <= 7:
        bits = max(1, 2 ** (n - 1) - 1)
        rows = [[1] * bits] + [[1 if (k + 1) >> (n - 1 - i) & 1 else -1 for k in range(bits)] for i in range(1, n)]
        return np.array(rows, np.float32) if n > 1 else np.ones((1, 1), np.float32)
    rng = np.random.default_rng(seed)
    bits = int(np.ceil(15 * np.log2(n)))
    best, apart = None, -1
    for _ in range(64):
        codes = rng.choice([-1.0, 1.0], (n, bits)).astype(np.float32)
        products = codes @ codes.T
        np.fill_diagonal(products, -bits)
        if (bits - products.max()) / 2 > apart and (np.abs(codes.sum(axis=0)) < n).all():
            best, apart = codes, (bits - products.max()) / 2
    return best


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed two-, three- and four-byte grams of lower-cased texts, letters kept and all else a space,
    with the place where each text's grams start. Every text has some."""
    forms = [b" " + (t or "").lower().encode().translate(_FORM) + b"    " for t in texts]
    raw = np.frombuffer(b"".join(forms), np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, forms), np.int64, len(forms))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    n = len(raw) - 3
    a, b, c, d = raw[:n], raw[1 : n + 1], raw[2 : n + 2], raw[3 : n + 3]
    two = a * np.uint32(2654435761) ^ b * np.uint32(2246822519)
    three = (two ^ (two >> np.uint32(15))) * np.uint32(3266489917) + c * np.uint32(668265263)
    four = (three ^ (three >> np.uint32(13))) * np.uint32(374761393) + d * np.uint32(2654435761)
    grams = np.stack([two, three, four], axis=1)
    grams ^= grams >> np.uint32(16)
    grams *= np.uint32(2246822519)
    return (grams >> np.uint32(32 - FEATURES.bit_length() + 1)).astype(np.int32), starts


def _count(batches):
    totals: dict[str, np.ndarray] = {}
    for batch in blocks(batches, most=1 << 20):
        texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
        for lang in set(langs):
            grams, _ = ngrams([t for t, x in zip(texts, langs) if x == lang])
            counts = np.bincount(grams.ravel(), minlength=FEATURES)
            totals[lang] = totals.get(lang, 0) + counts
    for lang, counts in totals.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], ["lang", "gram", "n"])


def part_of(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 4; 2 marks the held-out rows."""
    return F.crc32(F.col(doc_id).cast("string")) % 4


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model | None:
    """Fit on a sample of the labelled rows of ``docs(doc_id, text, lang)``; null if none is labelled.

    ``train_rows`` bounds the expected size of the sample; tables up to that size are used whole.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    total = labelled.select("doc_id").count()
    if total > train_rows:
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * train_rows / total))
    counts = labelled.select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(_count, "lang string, gram long, n long")
    rows = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    if not rows.num_rows:
        return None
    langs = sorted(set(rows.column("lang").to_pylist()))
    table = np.zeros((len(langs), FEATURES))
    np.add.at(table, (np.searchsorted(langs, rows.column("lang").to_pylist()), rows.column("gram").to_numpy()), rows.column("n").to_numpy())
    share = (table + SMOOTH) / (table + SMOOTH).sum(axis=1, keepdims=True)
    codes = codewords(len(langs))
    weights = np.zeros((FEATURES, codes.shape[1]), np.float32)
    trust = np.ones(codes.shape[1], np.float32)
    for k in range(codes.shape[1]):
        one, zero = share[codes[:, k] > 0], share[codes[:, k] < 0]
        if len(one) and len(zero):
            weights[:, k] = np.log(one.mean(axis=0)) - np.log(zero.mean(axis=0))
            # How far apart the languages' mean margins lie: bits that separate badly count less.
            margins = (share * weights[:, k]).sum(axis=1) * codes[:, k]
            trust[k] = max(float(margins.min()), 1e-3)
    return Model(tuple(langs), codes, weights, trust / trust.max())


def margins(model: Model, texts: list[str | None]) -> np.ndarray:
    """Mean weight of each text's n-grams for every bit."""
    grams, starts = ngrams(texts)
    out = np.empty((len(texts), model.weights.shape[1]))
    sizes = np.diff(np.concatenate([starts, [len(grams)]]))
    for k in range(model.weights.shape[1]):
        each = model.weights[:, k][grams].sum(axis=1, dtype=np.float32)
        out[:, k] = np.add.reduceat(each, starts, dtype=np.float64) / np.maximum(1, 3 * sizes)
    return out


def decode(model: Model, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest language, its score and whether another is as near, for rows of margins."""
    loss = (np.logaddexp(0, -STEEP * found[:, None, :] * model.codes[None, :, :]) * model.trust).sum(axis=2) / model.trust.sum() * 4
    score = np.exp(loss.min(axis=1, keepdims=True) - loss)
    score /= score.sum(axis=1, keepdims=True)
    ranked = np.sort(score, axis=1)
    close = ranked[:, -1] - ranked[:, -2] < AMBIGUOUS if score.shape[1] > 1 else np.zeros(len(score), bool)
    return loss.argmin(axis=1), ranked[:, -1], close


def _predict(shared):
    def run(batches):
        model: Model = shared.value
        for batch in blocks(batches, most=1 << 20):
            texts = batch.column("text").to_pylist()
            best, score, close = decode(model, margins(model, texts))
            lettered = [bool(t and _LETTER.search(t)) for t in texts]
            names = [model.languages[k] if ok else UNKNOWN for k, ok in zip(best, lettered)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names), pa.array(np.where(lettered, score, 0.0)), pa.array(np.where(lettered, close, True))],
                ["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
            )

    return run


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``lang_pred``, ``score`` (0 to 1) and ``ambiguous`` for every row of ``docs(doc_id, held_out, text)``.

    A null text, or one without a letter, is ``und`` with score 0 and flagged; so is every row if no
    labelled row was there to learn from. Repeated rows give repeated rows. Extra columns are
    ignored; an empty table gives an empty result.
    """
    if model is None:
        return docs.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double, ambiguous boolean"
    return docs.select("doc_id", "held_out", "text").mapInArrow(_predict(shared), schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang").withColumn("held_out", F.coalesce(part_of() == 2, F.lit(False)))
    model = fit(docs.where(part_of() != 2))
    return identify(docs.drop("lang"), model)
