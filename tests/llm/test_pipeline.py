"""The whole corpus pipeline against a chain of plain loops, with clashing columns, nulls and repeated rows."""

import collections
import random
import re
import zlib

import numpy as np

import corpus_pipeline
from test_operators import VOCAB, brute_good, brute_jaccard, edited

EXTRA = {"_row_number_": "int", "Row_Number": "string", "_gone_": "int", "gone_lines": "string", "_spans_": "int", "cut_spans": "int", "bitmap": "int", "rid": "string", "h": "int", "id": "int", "task": "int"}


def texts(rng):
    say = lambda n: " ".join(rng.choice(VOCAB) for _ in range(n))
    notice, passage = "All rights kept 2024 by the makers of this page", say(70)
    rows = []
    for k in range(160):
        kind = k % 8
        text = say(rng.randint(30, 160))
        if kind == 1:
            text = f"{notice.upper() if k % 3 else notice}\n{text}"
        if kind == 2 and rows:
            text = edited(rng.choice([r for r in rows if r and len(r.split()) > 40]), 2, rng)
        if kind == 3:
            text = f"{text} {passage}\n{say(20)}"
        if kind == 4:
            text += ' password = "aBcDeF0123456789" \n' + "deadbeef" * 3
        if kind == 5:
            text = rng.choice([None, "", " \n", say(6), "a b c d e " * 30, text, text])
        if kind == 6 and rows:
            text = rng.choice(rows)
        rows.append(text)
    return rows


def without_passages(rows):
    """Texts without the 50-word windows that an earlier document has."""
    places = collections.defaultdict(list)
    for k, text in rows:
        tokens = (text or "").split()
        for i in range(len(tokens) - 49):
            places[tuple(tokens[i : i + 50])].append((k, i))
    cut = collections.defaultdict(set)
    for found in places.values():
        if len({k for k, _ in found}) > 1:
            for k, i in found:
                if (k, i) != min(found):
                    cut[k] |= set(range(i, i + 50))
    out = []
    for k, text in rows:
        if k in cut:
            starts = [m.start() for m in re.finditer(r"\S+", text)] + [len(text)]
            text = text[: starts[0]] + "".join(text[a:b] for n, (a, b) in enumerate(zip(starts, starts[1:])) if n not in cut[k])
        if k not in cut or text.split():
            out.append((k, text))
    return out


def test_pipeline_is_a_chain_of_plain_loops(spark, tmp_path):
    from tokenizers import Tokenizer

    import public_tokenizers

    rng = random.Random(77)
    rows = [(k, text, "en", rng.choice(["a", "a", "b", None]), len(text or "")) for k, text in enumerate(texts(rng))]
    extra = [1 if kind == "int" else "x" for kind in EXTRA.values()]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{k} {v}" for k, v in EXTRA.items())
    folder = f"file://{tmp_path}"
    spark.createDataFrame([(*r, *extra) for r in rows], schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    docs, got = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        got.append(docs)

    good = brute_good([(k, text, source) for k, text, _, source, _ in rows])
    assert {r.doc_id: r.text for r in got[0].collect()} == good and 60 < len(good) < 150
    ids = sorted(good)
    label = brute_jaccard([good[k] for k in ids])
    one = [(ids[k], good[ids[k]]) for k in sorted(set(label))]
    assert sorted((r.doc_id, r.text) for r in got[1].collect()) == one and len(one) < len(good)
    cut = without_passages(one)
    assert sorted((r.doc_id, r.text) for r in got[2].collect()) == cut and cut != one
    safe = [(k, re.sub(r"(?:deadbeef){2,}", "[HEX]", re.sub(r'password = "aBcDeF0123456789', "[ASSIGN]", text))) for k, text in cut]
    assert sorted((r.doc_id, r.text) for r in got[3].collect()) == safe and safe != cut
    for stage in got[:4]:
        assert stage.columns == docs_columns(schema) and all(r.n_chars == len(r.text) and tuple(r)[5:] == tuple(extra) for r in stage.collect())
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {k: zlib.crc32(np.array([*own.encode(text, add_special_tokens=False).ids, 1], "<u4").tobytes()) for k, text in safe}
    packed = got[4].collect()
    assert {r.doc_id: r.ids_crc32 for r in packed} == want and len(packed) == len(want)
    ends = collections.defaultdict(list)
    for r in packed:
        ends[r.sequence_id].append((r.offset, r.offset + r.length))
    assert all(a == 0 or a in {b for _, b in places} for places in ends.values() for a, _ in places) and max(b for places in ends.values() for _, b in places) <= 4096
    assert sorted((r.doc_id, r.ids_crc32) for r in corpus_pipeline.run(spark, folder).collect()) == sorted(want.items())


def docs_columns(schema):
    return [x.split()[0] for x in schema.split(", ")]


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
