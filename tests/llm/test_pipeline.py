"""The pipeline against a composition of the brute-force versions."""

import random
import zlib

import numpy as np

import corpus_pipeline
from marketloom.llm import decontam, packing
from marketloom.llm.queries import tokenizer_path

from .test_groups import edited, near_brute
from .test_texts import SECRETS, prose, repetition_brute, secrets_brute


def corpus(rng):
    uniq = lambda n: " ".join(f"{rng.choice('abcdef')}{rng.randint(0, 10**6)}" for _ in range(n))
    items = [uniq(30), uniq(8)]
    texts = [None, "", prose(rng, 10), "spam ham " * 100]
    for _ in range(12):
        t = uniq(120)
        texts += [t, edited(rng, t, 1), t]
    texts += [f"{uniq(60)} {s}" for s in SECRETS if s and len(s) < 200]
    texts += [f"{uniq(60)} {items[0]}", f"{uniq(900)} {items[0][:90]}", f"{uniq(60)} {items[1].upper()}"]
    return texts, items


def test_pipeline_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    texts, items = corpus(random.Random(3))
    folder = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    left = [(i, t) for i, t in enumerate(texts) if repetition_brute(t)[-1]]
    _, comp = near_brute([t for _, t in left])
    left = [x for k, x in enumerate(left) if comp[k] == k]
    pairs = [(str(i), t) for i, t in enumerate(items)]
    clean = []
    for i, t in left:
        n, hit, _ = decontam.brute_force(t, pairs)
        if not (hit and 20 * hit >= n):
            clean.append((i, t))
    assert 0 < len(clean) < len(left) < len(texts)
    tok, want = Tokenizer.from_file(tokenizer_path()), set()
    for i, t in clean:
        out, at = "", 0
        for s, _, e, kind in secrets_brute(t):
            if e > at:
                out, at = out + (t[at:s] + f"[{kind}]" if s >= at else ""), e
        ids = [*tok.encode(out + t[at:], add_special_tokens=False).ids, 1]
        start = 0
        for n in packing.cuts(len(ids), 2048):
            want.add((i, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()), len(ids)))
            start += n
    got = corpus_pipeline.run(spark, folder)
    assert {(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got.collect()} == want


def test_stages_keep_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "redact_secrets", "pack"]
    for _, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, docs, "/root/testdata/sf0.001").columns == docs.columns
        assert f(spark, docs.where("false"), "/root/testdata/sf0.001").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), "").count() == 0
