"""The pipeline's stages, each held against a plain restatement on its own input."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from lodestrata.llm import toxicity

from . import brute


def test_stages(spark, sf_dir, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, rows, after = docs.columns, {}, {}
    for name, stage in corpus_pipeline.STAGES:
        rows[name] = {r["doc_id"]: r for r in docs.collect()}
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    ids = {name: {r["doc_id"] for r in out} for name, out in after.items()}
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scores = toxicity.toxicity(whole, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()
    assert ids["toxicity"] == {r["doc_id"] for r in scores if not r["predicted"]} and len(ids["toxicity"]) > 0.8 * len(scores)
    texts = lambda name: [(i, r["text"]) for i, r in rows[name].items()]
    assert ids["near_dedup"] == {i for i, _, _, kept in brute.near_duplicates(texts("near_dedup"), 80, 5) if kept}
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert ids["decontamination"] == {r[0] for r in brute.contamination(texts("decontamination"), items, 10) if not r[5]}
    assert ids["pii"] == ids["decontamination"] and all(r["n_chars"] == len(r["text"]) for r in after["pii"])
    tokenizer, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), set()
    for r in after["pii"]:
        tokens = [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 0]
        want |= {(r["doc_id"], p, zlib.crc32(np.array(tokens[a : a + 2048], "<u4").tobytes())) for p, a in enumerate(range(0, len(tokens), 2048))}
    assert {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in after["packing"]} == want
    total = sum(r["length"] for r in after["packing"])
    assert len({r["sequence_id"] for r in after["packing"]}) <= -(-total // 2048) + 1
    again = {tuple(r) for r in corpus_pipeline.run(spark, sf_dir).select("doc_id", "piece", "ids_crc32").collect()}
    assert again == want


def test_stages_on_awkward_rows(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline
    from pyspark.sql import functions as F

    passage = " ".join(f"q{i}" for i in range(12))
    rows = [(1, None), (2, ""), (3, " \t"), (None, None), (None, "free text of nobody"), (4, "one"), (5, "ONE"), (6, "mail a.b@c.org now please all of you"), (6, "another text of six words here"), (7, "x " + passage), (8, "z" * 200_000), (9, "so long " * 30_000)]
    given = {
        "documents": spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"), F.lit("clash").alias("kept"), F.lit("clash").alias("length")),
        "labels": spark.createDataFrame([(4, 1, 0), (None, 0, 1), (6, None, None)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, passage), (None, None)], "item_id long, text string"),
    }
    for empty in (False, True):
        sf = str(tmp_path / f"sf{empty}")
        for name, frame in given.items():
            frame.where(F.lit(not (empty and name == "documents"))).write.parquet(f"{sf}/{name}.parquet")
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            stage(spark, docs, sf).write.parquet(f"{sf}/{name}")
            docs = spark.read.parquet(f"{sf}/{name}")
            assert docs.columns == columns
        left = docs.collect()
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
        assert sum(r["length"] for r in packed) >= len(left) and (bool(left) or not packed)
        if not empty:
            assert sorted((r["doc_id"] for r in left), key=str) == sorted([1, 2, 3, None, None, 4, 6, 8, 9], key=str)
            assert not any("a.b@" in (r["text"] or "") for r in left) and all(r["kept"] == "clash" for r in left)
            assert len({r["sequence_id"] for r in packed if r["doc_id"] == 1}) == 1
