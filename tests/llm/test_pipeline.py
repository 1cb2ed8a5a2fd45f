"""The pipeline on the smallest tables: each stage against what a brute-force version or the operator's own test says."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import SF, documents, encode
from tests.llm.test_jaccard import by_brute_force
from tests.llm.test_quality import base
from tests.llm.test_tokens import check_packing
from tickweave.llm.jaccard import one_of_each
from tickweave.llm.quality import keep_good
from tickweave.llm.toxicity import drop_toxic


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        before, kept = kept, stage(spark, kept, SF).cache()
        assert kept.columns == columns
        rows, left = {r.doc_id: r.text for r in before.collect()}, {r.doc_id for r in kept.collect()}
        assert left <= set(rows) and len(left) >= 0.7 * len(rows), name
        if name == "quality":
            assert not any(base(rows[i])[5] for i in left)
        if name == "near copies":
            groups = by_brute_force(list(rows.items()))
            assert left == {c for _, _, c in groups}
    pieces = corpus_pipeline.run(spark, SF).collect()
    check_packing(pieces, 2048)
    lengths = {r.doc_id: len(encode(r.text)) + 1 for r in kept.collect()}
    assert {p.doc_id: p.doc_tokens for p in pieces} == lengths and sum(p.length for p in pieces) == sum(lengths.values())


def test_one_of_each_with_odd_keys(spark):
    texts = ["a b c d e f", "a b c d e f", None, "", "x y", "a b c d e f", "x y"]
    rows = one_of_each(documents(spark, texts, [7, 3, 4, 5, None, 3, 9])).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in rows) == [("3", "a b c d e f"), ("4", ""), ("5", ""), ("9", "x y"), ("None", "x y")]
    assert len(rows[0]) == 9 and np.all([r.lang == "en" for r in rows])


def test_one_of_each_with_one_key_on_different_texts(spark):
    one, two, three = ("a b c d e f g", "h i j k l m n", "o p q r s t u")
    # 3 stands for the group of `one` and lies in that of `two`, whose smallest key is 2; 5 is the smallest key of two groups
    rows = [(3, one), (4, one), (3, two), (2, two), (5, three), (5, "v w x y z a b"), (6, three), (5, three), (8, ""), (8, None), (8, " ")]
    kept = one_of_each(documents(spark, [t for _, t in rows], [k for k, _ in rows])).collect()
    assert sorted((r.doc_id, (r.text or "").strip()) for r in kept) == [(2, two), (3, one), (5, three), (5, "v w x y z a b"), (8, ""), (8, "")]


def test_clashing_names(spark):
    names = ["kept", "_kept", "Kept_", "hashed", "ratios", "_quality_ratios", "h", "group", "n", "c", "toxic", "tuning", "verdict"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    wide = docs.select("*", *(F.lit(i).alias(x) for i, x in enumerate(names)))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    plain = keep_good(docs, docs), drop_toxic(docs, labels), one_of_each(docs)
    for a, b in zip(plain, (keep_good(wide, wide), drop_toxic(wide, labels), one_of_each(wide)), strict=True):
        rows = b.collect()
        assert b.columns == wide.columns and sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in a.collect())
        assert all(tuple(r[x] for x in names) == tuple(range(len(names))) for r in rows)


def test_stages_without_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name
