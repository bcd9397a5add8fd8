"""What operators leave on disk and hold on the driver."""

from __future__ import annotations

import os
import tracemalloc

import numpy as np
from pyspark import TaskContext
from pyspark.sql import functions as F

from tessera.llm import class_lm, common, quality_knn


def test_language_model_keeps_one_table_and_no_shuffles(spark, monkeypatch):
    folder = common.checkpoint_dir(spark).removeprefix("file:")
    tables = lambda: {n for n in os.listdir(folder) if n.startswith("table-")}
    docs = spark.createDataFrame([(k, f"some words of text {k % 7} here and {k}") for k in range(60)], "doc_id long, text string")
    clean, before, seen = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", tables(), []
    kept, exchange = spark.conf.get(clean, None), class_lm.exchange
    monkeypatch.setattr(class_lm, "exchange", lambda *a: seen.append(spark.conf.get(clean, None)) or exchange(*a))
    scored = class_lm.class_lm_scores(docs, F.col("doc_id") % 3 != 0, frequent=8, rare=8, classes=4)
    assert seen == ["true"] and spark.conf.get(clean, None) == kept
    # what the scores are read from stays; the words, counts and vocabulary that it came from go
    assert len(tables() - before) == 1
    assert scored.count() == 60 and scored.where("isnan(score) or score >= 0").count() == 0


def test_quality_model_is_not_fitted_on_the_driver(spark, monkeypatch):
    docs = spark.createDataFrame([(k, ("good text " if k % 2 else "BAD!! 123 ") * (3 + k % 5)) for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    own = quality_knn.fit

    def refused(*args):
        if TaskContext.get() is None:
            raise MemoryError("fitted on the driver")
        return own(*args)

    monkeypatch.setattr(quality_knn, "fit", refused)
    rows = quality_knn.score_quality(docs, labels, F.col("doc_id") < 30).collect()
    assert all(r["_predicted"] == r["doc_id"] % 2 for r in rows)
    monkeypatch.setattr(quality_knn, "fit", own)
    assert quality_knn.score_quality(docs, labels.limit(0), F.lit(True)).where("_score != 0").count() == 0


def test_fit_does_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    counts, labels = rng.poisson(0.3, (70, 40 + quality_knn.SHAPES)).astype(np.float16), rng.integers(0, 2, 70)
    one = quality_knn.fit(counts, labels, 5)
    monkeypatch.setattr(quality_knn, "FITTED", 9)
    other = quality_knn.fit(counts, labels, 5)
    assert all((one[k] == other[k]).all() for k in one)


def test_counts_of_words_are_summed_in_little_memory():
    rng = np.random.default_rng(5)
    some = [(rng.integers(0, 9_000, 40_000).astype(np.uint64), rng.integers(0, 4, 40_000).astype(np.uint32), np.ones(40_000, np.int64)) for _ in range(50)]
    tracemalloc.start()
    words, cells, amounts = class_lm._summed(iter(some))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    keys, counts = np.unique(np.concatenate([w * np.uint64(4) + c for w, c, _ in some]), return_counts=True)
    assert (words * np.uint64(4) + cells == keys).all() and (amounts == counts).all()
    # 2,000,000 pieces of 20 bytes, of which 36,000 are distinct
    assert most < 20e6


def test_chunks_go_to_the_model_a_few_at_a_time(spark, monkeypatch):
    seen, conf, exchange = [], spark.conf.get(common.BATCH), class_lm.exchange
    monkeypatch.setattr(class_lm, "exchange", lambda *a: seen.append(spark.conf.get(common.BATCH)) or exchange(*a))
    docs = spark.createDataFrame([(k, f"a text {k % 5} of words") for k in range(40)], "doc_id long, text string")
    assert class_lm.class_lm_scores(docs, F.col("doc_id") % 3 != 0, frequent=8, rare=8, classes=4).count() == 40
    assert seen == ["8"] and spark.conf.get(common.BATCH) == conf
