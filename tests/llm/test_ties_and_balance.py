"""Ties among neighbours, and balance of shards with whole texts."""

import numpy as np
import pytest

from tessera.llm import quality_knn, sharding


def test_equally_near_neighbours_all_vote():
    similar = np.array([[0.9, 0.5, 0.5, 0.5, 0.1], [0.2, 0.2, 0.2, 0.2, 0.2], [5, 4, 3, 2, 1]])
    assert quality_knn.nearest(similar, 2).tolist() == [[True, True, True, True, False], [True] * 5, [True, True, False, False, False]]
    shuffled = np.random.default_rng(1).permutation(5)  # the order of labelled rows decides nothing
    assert (quality_knn.nearest(similar[:, shuffled], 2) == quality_knn.nearest(similar, 2)[:, shuffled]).all()


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_shards_of_whole_texts_are_near_equal(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    shards = 8 if sf == "0.001" else 40
    rows = sharding.shard_documents(docs, shards=shards).collect()
    loads = np.bincount([r["shard"] for r in rows], weights=[r["size"] for r in rows], minlength=shards)
    most = max(r["size"] for r in rows) / loads.mean()
    assert most < 1 and loads.max() / loads.mean() < 1.01 and loads.min() / loads.mean() > 0.98, (most, loads.max() / loads.mean(), loads.min() / loads.mean())
