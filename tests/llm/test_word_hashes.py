"""Hashes of words, and the T-occurrence search that decides links."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import class_lm, ngram_join, tokens


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_equal_hashes_are_equal_words():
    rng = np.random.default_rng(1)
    made = ["".join(rng.choice(list("abé"), size=n)) for n in rng.integers(1, 80, 3000)]
    made += [thue_morse(1 << k, x) for k in range(13) for x in ("ab", "ba")] + ["a" * n for n in range(1, 100)] + ["A" * 40, "a" * 40 + "\x0bb", "x\x00", "x"]
    found = tokens.words_of(pa.array(made + made[::-1]))
    seen = {}
    words = [w for t in made + made[::-1] for w in t.lower().replace("\x0b", " ").split(" ")]
    assert len(words) == len(found.hashes)
    for w, h in zip(words, found.hashes.tolist(), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_long_unlike_words_stay_apart(spark):
    docs = spark.createDataFrame([(k, thue_morse(1 << n, x)) for k, (n, x) in enumerate((n, x) for n in (10, 11, 12) for x in ("ab", "ba"))], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(docs).collect()} == {k: k for k in range(6)}
    scores = class_lm.class_lm_scores(docs, F.col("doc_id") == 0).collect()
    assert {r["doc_id"]: r["n_known"] for r in scores} == {k: 1 + (k == 0) for k in range(6)}  # the end is known to all


def brute(query, size, sets, sizes, percent):
    return [k for k, (s, n) in enumerate(zip(sets, sizes, strict=True)) if (i := len(set(query.tolist()) & set(s.tolist()))) and 100 * i >= percent * (size + n - i)]


@pytest.mark.parametrize("percent", [10, 50, 80, 100])
def test_t_occurrence_search(percent):
    rng = np.random.default_rng(percent)
    for _ in range(60):
        base = rng.choice(1000, size=rng.integers(1, 120), replace=False)
        sets = []
        for _ in range(30):
            own = base[rng.random(len(base)) < rng.random()]
            sets.append(np.unique(np.concatenate([own, rng.integers(1000, 1200, rng.integers(0, 30))])).astype(np.uint64))
        sets = [s for s in sets if len(s)]
        extra = rng.integers(0, 3, len(sets)).tolist()  # shingles that nobody shares are not among the sets
        sizes = [len(s) + e for s, e in zip(sets, extra, strict=True)]
        assert ngram_join.t_occurrence(base.astype(np.uint64), len(base), sets, sizes, percent) == brute(base.astype(np.uint64), len(base), sets, sizes, percent)


def test_links_that_no_block_finds(spark, monkeypatch):
    """Without rounds of blocks the late search finds all; without that search, links are lost."""
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join(words[:-1] + ["x"]), " ".join(["y"] + words[1:]), " ".join(words[30:] + words[:30]), "other text of no one at all"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def nothing(batches, percent):  # local, so that workers get it by value
        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64())], ["a", "b"])

    told = lambda: [r["component_id"] for r in ngram_join.ngram_components(docs).orderBy("doc_id").collect()]
    assert told() == [0, 0, 0, 0, 4]
    monkeypatch.setattr(ngram_join, "_search", nothing)
    assert told() == [0, 0, 0, 0, 4]
    monkeypatch.setattr(ngram_join, "_verify", nothing)
    assert told() == [0, 1, 2, 3, 4]
