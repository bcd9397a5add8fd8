"""Operators on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import audit, graph, lexical, retrieval, similar
from tessera.operators import sequence as seq


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_mirror_groups_keep_the_preferred_copy(spark):
    df = spark.createDataFrame([(1, "a", 1, 1, 2), (2, "a", 0, 0, 1), (3, "b", 0, 1, 5)], "id int, key string, pref int, priority int, matched int")
    out = lexical.mirror_groups(df, ["key"], [F.col("pref"), F.col("id")], coarse=["key"])
    assert rows(out.select("id", "copies", "group_priority", "group_matched", "mirrored_ids")) == [(2, 2, 0, 2, "1"), (3, 1, 1, 5, "")]


def test_term_candidates(spark):
    tokens = spark.createDataFrame([(1, "a", "a", 2), (1, "b", "b", 1), (2, "b", "b", 1), (3, "c", "c", 1)], "id int, form string, normalized string, count int")
    exact = spark.createDataFrame([(2,), (4,)], "id int")
    assert rows(lexical.term_candidates(tokens, exact, ["a", "b"])) == [(1, 1, 2), (2, 0, 1), (4, 0, 0)]


def test_fusion_counts_a_group_once_in_a_list(spark):
    hits = spark.createDataFrame([("x", 1, 10, "g"), ("x", 2, 11, "g"), ("x", 3, 12, "h"), ("y", 1, 12, "h")], "signal string, position int, id int, group_key string")
    out = {r["group_key"]: r for r in retrieval.reciprocal_rank_fusion(hits).collect()}
    assert out["g"]["score"] == round(1 / 61, 8) and out["h"]["score"] == round(1 / 62 + 1 / 61, 8)
    assert out["h"]["ranks"] == "x:2,y:1" and out["h"]["best_rank"] == 1


def test_dense_ties_go_to_the_smaller_identifier(spark):
    df = spark.createDataFrame([(3, [0.7, 0.1]), (1, [0.7, 0.1]), (2, [1.0, 0.0]), (4, [0.0, 1.0])], "vec_id int, embedding array<float>")
    assert [r["vec_id"] for r in retrieval.dense_top_k(df, [1.0, 0.0], 3).collect()] == [2, 1, 3]
    assert [r["vec_id"] for r in retrieval.dense_top_k(df, [1.0, 0.0], 3, F.col("vec_id") > 2).collect()] == [3, 4]


def test_rank_counts_each_credit_set_once(spark):
    results = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (1, 3, 7), (2, 1, 9)], "query_id int, position int, id int")
    credit = spark.createDataFrame([(1, 5, "k", False), (1, 6, "k", False), (1, 7, "t", True)], "query_id int, id int, credit_key string, is_target boolean")
    ranks = spark.createDataFrame([(1,), (2,)], "query_id int").join(retrieval.rank_of_target(results, credit), "query_id", "left")
    assert rows(ranks) == [(1, 2), (2, None)] or {(r[0], r[1]) for r in ranks.collect()} == {(1, 2), (2, None)}
    assert tuple(retrieval.recall_and_mrr(ranks).first()) == (2, 0.0, 0.5, 0.5, 0.25)


def test_usage_space_refuses_too_many_points(spark):
    weights = spark.createDataFrame([(i, "w", float(i)) for i in range(5)], "id int, normalized string, weight double")
    assert len(retrieval.usage_space(weights, points=5)) == 5
    with pytest.raises(ValueError):
        retrieval.usage_space(weights, points=4)


def test_near_keys(spark):
    vocabulary = spark.createDataFrame([("house",), ("mouse",), ("houses",), ("horse",), ("hat",), ("hut",), ("cat",)], "normalized string")
    words = spark.createDataFrame([("housse",), ("hit",)], "word string")
    assert rows(similar.near_keys(vocabulary, words)) == [("hit", "hat", 1), ("hit", "hut", 1), ("housse", "horse", 2), ("housse", "house", 1), ("housse", "houses", 2), ("housse", "mouse", 2)]


def test_shingle_pairs_against_brute_force(spark):
    texts = {"a": "the quick brown fox jumps", "b": "the quick brown fox jumped", "c": "something else entirely now", "d": "x"}
    df = spark.createDataFrame(list(texts.items()), "id string, text string")
    s = {k: {v[i : i + 5] for i in range(max(1, len(v) - 4))} for k, v in texts.items()}
    brute = sorted((a, b, len(s[a] & s[b])) for a in s for b in s if a < b and len(s[a] & s[b]) / len(s[a] | s[b]) >= 0.25 and min(len(texts[a]), len(texts[b])) >= 0.8 * max(len(texts[a]), len(texts[b])))
    assert [r[:3] for r in rows(similar.shingle_pairs(df))] == brute


def test_contained_sequences(spark):
    quotes = spark.createDataFrame([("q", ["b", "c"]), ("r", ["c", "b"])], "quote_id string, tokens array<string>")
    texts = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["b"]), (3, ["b", "c", "b", "c"])], "id int, tokens array<string>")
    assert rows(seq.contained_sequences(quotes, texts)) == [("q", 1, 1), ("q", 3, 0), ("q", 3, 2), ("r", 3, 1)]


def test_dictionary_claims(spark):
    entries = spark.createDataFrame(
        [("e1", "word", [("f1", ["Doric", "rare"]), ("f2", [])], [("gloss", ["Aeolic"], None), ("", [], "other")])],
        "id string, headword string, forms array<struct<form: string, tags: array<string>>>, senses array<struct<gloss: string, tags: array<string>, form_of: string>>",
    )
    out = graph.claims_of_entries(entries, ["Doric", "Aeolic"])
    assert rows(out.select("predicate", "value", "locator")) == [
        ("dialect_label", "Aeolic", "/senses/0"), ("dialect_label", "Doric", "/forms/0"), ("equivalent_form", "other", "/senses/1"),
        ("lemma", "word", "/word"), ("morphology", "f1,f2", "/forms"), ("sense_gloss", "gloss", "/senses/0"),
    ]


def test_snapshot_operators(spark):
    before = spark.createDataFrame([(1, "a", 1), (2, "b", None), (3, "c", 3)], "k int, x string, y int")
    after = spark.createDataFrame([(1, "a", 1), (2, "b", 5), (4, "d", 4)], "k int, x string, y int")
    assert rows(audit.snapshot_diff(before, after, "k")) == [(2, "changed", "y"), (3, "removed", ""), (4, "added", "")]
    assert audit.table_difference(before, before).count() == 0
    assert audit.upsert(before, after.where("k = 2"), "k").where("k = 2").first()["y"] == 5
    assert audit.table_fingerprint(before).first() == audit.table_fingerprint(before.repartition(3)).first()
    assert rows(graph.conflicts(before, "x", "k")) == []


def test_nearest_of_each_in_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    v = [(i, [float(x) for x in rng.normal(size=6).round(2)]) for i in range(90)] + [(90, v0 := [1.0] + [0.0] * 5), (91, v0), (92, v0)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    found = {(r["query_id"], r["rank"]): r["neighbour"] for r in retrieval.nearest_of_each(df, asked, 4, block=16).collect()}
    for q, x in v[::10]:
        scores = sorted((-round(float(np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y))), 6), i) for i, y in v if i != q)
        assert [found[(q, k + 1)] for k in range(4)] == [i for _, i in scores[:4]]


def test_near_duplicate_texts(spark):
    base = [f"word{i}" for i in range(100)]
    changed = [w if i % 10 else "x" for i, w in enumerate(base)]
    texts = {"a": " ".join(base), "b": " ".join(changed), "c": " ".join(base[::-1]), "d": "x " * 500, "e": "x " * 501}
    found = similar.near_duplicate_texts(spark.createDataFrame(list(texts.items()), "id string, text string")).collect()
    assert {(r["a"], r["b"]): r["ratio"] for r in found}[("a", "b")] == 0.9 and not any("c" in (r["a"], r["b"]) for r in found)
