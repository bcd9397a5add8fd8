"""Fusion within a scope, expansion with ceilings, alignments: hand-made rows."""

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from tessera.operators import alignment, expansion, fusion
from tessera.operators.fusion import Scope

RECORD = "id long, parent_id long, author_keys array<string>, language string, edition string, kind string, quality string, copy_key string, group_key string"


@pytest.fixture(scope="module")
def records(spark):
    rows = [
        (1, None, ["a"], "grc", "e1", "text", "source_text", "k1", "g1"), (2, None, ["b"], "grc", "e1", "text", "source_text", "k2", "g2"),
        (3, 1, ["m"], "eng", "t", "translation", "source_text", "k3", "g3"), (4, 2, ["m"], "eng", "t", "commentary", "source_text", "k4", "g4"),
        (5, None, ["a"], "grc", "e2", "text", "source_text", "k2", "g5"), (6, None, ["a"], "grc", "e1", "text", "machine_ocr", "k6", "g6"),
        (7, None, ["a", "b"], "grc", "e1", "text", None, "k7", "g7"), (8, 99, ["a"], "eng", "t", "translation", "source_text", "k8", "g8"), (9, None, ["a"], "grc", "e3", "text", "source_text", "k1", "g1"),
        (10, None, ["a"], "grc", "e1", "apparatus", "source_text", "k10", "g10"),
    ]
    return spark.createDataFrame(rows, RECORD)


def where(spark, records, scope, *ids):
    hits = spark.createDataFrame([("lexical", p, i) for p, i in enumerate(ids)], "signal string, position int, id long")
    return {r["id"]: (r["target_id"], r["scope"]) for r in fusion.targets(hits, records, scope).collect()}


def test_hits_stand_for_parents_themselves_or_copies(spark, records):
    assert where(spark, records, Scope(), *range(1, 12)) == {1: (1, "direct"), 2: (2, "direct"), 3: (1, "explicit_parent"), 4: (2, "explicit_parent"), 5: (5, "direct"), 7: (7, "direct"), 8: (8, "direct"), 9: (9, "direct")}
    assert where(spark, records, Scope(authors=("a",)), 1, 2, 3, 4, 7, 8) == {1: (1, "direct"), 2: (5, "copy_in_scope"), 3: (1, "explicit_parent"), 7: (7, "direct"), 8: (8, "direct")}
    assert where(spark, records, Scope(authors=("a",), language="eng"), 1, 3, 4, 8) == {3: (3, "author_of_parent"), 8: (8, "direct")}
    assert where(spark, records, Scope(edition="e2"), 1, 2, 5) == {2: (5, "copy_in_scope"), 5: (5, "direct")}
    assert where(spark, records, Scope(assisted=False), 1, 3) == {1: (1, "direct")}
    assert where(spark, records, Scope(include_reference=True), 6, 10) == {6: (6, "direct"), 10: (10, "direct")}


def test_a_group_has_one_vote_in_a_list(spark, records):
    rows = [("lexical", 1, 3), ("lexical", 2, 1), ("lexical", 3, 2), ("semantic", 1, 4), ("semantic", 2, 9), ("own", 1, 9), ("lexical", 4, 77)]
    hits = spark.createDataFrame(rows, "signal string, position int, id long")
    found = {r["group_key"]: r for r in fusion.fuse(hits, records, Scope(), {"own": 0.5}).collect()}
    assert found["g1"]["score"] == round(1 / 61 + 1 / 62 + 0.5 / 61, 8) and found["g2"]["score"] == round(1 / 62 + 1 / 61, 8)
    assert found["g1"]["ranks"] == {"lexical": 1, "semantic": 2, "own": 1} and found["g1"]["id"] == 1 and found["g1"]["copies"] == [1, 9]
    assert [tuple(e) for e in found["g1"]["evidence"]] == [("lexical", 1, "direct"), ("lexical", 3, "explicit_parent"), ("own", 9, "direct"), ("semantic", 9, "direct")]
    assert found["g2"]["reason"] == "lexical + semantic; linked evidence"
    assert fusion.fuse(hits.where("false"), records).count() == 0


@pytest.fixture(scope="module")
def lexicon(spark):
    forms = [("Ran", "run", "s1"), ("runs", "run", "s1"), ("saw", "see", "s1"), ("saw", "saw", "s2"), ("seen", "see", "s1"), ("ran", "run", "s2")]
    return {
        "forms": spark.createDataFrame(forms, "form string, lemma string, source string"), "entries": spark.createDataFrame([("see",)], "lemma string"),
        "listed": spark.createDataFrame([("run", "running", "d"), ("see", "see over", "d")], "lemma string, form string, source string"), "equivalents": spark.createDataFrame([("ran", "rann", "e")], "form string, other string, source string"),
    }


def test_expansion(spark, lexicon):
    keys = spark.createDataFrame([(0, "ran"), (1, "saw"), (2, "see")], "query_index int, key string")
    found = {(r["query_index"], r["key"]): (r["refs_total"], [x["kind"] for x in r["refs"]]) for r in expansion.alternatives(keys, **lexicon).collect()}
    assert found == {
        (0, "ran"): (3, ["attested", "attested", "literal"]), (0, "runs"): (1, ["attested"]), (0, "running"): (1, ["dictionary"]), (0, "rann"): (1, ["equivalent"]),
        (1, "saw"): (1, ["literal"]),  # two lemmas and no headword: no expansion
        (2, "see"): (1, ["literal"]), (2, "seen"): (1, ["attested"]),  # "saw" is ambiguous, "see over" two words
    }


def test_expansion_refuses(spark, lexicon):
    keys = spark.createDataFrame([(0, "ran"), (1, "see")], "query_index int, key string")
    for most, in_all in ((3, 100), (100, 5)):
        with pytest.raises(SparkRuntimeException, match="refused"):
            expansion.alternatives(keys, **lexicon, most_keys=most, most_in_all=in_all).collect()
    many = lexicon | {"listed": spark.createDataFrame([("run", "ran", f"d{i}") for i in range(20)], "lemma string, form string, source string")}
    told = {r["key"]: r for r in expansion.alternatives(keys, **many).collect()}
    assert len(told["ran"]["refs"]) == 8 and told["ran"]["refs_total"] == 23


def test_searches_by_forms(spark, lexicon):
    keys = spark.createDataFrame([(0, "ran"), (1, "see")], "query_index int, key string")
    tokens = spark.createDataFrame([(1, "runs", 2), (1, "seen", 1), (2, "rann", 1), (3, "saw", 4)], "id int, normalized string, count int")
    expanded = expansion.alternatives(keys, **lexicon)
    assert sorted(map(tuple, expansion.forms_search(tokens, expanded).collect())) == [(1, 2, 3), (2, 1, 1)]
    assert [tuple(r) for r in expansion.all_forms_search(tokens, expanded).collect()] == [(1, 3)]


def test_spans_are_of_the_source(spark):
    text = "Étè, été — ļa \U0001f600 fin.  "
    rows = alignment.word_spans(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")).collect()
    assert [r["form"] for r in rows] == ["Étè", "été", "ļa", "fin"]
    assert all(text[r["start"] : r["end"]] == r["form"] for r in rows)


def test_forms_are_linked_to_one_word_only(spark):
    spans = alignment.word_spans(spark.createDataFrame([(1, "Été ete hiver hiver Noël"), (2, "noel")], "id int, text string"))
    asked = [(1, 1, "été"), (2, 1, "ETE"), (3, 1, "éte"), (4, 1, "hiver"), (5, 1, "noel"), (6, 1, "rien"), (7, 2, "noel"), (8, 9, "noel")]
    found = {r["request_id"]: (r["status"], r["start"], r["token"]) for r in alignment.align_forms(spark.createDataFrame(asked, "request_id int, id int, form string"), spans).collect()}
    assert found == {1: ("exact", 0, "Été"), 2: ("exact", 4, "ete"), 3: ("ambiguous", None, None), 4: ("ambiguous", None, None), 5: ("folded", 20, "Noël"), 6: ("none", None, None), 7: ("exact", 0, "noel"), 8: ("none", None, None)}


def test_parallel_contexts(spark):
    text = "One two three four five six seven eight nine one"
    rows = [(1, "A", True, text), (2, "a", True, text.replace(" ", ", ") + "!"), (3, "b", True, text), (4, "a", False, text), (5, "a", True, text.lower()), (6, "a", True, "too short"), (7, "a", True, text), (8, None, True, text), (9, "a", True, None)]
    records = spark.createDataFrame(rows, "id int, author string, usable boolean, text string")
    asked = spark.createDataFrame([(1, "SIX"), (2, "one"), (3, "six"), (6, "too"), (7, "nine")], "id int, form string")
    found = {r["id"]: (r["matches"], r["match_ids"], r["token_index"], r["window"]) for r in alignment.parallel_contexts(asked, records).collect()}
    assert found == {1: (2, [2, 7], 5, "two three four five six seven eight nine one"), 7: (2, [1, 2], 8, "five six seven eight nine one")}
    assert alignment.parallel_contexts(asked, records, listed=1).where("id = 1").first()["match_ids"] == [2]


def test_boundary_proofs(spark):
    line = lambda *labels: [(x, f"text {x}") for x in labels]
    schema = "array<struct<label: string, text: string>>"
    sources = spark.createDataFrame([("s", line("1", "2", "3", "4")), ("t", [(a, b.upper()) for a, b in line("1", "2", "3", "5")]), ("u", line("1", "1", "1")), ("v", line("1", "2")), ("w", line("x", "y"))], f"source_id string, sequence {schema}")
    up = [(a, b.upper()) for a, b in line("1", "2", "3")]
    records = [("s12", "s", line("1", "2")), ("t12", "t", up[:2]), ("s3", "s", line("3")), ("t3", "t", up[2:]), ("u1", "u", line("1")), ("u111", "u", line("1", "1", "1")), ("v", "v", line("1", "2")), ("w", "w", line("x", "y")), ("lost", "s", line("9")), ("none", "s", [])]
    spans = alignment.source_spans(spark.createDataFrame(records, f"record_id string, source_id string, lines {schema}"), sources)
    assert {r["record_id"]: (r["start"], r["end"], r["next_anchor"], r["at_end"]) for r in spans.collect()} == {
        "s12": (0, 2, "3", False), "t12": (0, 2, "3", False), "s3": (2, 3, "4", False), "t3": (2, 3, "5", False), "u111": (0, 3, None, True), "v": (0, 2, None, True), "w": (0, 2, None, True),
    }
    readings = spark.createDataFrame([("s", 2), ("t", 2), ("u", 2), ("v", 1), ("w", 1)], "source_id string, readings int")
    pairs = spark.createDataFrame([("s12", "t12"), ("s3", "t3"), ("v", "w"), ("u111", "u111"), ("s12", "v")], "parent_id string, translation_id string")
    assert {(r["parent_id"], r["translation_id"], r["method"]) for r in alignment.boundary_proofs(pairs, spans, readings).collect()} == {("s12", "t12", "same_anchors_and_successor"), ("v", "w", "whole_sources")}
