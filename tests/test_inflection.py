"""Analyses of word forms on a small lexicon, worked out by hand."""

from __future__ import annotations

import pytest

from tessera.operators import inflection

FORMS = "form string, key string, lemma string, lemma_key string, marker string, analysis string, source string"
ENTRIES = "entry_id string, lemma string, key string, source string, gloss string"


@pytest.fixture(scope="module")
def lexicon(spark):
    forms = [
        ("leaves", "leaves", "leaf", "leaf", None, "noun-pl", "a"),
        ("leaves", "leaves", "leaf", "leaf", "1", "noun-pl", "b"),
        ("Leaves", "leaves", "leave", "leave", None, "verb-3sg", "a"),
        ("leaves", "leaves", "leave", "leave", "1", "verb-3sg", "b"),
        ("leaves", "leaves", "leave", "leave", "2", "verb-3sg", "c"),
        ("walked", "walked", "walk", "walk", None, "verb-past", "a"),
    ]
    entries = [("x1", "leaf", "leaf", "x", "of a tree"), ("x2", "Leaf", "leaf", "x", "a name"), ("y1", "leave", "leave", "y", "go"), ("y2", "leave", "leave", "y", "permission"), ("y3", "Walk", "walk", "y", "go on foot")]
    return spark.createDataFrame(forms, FORMS).repartition(3), spark.createDataFrame(entries, ENTRIES).repartition(2)


def _asked(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id string, word string, key string, variant int")


def _run(spark, lexicon, asked, contexts=(), occurrences=(), **options):
    contexts = spark.createDataFrame(list(contexts), "query_id string, passage_id long, author_id string")
    occurrences = spark.createDataFrame(list(occurrences), "key string, lemma_key string, analysis string, passage_id long, author_id string")
    rows = inflection.analyses(asked, *lexicon, inflection.supports(asked, contexts, occurrences), **options).collect()
    return sorted(rows, key=lambda r: (r["query_id"], r["rank"]))


def test_groups_markers_and_glosses(spark, lexicon):
    rows = _run(spark, lexicon, _asked(spark, ("q", "leaves", "leaves", 0)))
    # the unmarked row of leaf takes the one marker of its analysis; leave has two, so its unmarked row stays by itself
    assert [(r["lemma"], r["marker"], r["n_sources"], r["gloss"], r["matched_form"]) for r in rows] == [
        ("leaf", "1", 2, "of a tree", "leaves"), ("leave", "1", 1, None, "leaves"), ("leave", "2", 1, None, "leaves"), ("leave", None, 1, None, "Leaves")]
    assert rows[0]["reason"] == "the very form" and rows[3]["reason"] == "form of the same letters"


def test_support_goes_before_spelling(spark, lexicon):
    asked = _asked(spark, ("q", "leaves", "leaves", 0), ("r", "leaves", "leaves", 0))
    rows = _run(spark, lexicon, asked, [("q", 7, "h"), ("r", None, "h")], [("leaves", "leave", "verb-3sg", 7, "h"), ("leaves", None, "verb-3sg", 7, "h")], limit=1)
    assert [(r["query_id"], r["lemma"], r["reason"]) for r in rows] == [("q", "leave", "the very form; annotated in the passage"), ("r", "leave", "the very form; annotated in the author's texts")]


def test_near_and_other_spellings_only_where_needed(spark, lexicon):
    asked = _asked(spark, ("n", "walkd", "walkd", 0), ("v", "vvalked", "vvalked", 0), ("v", "vvalked", "walked", 1), ("z", "zzzzzz", "zzzzzz", 0))
    rows = _run(spark, lexicon, asked)
    found = {(r["query_id"], r["kind"]): (r["lemma"], r["distance"], r["reason"], r["gloss"]) for r in rows}
    assert found == {
        ("n", "form"): ("walk", 1, "near spelling, distance 1", "go on foot"),
        ("n", "lemma"): ("Walk", 1, "near spelling, distance 1", "go on foot"),
        ("v", "form"): ("walk", 0, "another spelling of the word", "go on foot"),
    }


def test_empty_tables(spark, lexicon):
    assert _run(spark, lexicon, _asked(spark)) == []
    nothing = (spark.createDataFrame([], FORMS), spark.createDataFrame([], ENTRIES))
    assert _run(spark, nothing, _asked(spark, ("q", "leaves", "leaves", 0))) == []
