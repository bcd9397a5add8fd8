"""Search in one call, citations, patched tables and zipped files on hand-made rows."""

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from tessera.operators import audit, lexical, references, search
from tessera.operators.fusion import Scope

DOCS = [
    (1, "x", "grc", "source_text", "Work 1", "the red house by the sea", "k1"), (2, "y", "grc", "source_text", "Work 2", "the  red\nhouse by the sea", "k1"), (3, "x", "eng", "source_text", "Work 3", "house red", "k3"),
    (4, "x", "grc", "mixed_content", "Work 4", "a red house", "k4"), (5, "z", "grc", "source_text", "Red house 5", "nothing of it", None), (6, "z", "grc", "source_text", "Work 6", "a horse and a mouse", "k6"),
]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, [a], lang, "", "text", q, c, t, k) for i, a, lang, q, c, t, k in DOCS]
    records = spark.createDataFrame(rows, "id long, author_keys array<string>, language string, edition string, kind string, quality string, citation string, text string, copy_key string").cache()
    tokens = lexical.token_table(records, "id").cache()
    return tokens, lexical.vocabulary(tokens).cache(), records


def told(corpus, query, scope=None, page=None):
    return [(r["id"], r["stage"], r["copies"], r["total"], r["hidden"]) for r in search.search(*corpus, query, scope, page).collect()]


def test_stages_of_a_search(corpus):
    assert told(corpus, "Red  house") == [(1, "exact", 2, 2, 1), (5, "exact", 1, 2, 1)]
    assert told(corpus, "red house", Scope(authors=("y",))) == [(2, "exact", 1, 1, 4 - 1)]
    assert told(corpus, "housse") == [(6, "spelling", 1, 3, 0), (1, "spelling", 2, 3, 0), (3, "spelling", 1, 3, 0)]  # "horse" and "mouse" are two letters away
    assert {(i, s) for i, s, *_ in told(corpus, "sea mouse")} == {(1, "words"), (6, "words")}
    assert told(corpus, "red house", Scope(language="lat")) == [] == told(corpus, "123 ..") == told(corpus, "")
    assert [x[0] for x in told(corpus, "red house", page=search.Page(1, 5))] == [5]


def test_near_spellings_are_few_and_ordered(spark):
    vocabulary = spark.createDataFrame([(f"word{c}",) for c in "abcdefghijk"] + [("ward",), ("word",)], "normalized string")
    assert [tuple(r) for r in search.near_spellings(vocabulary, "word").collect()] == [("word", 0), ("ward", 1), *[(f"word{c}", 1) for c in "abcdef"]]


@pytest.mark.parametrize(
    ("citation", "collection", "expected"),
    [
        ("fr. 31", False, [("31", "")]), ("Fragment 31a LP", False, [("31a", "lp")]), ("Voigt fr. 5", False, [("5", "voigt")]), ("frag. 31-33", False, []), ("fr. 31.4", False, []), ("fr 3 – 4, fr. 9", False, [("9", "")]),
        ("Page 12", False, [("12", "page")]), ("17", True, [("17", "")]), ("17", False, []), ("17 West", True, [("17", "west")]), ("no number", True, []), ("frieze 12", False, []), ("", True, []), (None, None, None),
    ],
)
def test_references_of_citations(spark, citation, collection, expected):
    found = spark.createDataFrame([(citation, collection)], "c string, k boolean").select(references.references(F.col("c"), F.col("k"))).first()[0]
    assert (None if found is None else [(r["number"], r["scheme"]) for r in found]) == expected


def test_cited_records(spark):
    schema = "id long, parent_id long, author string, language string, kind string, quality string, citation string, collection boolean, extracted boolean, partial boolean, section boolean"
    rows = [
        (1, None, "Poet", "grc", "text", "source_text", "fr. 7 LP", False, None, None, None), (2, 1, "Scholar", "eng", "translation", "source_text", "fr. 7", False, None, None, None), (3, None, "poet", "grc", "text", "needs_review", "fr. 7", False, None, None, None),
        (4, None, "Poet", "grc", "reference", "source_text", "7", True, None, None, None), (5, 3, "Scholar", "eng", "commentary", "source_text", "fr. 7", False, None, None, None), (6, None, "Poet", "grc", "text", "source_text", "fr. 7, Page 7", False, True, True, None), (7, None, "Poet", "grc", "text", "source_text", "fr. 7-9", False, None, None, None),
    ]
    records = spark.createDataFrame(rows, schema)
    asked = spark.createDataFrame([(1, "POET", "7", None), (2, "poet", "7", "Page"), (3, "Scholar", "7", ""), (4, "poet", "8", "")], "query_id int, author string, number string, scheme string")
    found = {(r["query_id"], r["id"]): (r["coverage"], r["by_parent"], r["refs"]) for r in references.cited_records(records, asked).collect()}
    assert found == {
        (1, 1): ("text", False, "7 lp"), (1, 2): ("translation", True, "7"), (1, 3): ("needs_review", False, "7"), (1, 4): ("reference_only", False, "7"), (1, 6): ("partial_text", False, "7,7 page"),
        (2, 6): ("partial_text", False, "7 page"), (3, 2): ("translation", False, "7"), (3, 5): ("commentary", False, "7"),
    }


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_patched_tables_are_those_made_anew(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    old, news = docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 = 0")
    before = lexical.token_table(old)
    tokens, vocabulary = audit.patched(before, lexical.vocabulary(before), lexical.token_table(news))
    whole = lexical.token_table(docs)
    assert same(tokens.select(*whole.columns), whole) and same(vocabulary.select("normalized", "form", "count"), lexical.vocabulary(whole).select("normalized", "form", "count"))
    key = ["source", "lang"]
    works, placed = audit.appended_works(old.groupBy(*key).agg(F.count(F.lit(1)).alias("count")), news.select("doc_id", *key), key, ["doc_id"])
    assert same(works.select(*key, "count"), docs.groupBy(*key).agg(F.count(F.lit(1)).alias("count")))
    all_places = lexical.with_sequence(old.select("doc_id", *key), key, ["doc_id"]).unionByName(placed)
    gaps = all_places.groupBy(*key).agg((F.max("sequence") + 1).alias("most"), F.count(F.lit(1)).alias("n"), F.countDistinct("sequence").alias("different")).where("most <> n or n <> different")
    assert gaps.count() == 0


def test_ordinals_and_zipped_tables(spark):
    rows = spark.range(0, 1000, numPartitions=7).select(((F.col("id") * 7919) % 1000).alias("k"))
    numbered = audit.with_ordinals(rows, ["k"])
    assert numbered.where("k <> ordinal").count() == 0 and numbered.count() == 1000
    both = audit.zipped(numbered, audit.with_ordinals(rows.select((-F.col("k")).alias("j")), ["j"]))
    assert both.where("left.k - right.j <> 999").count() == 0
    with pytest.raises(SparkRuntimeException, match="different lengths"):
        audit.zipped(numbered, audit.with_ordinals(rows.where("k < 999"), ["k"])).collect()
    assert audit.with_ordinals(rows.where("false"), ["k"]).count() == 0
