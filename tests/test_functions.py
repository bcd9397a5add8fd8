"""Scalar functions on hand-made rows."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import query as q
from tessera.functions import text as t


def test_folds_of_strings():
    assert q.fold("Ἔρως ῥόδων ς ϲ") == "ερωσ ροδων σ σ"
    assert q.query_variants("QEO/S")[0] == "θεοσ"
    assert q.query_variants("theos")[0] == "θεοσ"
    assert q.query_terms("a)/peira di/ktua") == ["a)/peira", "di/ktua"]


def test_folds_of_columns(spark):
    df = spark.createDataFrame([("Ἔρως, ῥόδων ς ϲ",), ("Été—d’or",), (None,)], "s string")
    rows = df.select(t.fold_search(F.col("s")).alias("a"), t.fold_lexicon(F.col("s")).alias("b"), t.fold_author(F.col("s")).alias("c")).collect()
    assert (rows[0].a, rows[0].b) == ("ερωσ, ροδων σ σ", "ερωσ ροδων σ σ")
    assert (rows[1].a, rows[1].b) == ("ete—d'or", "ete d'or")
    assert rows[2].a is None and rows[2].b is None


@pytest.mark.parametrize(
    ("text", "joined"),
    [("αβ-\nγδ-\nεζ", "αβγδεζ"), ("[α] βγ-\nδε [ζ]", "[α] βγδε [ζ]"), ("[αβ-\nγδ] εζ-\nηθ", "[αβ-\nγδ] εζηθ"), ("αβ-\nγδ…", "αβ-\nγδ…"), ("αβ-\nlatin", "αβ-\nlatin"), ("plain text", "plain text")],
)
def test_divided_words(text, joined):
    assert q.join_divided_words(text) == joined


def test_tags_and_references():
    assert q.describe_tag("v3sria---") == "verb · third person · singular · perfect · indicative · active"
    assert q.describe_tag("n-s---fl-") == "noun · singular · feminine · locative"
    assert q.describe_tag("t-spppmn-") == "participle · singular · present · passive · masculine · nominative"
    assert [q.describe_tag(x) for x in ("v3szia---", "v3s", None, "---------")] == [None] * 4
    assert q.parse_reference("Someone fr. 31a LP") == {"author": "Someone", "number": 31, "letter": "a", "scheme": "LP"}
    assert q.parse_reference("no number here") is None
    assert q.vowel_alternatives("λεγω") == ["λεγω", "ληγω", "λεγο"]


def test_keys_are_byte_exact(spark):
    parts = ["so\"urce", "an author", "work", "ed", "grc"]
    df = spark.createDataFrame([(*parts, "a  b\n c ")], "source string, author string, work string, edition string, language string, text string")
    row = df.select(t.work_id(*[F.col(c) for c in df.columns[:5]]).alias("w"), t.text_key(F.col("language"), F.lit("text"), F.col("text")).alias("k"), t.split_bucket(F.col("author")).alias("b")).first()
    assert row.w == hashlib.sha256(json.dumps(parts, ensure_ascii=False).encode()).hexdigest()[:20]
    assert row.k == hashlib.sha1("\x1f".join(["grc", "text", "a b c"]).encode()).hexdigest()[:24]
    assert row.b == int(hashlib.sha1(b"an author").hexdigest(), 16) % 100


def test_phrase_pattern(spark):
    df = spark.createDataFrame([("one of\nthe many",), ("prof the x",), ("of them",), ("of the",)], "s string")
    assert [r[0] for r in df.select(F.col("s").rlike(t.phrase_pattern("of the"))).collect()] == [True, False, False, True]


def test_cosine_and_trigrams(spark):
    row = spark.range(1).select(
        t.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("c"), t.trigrams(F.lit("abc")).alias("g"), t.shingles(F.lit("abcab"), 2).alias("s"), t.tokens(F.lit("l'eau d’or_x 9a")).alias("w")
    ).first()
    assert round(row.c, 6) == 0.707107 and row.g == ["^ab", "abc", "bc$"] and row.s == ["ab", "bc", "ca"]
    assert row.w == ["l'eau", "d’or", "x", "a"]


def test_scripts():
    assert q.from_beta("qeo/s7ei)mi") == "θεοσ ειμι" and q.from_beta("a.b") == "α β"
    assert q.from_roman("theos") == "θεοσ" and q.from_roman("psychē vita") == "ψυχη βιτα" and q.from_roman("a-b") == "α β"


@pytest.mark.parametrize(
    ("text", "masked"),
    [("a [b] c", "  ###  "), ("a b] c", "####  "), ("one\ntwo] x", "    ####  "), ("a [b\nc", "  ## "[:4] + "  "), ("⸢a⸣ ‹b", "### ##"), ("(a) b", "     ")],
)
def test_brackets(text, masked):
    assert "".join("#" if m else " " for m in q.editorial_mask(text)) == masked
