"""Close spellings against difflib itself."""

from __future__ import annotations

import difflib
import random

import pytest

from tessera.operators import similar
from tessera.plans import text


@pytest.mark.parametrize("count", [4, 900])
def test_close_matches_against_difflib(spark, count):
    rng = random.Random(count)
    asked = ["question", "of", "été", "abcabcab", "a", "internationalisation"]
    keys = {"ouestion", "question", "questions", "fo", "of", "off", "ete", "étés", "bcabcabc", "b", "internationalization"}
    keys |= {"".join(rng.choices("questionabcé", k=rng.randrange(1, 11))) for _ in range(count)}
    found = similar.close_matches(spark.createDataFrame([(k,) for k in keys], "normalized string").repartition(3), spark.createDataFrame([(w,) for w in asked], "word string"))
    got = {w: [] for w in asked}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got[r["word"]].append(r["normalized"])
    assert got == {w: difflib.get_close_matches(w, [k for k in keys if k != w and abs(len(k) - len(w)) <= 2], n=8, cutoff=0.72) for w in asked}


def test_difflib_neighbours_asks_every_word_of_every_form(spark, tmp_path):
    rows = spark.createDataFrame([(1, "once: ouestion thes", "en", "s", 19)], "doc_id long, text string, lang string, source string, n_chars long")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "the question")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {(r["word"], r["normalized"]) for r in text.difflib_neighbours(spark, str(tmp_path)).collect()} == {("the", "thes"), ("question", "ouestion")}
