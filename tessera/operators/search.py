"""Search as one call: scope, stages that stand in for each other, copies shown once, totals, pages.

The first stage that finds anything in scope answers: the words in order (in
texts or citations), near spellings of a single word, then any of the words by
how many are there and BM25.  All stages are part of one plan, so nothing runs
while it is built.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import phrase_pattern
from tessera.operators import lexical
from tessera.operators.fusion import Scope, eligible

#: How many near spellings are tried, and how long a word has to be for two letters to differ.
NEAREST, LONG_WORD = 8, 6
STAGES = ("exact", "spelling", "words")


@dataclass(frozen=True)
class Page:
    offset: int = 0
    limit: int = 30


def near_spellings(vocabulary: DataFrame, word: str, most: int = NEAREST) -> DataFrame:
    """(key, distance): the nearest keys of (normalized) to one word; ties in code-point order."""
    cutoff = 2 if len(word) >= LONG_WORD else 1
    near = vocabulary.where(F.length("normalized").between(len(word) - cutoff, len(word) + cutoff)).withColumn("distance", F.levenshtein("normalized", F.lit(word), cutoff))
    return near.where("distance >= 0").select(F.col("normalized").alias("key"), "distance").distinct().orderBy("distance", "key").limit(most)


def exact_matches(tokens: DataFrame, records: DataFrame, words: list[str]) -> DataFrame:
    """Identifiers of records whose text or citation has the words in order.

    In two phases: the index names texts that hold every word; only these are
    read and matched.  Citations are short, and matched all.
    """
    pattern = phrase_pattern(" ".join(words))
    held = tokens.where(F.col("normalized").isin(*words)).groupBy("id").agg(F.countDistinct("normalized").alias("_n")).where(F.col("_n") == len(set(words))).select("id")
    in_text = records.join(held, "id", "left_semi").where(F.lower("text").rlike(pattern)).select("id")
    return in_text.union(records.where(F.lower("citation").rlike(pattern)).select("id")).distinct()


def search(tokens: DataFrame, vocabulary: DataFrame, records: DataFrame, query: str, scope: Scope | None = None, page: Page | None = None, preference: Column | None = None) -> DataFrame:
    """A page of groups: id, stage, matched, score, copies, total (groups), hidden (exact matches that the scope's quality gate leaves out).

    ``records``: id, author_keys, language, edition, kind, quality, citation,
    text, copy_key (equal for copies; null: none).  ``tokens`` and
    ``vocabulary`` as stored.  Of copies the most preferred is shown (smallest
    ``preference``, then id).  A query without words finds nothing.
    """
    scope, page = scope or Scope(), page or Page()
    words = [w for w in query.lower().split() if any(c.isalpha() for c in w)]
    narrow = records.select("id", F.coalesce("copy_key", F.concat(F.lit("id:"), F.col("id").cast("string"))).alias("copy_key"), eligible(scope).alias("_in"), (F.lit(0) if preference is None else preference).alias("_pref"))
    inside = narrow.where("_in").drop("_in")
    exact = exact_matches(tokens, records, words) if words else records.select("id").limit(0)
    found = exact.select("id", F.lit(0).alias("stage"), F.lit(len(words)).cast("long").alias("matched"), F.lit(None).cast("double").alias("score"))
    if len(words) == 1:
        keys = near_spellings(vocabulary, words[0])
        close = tokens.join(F.broadcast(keys), F.col("normalized") == F.col("key")).groupBy("id").agg(F.countDistinct("key").alias("matched"), F.min("distance").cast("double").alias("score"))  # at most NEAREST keys
        found = found.unionByName(close.select("id", F.lit(1).alias("stage"), "matched", -F.col("score")).toDF(*found.columns))
    if len(words) > 1:
        found = found.unionByName(lexical.bm25(tokens, words).select("id", F.lit(2).alias("stage"), F.col("covered").alias("matched"), "score"))
    scoped = found.join(inside, "id")
    first = scoped.agg(F.min("stage").alias("_first"))
    answers = scoped.join(F.broadcast(first), F.col("stage") == F.col("_first")).drop("_first")  # one row
    best = F.row_number().over(Window.partitionBy("copy_key").orderBy("_pref", F.desc("matched"), F.desc("score"), "id"))
    shown = answers.withColumn("_k", best).where("_k = 1").select("id", "stage", "copy_key")
    groups = answers.groupBy(F.col("copy_key").alias("_key")).agg(F.count(F.lit(1)).alias("copies"), F.max("matched").alias("matched"), F.max("score").alias("score"))
    rows = shown.join(groups, F.col("copy_key") == F.col("_key"))
    totals = groups.agg(F.count(F.lit(1)).alias("total"))
    hidden = exact.join(narrow.where("not _in").select("id"), "id", "left_semi").agg(F.count(F.lit(1)).alias("hidden"))
    told = F.element_at(F.array(*map(F.lit, STAGES)), F.col("stage") + 1)
    ordered = lexical.page(rows, [F.desc("matched"), F.desc_nulls_last("score"), F.col("id")], page.offset, page.limit)
    return ordered.crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(hidden)).select("id", told.alias("stage"), "matched", "score", "copies", "total", "hidden")  # one row each
