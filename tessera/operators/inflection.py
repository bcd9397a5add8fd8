"""Word forms analysed: candidate lemmas with what speaks for each, best first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.similar import near_keys
from tessera.sources.stored import materialized


def matched_keys(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(query_id, key, variant) against (key) to (query_id, key, distance, variant).

    Spellings of a word stand for themselves; only where none of them is known,
    near spellings of known keys do, each at its least distance, then variant.
    """
    direct = asked.groupBy("query_id", "key").agg(F.min("variant").alias("variant")).join(known.select("key").distinct(), "key", "left_semi")
    rest = asked.join(direct.select("query_id").distinct(), "query_id", "left_anti")
    near = near_keys(known.select(F.col("key").alias("normalized")).distinct(), rest.select(F.col("key").alias("word")).distinct())
    met = rest.join(near, rest["key"] == near["word"]).groupBy("query_id", F.col("normalized").alias("key")).agg(F.min(F.struct("distance", "variant")).alias("_best"))
    return direct.select("query_id", "key", F.lit(0).alias("distance"), "variant").unionByName(met.select("query_id", "key", "_best.distance", "_best.variant"))


def glosses(lemmas: DataFrame, entries: DataFrame) -> DataFrame:
    """(lemma, lemma_key) to (lemma, lemma_key, gloss, n_entries): entries spelled like the lemma, else all with its key.

    Where a source has two of these entries, none is chosen; otherwise the first
    by source and identifier gives the gloss.  Lemmas without entries are left out.
    """
    hits = lemmas.distinct().join(entries.select(F.col("lemma").alias("_head"), F.col("key").alias("lemma_key"), "entry_id", "source", "gloss"), "lemma_key")
    exact = hits.withColumn("exact", F.col("_head") == F.col("lemma"))
    sources = exact.groupBy("lemma", "lemma_key", "exact", "source").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("source", "entry_id", "gloss")).alias("first"))
    sides = sources.groupBy("lemma", "lemma_key", "exact").agg(F.sum("n").alias("n_entries"), F.max("n").alias("most"), F.min("first").alias("first"))
    side = sides.groupBy("lemma", "lemma_key").agg(F.max(F.struct("exact", "n_entries", "most", "first")).alias("s"))
    return side.select("lemma", "lemma_key", F.when(F.col("s.most") == 1, F.col("s.first.gloss")).alias("gloss"), F.col("s.n_entries").alias("n_entries"))


def supports(asked: DataFrame, contexts: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(query_id, lemma_key, analysis, in_passage, same_author) of annotated occurrences of a word's first spelling.

    ``contexts`` (query_id, passage_id, author_id); ``occurrences`` (key,
    lemma_key, analysis, passage_id, author_id).  Unknown passages and authors
    support nothing.
    """
    own = asked.where("variant = 0").select("query_id", "key").join(contexts.toDF("query_id", "_passage", "_author"), "query_id")
    met = own.join(occurrences.where("lemma_key is not null and analysis is not null"), "key")
    found = met.groupBy("query_id", "lemma_key", "analysis").agg(F.max(F.col("passage_id") == F.col("_passage")).alias("in_passage"), F.max(F.col("author_id") == F.col("_author")).alias("same_author"))
    return found.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("in_passage", "same_author")}).where("in_passage or same_author")


def analyses(asked: DataFrame, forms: DataFrame, entries: DataFrame, support: DataFrame, limit: int = 12) -> DataFrame:
    """The candidates of each word, at most ``limit``: query_id, rank, kind, lemma, marker, analysis, entry_id, matched_form, distance, gloss, reason, n_sources, n_forms.

    ``asked`` (query_id, word, key, variant): the spellings of each word, the
    first as variant 0.  ``forms`` (form, key, lemma, lemma_key, marker, analysis,
    source): ``marker`` is the number that tells homographs apart, or null; a row
    without one takes that of the other rows of its lemma and analysis if these
    have a single one.  ``entries`` (entry_id, lemma, key, source, gloss).
    Order: distance, support of the passage, of the author, the very spelling,
    variant, forms before headwords, lemma, analysis, source.  Rows of one lemma,
    marker and analysis (or entry) are one candidate, with its sources and
    matched forms counted.  Words that nothing matches have no rows.
    """
    # read three times, and dear: near spellings are among them
    matches = materialized(matched_keys(asked.select("query_id", "key", "variant"), forms.select("key").unionByName(entries.select("key"))), "matches")
    same = Window.partitionBy("query_id", "lemma", "analysis")
    by_form = matches.join(forms, "key").withColumns({"_low": F.min("marker").over(same), "_high": F.max("marker").over(same)})
    one = F.when(F.col("_low") == F.col("_high"), F.col("_low"))
    told = glosses(forms.join(matches.select("key").distinct(), "key", "left_semi").select("lemma", "lemma_key"), entries)
    by_form = by_form.withColumns({"marker": F.coalesce("marker", one), "kind": F.lit("form"), "entry_id": F.lit(None).cast("string")}).join(told.select("lemma", "lemma_key", "gloss"), ["lemma", "lemma_key"], "left")
    by_head = matches.join(entries, "key").withColumns({"kind": F.lit("lemma"), "form": F.col("lemma"), "lemma_key": F.col("key"), "marker": F.lit(None).cast("string"), "analysis": F.lit(None).cast("string")})
    columns = ["query_id", "key", "distance", "variant", "kind", "lemma", "lemma_key", "marker", "analysis", "entry_id", "form", "gloss", "source"]
    rows = by_form.select(*columns).unionByName(by_head.select(*columns)).join(support, ["query_id", "lemma_key", "analysis"], "left")
    rows = rows.join(asked.where("variant = 0").select("query_id", "word"), "query_id")
    form = F.col("kind") == "form"
    exact, passage, author = F.col("form") == F.col("word"), F.coalesce("in_passage", F.lit(False)), F.coalesce("same_author", F.lit(False))
    why = (
        F.when(F.col("distance") > 0, F.concat(F.lit("near spelling, distance "), F.col("distance").cast("string")))
        .when(F.col("variant") > 0, "another spelling of the word")
        .when(exact, F.when(form, "the very form").otherwise("the very headword"))
        .otherwise(F.when(form, "form of the same letters").otherwise("headword of the same letters"))
    )
    reason = F.concat_ws("; ", why, F.when(passage, "annotated in the passage").when(author, "annotated in the author's texts"))
    order = F.struct("distance", (~passage).alias("p"), (~author).alias("a"), (~exact).alias("e"), "variant", (~form).alias("k"), "lemma", "analysis", "source", "entry_id", F.col("form").alias("matched_form"), "gloss", reason.alias("reason"))
    groups = rows.withColumn("_order", order).groupBy("query_id", "kind", "lemma", "marker", "analysis", "entry_id").agg(F.min("_order").alias("o"), F.countDistinct("source").alias("n_sources"), F.countDistinct("form").alias("n_forms"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("o", F.col("marker").asc_nulls_first()))
    kept = groups.withColumn("rank", rank).where(F.col("rank") <= limit)
    return kept.select("query_id", F.col("rank").cast("long").alias("rank"), "kind", "lemma", "marker", "analysis", "entry_id", "o.matched_form", F.col("o.distance").cast("long").alias("distance"), "o.gloss", "o.reason", "n_sources", "n_forms")
