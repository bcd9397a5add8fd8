"""Query words expanded to the forms that sources list for them, each with where it comes from.

Ceilings refuse a search; nothing is left out silently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most keys of a word, of a query, and references that are told of a key.
MOST_KEYS, MOST_IN_ALL, MOST_REFERENCES = 2000, 20_000, 8
_REF = ("kind", "form", "lemma", "source")


def lemmas_of(keys: DataFrame, forms: DataFrame, entries: DataFrame) -> DataFrame:
    """(query_index, lemma): headwords that are the word itself; where there is none, the one lemma of the word's forms.

    A form with several lemmas and no headword leads nowhere.
    """
    heads = keys.join(entries.select(F.lower("lemma").alias("key"), F.lower("lemma").alias("lemma")).distinct(), "key").select("query_index", "lemma").distinct()
    by_form = keys.join(forms.select(F.lower("form").alias("key"), F.lower("lemma").alias("lemma")).distinct(), "key")
    single = by_form.groupBy("query_index").agg(F.min("lemma").alias("lemma"), F.max("lemma").alias("_other")).where("lemma = _other").drop("_other")
    return heads.unionByName(single.join(heads.select("query_index").distinct(), "query_index", "left_anti"))


def unambiguous(forms: DataFrame) -> DataFrame:
    """The rows of forms that have one lemma only."""
    told = forms.groupBy(F.lower("form").alias("_key")).agg(F.min(F.lower("lemma")).alias("_one"), F.max(F.lower("lemma")).alias("_two"))
    return forms.join(told.where("_one = _two").select("_key"), F.lower(forms["form"]) == F.col("_key"), "left_semi")


def alternatives(keys: DataFrame, forms: DataFrame, entries: DataFrame, listed: DataFrame, equivalents: DataFrame, most_keys: int = MOST_KEYS, most_in_all: int = MOST_IN_ALL) -> DataFrame:
    """(query_index, key, refs, refs_total): all keys that may stand for each query word, with at most eight references each.

    ``keys`` (query_index, key): spellings of the query's words.  ``forms``
    (form, lemma, source): attested forms; ``entries`` (lemma): headwords;
    ``listed`` (lemma, form, source): forms that a dictionary lists;
    ``equivalents`` (form, other, source): spellings that a source calls the
    same.  A key with several words is left out.  More than ``most_keys`` keys
    of a word, or ``most_in_all`` in all, fail the search.
    """
    lemmas = lemmas_of(keys, forms, entries)
    none = F.lit(None).cast("string")
    literal = keys.select("query_index", "key", F.lit("literal").alias("kind"), F.col("key").alias("form"), none.alias("lemma"), none.alias("source"))
    own = unambiguous(forms).select(F.lower("form").alias("key"), F.col("form"), F.lower("lemma").alias("lemma"), "source")
    attested = lemmas.join(own, "lemma").select("query_index", "key", F.lit("attested").alias("kind"), "form", "lemma", "source")
    heads = lemmas.unionByName(keys.select("query_index", F.col("key").alias("lemma"))).distinct()
    dictionary = heads.join(listed.select(F.lower("lemma").alias("lemma"), "form", "source"), "lemma").select("query_index", F.lower("form").alias("key"), F.lit("dictionary").alias("kind"), "form", "lemma", "source")
    same = keys.join(equivalents.select(F.lower("form").alias("key"), F.col("other").alias("form"), "source"), "key").select("query_index", F.lower("form").alias("key"), F.lit("equivalent").alias("kind"), "form", none.alias("lemma"), "source")
    found = literal.unionByName(attested).unionByName(dictionary).unionByName(same).where("key <> '' and not key rlike '\\\\s'").distinct()
    each = Window.partitionBy("query_index", "key")
    told = found.withColumn("_n", F.row_number().over(each.orderBy("kind", "form", F.coalesce("lemma", F.lit("")), F.coalesce("source", F.lit("")))))
    totals = found.groupBy("query_index", "key").agg(F.count(F.lit(1)).alias("refs_total"))
    first = told.where(F.col("_n") <= MOST_REFERENCES).groupBy(F.col("query_index").alias("_q"), F.col("key").alias("_k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", *_REF))), lambda r: F.struct(*[r[x].alias(x) for x in _REF])).alias("refs"))
    rows = totals.join(first, (F.col("query_index") == F.col("_q")) & (F.col("key") == F.col("_k"))).select("query_index", "key", "refs", "refs_total")
    per_word, all_keys = totals.groupBy("query_index").agg(F.count(F.lit(1)).alias("n")), totals.agg(F.count(F.lit(1)).alias("all"))
    most = per_word.agg(F.max("n").alias("_word")).crossJoin(all_keys)  # one row
    refuse = F.when((F.col("_word") > most_keys) | (F.col("all") > most_in_all), F.raise_error(F.lit("too many alternatives: the search is refused")).cast("boolean"))
    return rows.crossJoin(F.broadcast(most)).where(F.coalesce(refuse, F.lit(True))).drop("_word", "all")


def forms_search(tokens: DataFrame, expanded: DataFrame) -> DataFrame:
    """(id, matched, count): texts with any form of any word: the words they have a form of, and how often forms stand there."""
    keys = expanded.select("query_index", F.col("key").alias("_key"))
    met = tokens.join(F.broadcast(keys), F.col("normalized") == F.col("_key"))  # at most MOST_IN_ALL keys
    return met.groupBy("id").agg(F.countDistinct("query_index").alias("matched"), F.sum("count").alias("count"))


def all_forms_search(tokens: DataFrame, expanded: DataFrame) -> DataFrame:
    """(id, count): texts that have a form of every word: relational division by the expanded query."""
    wanted = expanded.agg(F.countDistinct("query_index").alias("_all"))
    return forms_search(tokens, expanded).crossJoin(F.broadcast(wanted)).where("matched = _all").select("id", "count")
