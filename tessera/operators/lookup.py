"""Lookups by key, pairings with reasons, candidates, references and excerpts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def occurrences(rows: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int) -> DataFrame:
    """(id, ..., text) to the texts that hold any of the keys, with how many, in order."""
    held = F.size(F.array_intersect(F.regexp_extract_all(F.lower("text"), F.lit("\\p{L}+"), F.lit(0)), F.array(*[F.lit(k) for k in keys])))
    return rows.withColumn("keys", held.cast("long")).where("keys > 0").drop("text").orderBy(*order, "id").limit(limit)


def first_reason(rows: DataFrame, reasons: Sequence[tuple[str, Column]], otherwise: str) -> DataFrame:
    """Add the first reason whose condition holds; a condition that is null does not hold."""
    told = F.lit(otherwise)
    for name, holds in reversed(reasons):
        told = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(told)
    return rows.withColumn("reason", told)


def rarest_anchor(asked: DataFrame, tokens: DataFrame, id_col: str) -> DataFrame:
    """(id, key) distinct against (key) occurrences: the rarest key of each id that occurs, its count, and how many keys occur."""
    counts = tokens.join(asked.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct("n", "key"))
    return asked.join(counts, "key").groupBy(id_col).agg(best.alias("_b"), F.count(F.lit(1)).alias("keys")).select(id_col, F.col("_b.key").alias("anchor"), F.col("_b.n").alias("occurrences"), "keys")


def word_excerpt(text: Column, length: int) -> Column:
    """The start of a text, cut behind its last whole word; a text without a blank is cut at the length."""
    start = F.substring(text, 1, length)
    cut = F.regexp_extract(start, "(?s)^(.*)\\s", 1)
    return F.when((F.length(text) <= length) | (cut == ""), start).otherwise(F.rtrim(cut))


def candidate_groups(rows: DataFrame, form: str, candidate: str) -> DataFrame:
    """Per form: the candidate with most rows (ties: the smallest), numbers of candidates and rows, and whether there are several."""
    counted = rows.groupBy(form, candidate).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("minus"), F.col(candidate).alias("candidate")))
    out = counted.groupBy(form).agg(best.alias("_b"), F.count(F.lit(1)).alias("candidates"), F.sum("n").alias("lines"))
    return out.select(F.col(form).alias("form"), F.col("_b.candidate").alias("best"), "candidates", "lines", (F.col("candidates") > 1).alias("ambiguous"))


def bounded_refs(rows: DataFrame, key: str, ref: str, most: int) -> DataFrame:
    """Per key: how many references it has, and the first ``most``; lists are cut before they are gathered."""
    distinct = rows.select(key, ref).distinct()
    ranked = distinct.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(ref)))
    first = F.array_sort(F.collect_list(F.when(F.col("_k") <= most, F.col(ref))))
    return ranked.groupBy(key).agg(F.count(F.lit(1)).alias("documents"), F.array_join(F.transform(first, lambda x: x.cast("string")), ",").alias("refs"))


def upstream(rows: DataFrame, key: str, source: str, id_col: str) -> DataFrame:
    """Each record with the first of its key where all of the key come from one source, else null."""
    groups = rows.groupBy(key).agg(F.countDistinct(source).alias("_sources"), F.min(id_col).alias("_first"))
    return rows.join(groups, key).select(id_col, F.when(F.col("_sources") == 1, F.col("_first")).alias("upstream"))


def by_coverage(rows: DataFrame, numbers: str, order: Sequence[str]) -> DataFrame:
    """Rows with a class of how many references they hold: one first, then several, then none."""
    n = F.col(numbers)
    named = rows.withColumn("coverage", F.when(n == 0, "none").when(n == 1, "single").otherwise("several"))
    return named.orderBy(F.when(n == 1, 0).when(n > 1, 1).otherwise(2), *order)
