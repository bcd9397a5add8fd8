"""Ranked lists of hits fused into one list of passages, within a scope.

A hit stands for its passage, for the parent passage that its note or
translation belongs to, or, where neither is in scope, for the first copy of
its text that is.  Passages of the same words are one group, which has one vote
in each list.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds that hang on a parent, kinds that need leave, qualities that are left out, the constant of the votes.
LINKED = ("translation", "commentary")
REFERENCE_KINDS = ("reference", "apparatus")
EXCLUDED = ("machine_ocr", "mixed_content", "needs_review")
RRF = 60


@dataclass(frozen=True)
class Scope:
    """What a search may return.  No authors: any; an empty language or edition: any."""

    authors: tuple[str, ...] = ()
    language: str = ""
    edition: str = ""
    include_reference: bool = False
    assisted: bool = True
    source_language: str = "grc"


def eligible(scope: Scope, authors: Sequence[str] | None = None, language: str | None = None, edition: str | None = None) -> Column:
    """Whether a record (author_keys, language, edition, kind, quality) is in scope; arguments stand in for the scope's own."""
    authors = scope.authors if authors is None else authors
    language = scope.language if language is None else language
    edition = scope.edition if edition is None else edition
    ok = F.lit(True)
    if authors:
        ok = ok & F.arrays_overlap("author_keys", F.array(*map(F.lit, authors)))
    if language:
        ok = ok & (F.col("language") == language)
    if edition:
        ok = ok & (F.col("edition") == edition)
    if not scope.include_reference:
        ok = ok & ~F.col("kind").isin(*REFERENCE_KINDS) & ~F.coalesce(F.col("quality"), F.lit("")).isin(*EXCLUDED)
    return F.coalesce(ok, F.lit(False))


def facts(records: DataFrame, scope: Scope) -> DataFrame:
    """Records as narrow rows: identifiers, keys and what the scope says of them."""
    source = (F.col("kind") == "text") & (F.col("language") == scope.source_language)
    return records.select(
        "id", "parent_id", "kind", "quality", "copy_key", "group_key", source.alias("is_source"), eligible(scope).alias("ok"),
        eligible(scope, authors=()).alias("ok_whoever"), (source & eligible(scope)).alias("ok_parent"), (source & eligible(scope, language=scope.source_language, edition="")).alias("ok_author"),
    )


def targets(hits: DataFrame, records: DataFrame, scope: Scope) -> DataFrame:
    """(signal, position, id) to the same with target_id, group_key and how the two belong together; hits out of scope are dropped.

    Records: id, parent_id, author_keys, language, edition, kind, quality,
    copy_key (same words), group_key (same words, author, language, kind,
    quality).  Copies in scope are reduced to the first of each key before the
    join, so a text with very many copies adds one row.
    """
    known = facts(records, scope)
    parents = known.select(F.col("id").alias("_pid"), F.col("group_key").alias("_pgroup"), "ok_parent", "ok_author").withColumnRenamed("ok_parent", "_pok").withColumnRenamed("ok_author", "_pauthor")
    copies = known.where("ok and copy_key is not null").groupBy("copy_key").agg(F.min(F.struct("id", "group_key")).alias("_copy")).withColumnRenamed("copy_key", "_ckey")
    rows = hits.select("signal", "position", F.col("id").alias("_hit")).join(known, F.col("_hit") == F.col("id")).drop("_hit")
    if not scope.include_reference:
        rows = rows.where(~F.coalesce(F.col("quality"), F.lit("")).isin(*EXCLUDED))
    if not scope.assisted:
        rows = rows.where("is_source")
    rows = rows.join(parents, F.col("parent_id") == F.col("_pid"), "left").join(copies, F.col("copy_key") == F.col("_ckey"), "left")
    linked = F.col("kind").isin(*LINKED) & F.lit(scope.assisted)
    to_parent = F.coalesce(linked & F.col("_pok"), F.lit(False))
    by_author = F.coalesce(linked & F.lit(bool(scope.authors)) & F.col("ok_whoever") & F.col("_pauthor"), F.lit(False))
    itself = F.col("ok") | by_author
    pick = lambda parent, own, copy: F.when(to_parent, parent).when(itself, own).otherwise(copy)
    return rows.select(
        "signal", "position", "id",
        pick(F.col("_pid"), F.col("id"), F.col("_copy.id")).alias("target_id"), pick(F.col("_pgroup"), F.col("group_key"), F.col("_copy.group_key")).alias("group_key"),
        pick(F.lit("explicit_parent"), F.when(F.col("ok"), "direct").otherwise("author_of_parent"), F.lit("copy_in_scope")).alias("scope"),
    ).where("target_id is not null")


def fuse(hits: DataFrame, records: DataFrame, scope: Scope | None = None, weights: dict[str, float] | None = None, signals: Sequence[str] = ("lexical", "forms", "semantic")) -> DataFrame:
    """One row for each group: id, score, best_rank, ranks (map), evidence (distinct signal, id, scope), copies (sorted ids), reason.

    ``hits``: (signal, position, id), pools whose size the caller bounds; hits of
    no record are skipped.  The record of a group is that of its first hit, lists
    taken in the order of ``signals`` (others after them, by name).  Ranks count
    the groups met in a list, not the hits.  To be ordered by
    score (falling), best_rank, id.
    """
    found = targets(hits, records, scope or Scope())
    order = F.coalesce(F.array_position(F.array(*map(F.lit, signals)), F.col("signal")), F.lit(0))
    turn = F.struct(F.when(order > 0, order).otherwise(1 << 30).alias("list"), "signal", "position")
    places = found.groupBy("signal", "group_key").agg(F.min("position").alias("_first"))
    ranked = places.withColumn("rank", F.row_number().over(Window.partitionBy("signal").orderBy("_first"))).select(F.col("signal").alias("_s"), F.col("group_key").alias("_g"), "_first", "rank")
    # the hit that gives a group its vote carries the rank; the others only add evidence
    votes = found.join(ranked, (F.col("signal") == F.col("_s")) & (F.col("group_key") == F.col("_g"))).withColumn("rank", F.when(F.col("position") == F.col("_first"), F.col("rank")))
    weight = F.lit(1.0)
    for name, value in (weights or {}).items():
        weight = F.when(F.col("signal") == name, F.lit(float(value))).otherwise(weight)
    entry = F.when(F.col("rank").isNotNull(), F.struct("signal", "rank"))
    groups = votes.groupBy("group_key").agg(
        F.min_by("target_id", turn).alias("id"), F.round(F.sum(weight / (RRF + F.col("rank"))), 8).alias("score"), F.min("rank").alias("best_rank"),
        F.map_from_entries(F.array_sort(F.collect_set(entry))).alias("ranks"), F.array_sort(F.collect_set(F.struct("signal", "id", "scope"))).alias("evidence"), F.array_sort(F.collect_set("target_id")).alias("copies"),
    )
    bridged = F.exists("evidence", lambda e: e["id"] != F.col("id"))
    reason = F.concat(F.array_join(F.map_keys("ranks"), " + "), F.when(bridged, "; linked evidence").otherwise("; direct match"))
    return groups.withColumn("reason", reason)
