"""Records by explicit citation: which numbers a citation states, and which records answer to one of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Edition schemes, and how a number, a range behind it and a fragment are written.
SCHEMES = ("LP", "Voigt", "Page", "PMG", "West", "Diehl", "Bergk", "Campbell", "Edmonds")
_SCHEME = "(" + "|".join(SCHEMES) + ")"
NUMBER, RANGE = "(\\d+[a-z]?)", "(\\s*[-–—]\\s*\\d+|[.:]\\d+)?"
FRAGMENT = f"(?i)(?:\\b{_SCHEME}\\s+)?\\bfr(?:ag(?:ment)?)?\\.?\\s*{NUMBER}{RANGE}(?:\\s+{_SCHEME}\\b)?"
NAMED = f"(?i)\\b{_SCHEME}\\s+{NUMBER}{RANGE}"
BARE = f"(?i)^\\s*{NUMBER}(?:\\s+{_SCHEME})?\\s*$"
#: What a record offers of the passage, the best first.
COVERAGE = ("text", "section_text", "partial_text", "translation", "commentary", "needs_review", "reference_only")


def references(citation: Column, collection: Column) -> Column:
    """Array of distinct (number, scheme) that a citation states; a scheme it doesn't name is ''.

    ``fr. 31``, ``LP fr. 31`` and ``fr. 31 LP`` are fragments, ``Page 5`` is a
    number of an edition; a bare number counts only where the work is a
    ``collection`` of fragments.  The first number of a range or of a line
    reference (``31-33``, ``31.4``) is no reference.
    """
    part = lambda m, pattern, k: F.lower(F.regexp_extract(m, pattern, k))
    single = lambda m, pattern, k: F.regexp_extract(m, pattern, k) == ""
    found = F.filter(F.regexp_extract_all(citation, F.lit(FRAGMENT), F.lit(0)), lambda m: single(m, FRAGMENT, 3))
    fragments = F.transform(found, lambda m: F.struct(part(m, FRAGMENT, 2).alias("number"), F.when(part(m, FRAGMENT, 1) != "", part(m, FRAGMENT, 1)).otherwise(part(m, FRAGMENT, 4)).alias("scheme")))
    told = F.filter(F.regexp_extract_all(citation, F.lit(NAMED), F.lit(0)), lambda m: single(m, NAMED, 3))
    named = F.transform(told, lambda m: F.struct(part(m, NAMED, 2).alias("number"), part(m, NAMED, 1).alias("scheme")))
    bare = F.when(F.coalesce(collection, F.lit(False)) & citation.rlike(BARE), F.array(F.struct(part(citation, BARE, 1).alias("number"), part(citation, BARE, 2).alias("scheme"))))
    return F.array_sort(F.array_distinct(F.concat(fragments, named, F.coalesce(bare, F.array().cast("array<struct<number:string,scheme:string>>")))))


def coverage_class(kind: Column, quality: Column, extracted: Column, partial: Column, section: Column) -> Column:
    """What a record offers: catalogue entries and records without text first, then what needs review, then the extent of the text."""
    return (
        F.when(kind.isin("reference", "apparatus") | ~F.coalesce(extracted, F.lit(True)), "reference_only")
        .when(quality.isin("needs_review", "machine_ocr", "mixed_content"), "needs_review")
        .when(F.coalesce(partial, F.lit(False)), "partial_text")
        .when(F.coalesce(section, F.lit(False)) & (kind == "text"), "section_text")
        .when(kind == "text", "text").when(kind == "translation", "translation").otherwise("commentary")
    )


def cited_records(records: DataFrame, asked: DataFrame, source_language: str = "grc", good: Sequence[str] = ("source_text", "machine_corrected_ocr")) -> DataFrame:
    """(query_id, author, number, scheme or '') to the records that state the number: query_id, id, coverage, by_parent, refs, place.

    ``records``: id, parent_id, author, language, kind, quality, citation,
    collection, extracted, partial, section.  A record answers for its author,
    or, as a translation or commentary, for the author of its parent text.  A
    query without a scheme takes any.  Results are placed by coverage, citation
    and id; nothing else is tried where none is found.
    """
    rows = records.select("id", "parent_id", F.lower("author").alias("author"), "kind", "citation", references(F.col("citation"), F.col("collection")).alias("refs"), coverage_class(*map(F.col, ("kind", "quality", "extracted", "partial", "section"))).alias("coverage"))
    stated = rows.where(F.size("refs") > 0)
    parents = records.where((F.col("kind") == "text") & (F.col("language") == source_language) & F.col("quality").isin(*good)).select(F.col("id").alias("_pid"), F.lower("author").alias("_pauthor"))
    linked = stated.where(F.col("kind").isin("translation", "commentary")).join(parents, F.col("parent_id") == F.col("_pid")).where("not author <=> _pauthor")
    answers = stated.select("*", F.col("author").alias("for"), F.lit(False).alias("by_parent")).unionByName(linked.select(*stated.columns, F.col("_pauthor").alias("for"), F.lit(True).alias("by_parent")))
    each = answers.select("*", F.explode("refs").alias("_ref"))
    want = asked.select("query_id", F.lower("author").alias("_author"), F.lower("number").alias("_number"), F.lower(F.coalesce("scheme", F.lit(""))).alias("_scheme"))
    fits = (F.col("for") == F.col("_author")) & (F.col("_ref.number") == F.col("_number"))
    met = each.join(want, fits).where((F.col("_scheme") == "") | (F.col("_ref.scheme") == F.col("_scheme")))
    rank = F.array_position(F.array(*map(F.lit, COVERAGE)), F.col("coverage")).cast("int")
    return met.groupBy("query_id", "id").agg(
        F.first("coverage").alias("coverage"), F.first(rank).alias("rank"), F.first("citation").alias("citation"), F.min("by_parent").alias("by_parent"),
        F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", "_ref.number", F.when(F.col("_ref.scheme") != "", F.col("_ref.scheme"))))), ",").alias("refs"),
    )
