"""Words and passages brought together across editions: spans, alignments, parallel contexts, boundary proofs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import letter_words, strip_marks

#: Words with their marks, and what stands between: together the whole text.
TILES = "\\p{L}[\\p{L}\\p{M}]*|[^\\p{L}]+"
CONTEXT = 4


def word_spans(texts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, form, start, end): words of texts with their code points in the source.

    Words are cut from the source itself, marks and all, so that whatever key is
    made of a word later, its span is that of the source: substring(text,
    start + 1, end - start) is the form.
    """
    tiles = texts.select(F.col(id_col).alias("id"), F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(TILES), F.lit(0))).alias("tile", "form"))
    placed = tiles.withColumn("end", F.sum(F.length("form")).over(Window.partitionBy("id").orderBy("tile")))  # of texts with one identifier, tiles of one number count together
    return placed.where(F.col("form").rlike("^\\p{L}")).select("id", "form", (F.col("end") - F.length("form")).cast("int").alias("start"), F.col("end").cast("int").alias("end"))


def align_forms(requests: DataFrame, spans: DataFrame, strict: Callable[[Column], Column] = F.lower, loose: Callable[[Column], Column] = strip_marks) -> DataFrame:
    """(request_id, id, form) to the one word of the text that it is: status, start, end, token.

    Words of the same strict key are tried first, those of the same loose key
    only where there is none; a form is linked only if one word is left.
    Status: exact, folded, ambiguous or none.
    """
    asked = requests.select("request_id", F.col("id").alias("_id"), F.col("form").alias("_form"), strict(F.col("form")).alias("_strict"), loose(F.col("form")).alias("_loose"))
    met = asked.join(spans.withColumns({"_s": strict(F.col("form")), "_l": loose(F.col("form"))}), (F.col("_id") == F.col("id")) & (F.col("_loose") == F.col("_l")))
    word = F.struct("start", "end", "form")
    told = met.groupBy(F.col("request_id").alias("_r")).agg(
        F.count(F.lit(1)).alias("_near"), F.count(F.when(F.col("_s") == F.col("_strict"), 1)).alias("_same"), F.min(word).alias("_any"), F.min(F.when(F.col("_s") == F.col("_strict"), word)).alias("_exact")
    )
    status = F.when(F.col("_same") == 1, "exact").when(F.col("_same") > 1, "ambiguous").when(F.col("_near") == 1, "folded").when(F.col("_near") > 1, "ambiguous").otherwise("none")
    chosen = F.when(status == "exact", F.col("_exact")).when(status == "folded", F.col("_any"))
    rows = requests.select("request_id", "id", "form").join(told, F.col("request_id") == F.col("_r"), "left").withColumns({"status": status, "_w": chosen})
    return rows.select("request_id", "id", "form", "status", F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), F.col("_w.form").alias("token"))


def parallel_contexts(targets: DataFrame, records: DataFrame, least_words: int = 8, listed: int = 10) -> DataFrame:
    """(id, form) whose whole word sequence stands in other records of the author too: matches, match_ids, words, token_index, window.

    ``records``: id, author, usable (of a quality that may be compared), text.
    Accents, case and order have to agree, punctuation may differ.  The form has
    to stand exactly once in a text of at least ``least_words`` words.  Records
    are grouped by author and SHA-256 of the words, so copies are never paired:
    each target gets the number of the others and the ``listed`` smallest of their identifiers.
    """
    words = records.where("usable and author is not null").select("id", F.lower("author").alias("author"), letter_words(F.col("text")).alias("words")).where(F.size("words") >= least_words)
    sequence = F.sha2(F.array_join("words", " "), 256)
    keyed = words.select("id", "author", sequence.alias("key"))
    first = keyed.withColumn("_n", F.row_number().over(Window.partitionBy("author", "key").orderBy("id"))).where(F.col("_n") <= listed + 1)
    groups = keyed.groupBy("author", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").withColumnsRenamed({"author": "_a", "key": "_k"})
    some = first.groupBy("author", "key").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumnsRenamed({"author": "_fa", "key": "_fk"})  # at most listed + 1
    own = targets.select(F.col("id").alias("_id"), "form").join(words, F.col("_id") == F.col("id")).withColumn("key", sequence)
    low = F.transform("words", lambda w: F.lower(w))
    at = F.array_position(low, F.lower("form")).cast("int")
    once = own.withColumns({"token_index": at - 1, "_times": F.size(F.filter(low, lambda w: w == F.lower(F.col("form"))))}).where("_times = 1")
    met = once.join(groups, (F.col("author") == F.col("_a")) & (F.col("key") == F.col("_k"))).join(some, (F.col("author") == F.col("_fa")) & (F.col("key") == F.col("_fk")))
    start = F.greatest(F.col("token_index") - CONTEXT, F.lit(0))
    window = F.array_join(F.slice("words", start + 1, F.col("token_index") + CONTEXT + 1 - start), " ")
    others = F.slice(F.array_remove("ids", F.col("id")), 1, listed)
    return met.select("id", "form", (F.col("size") - 1).alias("matches"), others.alias("match_ids"), F.size("words").alias("words"), "token_index", window.alias("window"))


def source_spans(records: DataFrame, sources: DataFrame) -> DataFrame:
    """Where the lines of a record stand in its source, if that is one place only.

    ``records`` (record_id, source_id, lines) and ``sources`` (source_id,
    sequence): arrays of (label, text).  Places are found by the hash of the
    first line, then compared as a whole.  Gives start, end (exclusive),
    next_anchor (label behind), at_end, whole.
    """
    line = lambda x: F.xxhash64(x["label"], x["text"])
    wanted = records.where(F.size("lines") > 0).select("record_id", "source_id", "lines", line(F.col("lines")[0]).alias("first"))
    places = sources.select(F.col("source_id").alias("_sid"), F.posexplode(F.transform("sequence", line)).alias("start", "_hash"))
    hits = wanted.join(places, (F.col("source_id") == F.col("_sid")) & (F.col("first") == F.col("_hash"))).drop("_sid", "_hash", "first")
    bodies = sources.select(F.col("source_id").alias("_sid"), "sequence")
    end = F.col("start") + F.size("lines")
    same = hits.join(bodies, F.col("source_id") == F.col("_sid")).where(F.slice("sequence", F.col("start") + 1, F.size("lines")) == F.col("lines"))
    told = same.select("record_id", "source_id", "start", end.alias("end"), F.get("sequence", end)["label"].alias("next_anchor"), (end == F.size("sequence")).alias("at_end"), F.transform("lines", lambda x: x["label"]).alias("labels"))
    one = told.groupBy("record_id").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("source_id", "start", "end", "next_anchor", "at_end", "labels")).alias("s")).where("_n = 1")
    return one.select("record_id", "s.*")


def boundary_proofs(pairs: DataFrame, spans: DataFrame, readings: DataFrame) -> DataFrame:
    """(parent_id, translation_id) whose boundaries are proven to be the same, with the method.

    ``readings`` (source_id, readings): how many records a source was cut into.
    Either both records are the whole of sources that are one record each, or
    both have the same labels in the same order, none twice, and the same label
    (or the end) follows.
    """
    known = spans.join(readings.select(F.col("source_id").alias("_src"), "readings"), F.col("source_id") == F.col("_src")).drop("_src")
    side = lambda p: known.select(*[F.col(c).alias(p + c) for c in known.columns])
    both = pairs.join(side("p_"), F.col("parent_id") == F.col("p_record_id")).join(side("t_"), F.col("translation_id") == F.col("t_record_id"))
    whole = (F.col("p_readings") == 1) & (F.col("t_readings") == 1) & (F.col("p_start") == 0) & (F.col("t_start") == 0) & F.col("p_at_end") & F.col("t_at_end")
    anchors = (F.col("p_labels") == F.col("t_labels")) & (F.size(F.array_distinct("p_labels")) == F.size("p_labels")) & F.col("p_next_anchor").eqNullSafe(F.col("t_next_anchor")) & (F.col("p_at_end") == F.col("t_at_end"))
    method = F.when(whole, "whole_sources").when(anchors, "same_anchors_and_successor")
    return both.select("parent_id", "translation_id", method.alias("method"), F.col("p_start").alias("parent_start"), F.col("p_end").alias("parent_end"), F.col("t_start").alias("translation_start"), F.col("t_end").alias("translation_end")).where("method is not null")
