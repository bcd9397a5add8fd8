"""Alternatives that a text states between labels ("nom. or acc. pl."), with spans, and claims that show only some of them."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.stored import materialized

_LETTER = "[\\p{L}\\p{N}_]"
#: Abbreviations and names of grammatical features.
GRAMMAR = {
    "pres": ("tense", "present"), "aor": ("tense", "aorist"), "imperf": ("tense", "imperfect"), "fut": ("tense", "future"), "perf": ("tense", "perfect"),
    "act": ("voice", "active"), "mid": ("voice", "middle"), "pass": ("voice", "passive"),
    "ind": ("mood", "indicative"), "indic": ("mood", "indicative"), "subj": ("mood", "subjunctive"), "opt": ("mood", "optative"), "inf": ("mood", "infinitive"),
    "infin": ("mood", "infinitive"), "imper": ("mood", "imperative"), "partic": ("mood", "participle"), "ptc": ("mood", "participle"),
    "nom": ("case", "nominative"), "gen": ("case", "genitive"), "dat": ("case", "dative"), "acc": ("case", "accusative"), "voc": ("case", "vocative"),
    "sg": ("number", "singular"), "pl": ("number", "plural"), "masc": ("gender", "masculine"), "fem": ("gender", "feminine"), "neut": ("gender", "neuter"),
    "1st": ("person", "1"), "2nd": ("person", "2"), "3rd": ("person", "3"),
}
#: Names stand for themselves.
GRAMMAR |= {value: (key, value) for key, value in GRAMMAR.values() if key != "person"}


def _any(words: Sequence[str]) -> str:
    """Pattern of whole words."""
    return f"(?<!{_LETTER})(?:{'|'.join(map(re.escape, sorted(words, key=len, reverse=True)))})(?!{_LETTER})"


def _after(parts: Column, matches: Column, upto: Column) -> Column:
    """Length of the first ``upto`` matches and of one gap more: where the next match begins."""
    lengths = lambda some, n: F.aggregate(F.slice(some, 1, n), F.lit(0), lambda s, x: s + F.length(x))
    return lengths(parts, upto + 1) + lengths(matches, upto)


def alternatives(text: Column, labels: Mapping[str, tuple[str, str]] = GRAMMAR, joiner: str = "or", fillers: Sequence[str] = ("a", "an"), marks: str = ".,") -> Column:
    """Array of (start, end, text, branches) of the alternatives stated in a text; branches are (label, start, end, features, unresolved).

    A run begins at a label and goes on over labels, fillers, marks and the
    joiner, whatever blanks are between them.  A run in which the joiner stands
    states alternatives, if there is a label on each side of every joiner;
    otherwise nothing is taken of it.  A branch reaches from its first label to
    its last and takes a full stop behind that.  ``features`` has what the
    branch's own labels say; a key for which they say different things is
    ``unresolved`` and has no feature.  Places count characters from 0, the end
    not included.  A null text gives null, an empty one an empty array.
    """
    label, join = _any(list(labels)), f"(?i){_any([joiner])}"
    # possessive, so that a run of any length is matched without a stack
    run = f"(?i){label}(?:\\s*+(?:{_any([*labels, joiner, *fillers])}|[{re.escape(marks)}]))*+"
    label = f"(?i){label}"
    meaning = F.create_map(*[x for k, (key, value) in labels.items() for x in (F.lit(k.lower()), F.struct(F.lit(key).alias("key"), F.lit(value).alias("value")))])

    def branch(part: Column, start: Column) -> Column:
        gaps, found = F.split(part, label), F.regexp_extract_all(part, F.lit(label), F.lit(0))
        low, high = F.length(gaps[0]), F.length(part) - F.length(F.element_at(gaps, -1)) + F.startswith(F.element_at(gaps, -1), F.lit(".")).cast("int")
        said = F.array_distinct(F.transform(found, lambda m: F.element_at(meaning, F.lower(m))))
        often = lambda key: F.size(F.filter(said, lambda x: x["key"] == key)) > 1
        return F.struct(
            F.substring(part, low + 1, high - low).alias("label"), (start + low).alias("start"), (start + high).alias("end"),
            F.map_from_entries(F.array_sort(F.filter(said, lambda x: ~often(x["key"])))).alias("features"),
            F.array_sort(F.array_distinct(F.transform(F.filter(said, lambda x: often(x["key"])), lambda x: x["key"]))).alias("unresolved"),
        )

    def stated(found: Column, start: Column) -> Column:
        parts, joins = F.split(found, join), F.regexp_extract_all(found, F.lit(join), F.lit(0))
        branches = F.transform(parts, lambda p, k: branch(p, start + _after(parts, joins, k) - F.length(p)))
        low, high = branches[0]["start"], F.element_at(branches, -1)["end"]
        return F.struct(low.alias("start"), high.alias("end"), F.substring(found, low - start + 1, high - low).alias("text"), branches.alias("branches"))

    gaps, runs = F.split(text, run), F.regexp_extract_all(text, F.lit(run), F.lit(0))
    # places of all runs in one pass; only those with alternatives are kept on the way
    whole = lambda found: found.rlike(join) & F.forall(F.split(found, join), lambda p: p.rlike(label))
    none = F.array().cast("array<struct<run:string,start:int>>")
    zero = F.struct(F.lit(0).alias("at"), none.alias("kept"))
    pairs = F.arrays_zip(runs.alias("run"), F.slice(gaps, 1, F.size(runs)).alias("gap"))
    placed = lambda s, p: F.struct(p["run"].alias("run"), (s["at"] + F.length(p["gap"])).alias("start"))
    kept = lambda s, p: F.when(whole(p["run"]), F.concat(s["kept"], F.array(placed(s, p)))).otherwise(s["kept"])
    walked = F.aggregate(pairs, zero, lambda s, p: F.struct((s["at"] + F.length(p["gap"]) + F.length(p["run"])).alias("at"), kept(s, p).alias("kept")), lambda s: s["kept"])
    found = F.when(text.rlike(join), walked).when(text.isNotNull(), none)
    return F.transform(found, lambda x: stated(x["run"], x["start"]))


def label_place(label: Column, quote: Column, start: Column, end: Column) -> Column:
    """(start, end) of a label in a quote: the declared place if the label stands there, without one the only place; else null."""
    escaped = F.transform(F.split(F.trim(label), "\\s+"), lambda w: F.concat(F.lit("\\Q"), w, F.lit("\\E")))
    pattern = F.concat(F.lit(f"(?i)(?<!{_LETTER})"), F.array_join(escaped, "\\s+"), F.lit(f"(?!{_LETTER})"))
    found, gaps = F.regexp_extract_all(quote, pattern, F.lit(0)), F.split(quote, pattern)
    spans = F.transform(found, lambda m, k: F.struct(_after(gaps, found, k).alias("start"), (_after(gaps, found, k) + F.length(m)).alias("end")))
    declared = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))
    chosen = F.when(start.isNull() & end.isNull(), F.when(F.size(spans) == 1, spans[0])).when(F.array_contains(spans, declared), declared)
    return F.when(F.trim(label) != "", chosen)


def qualified_claims(claims: DataFrame, labels: Mapping[str, tuple[str, str]] = GRAMMAR, joiner: str = "or", fillers: Sequence[str] = ("a", "an")) -> DataFrame:
    """Claims that rest on one of several stated alternatives: claim_id, status, n_stated, n_complete, conflicting (keys).

    ``claims``: claim_id, subject, accepted, label, features (map), start, end
    (the label's declared place, or null), evidence (array of structs with
    ``quote``; evidence is the same where all its fields are).  A branch is
    shown if an accepted claim of the same subject and evidence has its label at
    the branch's whole span and all its features, and none of them is
    unresolved.  A claim is ``incomplete`` if a branch says otherwise than it
    while not all branches are shown, ``represented`` if all branches of all
    its alternatives are, and ``partial`` otherwise.  Claims without features,
    label, place or stated alternatives have no row.

    What is stated and shown is worked out once for each (subject, evidence),
    so claims of one subject never meet each other.
    """
    rows = claims.where("label is not null and size(features) > 0").select("*", F.explode("evidence").alias("_e")).where("_e.quote is not null")
    rows = rows.withColumns({"_key": F.sha2(F.to_json(F.struct("subject", "_e")), 256), "_at": label_place(F.col("label"), F.col("_e.quote"), F.col("start"), F.col("end"))}).where("_at is not null")
    quotes = rows.groupBy("_key").agg(F.any_value("_e.quote").alias("_quote"))
    stated = quotes.select("_key", F.explode(alternatives(F.col("_quote"), labels, joiner, fillers)).alias("_a"))
    met = rows.select("claim_id", "_key", "_at", "features", "accepted").join(stated, "_key").where("_a.start <= _at.start and _at.end <= _a.end").select("*", F.col("_a.start").alias("_from"))
    met = materialized(met, "met")
    entries = F.array_sort(F.map_entries("features"))
    shown = met.where("accepted").select("_key", "_at", entries.alias("_has")).distinct()
    wanted = met.select("_key", "_from", "_a.branches").groupBy("_key", "_from").agg(F.any_value("branches").alias("branches"))
    each = wanted.select("_key", "_from", F.explode("branches").alias("_b")).withColumn("_at", F.struct("_b.start", "_b.end"))
    fits = (F.size("_b.unresolved") == 0) & (F.size(F.array_except(F.map_entries("_b.features"), F.col("_has"))) == 0)
    seen = each.join(shown, ["_key", "_at"], "left").groupBy("_key", "_from", "_at").agg(F.coalesce(F.bool_or(fits), F.lit(False)).alias("_shown"))
    complete = seen.groupBy("_key", "_from").agg(F.bool_and("_shown").alias("_complete"))
    said = F.flatten(F.transform("_a.branches", lambda b: F.map_entries(b["features"])))
    against = F.filter(said, lambda x: F.element_at("features", x["key"]) != x["value"])
    told = met.select("claim_id", "_key", "_from", F.array_distinct(F.transform(against, lambda x: x["key"])).alias("_against")).join(complete, ["_key", "_from"])
    status = F.when(F.bool_or((F.size("_against") > 0) & ~F.col("_complete")), "incomplete").when(F.bool_and("_complete"), "represented").otherwise("partial")
    return told.groupBy("claim_id").agg(status.alias("status"), F.count(F.lit(1)).alias("n_stated"), F.count_if("_complete").alias("n_complete"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("_against")))).alias("conflicting"))
