"""Folding, tokens, keys and distances as columns.

Spark has no Unicode normalisation, so folding runs in one Arrow UDF; everything
else stays in the JVM.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Apostrophe-like signs and the forms of sigma that fold to one.
APOSTROPHES = "’᾽ʼ"
SIGMAS = "ςϲϹ"
SPACE = "[ \\t\\n\\r\\f\\x0B]+"
#: Editorial brackets, each opening sign before its closing one.
BRACKETS = "[]<>{}⟨⟩〈〉‹›⟦⟧⸢⸣⸤⸥"
_BRACKET = "".join("\\" + c if c in "[]" else c for c in BRACKETS)
INNERMOST = "|".join(f"[{o}][^{_BRACKET}]*[{c}]" if o != "[" else f"\\[[^{_BRACKET}]*\\]" for o, c in zip(BRACKETS[::2], BRACKETS[1::2], strict=True))
LONE_CLOSING, LONE_OPENING = "(?m)^[^\\n]*[\\]" + BRACKETS[3::2] + "]", "[\\[" + BRACKETS[2::2] + "][^\\n]*"
#: Depth to which brackets in brackets are told apart.
DEPTH = 4


@F.arrow_udf(StringType())
def strip_marks(text: pa.Array) -> pa.Array:
    """Lower-cased and decomposed, without combining marks; null stays null."""
    return pc.replace_substring_regex(pc.utf8_normalize(pc.utf8_lower(text), "NFD"), r"\p{Mn}+", "")


@F.arrow_udf(StringType())
def lowered(text: pa.Array) -> pa.Array:
    """Lower-cased letter by letter, whatever stands beside it: a last sigma is as any other, which ``lower`` of Spark tells apart."""
    return pc.utf8_lower(text)


def _bare(text: str | None) -> str | None:
    if text is None or text.isascii():
        return text
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c)[0] != "M"))


@F.arrow_udf(StringType())
def without_marks(text: pa.Array) -> pa.Array:
    """NFC form without marks of any kind (spacing and enclosing ones too); capitals stay as they are, null stays null."""
    return pa.array([_bare(t) for t in text.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def compose(text: pa.Array) -> pa.Array:
    """NFC form.  The standard library composes; Arrow's own function leaves some texts decomposed."""
    return pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFC", t) for t in text.to_pylist()], pa.string())


def fold_search(text: Column) -> Column:
    """Key for search: no case, no marks, one sigma, one apostrophe; punctuation stays."""
    return F.translate(strip_marks(text), SIGMAS + APOSTROPHES, "σσσ'''")


def fold_lexicon(text: Column) -> Column:
    """Key for dictionaries: as for search, but all that is no letter or apostrophe counts as space, collapsed."""
    folded = F.translate(strip_marks(text), SIGMAS + APOSTROPHES + "‘`", "σσσ'''''")
    return F.trim(F.regexp_replace(folded, "[^\\p{L}']+", " "))


def fold_author(label: Column) -> Column:
    """Key for names: no case, no marks, one sigma; spaces, underscores and hyphens are one space."""
    return F.trim(F.regexp_replace(F.translate(strip_marks(label), SIGMAS, "σσσ"), "[\\s_-]+", " "))


def tokens(text: Column) -> Column:
    """Letters with attached marks and inner apostrophes; digits and underscores separate."""
    return F.regexp_extract_all(text, F.lit("\\p{L}[\\p{L}\\p{M}]*(?:['" + APOSTROPHES + "](?=\\p{L})[\\p{L}\\p{M}]+)*"), F.lit(0))


def letter_words(text: Column) -> Column:
    """Runs of letters."""
    return F.regexp_extract_all(text, F.lit("\\p{L}+"), F.lit(0))


def readable(text: Column) -> Column:
    """The text with an ellipsis in place of all that stands in editorial brackets.

    Pairs may reach over lines, which then are one.  A bracket without its
    partner takes the rest of its line (a closing one, the start), and so do
    pairs that lie deeper than DEPTH.
    """
    shown = text
    for _ in range(DEPTH):
        shown = F.regexp_replace(shown, INNERMOST, "…")
    shown = F.regexp_replace(F.regexp_replace(shown, LONE_CLOSING, "…"), LONE_OPENING, "…")
    return F.when(text.rlike(f"[{_BRACKET}]"), shown).otherwise(text)  # most texts have none


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def text_key(language: Column, kind: Column, text: Column) -> Column:
    """24 hex digits that copies of a text in one language and kind share."""
    return F.substring(F.sha1(F.concat_ws("\u001f", language, kind, collapse(compose(text))).cast("binary")), 1, 24)


def work_id(*parts: Column) -> Column:
    """20 hex digits of the JSON list of the parts, with a space behind each comma."""
    quoted = [F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(p, "\\\\", "\\\\\\\\"), '"', '\\\\"'), F.lit('"')) for p in parts]
    return F.substring(F.sha2(F.concat(F.lit("["), F.concat_ws(", ", *quoted), F.lit("]")), 256), 1, 20)


def split_bucket(value: Column, buckets: int = 100) -> Column:
    """The SHA-1 of a value, as a number, modulo ``buckets``: stable over runs and tools."""
    digits = F.transform(F.split(F.sha1(value.cast("binary")), ""), lambda d: F.conv(d, 16, 10).cast("int"))
    return F.aggregate(digits, F.lit(0), lambda acc, d: (acc * 16 + F.coalesce(d, F.lit(0))) % buckets)


def trigrams(key: Column) -> Column:
    """Character trigrams of ^key$."""
    padded = F.concat(F.lit("^"), key, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(key), F.lit(1))), lambda i: F.substring(padded, i, F.lit(3)))


def shingles(text: Column, width: int = 5) -> Column:
    """Distinct character shingles."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - (width - 1), F.lit(1)))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(width))))


def mirror_preference(quality: Column, source: Column, later: dict[str, int] | None = None) -> Column:
    """Rank of a copy: by quality, then by source (``later``: sources that rank behind the rest, with their rank)."""
    q = F.when(quality == "source_text", 0).when(quality == "machine_corrected_ocr", 1).otherwise(3)
    rank = F.lit(0)
    for name, value in (later or {}).items():
        rank = F.when(source == name, value).otherwise(rank)
    return q * 10 + rank


def excerpt(text: Column, length: int = 200) -> Column:
    """A struct of the text's start and whether something follows."""
    return F.struct(F.substring(text, 1, length).alias("excerpt"), (F.length(text) > length).alias("truncated"))


def cosine(a: Column, b: Column) -> Column:
    """Exact cosine similarity of two arrays of numbers, in doubles."""
    double = lambda x: F.transform(x, lambda v: v.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(double(x), double(y), lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def phrase_pattern(query: str, greek: bool = False) -> str:
    """A regular expression for whole words in order, any white space between them."""
    import re

    words = "[ \\t\\n\\r\\f]+".join(re.escape(w) for w in query.split())
    if not greek:
        return f"(?<![\\p{{L}}\\p{{N}}_]){words}(?![\\p{{L}}\\p{{N}}_])"
    tail = "" if query[-1:] in "'᾿" else "'᾿"
    return f"(?<![\\p{{L}}\\p{{N}}_])(?<![\\p{{L}}\\p{{N}}_]['᾿]){words}(?![\\p{{L}}\\p{{N}}_{tail}])"
