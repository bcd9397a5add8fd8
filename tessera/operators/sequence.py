"""Words in texts by their places: in order, near each other, or anywhere.

The positional index is a table of occurrences (term, id, segment, place, form):
a text is cut into segments at gaps and editorial signs, and places count the
words of a segment from 0.  What stands in editorial brackets is not indexed.
Searches read the rows of their terms only, and decide by windows over
(id, segment), so their work grows with the occurrences of the words asked for.

A query is a list of words, each with its alternatives.  Each needs a token of
its own, also where alternatives overlap or a word is asked for twice.  By Hall's
theorem such an assignment exists if every set of query words has at least as
many tokens that fit one of them; only sets that hang together by common
alternatives, with equal words taken together, have to be looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import letter_words, readable

#: Signs at which a segment ends, besides two or more full stops.
BARRIER = "[…†‡\u2010\u00ad\u0323\\[\\]<>{}⟨⟩〈〉‹›⟦⟧⸢⸣⸤⸥-]|\\.\\.+"
#: Most different words of a query whose alternatives overlap.
MOST_CLASSES = 10
#: With fewer keys, a filter reaches the files of the index.
PUSHED = 500


class TooMuchWork(ValueError):
    """The search would take more steps than allowed; it is refused, not cut short."""


def positional_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: Callable[[Column], Column] = F.lower) -> DataFrame:
    """(term, id, segment, place, form), one row for each readable word.

    Rows are dealt by term and text, so a very frequent word is spread over all
    files, and each file is in order of terms, so a search reads few pages of it.
    Null and empty texts have no rows; a null identifier is kept.
    """
    pieces = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(readable(F.col(text_col)), BARRIER, -1)).alias("segment", "_piece"))
    words = pieces.select("id", "segment", F.posexplode(letter_words(F.col("_piece"))).alias("place", "form"))
    rows = words.select(key(F.col("form")).alias("term"), "id", "segment", "place", "form")
    return rows.repartition("term", "id").sortWithinPartitions("term", "id", "segment", "place")


def _classes(groups: Sequence[set[str]]) -> tuple[list[frozenset[str]], list[int]]:
    """The different words of a query, and how often each is asked for."""
    if not groups or not all(groups):
        raise ValueError("every query word needs an alternative")
    counted = Counter(frozenset(g) for g in groups)
    return list(counted), list(counted.values())


def hall_sets(groups: Sequence[set[str]]) -> list[tuple[int, int]]:
    """(bits of the different words, tokens needed) of each set of words that hangs together by common alternatives."""
    classes, times = _classes(groups)
    touch = [{j for j, d in enumerate(classes) if c & d} for c in classes]
    together: list[set[int]] = []
    for i in range(len(classes)):  # connected parts of the overlap graph
        met = [p for p in together if p & touch[i]]
        together = [p for p in together if p not in met] + [set().union({i}, *met)]
    if max(map(len, together)) > MOST_CLASSES:
        raise TooMuchWork(f"more than {MOST_CLASSES} words with common alternatives")

    def connected(some: tuple[int, ...]) -> bool:
        seen, todo = {some[0]}, [some[0]]
        while todo:
            more = touch[todo.pop()] & set(some) - seen
            seen |= more
            todo += more
        return len(seen) == len(some)

    sets = [s for part in together for k in range(1, len(part) + 1) for s in combinations(sorted(part), k) if connected(s)]
    return [(sum(1 << i for i in s), sum(times[i] for i in s)) for s in sets]


def matched(index: DataFrame, groups: Sequence[set[str]]) -> DataFrame:
    """(id, segment, place, form, mask): the occurrences of any key; bit i of the mask: it fits word i."""
    bits: dict[str, int] = {}
    for i, g in enumerate(groups):
        for k in g:
            bits[k] = bits.get(k, 0) | 1 << i
    keys = index.sparkSession.createDataFrame(sorted(bits.items()), "_key string, mask long")
    rows = index.where(F.col("term").isin(*bits)) if len(bits) <= PUSHED else index
    return rows.join(F.broadcast(keys), F.col("term") == F.col("_key")).select("id", "segment", "place", "form", "mask")  # keys: those of one query


def _within_budget(rows: DataFrame, each: int, budget: int) -> DataFrame:
    """Refuses the search if a segment has more matched words than can be looked at."""
    work = F.count(F.lit(1)).over(Window.partitionBy("id", "segment")) * each
    refused = F.when(F.col("_work") > budget, F.raise_error(F.lit(f"more than {budget} steps in one text: the search is refused")).cast("boolean"))
    return rows.withColumn("_work", work).where(F.coalesce(refused, F.lit(True))).drop("_work")


def in_order(index: DataFrame, groups: Sequence[set[str]], slop: int = 0, budget: int = 2_000_000) -> DataFrame:
    """(id, segment, first, last, extra_words, forms): texts that have the words in order with at most ``slop`` others between, and their first place.

    From the last word backwards each occurrence learns the nearest chain behind
    it; all words share one sort.
    """
    n, reach = len(groups), len(groups) + slop - 1
    _classes(groups)
    rows = _within_budget(matched(index, groups), n + slop, budget)
    behind = Window.partitionBy("id", "segment").orderBy("place").rangeBetween(1, max(reach, 1))
    here = F.array(F.struct("place", "form"))
    fits = lambda k: F.col("mask").bitwiseAND(1 << k) != 0
    rows = rows.withColumn("_chain", F.when(fits(n - 1), here))
    for k in reversed(range(n - 1)):
        follows = F.min(F.when(F.col("_chain").isNotNull(), F.struct("place", "_chain"))).over(behind)
        rows = rows.withColumn("_next", follows).withColumn("_chain", F.when(fits(k) & F.col("_next").isNotNull(), F.concat(here, F.col("_next._chain"))))
    last = F.element_at("_chain", -1)["place"]
    found = rows.where(F.col("_chain").isNotNull() & (last - F.col("place") <= reach))
    best = found.groupBy("id").agg(F.min(F.struct("segment", "_chain")).alias("w")).select("id", "w.segment", F.col("w._chain").alias("c"))
    first, end = F.col("c")[0]["place"], F.element_at("c", -1)["place"]
    return best.select("id", "segment", first.alias("first"), end.alias("last"), (end - first + 1 - n).alias("extra_words"), F.array_join(F.transform("c", lambda t: t["form"]), " ").alias("forms"))


def _enough(sets: list[tuple[int, int]], over: Window | None = None) -> Column:
    """Whether every set of words has its tokens, in a group or in a window."""
    ok = F.lit(True)
    for bits, needed in sets:
        amount = F.sum(F.when(F.col("mask").bitwiseAND(bits) != 0, 1).otherwise(0))
        ok = ok & ((amount if over is None else amount.over(over)) >= needed)
    return ok


def near_each_other(index: DataFrame, groups: Sequence[set[str]], slop: int = 0, budget: int = 2_000_000) -> DataFrame:
    """(id, segment, first, last, extra_words, forms): texts that have the words in any order among n + ``slop`` words of a segment.

    ``first`` is the first word from which that holds, ``last`` the word that
    makes it complete, ``forms`` what matches from one to the other.
    """
    sets, (classes, _), reach = hall_sets(groups), _classes(groups), len(groups) + slop - 1
    rows = _within_budget(matched(index, classes), len(groups) + slop, budget)
    ahead = Window.partitionBy("id", "segment").orderBy("place").rangeBetween(0, reach)
    starts = rows.withColumn("_ok", _enough(sets, ahead)).where("_ok").groupBy("id").agg(F.min(F.struct("segment", "place")).alias("w"))
    starts = starts.select(F.col("id").alias("_id"), F.col("w.segment").alias("_segment"), F.col("w.place").alias("first"))
    inside = rows.join(starts, F.col("id").eqNullSafe(F.col("_id")) & (F.col("segment") == F.col("_segment")) & F.col("place").between(F.col("first"), F.col("first") + reach))
    so_far = Window.partitionBy("id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    told = inside.withColumn("_ok", _enough(sets, so_far)).withColumn("last", F.min(F.when(F.col("_ok"), F.col("place"))).over(Window.partitionBy("id"))).where("place <= last")
    out = told.groupBy("id", "segment", "first", "last").agg(F.array_sort(F.collect_list(F.struct("place", "form"))).alias("t"))  # at most n + slop words
    return out.select("id", "segment", "first", "last", (F.col("last") - F.col("first") + 1 - len(groups)).alias("extra_words"), F.array_join(F.transform("t", lambda t: t["form"]), " ").alias("forms"))


def all_words(index: DataFrame, groups: Sequence[set[str]]) -> DataFrame:
    """(id, tokens): texts that have a token of its own for every word, and how many tokens fit any.

    Tokens are counted by the words they fit, before the shuffle; no list is kept.
    """
    sets, (classes, _) = hall_sets(groups), _classes(groups)
    amounts = matched(index, classes).groupBy("id", "mask").agg(F.count(F.lit(1)).alias("_n"))
    ok = F.lit(True)
    for bits, needed in sets:
        ok = ok & (F.sum(F.when(F.col("mask").bitwiseAND(bits) != 0, F.col("_n")).otherwise(0)) >= needed)
    return amounts.groupBy("id").agg(ok.alias("_ok"), F.sum("_n").alias("tokens")).where("_ok").drop("_ok")


def contained_sequences(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """(quote_id, tokens) in (id, tokens): where a quotation's tokens stand contiguously in a text.

    Joined on the quotation's first two tokens, then compared as a whole.
    """
    led = quotes.where(F.size("tokens") >= 2).select("quote_id", F.col("tokens").alias("quoted"), F.get("tokens", F.lit(0)).alias("one"), F.get("tokens", F.lit(1)).alias("two"))
    places = texts.where(F.size("tokens") >= 2).select("id", F.posexplode(F.arrays_zip(F.slice("tokens", F.lit(1), F.size("tokens") - 1).alias("one"), F.slice("tokens", F.lit(2), F.size("tokens") - 1).alias("two"))).alias("place", "pair"))
    hits = places.select("id", "place", "pair.one", "pair.two").join(led, ["one", "two"])
    whole = hits.join(texts, "id").where(F.slice("tokens", F.col("place") + 1, F.size("quoted")) == F.col("quoted"))
    return whole.select("quote_id", "id", "place").distinct()
