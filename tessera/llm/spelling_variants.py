"""Spelling variants: words one edit apart, found by merging the subtrees of an errata trie.

In the trie of all words, two words that differ by one character part at a node
``v``: either both go on with the same rest after different characters, or one
of them has a character more there (the last of its run, so that each pair has
one place only).  With the heaviest child of every node set aside, the words of
the light subtrees are merged, smallest first, into the node's errata subtree
with one character replaced, skipped or, for the heavy child, put in; where a
merged terminal coincides with one that is there, two words are one edit apart.
A word lies in at most log2(n) light subtrees, so n log n terminals are merged.

The sorted words are cut into ranges, and each task holds the trie of its range.
Nodes inside a range are merged in the task.  Only the nodes on the paths of the
cuts belong to several ranges: their heavy children are agreed on by counting,
and their merged terminals meet in a shuffle.  Where a merged terminal lies
under the heavy child (or under any child, for a skipped character), it is a
whole word, so it meets the words themselves; terminals of light siblings meet
under the node's wildcard key, of which there are no more than letters.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import delete_stored, shuffle_partitions, stored

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Stands for any character; no word holds it.
WILD = "\x00"
#: Counts that a task gathers before it hands them on.
HELD = 300_000
#: Words of a range, about.
RANGE = 60_000


def runs_of(text: bytes | None, doc_id: object, least: int, every: int, pattern: re.Pattern) -> Iterator[tuple[str, int]]:
    """(word, times) of a text: its lower-cased runs, of which some lose a letter."""
    for run, times in Counter(pattern.findall((text or b"").translate(_LOWER).decode("utf-8", "replace"))).items():
        if doc_id is not None:
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < least:
                    continue
        yield run, times


def _counts(batches: Iterator[pa.RecordBatch], least: int, every: int) -> Iterator[pa.RecordBatch]:
    pattern, found = re.compile(f"[a-zÀ-ÿ]{{{least},}}"), Counter()
    table = lambda c: pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["word", "n"])
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for word, times in runs_of(text.as_py(), doc_id, least, every, pattern):
                found[word] += times
            if len(found) >= HELD:
                yield table(found)
                found.clear()
    if found:
        yield table(found)


def word_counts(docs: DataFrame, least_length: int = 6, least_count: int = 5, every: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of the whole texts that are long and frequent enough; summed within tasks before the shuffle."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    counts = rows.mapInArrow(partial(_counts, least=least_length, every=every), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n - 1  # a[:lo] == b[:lo], a[:hi + 1] != b[:hi + 1]
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    return lo


def nodes(words: list[str], path: list[str]) -> Iterator[tuple[str, bool, int, list[tuple[str, int, int]]]]:
    """(prefix, shared, terminal, [(character, lo, hi), ...]) of the nodes of sorted words where something can meet.

    ``path``: the words before and behind the range; nodes on their paths are
    shared, and come even if all words of the range go on alike.  ``terminal``
    is the place of the word that ends at the node, or -1.  Other nodes come only
    if they branch.
    """
    stack = [(0, len(words), 0)] if words else []
    while stack:
        lo, hi, depth = stack.pop()
        shared = any(w[:depth] == words[lo][:depth] for w in path)
        if not shared:
            depth = common_prefix(words[lo], words[hi - 1])
        prefix = words[lo][:depth]
        terminal = lo if len(words[lo]) == depth else -1
        at, children = lo + (terminal >= 0), []
        while at < hi:
            c = words[at][depth]
            to = bisect.bisect_left(words, prefix + chr(ord(c) + 1), at, hi)
            children.append((c, at, to))
            if to - at > 1 or shared:
                stack.append((at, to, depth + 1))
            at = to
        if shared or len(children) + (terminal >= 0) > 1:
            yield prefix, shared, terminal, children


def heaviest(children: list[tuple[str, int]]) -> str:
    """Of (character, words below), the character with most; of equals the first in code-point order."""
    return min(children, key=lambda c: (-c[1], c[0]))[0] if children else ""


def merge(words: list[str], counts: list[int], path: list[str], heavy: dict[str, str]) -> Iterator[tuple]:
    """Pairs (a, n, b, m) inside the range; and, for shared nodes, (a, n, key) to be met elsewhere."""
    place = {w: i for i, w in enumerate(words)}
    for prefix, shared, terminal, children in nodes(words, path):
        depth = len(prefix)
        h = heavy.get(prefix, "") if shared else heaviest([(c, hi - lo) for c, lo, hi in children])
        light = sorted((x for x in children if x[0] != h), key=lambda x: x[2] - x[1])
        errata: dict[str, list[int]] = {}
        for i, c in [(terminal, "")] * (terminal >= 0) + [(i, c) for c, lo, hi in light for i in range(lo, hi)]:
            w = words[i]
            rest = w[depth + 1 :]
            whole = [prefix + h + w[depth:]] if h else []  # the heavy character put in
            if c:
                whole += [prefix + h + rest] if h else []  # replaced by the heavy one
                if rest[:1] != c:
                    whole.append(prefix + rest)  # skipped
            if shared:
                yield from ((w, counts[i], k) for k in whole)
                if c:
                    yield w, counts[i], prefix + WILD + rest
            else:
                for k in whole:
                    if (j := place.get(k)) is not None:
                        yield w, counts[i], k, counts[j]
                if c:
                    mates = errata.setdefault(rest, [])
                    yield from ((w, counts[i], words[j], counts[j]) for j in mates)
                    mates.append(i)


def _ranges(words: DataFrame, least: int) -> tuple[DataFrame, dict[int, list[str]]]:
    """(part, word, n), stored, each part a range of the sorted words; and for each part the words on either side of it."""
    amount = words.count()
    parts = max(1, min(max(shuffle_partitions(words.sparkSession), -(-amount // RANGE)), -(-amount // least)))
    dealt = stored(words.repartitionByRange(parts, "word").select(F.spark_partition_id().alias("part"), "word", "n"))
    edges = dealt.groupBy("part").agg(F.min("word").alias("lo"), F.max("word").alias("hi")).orderBy("part").collect()  # one row for each range
    sides = {}
    for k, r in enumerate(edges):
        sides[r["part"]] = [edges[k - 1]["hi"]] * (k > 0) + ([edges[k + 1]["lo"]] if k + 1 < len(edges) else [])
    return dealt, sides


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[str], list[int]]]:
    """The words of each part of a task, sorted."""
    found: dict[int, list[tuple[str, int]]] = {}
    for b in batches:
        for part, word, n in zip(*[b.column(k).to_pylist() for k in range(3)], strict=True):
            found.setdefault(part, []).append((word, n))
    for part, rows in found.items():
        rows.sort()
        yield part, [w for w, _ in rows], [n for _, n in rows]


def near_words(words: DataFrame, least: int = 500) -> DataFrame:
    """(word, n, other, m), once for each two words of (word, n) that are one inserted, deleted or replaced character apart.

    Words have to be distinct.  ``least``: ranges aren't made smaller than that.
    """
    spark = words.sparkSession
    dealt, sides = _ranges(words, least)
    parts = max(len(sides), 1)
    shared = spark.sparkContext.broadcast(sides)  # two words for each range

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many words go on with each character at the nodes on the paths of the cuts."""
        for part, own, _ in _sorted(batches):
            rows = [(p, c, hi - lo) for p, there, _, children in nodes(own, shared.value[part]) if there for c, lo, hi in children]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["prefix", "c", "n"])

    in_parts = dealt.repartitionById(parts, F.col("part"))
    below = in_parts.mapInArrow(weights, "prefix string, c string, n long").groupBy("prefix", "c").agg(F.sum("n").alias("n"))
    first = below.groupBy("prefix").agg(F.min(F.struct((-F.col("n")).alias("less"), F.col("c").alias("c"))).alias("best"))
    heavy = {r["prefix"]: r["c"] for r in first.select("prefix", F.col("best.c").alias("c")).collect()}  # at most the letters of two words for each range
    agreed = spark.sparkContext.broadcast(heavy)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["word", "n", "key", "other_n"], (pa.string(), pa.int64(), pa.string(), pa.int64())
        for part, own, counts in _sorted(batches):
            rows: list[tuple] = []
            for r in merge(own, counts, shared.value[part], agreed.value):
                rows.append(r if len(r) == 4 else (*r, None))
                if len(rows) == 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)
                    rows = []
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    met = stored(in_parts.mapInArrow(meet, "word string, n long, key string, other_n long"))
    within = met.where("other_n is not null").select("word", "n", F.col("key").alias("other"), F.col("other_n").alias("m"))
    wild = F.contains("key", F.lit(WILD))
    sought = met.where(F.col("other_n").isNull() & ~wild).select("word", "n", "key")
    found = sought.join(words.select(F.col("word").alias("other"), F.col("n").alias("m")), F.col("key") == F.col("other")).select("word", "n", "other", "m")
    copies = met.where(F.col("other_n").isNull() & wild)
    left, right = copies.select("word", "n", "key"), copies.select(F.col("word").alias("other"), F.col("n").alias("m"), F.col("key").alias("_key"))
    siblings = left.join(right, (F.col("key") == F.col("_key")) & (F.col("word") < F.col("other"))).select("word", "n", "other", "m")
    return within.unionByName(found).unionByName(siblings)


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) to (word, root): forms followed to the last, by pointer jumping; forms may not go in circles."""
    hops = stored(forms.select("word", F.col("form").alias("to"), F.lit(True).alias("moved")))
    while not hops.where("moved").isEmpty():
        further = hops.select(F.col("word").alias("_at"), F.col("to").alias("_to"))
        jumped = stored(hops.join(further, F.col("to") == F.col("_at"), "left").select("word", F.coalesce("_to", "to").alias("to"), F.col("_to").isNotNull().alias("moved")))
        delete_stored(hops)
        hops = jumped
    return hops.select("word", F.col("to").alias("root"))


def spelling_variants(
    docs: DataFrame, least_length: int = 6, least_count: int = 5, every: int = 199, ratio: int = 5, id_col: str = "doc_id", text_col: str = "text", least_range: int = 500
) -> DataFrame:
    """One row for each word: word, form, root, n, n_near, form_n.

    A word's form is its near word of largest n (of equals the smallest in
    code-point order), if that n is at least ``ratio`` times the word's own.
    Null and empty texts have no words.  Rows without an identifier take part,
    but none of their runs loses a letter.  Repeated rows count each.  Words of
    any length are kept whole.  Other columns are ignored, whatever their names;
    an empty table gives an empty result.
    """
    words = stored(word_counts(docs, least_length, least_count, every, id_col, text_col))
    pairs = near_words(words, least_range)
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("m").alias("n"), F.col("word").alias("other"), F.col("n").alias("m")))
    told = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), F.col("other").alias("other"))).alias("best"), F.first("n").alias("_n"))
    enough = -F.col("best.less") >= ratio * F.col("_n")
    told = stored(told.select(F.col("word").alias("_word"), "n_near", F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")))
    ends = roots(told.where("form is not null").select(F.col("_word").alias("word"), "form")).withColumnRenamed("word", "_at")
    rows = words.join(told, F.col("word") == F.col("_word"), "left").join(ends, F.col("word") == F.col("_at"), "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
