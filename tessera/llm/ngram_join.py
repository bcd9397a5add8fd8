"""Jaccard self-join of documents on word n-grams by T-occurrence search.

Two documents of n and m distinct shingles link when 100 * I >= percent * U.
Their overlap then reaches T = ceil(percent * n / 100) for either of them, so a
partner occurs in at least T of a document's inverted lists.

1. Documents with the same shingle set are one class; only classes are joined.
2. Shingles are dealt to parts by hash.  A part holds whole inverted lists, so
   it knows each shingle's exact document frequency; shingles of one class only
   are dropped, as they can't be shared.
3. A class that keeps fewer than T shingles has no partner.  The others ("open"
   classes) keep their shared shingles, rarest first.
4. DivideSkip: open classes meet in blocks (equal minima under a hash of the
   shingles; large blocks are dealt into parts of ``BLOCK``).  A block builds its
   inverted lists; for each class, the longest lists are set aside, the short
   ones are merged with a heap, and what occurs often enough in them is probed
   for in the long ones by binary search.  Links go through a union-find in the
   block, and a distributed union-find joins the blocks.
5. Several rounds of blocks leave few links open; those are found exactly: with
   T occurrences among f shared shingles, two linked classes have one in common
   among the f - T + 1 rarest of each.  Shingles there that occur in more than
   one component give candidates across components; those of one class are
   searched together, again by DivideSkip, which alone decides what links.
   So no link between different texts is lost, and pairs inside a component are
   never written out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, shuffle_partitions, stored
from tessera.llm.components import components
from tessera.llm.tokens import chunks, mix, shingle_sets, words_of

BLOCK = 48
#: Candidates of a query that are looked up at once.
LOOKED_UP = 256
ROUNDS = 3
LISTS = "part int, keys binary, sizes binary, counts binary, hashes binary"
OPEN = "key long, n int, shingles binary, " + ", ".join(f"m{r} long" for r in range(ROUNDS))


def required(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def linked(overlap: int, n: int, m: int, percent: int) -> bool:
    return overlap > 0 and 100 * overlap >= percent * (n + m - overlap)


def set_key(shingles: np.ndarray) -> int:
    """64 bits that tell shingle sets apart."""
    with np.errstate(over="ignore"):
        total = mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def _groups(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            found = shingle_sets(words_of(part.column(1)), width)
            keys = pa.array([set_key(s) if len(s) else None for s in found], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in found], pa.int64()), keys], ["doc_id", "n_shingles", "_key"])


def _rows(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32()] + [pa.binary()] * (len(names) - 1)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def posted(sets: dict[int, np.ndarray], parts: int) -> Iterator[pa.RecordBatch]:
    """Sets by key to (part, keys, sizes, counts, hashes): what each part gets of them."""
    if not sets:
        return
    keys, sizes = np.array(list(sets), np.int64), np.array([len(s) for s in sets.values()], np.uint32)
    hashes = np.concatenate(list(sets.values()))
    owner, group = np.repeat(np.arange(len(keys)), sizes), _groups(hashes, parts)
    order = np.argsort(group, kind="stable")
    hashes, owner, group = hashes[order], owner[order], group[order]
    rows = []
    for g in np.unique(group).tolist():
        lo, hi = np.searchsorted(group, [g, g + 1])
        own, count = np.unique(owner[lo:hi], return_counts=True)
        rows.append((g, keys[own].tobytes(), sizes[own].tobytes(), count.astype(np.uint32).tobytes(), hashes[lo:hi].tobytes()))
    yield _rows(["part", "keys", "sizes", "counts", "hashes"], rows)


def _postings(batches: Iterator[pa.RecordBatch], parts: int, width: int) -> Iterator[pa.RecordBatch]:
    """Texts to the shingles of each chunk's classes, by part."""
    for batch in batches:
        for part in chunks(batch):
            yield from posted({set_key(s): s for s in shingle_sets(words_of(part.column(1)), width) if len(s)}, parts)


def _whole(batches: Iterator[pa.RecordBatch], kinds: list) -> list[np.ndarray]:
    """All rows of a task: its binary columns (behind the first), each in one array."""
    found = [[] for _ in kinds]
    for b in batches:
        for k, kind in enumerate(kinds):
            found[k] += [np.frombuffer(x.as_buffer(), kind) for x in b.column(k + 1)]
    return [np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(found, kinds, strict=True)]


def _shared(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Whole parts of inverted lists to the shingles that more than one class has, by class."""
    keys, sizes, counts, hashes = _whole(batches, [np.int64, np.uint32, np.uint32, np.uint64])
    if not len(keys):
        return
    # a class that several chunks have comes once for each; part by part its entries are alike
    starts = np.r_[0, np.cumsum(counts[:-1], dtype=np.int64)]
    _, first = np.unique(np.stack([keys, hashes[starts].view(np.int64)], axis=1), axis=0, return_index=True)
    once = np.zeros(len(keys), bool)
    once[first] = True
    owner = np.repeat(np.arange(len(keys)), counts)
    inside = once[owner]
    hashes, owner = hashes[inside], owner[inside]
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    begin = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    amount = np.diff(np.r_[begin, len(ordered)])
    frequency = np.empty(len(hashes), np.uint32)
    frequency[order] = np.repeat(amount, amount)
    several = frequency > 1
    hashes, owner, frequency = hashes[several], owner[several], frequency[several]
    own, count = np.unique(owner, return_counts=True)  # entries of a class are together
    if not len(own):
        return
    to = _groups(keys[own].view(np.uint64), parts)
    place = np.repeat(to, count)
    for g in np.unique(to).tolist():
        mine, at = to == g, place == g
        yield _rows(
            ["part", "keys", "sizes", "counts", "hashes", "frequencies"],
            [(g, keys[own[mine]].tobytes(), sizes[own[mine]].tobytes(), count[mine].astype(np.uint32).tobytes(), hashes[at].tobytes(), frequency[at].tobytes())],
        )


def _open(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Classes, whole: those whose shared shingles reach T, with them in order from the rarest."""
    keys, sizes, counts, hashes, frequencies = _whole(batches, [np.int64, np.uint32, np.uint32, np.uint64, np.uint32])
    if not len(keys):
        return
    classes, back = np.unique(keys, return_inverse=True)
    total = np.bincount(back, weights=counts).astype(np.int64)
    size = np.zeros(len(classes), np.int64)
    size[back] = sizes
    alive = (total * 100 >= percent * size) & (total > 0)
    owner = np.repeat(back, counts)
    inside = alive[owner]
    hashes, frequencies, owner = hashes[inside], frequencies[inside], owner[inside]
    order = np.lexsort((hashes, frequencies, owner))
    hashes, owner = hashes[order], owner[order]
    bounds = np.searchsorted(owner, np.arange(len(classes) + 1))
    rows = [(int(classes[c]), int(size[c]), hashes[bounds[c] : bounds[c + 1]]) for c in np.flatnonzero(alive)]
    for at in range(0, len(rows), 1000):
        some = rows[at : at + 1000]
        minima = [[int(mix(s ^ mix(np.array([r + 1], np.uint64))).min().view(np.int64)) for _, _, s in some] for r in range(ROUNDS)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in some], pa.int64()), pa.array([r[1] for r in some], pa.int32()), pa.array([r[2].tobytes() for r in some], pa.binary()), *[pa.array(m, pa.int64()) for m in minima]],
            ["key", "n", "shingles", *[f"m{r}" for r in range(ROUNDS)]],
        )


def divide_skip(sets: list[np.ndarray], sizes: list[int], percent: int) -> list[tuple[int, int]]:
    """Links between sets of a block that join its components (a spanning forest of all links).

    ``sets``: distinct shingles of each, those of at least T shared ones; ``sizes``: of the full sets.
    """
    known, back = np.unique(np.concatenate(sets), return_inverse=True)
    edges = np.r_[0, np.cumsum([len(s) for s in sets])]
    ids = [np.sort(back[lo:hi]) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
    owner = np.repeat(np.arange(len(sets)), np.diff(edges))
    order = np.argsort(back, kind="stable")
    lists, bounds = owner[order], np.searchsorted(back[order], np.arange(len(known) + 1))
    length = np.diff(bounds)
    parent = list(range(len(sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for q, own in enumerate(ids):
        least = required(sizes[q], percent)
        if len(own) < least:
            continue
        by_length = own[np.argsort(length[own], kind="stable")]
        enough = max(1, least // 20)  # what the short lists have to show
        short, long = by_length[: len(own) - least + enough], np.sort(by_length[len(own) - least + enough :])
        merged = heapq.merge(*[lists[bounds[s] : bounds[s + 1]].tolist() for s in short.tolist() if length[s] > 1])
        seen: dict[int, int] = {}
        for d in merged:
            seen[d] = seen.get(d, 0) + 1
        for d, n in seen.items():
            if n < enough or d >= q or find(d) == find(q) or 100 * min(sizes[d], sizes[q]) < percent * max(sizes[d], sizes[q]):
                continue
            at = np.minimum(np.searchsorted(ids[d], long), len(ids[d]) - 1)
            if linked(n + int((ids[d][at] == long).sum()), sizes[q], sizes[d], percent):
                out.append((q, d))
                parent[find(q)] = find(d)
    return out


def _search(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(block, key, n, shingles), whole blocks: links."""
    blocks: dict[tuple, list] = {}
    for b in batches:
        for minimum, salt, key, n, shingles in zip(*[b.column(k).to_pylist() for k in range(5)], strict=True):
            blocks.setdefault((minimum, salt), []).append((key, n, np.frombuffer(shingles, np.uint64)))
    for rows in blocks.values():
        if len(rows) > 1:
            rows.sort(key=lambda r: r[0])
            found = divide_skip([r[2] for r in rows], [r[1] for r in rows], percent)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([rows[q][0] for q, _ in found], pa.int64()), pa.array([rows[d][0] for _, d in found], pa.int64())], ["a", "b"])


def _prefixes(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(key, root, n, shingles) to the f - T + 1 rarest shingles, with how many follow each."""
    for b in batches:
        for key, root, n, shingles in zip(*[b.column(k).to_pylist() for k in range(4)], strict=True):
            s = np.frombuffer(shingles, np.int64)
            p = len(s) - required(n, percent) + 1
            rest = len(s) - np.arange(p)
            yield pa.RecordBatch.from_arrays(
                [pa.array(s[:p]), pa.array(np.full(p, key)), pa.array(np.full(p, root)), pa.array(np.full(p, n), pa.int32()), pa.array(rest, pa.int32())], ["shingle", "key", "root", "n", "rest"]
            )


def t_occurrence(query: np.ndarray, size: int, sets: list[np.ndarray], sizes: list[int], percent: int) -> list[int]:
    """Which of ``sets`` link with a query set: DivideSkip over their inverted lists.

    A partner has at least T of the query's shingles.  The T - t longest lists
    are set aside, so it is at least t times in the short ones, which are merged;
    those that are get their long shingles counted by binary search.  (Fewer than
    T shared shingles are no answer, whatever the order of the lists.)
    """
    least = required(size, percent)
    query = np.unique(query)
    places = [np.searchsorted(query, s[np.isin(s, query, assume_unique=True)]) for s in sets]
    owner = np.repeat(np.arange(len(sets)), [len(p) for p in places])
    at = np.concatenate(places) if places else np.zeros(0, np.int64)
    order = np.argsort(at, kind="stable")
    lists, bounds = owner[order], np.searchsorted(at[order], np.arange(len(query) + 1))
    by_length = np.argsort(np.diff(bounds), kind="stable")
    enough = max(1, least // 20)
    cut_at = max(0, len(query) - least + enough)
    short, long = by_length[:cut_at], np.sort(by_length[cut_at:])
    seen: dict[int, int] = {}
    for d in heapq.merge(*[lists[bounds[s] : bounds[s + 1]].tolist() for s in short.tolist()]):
        seen[d] = seen.get(d, 0) + 1
    out = []
    for d, n in seen.items():
        if n >= enough:
            own = np.sort(places[d])
            to = np.minimum(np.searchsorted(own, long), max(len(own) - 1, 0))
            if linked(n + int((own[to] == long).sum()), size, sizes[d], percent):
                out.append(d)
    return sorted(out)


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(ra, rb, n, m, s, t, b), rows of one query b together: the links between the components."""
    for batch in batches:
        ra, rb, n, m, s, t, b = (batch.column(k).to_pylist() for k in range(7))
        keep, lo = [], 0
        for hi in range(1, len(b) + 1):
            if hi == len(b) or b[hi] != b[lo] or hi - lo == LOOKED_UP:
                candidates = [np.frombuffer(x, np.uint64) for x in s[lo:hi]]
                keep += [lo + k for k in t_occurrence(np.frombuffer(t[lo], np.uint64), m[lo], candidates, n[lo:hi], percent)]
                lo = hi
        yield pa.RecordBatch.from_arrays([pa.array([ra[k] for k in keep], pa.int64()), pa.array([rb[k] for k in keep], pa.int64())], ["a", "b"])


def linked_sets(lists: DataFrame, percent: int) -> DataFrame:
    """``posted`` sets, dealt to as many parts as there are shuffle partitions, to (node, top) of all that link with another: the smallest key of its component."""
    parts = shuffle_partitions(lists.sparkSession)
    opened = stored(
        lists.repartitionById(parts, F.col("part"))
        .mapInArrow(partial(_shared, parts=parts), LISTS + ", frequencies binary")
        .repartitionById(parts, F.col("part"))
        .mapInArrow(partial(_open, percent=percent), OPEN)
    )
    found = None
    for r in range(ROUNDS):
        sizes = cut(opened.groupBy(f"m{r}").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").withColumnRenamed(f"m{r}", "_m"))
        salt = F.pmod(F.xxhash64("key", F.lit(r)), F.ceil(F.col("_n") / BLOCK))
        blocks = opened.select(F.col(f"m{r}").alias("m"), "key", "n", "shingles").join(sizes, F.col("m") == F.col("_m")).select("m", salt.alias("salt"), "key", "n", "shingles")
        links = blocks.repartition(parts, "m", "salt").mapInArrow(partial(_search, percent=percent), "a long, b long")
        found = links if found is None else found.union(links)
    labels = components(found)

    placed = opened.join(labels, F.col("key") == F.col("node"), "left").select("key", F.coalesce("root", "key").alias("root"), "n", "shingles")
    prefixes = placed.mapInArrow(partial(_prefixes, percent=percent), "shingle long, key long, root long, n int, rest int")
    mixed = cut(prefixes.groupBy("shingle").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo < _hi").select(F.col("shingle").alias("_shingle")))
    across = cut(prefixes.join(mixed, F.col("shingle") == F.col("_shingle")).drop("_shingle"))
    x, y = across.alias("x"), across.alias("y")
    fits = (
        (F.col("x.shingle") == F.col("y.shingle"))
        & (F.col("x.root") < F.col("y.root"))
        & (F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent)
        & (F.least("x.rest", "y.rest") * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent)
    )
    pairs = cut(x.join(y, fits).select(F.col("x.key").alias("a"), F.col("y.key").alias("b"), F.col("x.root").alias("ra"), F.col("y.root").alias("rb")).distinct())
    of = opened.select("key", "n", "shingles")
    first, second = of.toDF("_a", "n", "s"), of.toDF("_b", "m", "t")
    both = pairs.join(first, F.col("a") == F.col("_a")).join(second, F.col("b") == F.col("_b"))
    late = both.select("ra", "rb", "n", "m", "s", "t", "b").mapInArrow(partial(_verify, percent=percent), "a long, b long")
    merged = components(late).toDF("_root", "_top")
    # two joins that can be split at a hot root, in place of a full one that can't
    known = labels.join(merged, F.col("root") == F.col("_root"), "left").select("node", F.coalesce("_top", "root").alias("top"))
    return known.union(merged.join(labels, F.col("_root") == F.col("node"), "left_anti").toDF("node", "top"))


def ngram_components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    Null, empty and blank texts have no shingles, link with nothing and are their
    own component.  Fewer words than ``width`` are one shingle.  Null identifiers
    take part but never name a component unless nothing else is in it (then the
    component is null).  Repeated rows are one class and get a row each; other
    columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sets = cut(rows.mapInArrow(partial(_sets, width=width), "doc_id long, n_shingles long, _key long"))
    texts = rows.select(F.lit(0).alias("_"), "text")
    tops = cut(linked_sets(texts.mapInArrow(partial(_postings, parts=parts, width=width), LISTS), percent))

    owned = cut(sets.join(tops, F.col("_key") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("top", "_key").alias("_top")))
    names = cut(owned.where("_top is not null").groupBy("_top").agg(F.min("doc_id").alias("component_id")).withColumnRenamed("_top", "_name"))
    return owned.join(names, F.col("_top") == F.col("_name"), "left").select(
        "doc_id", "n_shingles", F.when(F.col("_top").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns kept, with one of each component: the one whose identifier names it.

    Identifiers should be unique; rows that share one stay or go together.
    Documents without an identifier stay only where their component has none.
    """
    told = ngram_components(docs, width, percent, id_col, text_col).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = told.select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, docs[id_col].cast("long").eqNullSafe(kept["__kept"]), "left_semi")
