"""Class-based bigram language model: exchange clustering of words, scores for all documents.

log P(text) = sum over its tokens of log P(class | class before) + log P(word | class).

Texts are read once.  Each chunk of them becomes a row: its distinct words, known
by 64-bit hashes, and its line, which says for each token which of them it is.
Only distinct words leave a chunk, with sums over its tokens, so that the most
frequent word is sent once for each chunk, not once for each occurrence.

1. Words are dealt to parts by hash, which sum their counts over all training texts.
2. The ``frequent`` most frequent words are atoms, and the others fall into ``rare``
   atoms by their ending.  The exchange algorithm moves atoms between classes while
   that raises the likelihood of the training bigrams.  Only tables of atoms and
   classes (a fixed size) reach the driver.
3. Every other word that training texts hold (``least`` times or more) is then moved
   by itself: the parts know how often it stands before and behind each class, and
   put it into the class where the likelihood gains most, all other words staying
   where they are.  Unseen words are in the class of their ending.
4. Chunks ask the parts for the counts and classes of their words - the vocabulary is
   never broadcast - and keep the class of each token.  Class bigrams are counted over
   these for all training texts, and documents are scored from them.

P(word | class) = (c(word) + 1) / (N_class + V_class + 1): one count of the class
is left for words that were never seen.  P(class | before) = (n + d) / (n_before
+ d * classes).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BATCH, configured, delete_stored, lean, shuffle_partitions, stored
from tessera.llm.tokens import chunks, suffix_buckets, words_of

RARE = 255
SMOOTH = 0.1
#: Contexts of words that are weighed against all classes at once.
SLICE = 1 << 12
#: Rows of a chunk, up to some MB each, that go to a Python worker at once: all of a task's would be held twice by Spark and once by the worker.
AT_ONCE = 8
CHUNKS = "chunk long, words binary, endings binary, line binary, sizes binary, ids binary, flags binary, keys binary"
COUNTED = "kind string, hash long, count long, bucket int, n long"
COUNTS = "part int, words binary, counts binary, endings binary"
CONTEXTS = "part int, words binary, entries binary, cells binary, amounts binary"
VOCABULARY = "part int, words binary, counts binary, classes binary, n_class binary, v_class binary"
REQUESTS = "part int, chunk long, words binary, counts binary, classes binary"
CLASSED = "classes binary, sizes binary, ids binary, flags binary, keys binary, known binary, sums binary"


def _record(schema: str, rows: list[dict]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    names = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[k]) for n, k in names], [n for n, _ in names])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for k in range(b.num_rows):
            yield {name: column[k].as_py() for name, column in zip(b.schema.names, b.columns, strict=True)}


def _chunked(batches: Iterator[pa.RecordBatch], rare: int) -> Iterator[pa.RecordBatch]:
    """(key, text, train, doc_id) to one row for each chunk: its distinct words, their endings, and the texts as places of these."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for part in chunks(batch):
            number += 1
            words = words_of(part.column(1))
            known, first, line = np.unique(words.hashes, return_index=True, return_inverse=True)
            ids, train = part.column(3), part.column(2).fill_null(False).to_numpy(zero_copy_only=False).astype(np.uint8)
            yield _record(CHUNKS, [{
                "chunk": number, "words": known.tobytes(), "endings": suffix_buckets(words, rare)[first].astype(np.int32).tobytes(), "line": line.astype(np.uint32).tobytes(),
                "sizes": np.diff(words.bounds).astype(np.int64).tobytes(), "ids": ids.fill_null(0).to_numpy().astype(np.int64).tobytes(),
                "flags": (np.asarray(ids.is_null()) * 2 + train).astype(np.uint8).tobytes(), "keys": part.column(0).to_numpy().astype(np.int64).tobytes(),
            }])


def _tokens(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk: words, the line, and for each of its tokens whether its text is one to learn from."""
    sizes = np.frombuffer(row["sizes"], np.int64)
    train = np.frombuffer(row["flags"], np.uint8) % 2 == 1
    return np.frombuffer(row["words"], np.uint64), np.frombuffer(row["line"], np.uint32).astype(np.int64), np.repeat(train, sizes)


def _ended(values: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of all tokens of a chunk in one line, an end before the first and behind each text; places of the first tokens."""
    line = np.full(1 + len(values) + len(sizes), end, np.int64)
    line[1 + np.arange(len(values)) + np.repeat(np.arange(len(sizes)), sizes)] = values
    return line, np.r_[0, np.cumsum(sizes[:-1] + 1)].astype(np.int64)[: len(sizes)] + 1


def _parts(words: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, from, to) of ascending hashes."""
    group = ((words >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    return [(g, *np.searchsorted(group, [g, g + 1]).tolist()) for g in np.unique(group).tolist()]


def _occurrences(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Chunks to the training counts of their words, by part."""
    for row in _rows(batches):
        words, line, train = _tokens(row)
        count, endings = np.bincount(line[train], minlength=len(words)), np.frombuffer(row["endings"], np.int32)
        seen = count > 0
        words, count, endings = words[seen], count[seen], endings[seen]
        found = [{"part": g, "words": words[lo:hi].tobytes(), "counts": count[lo:hi].tobytes(), "endings": endings[lo:hi].tobytes()} for g, lo, hi in _parts(words, parts)]
        if found:
            yield _record(COUNTS, found)


def _summed(pieces: Iterator[tuple[np.ndarray, ...]], most: int = 1 << 18) -> tuple[np.ndarray, ...]:
    """(keys, ..., amounts) pieces to distinct keys with sums; no more than twice the distinct ones, or ``most`` and a piece, are held."""
    held, size = [], 0

    def fold() -> list[tuple[np.ndarray, ...]]:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        held.clear()
        order = np.lexsort(columns[-2::-1])
        for k, c in enumerate(columns):
            columns[k] = c[order]
        del order, c
        fresh = np.zeros(len(columns[0]), bool)
        fresh[:1] = True
        for c in columns[:-1]:
            fresh[1:] |= c[1:] != c[:-1]
        first = np.flatnonzero(fresh)
        return [(*[c[first] for c in columns[:-1]], np.add.reduceat(columns[-1], first) if len(first) else columns[-1])]

    for piece in pieces:
        held.append(piece)
        size += len(piece[0])
        if size > most:
            held += fold()
            size = len(held[0][0])
            most = max(most, 2 * size)
    return fold()[0] if held else ()


def _count(batches: Iterator[pa.RecordBatch], frequent: int, rare: int) -> Iterator[pa.RecordBatch]:
    """A part, whole: its most frequent words, and the number and the counts of words of each ending."""
    summed = _summed((np.frombuffer(r["words"], np.uint64), np.frombuffer(r["endings"], np.int32), np.frombuffer(r["counts"], np.int64)) for r in _rows(batches))
    if not summed:
        return
    words, ending, count = summed
    v, n = np.bincount(ending, minlength=rare), np.bincount(ending, weights=count, minlength=rare).astype(np.int64)
    yield _record(COUNTED, [{"kind": "ending", "bucket": b, "n": int(v[b]), "count": int(n[b])} for b in range(rare)])
    top = np.lexsort((words, -count))[:frequent]
    yield _record(COUNTED, [{"kind": "top", "hash": int(h), "count": int(c), "bucket": int(b)} for h, c, b in zip(words[top].view(np.int64), count[top], ending[top], strict=True)])


def atoms_of(words: np.ndarray, endings: np.ndarray, top: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The atom of each word: its own for the frequent ones (``top``, ascending), else that of its ending."""
    atom = endings.astype(np.int64) + len(top)
    if len(top) and len(words):
        near = np.minimum(np.searchsorted(top, words), len(top) - 1)
        known = top[near] == words
        atom[known] = ranks[near[known]]
    return atom


def _training_pairs(line: np.ndarray, sizes: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Which neighbours in a line with ends stand in a text to learn from; the end before a text belongs to it."""
    return np.repeat(flags % 2 == 1, sizes + 1)


def _bigrams(batches: Iterator[pa.RecordBatch], top, atoms: int, rare: int) -> Iterator[pa.RecordBatch]:
    """Atom bigrams of a task's training texts: those that occur."""
    total = np.zeros(atoms * atoms, np.int64)
    for row in _rows(batches):
        words, line, _ = _tokens(row)
        sizes, flags = np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["flags"], np.uint8)
        whole, _ = _ended(atoms_of(words, np.frombuffer(row["endings"], np.int32), *top.value)[line], sizes, atoms - 1)
        total += np.bincount((whole[:-1] * atoms + whole[1:])[_training_pairs(whole, sizes, flags)], minlength=atoms * atoms)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])


def _gain(x: np.ndarray, more: np.ndarray) -> np.ndarray:
    f = lambda y: np.where(y > 0, y * np.log(np.maximum(y, 1)), 0.0)
    return f(x + more) - f(x)


def exchange(counts: np.ndarray, classes: int, rounds: int = 6) -> np.ndarray:
    """A class for each atom but the last (the end, which is a class of its own), by exchange over atom bigram counts."""
    atoms = len(counts) - 1
    amount = counts.sum(axis=0) + counts.sum(axis=1)
    own = np.zeros(atoms + 1, np.int64)
    own[np.argsort(-amount[:atoms], kind="stable")] = np.arange(atoms) % classes
    own[atoms] = classes
    member = np.zeros((atoms + 1, classes + 1))
    member[np.arange(atoms + 1), own] = 1
    table = member.T @ counts @ member
    f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)
    for _ in range(rounds):
        moved = 0
        for a in np.argsort(-amount[:atoms], kind="stable"):
            if amount[a] == 0:
                continue
            here, self_ = own[a], counts[a, a]
            to, fro = counts[a] @ member, counts[:, a] @ member
            to[here] -= self_
            fro[here] -= self_
            table[here] -= to
            table[:, here] -= fro
            table[here, here] -= self_
            out, into = table.sum(axis=1)[:classes], table.sum(axis=0)[:classes]
            rows, columns = table[:classes], table[:, :classes].T
            k = np.arange(classes)
            gain = (f(rows + to) - f(rows)).sum(axis=1) + (f(columns + fro) - f(columns)).sum(axis=1)
            d = table[k, k]
            gain += f(d + to[k] + fro[k] + self_) - f(d) - (f(d + to[k]) - f(d)) - (f(d + fro[k]) - f(d))
            gain -= f(out + to.sum() + self_) - f(out) + f(into + fro.sum() + self_) - f(into)
            best = int(np.argmax(gain))
            if gain[best] <= gain[here] + 1e-9:
                best = int(here)
            table[best] += to
            table[:, best] += fro
            table[best, best] += self_
            moved += best != here
            member[a, here], member[a, best], own[a] = 0, 1, best
            if best == here:
                member[a, here] = 1
        if not moved:
            break
    return own


def best_classes(here: np.ndarray, owner: np.ndarray, cell: np.ndarray, amount: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class of each word where the likelihood gains most, all others staying where they are.

    ``here``: classes now; ``owner``, ``cell``, ``amount``: how often word ``owner`` stands
    before class ``cell``, or behind class ``cell`` - len(table); ``table``: class bigrams, the
    end's class last.  Each word's own counts are taken out of the table first.
    """
    width, classes, words = len(table), len(table) - 1, len(here)
    before = cell < width
    side = np.where(before, cell, cell - width)
    # the table as the word sees it, in the cells of its neighbours: (entries, classes)
    cells = np.where(before[:, None], table[:classes, side].T, table[side, :classes])
    mine = here[owner]
    at = np.arange(len(owner))
    cells[at, mine] = np.maximum(cells[at, mine] - amount, 0)
    gain = np.zeros((words, classes))
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
    if len(first):
        gain[owner[first]] = np.add.reduceat(_gain(cells, amount[:, None]), first, axis=0)
    to, fro = np.bincount(owner, weights=amount * before, minlength=words), np.bincount(owner, weights=amount * ~before, minlength=words)
    out, into = np.tile(table.sum(axis=1)[:classes], (words, 1)), np.tile(table.sum(axis=0)[:classes], (words, 1))
    rows = np.arange(words)
    out[rows, here], into[rows, here] = np.maximum(out[rows, here] - to, 0), np.maximum(into[rows, here] - fro, 0)
    gain -= _gain(out, to[:, None]) + _gain(into, fro[:, None])
    best = gain.argmax(axis=1)
    return np.where(gain[rows, best] > gain[rows, here] + 1e-9, best, here)


def _contexts(batches: Iterator[pa.RecordBatch], top, own: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Chunks to how often each word stands before and behind each class in training texts, by part, with its class now."""
    width = int(own[-1]) + 1
    for row in _rows(batches):
        words, line, _ = _tokens(row)
        sizes, flags = np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["flags"], np.uint8)
        now = own[atoms_of(words, np.frombuffer(row["endings"], np.int32), *top.value)]
        classes, _ = _ended(now[line], sizes, width - 1)
        tokens, _ = _ended(line, sizes, len(words))
        use = _training_pairs(classes, sizes, flags)
        keys = np.concatenate([(tokens[:-1] * (2 * width) + classes[1:])[use], (tokens[1:] * (2 * width) + width + classes[:-1])[use]])
        keys, amounts = np.unique(keys[keys < len(words) * 2 * width], return_counts=True)
        owner, cell = keys // (2 * width), keys % (2 * width)
        held, entries = np.unique(owner, return_counts=True)
        bounds = np.r_[0, np.cumsum(entries)]
        found = []
        for g, lo, hi in _parts(words[held], parts):
            inside = slice(bounds[lo], bounds[hi])
            # the class now goes with the word, above the number of its entries
            some = (now[held[lo:hi]] << 16 | entries[lo:hi]).astype(np.uint32)
            found.append({"part": g, "words": words[held[lo:hi]].tobytes(), "entries": some.tobytes(), "cells": cell[inside].astype(np.uint16).tobytes(), "amounts": amounts[inside].astype(np.uint32).tobytes()})
        if found:
            yield _record(CONTEXTS, found)


def _context_pieces(rows: Iterator[dict]) -> Iterator[tuple[np.ndarray, ...]]:
    for r in rows:
        entries = np.frombuffer(r["entries"], np.uint32)
        times = (entries & 0xFFFF).astype(np.int64)
        now = np.repeat(entries & np.uint32(0xFFFF0000), times)
        yield np.repeat(np.frombuffer(r["words"], np.uint64), times), now | np.frombuffer(r["cells"], np.uint16), np.frombuffer(r["amounts"], np.uint32).astype(np.int64)


def _place_words(batches: Iterator[pa.RecordBatch], top, table: np.ndarray, least: int, parts: int) -> Iterator[pa.RecordBatch]:
    """A part, whole: its words with counts and classes.  Frequent words are where the exchange of atoms put them."""
    summed = _summed(_context_pieces(_rows(batches)))
    if not summed:
        return
    word, code, amount = summed
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    words, owner = word[first], np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.r_[first, len(word)]))
    classes, cell = (code[first] >> 16).astype(np.int64), (code & 0xFFFF).astype(np.uint16)
    count = np.bincount(owner, weights=amount * (cell < len(table))).astype(np.int64)
    del word, code, summed
    fixed = np.isin(words, top.value[0]) | (count < least)
    free, inside = np.flatnonzero(~fixed), ~fixed[owner]
    owner, cell, amount = (np.cumsum(~fixed, dtype=np.int32) - 1)[owner[inside]], cell[inside], amount[inside]
    bounds, lo = np.searchsorted(owner, np.arange(len(free) + 1, dtype=np.int32)), 0
    while lo < len(free):
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + SLICE, side="right")) - 1)
        at = slice(bounds[lo], bounds[hi])
        classes[free[lo:hi]] = best_classes(classes[free[lo:hi]], owner[at].astype(np.int64) - lo, cell[at].astype(np.int64), amount[at].astype(np.float64), table)
        lo = hi
    v, n = np.bincount(classes, minlength=len(table)), np.bincount(classes, weights=count, minlength=len(table)).astype(np.int64)
    for k, (g, lo, hi) in enumerate(_parts(words, parts)):
        totals = {"n_class": n.tobytes(), "v_class": v.tobytes()} if k == 0 else {}
        yield _record(VOCABULARY, [{"part": g, "words": words[lo:hi].tobytes(), "counts": count[lo:hi].tobytes(), "classes": classes[lo:hi].astype(np.int16).tobytes(), **totals}])


def _requests(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        words = np.frombuffer(row["words"], np.uint64)
        found = [{"part": g, "chunk": row["chunk"], "words": words[lo:hi].tobytes()} for g, lo, hi in _parts(words, parts)]
        if found:
            yield _record(REQUESTS, found)


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of parts, the vocabulary (without a chunk) before the requests: counts and classes (-1: never seen) of the words asked for."""
    part, words = None, np.zeros(0, np.uint64)
    for r in _rows(batches):
        asked = np.frombuffer(r["words"], np.uint64)
        if r["chunk"] is None:
            part, words = r["part"], asked
            counts, classes = np.frombuffer(r["counts"], np.int64), np.frombuffer(r["classes"], np.int16)
            continue
        count, label = np.zeros(len(asked), np.int64), np.full(len(asked), -1, np.int16)
        if r["part"] == part and len(words):
            near = np.minimum(np.searchsorted(words, asked), len(words) - 1)
            known = words[near] == asked
            count[known], label[known] = counts[near[known]], classes[near[known]]
        yield _record(REQUESTS, [{"part": r["part"], "chunk": r["chunk"], "counts": count.tobytes(), "classes": label.tobytes()}])


def _classed(batches: Iterator[pa.RecordBatch], endings: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Chunks, each behind its answers in the order of their parts: the class of every token and the sums for every document."""
    counts, labels = [], []
    for r in _rows(batches):
        if r["part"] is not None:
            counts.append(np.frombuffer(r["counts"], np.int64))
            labels.append(np.frombuffer(r["classes"], np.int16))
            continue
        line = np.frombuffer(r["line"], np.uint32).astype(np.int64)
        count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        label = np.concatenate(labels).astype(np.int64) if labels else np.zeros(0, np.int64)
        counts, labels = [], []
        label = np.where(label < 0, endings[np.frombuffer(r["endings"], np.int32)], label)
        sizes = np.frombuffer(r["sizes"], np.int64)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        sums, known = np.bincount(doc, weights=np.log10(count + 1.0)[line], minlength=len(sizes)), np.bincount(doc, weights=(count > 0)[line], minlength=len(sizes)).astype(np.int64)
        yield _record(CLASSED, [{"classes": label[line].astype(np.int16).tobytes(), "known": known.tobytes(), "sums": sums.tobytes(), **{k: r[k] for k in ("sizes", "ids", "flags", "keys")}}])


def _class_bigrams(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(width * width, np.int64)
    for r in _rows(batches):
        sizes, flags = np.frombuffer(r["sizes"], np.int64), np.frombuffer(r["flags"], np.uint8)
        line, _ = _ended(np.frombuffer(r["classes"], np.int16), sizes, width - 1)
        total += np.bincount((line[:-1] * width + line[1:])[_training_pairs(line, sizes, flags)], minlength=width * width)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])


def _score(batches: Iterator[pa.RecordBatch], transition: np.ndarray, emission: np.ndarray) -> Iterator[pa.RecordBatch]:
    for r in _rows(batches):
        sizes, flags = np.frombuffer(r["sizes"], np.int64), np.frombuffer(r["flags"], np.uint8)
        line, first = _ended(np.frombuffer(r["classes"], np.int16), sizes, len(emission) - 1)
        steps = np.add.reduceat(transition[line[:-1], line[1:]] - emission[line[1:]], first - 1)
        sums = np.frombuffer(r["sums"])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.frombuffer(r["ids"], np.int64), mask=flags >= 2), pa.array(flags % 2 == 0), pa.array(sizes + 1), pa.array(np.frombuffer(r["known"], np.int64)), pa.array(sums), pa.array(sums + steps)],
            ["doc_id", "held_out", "n_tokens", "_known", "_sum", "score"],
        )


def _matrix(pairs: DataFrame, width: int) -> np.ndarray:
    """(pair, n) rows, summed, as a square table; at most width * width numbers reach the driver."""
    out = np.zeros(width * width)
    found = pairs.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(width, width)


@lean
def class_lm_scores(
    docs: DataFrame, train: Column, frequent: int = 768, rare: int = RARE, classes: int = 64, least: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    ``train`` (of ``doc_id``) says which rows the model learns from; where it is
    null they are held out.  Null texts count as empty: their only token is the
    end.  Rows that repeat are scored each; equal texts have equal scores.  Where
    nothing can be learned from (an empty table, no training rows), every count is
    0: the base is log10(1) = 0 for each token.  Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select(F.xxhash64("doc_id", "text").alias("_own"), "text", F.coalesce(train, F.lit(False)).alias("_train"), "doc_id")
    told = stored(rows.mapInArrow(partial(_chunked, rare=rare), CHUNKS))
    with configured(spark, BATCH, str(AT_ONCE)):
        return _scored(rows, told, frequent, rare, classes, least)


def _scored(rows: DataFrame, told: DataFrame, frequent: int, rare: int, classes: int, least: int) -> DataFrame:
    """Chunks of the texts of ``rows`` to scores; what is stored on the way is deleted as soon as it was read."""
    spark = rows.sparkSession
    parts = shuffle_partitions(spark)
    lines = told.select("words", "endings", "line", "sizes", "flags")

    counted = lines.mapInArrow(partial(_occurrences, parts=parts), COUNTS).repartitionById(parts, F.col("part"))
    counted = stored(counted.mapInArrow(partial(_count, frequent=frequent, rare=rare), COUNTED))
    total = counted.where("kind = 'ending'").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("count"), F.lit(0))).first()
    best = counted.where("kind = 'top'").orderBy(F.desc("count"), "hash").limit(frequent).collect()
    ends = rows.where("_train").count()
    vocabulary, tokens = total[0] + (ends > 0), total[1] + ends

    hashes = np.array([r["hash"] for r in best], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    atoms, width = len(best) + rare + 1, classes + 1
    top = spark.sparkContext.broadcast((hashes[order], order.astype(np.int64)))
    counts = _matrix(lines.mapInArrow(partial(_bigrams, top=top, atoms=atoms, rare=rare), "pair long, n long"), atoms)
    own = exchange(counts, classes)
    member = np.zeros((atoms, width))
    member[np.arange(atoms), own] = 1

    contexts = lines.mapInArrow(partial(_contexts, top=top, own=own, parts=parts), CONTEXTS).repartitionById(parts, F.col("part"))
    placed = stored(contexts.mapInArrow(partial(_place_words, top=top, table=member.T @ counts @ member, least=least, parts=parts), VOCABULARY))
    asked = told.select("chunk", "words").mapInArrow(partial(_requests, parts=parts), REQUESTS)
    known = placed.select("part", F.lit(None).cast("long").alias("chunk"), "words", "counts", "classes")
    # within a task, the words of a part come before what asks for them, and a chunk after its answers
    answers = known.union(asked).repartitionById(parts, F.col("part")).sortWithinPartitions("part", F.col("chunk").asc_nulls_first()).mapInArrow(_answers, REQUESTS)
    both = told.drop("words").unionByName(answers.drop("words"), allowMissingColumns=True).select("chunk", "part", "counts", "classes", "endings", "line", "sizes", "ids", "flags", "keys")
    classed = stored(both.repartition(parts, "chunk").sortWithinPartitions("chunk", F.col("part").asc_nulls_last()).mapInArrow(partial(_classed, endings=own[len(best) : len(best) + rare]), CLASSED))

    delete_stored(told)
    delete_stored(counted)

    table = _matrix(classed.select("classes", "sizes", "flags").mapInArrow(partial(_class_bigrams, width=width), "pair long, n long"), width)
    mass = np.zeros(width)
    for n, v in placed.where("n_class is not null").select("n_class", "v_class").toLocalIterator():
        mass += np.frombuffer(n, np.int64) + np.frombuffer(v, np.int64)
    delete_stored(placed)
    emission = np.log10(mass + 1)
    emission[classes] = 0  # the end is the only word of its class
    transition = np.log10((table + SMOOTH) / (table.sum(axis=1, keepdims=True) + SMOOTH * width))
    scored = classed.mapInArrow(partial(_score, transition=transition, emission=emission), "doc_id long, held_out boolean, n_tokens long, _known long, _sum double, score double")
    return scored.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("_known") + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("_sum") + F.lit(float(np.log10(ends + 1))) - F.col("n_tokens") * F.lit(float(np.log10(tokens + vocabulary + 1)))).alias("base_score"),
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
