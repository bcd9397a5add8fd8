"""Language of texts by a byte convolutional network.

Bytes of the lower-cased text are embedded; filters of several widths run over
fixed-length windows, the largest answer of each filter in a window is kept, and
a softmax layer tells the language from these.  The network is trained in numpy
on windows of a bounded sample of labelled rows, from everywhere in their texts,
cropped to random lengths.  Every whole text is cut into windows that overlap by
a filter's width; their probabilities, weighted by the letters in each window,
are averaged.

Embedding and filters are linear up to the maximum, so for application they are
multiplied out into one table for each pair of adjacent bytes: a filter of width
four is the sum of two rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tessera.llm.tokens import chunks, raw

#: Bytes of a window, and of the step to the next one.
WINDOW, STEP = 128, 125
WIDTHS = (2, 3, 4)
UNKNOWN = "und"
_LETTER = np.zeros(256, np.int64)
_LETTER[97:123] = _LETTER[128:] = 1


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  #: 256 x dimensions; byte 0 pads
    filters: list[np.ndarray]  #: of each width: (width * dimensions) x filters
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray


def window_places(offsets: np.ndarray, window: int = WINDOW, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length) of the windows that cover each text; the last ends with its text, and empty texts have none."""
    begin, size = offsets[:-1], np.diff(offsets)
    amount = np.where(size > 0, 1 + np.maximum(-(-(size - window) // step), 0), 0)
    owner = np.repeat(np.arange(len(size)), amount)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(amount) - amount, amount)
    start = np.minimum(begin[owner] + place * step, np.maximum(begin + size - window, begin)[owner])
    return owner, start, np.minimum(size[owner], window)


def cut_windows(padded: np.ndarray, start: np.ndarray, length: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Windows as rows of bytes, zeros behind short ones.  ``padded``: a window of bytes follows the last text."""
    x = padded[start[:, None] + np.arange(window)]
    if (length < window).any():
        x = np.where(np.arange(window) < length[:, None], x, 0)
    return x


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(x: np.ndarray, labels: list[str], steps: int = 1000, batch: int = 128, dimensions: int = 8, filters: int = 16, rate: float = 0.01, seed: int = 11) -> Network:
    """Adam on the cross entropy of windows (rows of bytes); each language is drawn equally often, half of the windows cropped."""
    languages = sorted(set(labels))
    y = np.searchsorted(languages, labels)
    rng = np.random.default_rng(seed)
    of = [np.flatnonzero(y == k) for k in range(len(languages))]
    p = {"e": rng.normal(0, 0.5, (256, dimensions)), "b": np.zeros(len(WIDTHS) * filters), "c": np.zeros(len(languages))}
    p |= {f"w{w}": rng.normal(0, 1 / np.sqrt(w * dimensions), (w * dimensions, filters)) for w in WIDTHS}
    p["d"] = rng.normal(0, 0.1, (len(WIDTHS) * filters, len(languages)))
    p = {k: v.astype(np.float32) for k, v in p.items()}
    p["e"][0] = 0
    first, second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    length = (x > 0).sum(axis=1)
    for step in range(1, steps + 1):
        rows = np.array([rng.choice(of[k]) for k in rng.integers(0, len(languages), batch)])
        size = length[rows]
        most = np.where(rng.random(batch) < 0.5, size, np.minimum(size, rng.integers(6, WINDOW, batch)))
        shift = rng.integers(0, size - most + 1)
        padded = np.concatenate([x[rows], np.zeros((batch, WINDOW), x.dtype)], axis=1)
        z = np.take_along_axis(padded, shift[:, None] + np.arange(WINDOW), axis=1)
        z[np.arange(WINDOW) >= most[:, None]] = 0
        e = p["e"][z]
        columns, places, tops = {}, {}, []
        for w in WIDTHS:
            columns[w] = np.concatenate([e[:, j : WINDOW - w + 1 + j] for j in range(w)], axis=2)
            answers = columns[w] @ p[f"w{w}"]
            places[w] = answers.argmax(axis=1)
            tops.append(np.take_along_axis(answers, places[w][:, None], axis=1)[:, 0])
        before = np.concatenate(tops, axis=1) + p["b"]
        kept = np.maximum(before, 0)
        wrong = softmax(kept @ p["d"] + p["c"])
        wrong[np.arange(batch), y[rows]] -= 1
        wrong /= batch
        g = {"d": kept.T @ wrong, "c": wrong.sum(axis=0)}
        back = (wrong @ p["d"].T) * (before > 0)
        g["b"], g["e"] = back.sum(axis=0), np.zeros_like(p["e"])
        for k, w in enumerate(WIDTHS):
            own, at = back[:, k * filters : (k + 1) * filters], places[w]
            picked = columns[w][np.arange(batch)[:, None], at]  # batch x filters x (w * dimensions)
            g[f"w{w}"] = np.einsum("bfi,bf->if", picked, own)
            for j in range(w):
                np.add.at(g["e"], z[np.arange(batch)[:, None], at + j], own[:, :, None] * p[f"w{w}"].T[None, :, j * dimensions : (j + 1) * dimensions])
        g["e"][0] = 0
        for k, v in p.items():
            first[k] = 0.9 * first[k] + 0.1 * g[k]
            second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
            slower = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            v -= slower * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Network(languages, p["e"], [p[f"w{w}"] for w in WIDTHS], p["b"], p["d"], p["c"])


class Scorer:
    """A network with its filters multiplied out over pairs of bytes."""

    def __init__(self, net: Network):
        self.net, d = net, net.embedding.shape[1]
        single = lambda w, j: (net.embedding @ w[j * d : (j + 1) * d]).astype(np.float32)
        pair = lambda w, j: (single(w, j)[:, None] + single(w, j + 1)[None]).reshape(1 << 16, -1)
        two, three, four = net.filters
        self.two, self.three, self.third, self.four, self.last = pair(two, 0), pair(three, 0), single(three, 2), pair(four, 0), pair(four, 2)

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the languages for each row of bytes."""
        codes = (x[:, :-1].astype(np.intp) << 8) | x[:, 1:]
        tops = [self.two[codes].max(axis=1), (self.three[codes[:, :-1]] + self.third[x[:, 2:]]).max(axis=1), (self.four[codes[:, :-2]] + self.last[codes[:, 2:]]).max(axis=1)]
        kept = np.maximum(np.concatenate(tops, axis=1) + self.net.bias, 0)
        # summed row by row, so that equal windows have equal answers in whatever block
        return softmax((kept[:, :, None] * self.net.dense).sum(axis=1) + self.net.offset)

    def texts(self, texts: pa.Array, block: int = 192) -> np.ndarray:
        """Mean probabilities of the windows of each text, weighted by their letters; zeros for texts without letters."""
        data, offsets = raw(texts)
        owner, start, length = window_places(offsets)
        padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
        letters = np.r_[0, np.cumsum(_LETTER[data])]
        weight = (letters[start + length] - letters[start]).astype(np.float64)
        total = np.zeros((len(offsets) - 1, len(self.net.languages)))
        for at in range(0, len(owner), block):
            own = owner[at : at + block]
            found = self.windows(cut_windows(padded, start[at : at + block], length[at : at + block])) * weight[at : at + block, None]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            total[own[first]] += np.add.reduceat(found, first, axis=0)
        return total / np.maximum(np.bincount(owner, weights=weight, minlength=len(total)), 1)[:, None]


def labelled_windows(docs: DataFrame, learn: Column, per_language: int = 1024, max_labelled: int = 8192, per_text: int = 4) -> tuple[np.ndarray, list[str]]:
    """Windows to train on, and their languages: about ``per_language`` texts of each language, at most ``max_labelled`` in all.

    Which texts is decided by hashes of identifiers; of each, ``per_text``
    windows spread over the whole text are taken.
    """
    spark = docs.sparkSession
    known = docs.select("doc_id", F.col("lang").cast("string").alias("_lang"), learn.alias("_learn")).where("_learn and _lang is not null and doc_id is not null")
    shares = known.groupBy("_lang").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "_lang").limit(max_labelled).collect()  # one row for each language
    if not shares:
        return np.zeros((0, WINDOW), np.uint8), []
    cuts = spark.createDataFrame([(r["_lang"], min(1.0, per_language / r["_n"])) for r in shares], "_of string, _share double")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003))
    drawn = known.join(F.broadcast(cuts), F.col("_lang") == F.col("_of")).where(place < F.col("_share") * 1_000_003)
    chosen = drawn.groupBy("doc_id").agg(F.min("_lang").alias("_lang")).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(max_labelled)
    picked = spark.createDataFrame(chosen.select(F.col("doc_id").alias("_id"), "_lang").collect(), "_id long, _lang string" if dict(docs.dtypes)["doc_id"] != "string" else "_id string, _lang string")
    texts = docs.select(F.col("doc_id").alias("_d"), F.lower("text").alias("text")).join(F.broadcast(picked), F.col("_d") == F.col("_id"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 0):
                data, offsets = raw(part.column(0))
                owner, start, length = window_places(offsets)
                padded, rows = np.concatenate([data, np.zeros(WINDOW, np.uint8)]), []
                bounds = np.searchsorted(owner, np.arange(len(offsets)))
                for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    some = np.unique(np.linspace(lo, hi - 1, min(per_text, hi - lo)).astype(np.int64)) if hi > lo else np.zeros(0, np.int64)
                    rows.append(cut_windows(padded, start[some], length[some]).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(rows, pa.binary())], ["id", "lang", "x"])

    found = texts.select("text", F.col("_id").cast("string"), "_lang").mapInArrow(windows, "id string, lang string, x binary")
    # rows that repeat an identifier give one row
    rows = found.groupBy("id").agg(F.min("x").alias("x"), F.first("lang").alias("lang")).orderBy("id").collect()  # at most max_labelled
    x = np.frombuffer(b"".join(r["x"] for r in rows), np.uint8).reshape(-1, WINDOW)
    labels = [r["lang"] for r in rows for _ in range(len(r["x"]) // WINDOW)]
    told = _LETTER[x].sum(axis=1) >= 6
    return x[told], [lang for lang, there in zip(labels, told.tolist(), strict=True) if there]


def identify_languages(docs: DataFrame, learn: Column, per_language: int = 1024, max_labelled: int = 8192, steps: int = 1000, pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """All columns of the documents and two more: the language and its probability.

    ``docs`` has doc_id, text and lang; ``learn`` tells, of doc_id, from which
    rows to learn.  Rows without language or identifier are not learned from.
    Only texts are looked at for a prediction: equal texts have equal ones.  Null
    texts and texts without a letter are ``und`` with the score 0; so is
    every text where there is nothing to learn from.  Of equally likely languages
    the first by name is taken.  Columns keep their names and types; a
    column that has the name of one of the two is an error.  An empty table gives
    an empty result.
    """
    if clash := {pred_col, score_col} & set(docs.columns):
        raise ValueError(f"documents have a column {sorted(clash)}: give pred_col and score_col other names")
    x, labels = labelled_windows(docs, learn, per_language, max_labelled)
    net = train(x, labels, steps) if labels else None
    shared = docs.sparkSession.sparkContext.broadcast(net)
    names, columns = docs.columns, len(docs.columns)
    schema = StructType([*docs.schema.fields, StructField(pred_col, StringType()), StructField(score_col, DoubleType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value else None
        for batch in batches:
            for part in chunks(batch, columns):
                told, score = np.zeros(part.num_rows, bool), np.zeros(part.num_rows)
                best = np.zeros(part.num_rows, np.int64)
                if scorer:
                    p = np.round(scorer.texts(part.column(columns)), 6)
                    best, score = p.argmax(axis=1), p.max(axis=1)
                    told = part.column(columns + 1).to_numpy(zero_copy_only=False).astype(bool)
                languages = pa.array([shared.value.languages[b] if t else UNKNOWN for b, t in zip(best.tolist(), told.tolist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:columns], languages, pa.array(np.where(told, score, 0.0))], names=[*names, pred_col, score_col])

    lettered = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    low, has = [n for n in (f"_{k}" for k in range(columns + 2)) if n not in names][:2]
    return docs.select(*names, F.lower("text").alias(low), lettered.alias(has)).mapInArrow(predict, schema)
