"""Text quality by nearest-neighbour voting among labelled latent-semantic vectors.

Every whole text becomes counts of hashed byte trigrams, damped and weighted by
rarity, beside a few shares that tell its shape (repeated words, capitals,
symbols, digits, length), and is projected to a few latent dimensions.  Without
the shares a text that says one thing over and over looks like any other: of 990
held-out labelled documents 35 are misjudged then, in place of 3 (README).  The projection and the
labelled vectors come from a bounded sample of labelled rows (``max_labelled``),
so both can be broadcast whatever the size of the corpus.  Each document is
compared with every labelled vector by exact cosine, in blocks, and its nearest
neighbours vote with their similarity.

Weights, projection and vectors are whole numbers in double precision, small
enough for every sum of products to be exact.  So a text's score doesn't depend
on the block it is scored in, and equally similar neighbours are truly equal:
all that are as near as the last one vote.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tessera.llm.tokens import chunks, mix, words_of

FEATURES, SHAPES = 2048, 6
#: Length of the shape shares against the trigrams' unit length.
SHAPE_WEIGHT = 2.0
_UPPER, _DIGIT, _SYMBOL = np.zeros(256), np.zeros(256), np.zeros(256)
_UPPER[65:91] = _DIGIT[48:58] = 1
_SYMBOL[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
#: Steps of 1 in which weights, projection and vectors are counted.
GRAIN = 1 << 12
#: Labelled rows that are weighed at once.
FITTED = 256
#: Parts of a model, doubles all, with their shapes.
MODEL = {"idf": (-1,), "projection": (FEATURES + SHAPES, -1), "vectors": (-1,), "labels": (-1,)}


def text_features(texts: pa.Array, features: int = FEATURES) -> np.ndarray:
    """Damped counts (texts x features) of hashed byte trigrams within each text, then SHAPES shares of each; texts of under three bytes have none of either."""
    words = words_of(texts)
    data, offsets = words.data, words.offsets
    n = len(offsets) - 1
    if len(data) < 3:
        return np.zeros((n, features + SHAPES), np.float32)
    table = (mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(7)) % np.uint64(features)).astype(np.uint32)
    wide = data.astype(np.uint32)
    codes = table[(wide[:-2] << 8) | wide[1:-1]] + wide[2:] * np.uint32(269)
    codes %= np.uint32(features)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    within = owner[:-2] == owner[2:]
    flat = owner[:-2] * features + codes
    counts = np.bincount(flat[within], minlength=n * features).reshape(n, features)

    size = np.maximum(np.diff(offsets), 1)
    amount = np.diff(words.bounds)
    of = np.repeat(np.arange(n), amount)
    follows, again = np.zeros(len(of), bool), np.zeros(len(of), bool)
    follows[1:] = (words.hashes[1:] == words.hashes[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((words.hashes, of))
    again[1:] = (words.hashes[order][1:] == words.hashes[order][:-1]) & (of[order][1:] == of[order][:-1])
    share = lambda mask, whose, base: np.bincount(whose, weights=mask, minlength=n) / np.maximum(base, 1)
    shapes = [share(follows, of, amount), share(again, of[order], amount), *[share(kind[data], owner, size) for kind in (_UPPER, _SYMBOL, _DIGIT)], np.minimum(np.log1p(size) / 20, 1) * 0.3]
    told = (np.diff(offsets) >= 3)[:, None]
    return np.concatenate([np.log1p(counts), np.stack(shapes, axis=1) * told], axis=1).astype(np.float32)


def _grains(x: np.ndarray) -> np.ndarray:
    """Rows of unit length, in whole steps; rows of zeros stay."""
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.rint(x / np.where(length > 0, length, 1) * GRAIN)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    shapes = np.rint(counts[:, -SHAPES:].astype(np.float64) * (SHAPE_WEIGHT * GRAIN))
    return np.concatenate([_grains(counts[:, :-SHAPES].astype(np.float64) * idf), shapes], axis=1)


def latent(x: np.ndarray, projection: np.ndarray) -> np.ndarray:
    return _grains(x @ projection)


def fit(counts: np.ndarray, labels: np.ndarray, dimensions: int = 64) -> dict[str, np.ndarray]:
    """Rarity weights, projection and labelled vectors.

    Rows are weighed in blocks: their sums of products are exact, whatever the
    blocks, and the driver never holds all weighted rows.
    """
    blocks = [slice(lo, lo + FITTED) for lo in range(0, len(counts), FITTED)]
    seen = sum(((counts[b, :-SHAPES] > 0).sum(axis=0) for b in blocks), np.zeros(counts.shape[1] - SHAPES, np.int64))
    idf = np.log((1 + len(counts)) / (1 + seen)) + 1
    products = np.zeros((counts.shape[1], counts.shape[1]))
    for b in blocks:
        x = weighted(counts[b], idf)
        products += x.T @ x
    values, vectors = np.linalg.eigh(products) if blocks else (np.zeros(1), np.zeros((counts.shape[1], 1)))
    projection = np.ascontiguousarray(np.rint(vectors[:, ::-1][:, :dimensions] * GRAIN))
    told = [latent(weighted(counts[b], idf), projection) for b in blocks]
    return {"idf": idf, "projection": projection, "vectors": np.concatenate([np.zeros((0, projection.shape[1])), *told]), "labels": labels.astype(np.float64)}


def nearest(similar: np.ndarray, k: int) -> np.ndarray:
    """Whether each column is among the k largest of its row, or equal to the k-th."""
    return similar >= np.partition(similar, similar.shape[1] - k, axis=1)[:, similar.shape[1] - k :][:, :1]


def vote(counts: np.ndarray, model: dict[str, np.ndarray], neighbours: int = 25, power: float = 8.0) -> np.ndarray:
    """Share of the label 1 among the nearest labelled vectors, weighted by similarity; texts without features and without similar neighbours: the overall share."""
    labels, vectors = model["labels"], model["vectors"]
    if len(labels) == 0:
        return np.zeros(len(counts))
    z = latent(weighted(counts, model["idf"]), model["projection"])
    similar = np.maximum(z @ vectors.T, 0) / GRAIN**2
    weight = np.where(nearest(similar, min(neighbours, len(labels))), similar, 0) ** power
    total = weight.sum(axis=1)
    share = (weight * labels).sum(axis=1) / np.where(total > 0, total, 1)
    return np.where((total > 0) & (counts > 0).any(axis=1), share, labels.mean()).clip(0, 1)


def labelled_model(docs: DataFrame, labels: DataFrame, learn: Column, max_labelled: int = 4096, dimensions: int = 64) -> dict[str, np.ndarray]:
    """Fit on at most ``max_labelled`` labelled rows for which ``learn`` (of doc_id) holds: those of the smallest id hash.

    Null labels and identifiers are left out; several labels of one document are averaged.
    """
    chosen = (
        labels.select(F.col("doc_id").alias("_labelled"), F.col("quality").cast("double").alias("_quality"))
        .where(F.col("_labelled").isNotNull() & F.col("_quality").isNotNull())
        .groupBy("_labelled")
        .agg(F.avg("_quality").alias("_quality"))
    )
    chosen = chosen.withColumn("doc_id", F.col("_labelled")).where(learn).drop("doc_id").orderBy(F.xxhash64("_labelled"), "_labelled").limit(max_labelled)
    rows = chosen.collect()  # at most max_labelled
    picked = docs.sparkSession.createDataFrame(rows, chosen.schema)
    texts = docs.select(F.col("doc_id").alias("_labelled"), F.col("text").alias("text")).join(F.broadcast(picked), "_labelled")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 0):
                x = [f.astype(np.float16).tobytes() for f in text_features(part.column(0))]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(x, pa.binary()), part.column(2)], ["id", "x", "y"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches), pa.schema([("id", pa.string()), ("x", pa.binary()), ("y", pa.float64())]))
        if whole.num_rows:
            counts = np.frombuffer(b"".join(whole.column("x").to_pylist()), np.float16).reshape(whole.num_rows, FEATURES + SHAPES)
            model = fit(counts, whole.column("y").to_numpy(), dimensions)
            yield pa.RecordBatch.from_arrays([pa.array([model[k].tobytes()], pa.binary()) for k in MODEL], list(MODEL))

    # rows that repeat an identifier give one row, whatever their number: that of the smallest features
    found = texts.select("text", F.col("_labelled").cast("string"), "_quality").mapInArrow(features, "id string, x binary, y double")
    rows = found.groupBy("id").agg(F.min("x").alias("x"), F.first("y").alias("y"))
    # at most max_labelled rows, fitted on an executor: the driver's memory holds the model alone
    told = rows.repartition(1).sortWithinPartitions("id").mapInArrow(fitted, ", ".join(f"{k} binary" for k in MODEL)).collect()
    if not told:
        return fit(np.zeros((0, FEATURES + SHAPES), np.float16), np.zeros(0), dimensions)
    model = {k: np.frombuffer(told[0][k]).reshape(shape) for k, shape in MODEL.items()}
    return model | {"vectors": model["vectors"].reshape(len(model["labels"]), -1)}


def score_quality(
    docs: DataFrame, labels: DataFrame, learn: Column, threshold: float = 0.7, max_labelled: int = 4096, neighbours: int = 25, dimensions: int = 64, score_col: str = "_score", predicted_col: str = "_predicted"
) -> DataFrame:
    """All columns of the documents and two more: the score, and 1 if it reaches the threshold, else 0.

    Only texts are looked at.  Null, empty and very short texts have no features
    and get the overall share of the label 1; so do all texts if no row is
    labelled (share 0).  Equal texts have equal scores.  Columns keep their names
    and types; a column that has the name of one of the two is an error.  An
    empty table gives an empty result.
    """
    if clash := {score_col, predicted_col} & set(docs.columns):
        raise ValueError(f"documents have a column {sorted(clash)}: give score_col and predicted_col other names")
    model = labelled_model(docs, labels, learn, max_labelled, dimensions)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    schema = StructType([*docs.schema.fields, StructField(score_col, DoubleType()), StructField(predicted_col, IntegerType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, at):
                s = np.round(vote(text_features(part.column(at)), shared.value, neighbours), 6)
                more = [pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, score_col, predicted_col])

    return docs.mapInArrow(score, schema)


def held_out(doc_id: Column, of: int = 4, remainder: int = 2) -> Column:
    """Whether a document is never learned from; null identifiers aren't held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(of)) == remainder, F.lit(False))
