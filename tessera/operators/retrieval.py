"""Vectors, rank fusion, parents, projections and evaluation of ranked lists."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import cosine

RRF_CONSTANT = 60


def dense_top_k(vectors: DataFrame, query: Sequence[float], k: int, eligible: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Exact cosine top-k over eligible rows; ties go to the smaller identifier.  The filter runs before any score."""
    rows = vectors if eligible is None else vectors.where(eligible)
    given = F.array(*[F.lit(float(x)) for x in query])
    score = F.round(cosine(F.col(vector_col), given), 6)
    return rows.withColumn("score", score).orderBy(F.desc("score"), id_col).limit(k)


class _Vectors:
    """Vectors as rows of a matrix.  Missing entries are zeros that ``known`` tells apart; ``plain`` rows are whole and have a direction."""

    def __init__(self, ids: pa.Array, lists: pa.Array, dimensions: int = 0):
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        values = pc.list_flatten(lists).cast(pa.float64())
        self.ids, self.dimensions = ids, max(dimensions, int(sizes.max(initial=0)))
        row, place = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.known, self.rows = np.zeros((len(sizes), self.dimensions), bool), np.zeros((len(sizes), self.dimensions))
        self.known[row, place] = values.is_valid().to_numpy(zero_copy_only=False)
        self.rows[row, place] = pc.fill_null(values, 0.0).to_numpy(zero_copy_only=False)
        with np.errstate(all="ignore"):
            self.squares = _in_turn(self.rows, self.rows)
            self.plain = self.known.all(1) & (self.squares > 1e-200) & (self.squares < 1e200)
            self.unit = (self.rows / np.sqrt(np.where(self.plain, self.squares, np.inf))[:, None]).astype(np.float32)  # zeros for other rows
        self.unit[~self.plain] = 0

    def widened(self, dimensions: int) -> _Vectors:
        return self if dimensions <= self.dimensions else _Vectors(self.ids, pa.array([r[k].tolist() for r, k in zip(self.rows, self.known, strict=True)], pa.list_(pa.float64())), dimensions)


def _in_turn(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of rows, their entries added one after the other."""
    total = np.zeros(len(x))
    for column in range(x.shape[1]):
        total += x[:, column] * y[:, column]
    return total


def _likely(asked: np.ndarray, given: np.ndarray, own: list[tuple[int, np.ndarray]], k: int, margin: float = 3e-5, lanes: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """(row of asked, row of given): all that may be among the k largest products, the own rows left out.

    Rows of given are dealt into groups.  The k-th largest of the groups' maxima is
    no more than the k-th largest product, so only groups and rows that reach it
    are left, with a margin for products in single precision and rounded scores.
    """
    wide = -(-len(given) // lanes)
    products = np.full((len(asked), wide * lanes), -np.inf, np.float32)
    np.matmul(asked, given.T, out=products[:, : len(given)])
    for row, places in own:
        products[row, places] = -np.inf
    laned = products.reshape(len(asked), lanes, wide)
    largest = laned.max(1)
    least = np.partition(largest, wide - k, 1)[:, wide - k] - margin if wide >= k else np.full(len(asked), -np.inf, np.float32)
    row, group = np.nonzero(largest >= least[:, None])
    pair, lane = np.nonzero(laned[row, :, group] >= least[row][:, None])
    row, place = row[pair], lane * wide + group[pair]
    found = (place < len(given)) & (products[row, place] > -np.inf)
    return row[found], place[found]


def _nearest(asked: _Vectors, given: _Vectors, order: np.ndarray, k: int, tile: int = 256) -> Iterator[pa.RecordBatch]:
    """The k nearest rows of given for each row of asked: likely ones by single precision, then exactly.  ``order``: of the ids of given."""
    ids = given.ids.to_numpy(zero_copy_only=False)
    ranks = np.empty(len(order), int)
    ranks[order] = np.arange(len(order))
    all_plain, odd = given.plain.all(), np.flatnonzero(~given.plain)
    unit = given.unit if all_plain else given.unit[given.plain]
    plain = np.flatnonzero(given.plain)
    own_ids = asked.ids.to_numpy(zero_copy_only=False)
    low, high = np.searchsorted(ids[order], own_ids, "left"), np.searchsorted(ids[order], own_ids, "right")
    for start in range(0, len(own_ids), tile):
        rows = np.arange(start, min(start + tile, len(own_ids)))
        usual, rest = rows[asked.plain[rows]], rows[~asked.plain[rows]]
        own = [(int(i), order[low[r] : high[r]]) for i, r in enumerate(usual) if low[r] < high[r]]
        if not all_plain:
            where = np.cumsum(given.plain) - 1
            own = [(i, where[places[given.plain[places]]]) for i, places in own]
        x, y = _likely(asked.unit[usual], unit, own, k)
        # a row without a direction, or with entries missing, meets all
        met = [(usual[x], plain[y]), (np.repeat(usual, len(odd)), np.tile(odd, len(usual)))]
        met += [(np.full(len(ids), r), np.arange(len(ids))) for r in rest]
        x, y = np.concatenate([m[0] for m in met]), np.concatenate([m[1] for m in met])
        other = (ranks[y] < low[x]) | (ranks[y] >= high[x])
        x, y = x[other], y[other]
        with np.errstate(all="ignore"):
            scores = np.round(_in_turn(asked.rows[x], given.rows[y]) / np.sqrt(asked.squares[x] * given.squares[y]), 6)
        null = ~(asked.known[x] & given.known[y]).any(1) if len(odd) or len(rest) else np.zeros(len(x), bool)
        # as in SQL: NaN before all numbers, null behind them
        kind = np.where(null, 2, np.where(np.isnan(scores), 0, 1))
        first = np.lexsort((ranks[y], np.where(kind == 1, -scores, 0), kind, x))
        x, y, scores, null = x[first], y[first], scores[first], null[first]
        starts = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, int)
        kept = np.arange(len(x)) - np.repeat(starts, np.diff(np.append(starts, len(x)))) < k
        columns = [asked.ids.take(pa.array(x[kept])), given.ids.take(pa.array(y[kept])), pa.array(scores[kept], pa.float64(), mask=null[kept])]
        yield pa.RecordBatch.from_arrays(columns, ["query_id", "neighbour", "score"])


def nearest_of_each(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 1 << 14) -> DataFrame:
    """Exact nearest neighbours of each of (query_id, query_vector) among all vectors, by cosine rounded to six digits; ties go to the smaller identifier.

    Vectors are dealt into parts of about ``block`` rows, or less where they are few;
    all queries pass each part, some rows at a time, and a part hands on k rows for
    a query.  Products of matrices in single precision tell which vectors may be
    among the nearest, and these are scored in double precision.  So what a task
    holds is one part and some queries, whatever the number of either, and nothing
    is broadcast.  The work is the number of queries times that of vectors.
    """
    kind = vectors.schema[id_col].dataType.simpleString()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, given, order = None, [], None, None
        for batch in batches:
            keys = batch["part"].to_numpy() * 2 + batch["side"].to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if start == end:
                    continue
                some, now = batch.slice(start, end - start), int(keys[start]) // 2
                if now != part:
                    part, held, given = now, [], None
                if keys[start] % 2 == 0:
                    held.append(some)
                elif held or given is not None:
                    if given is None:
                        rows = pa.Table.from_batches(held).combine_chunks()
                        given, held = _Vectors(rows["id"].combine_chunks(), rows["v"].combine_chunks()), []
                        order = np.argsort(given.ids.to_numpy(zero_copy_only=False), kind="stable")
                    asked = _Vectors(some["id"], some["v"], given.dimensions)
                    given = given.widened(asked.dimensions)
                    yield from _nearest(asked, given, order, k)

    count = vectors.count()
    parts = max(1, -(-count // block), min(-(-count // 1024), 64))
    given = vectors.where(F.col(id_col).isNotNull()).select(F.pmod(F.xxhash64(id_col), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("side"), F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    asked = queries.where("query_id is not null").select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("side"), F.col("query_id").cast(kind).alias("id"), F.col("query_vector").cast(vectors.schema[vector_col].dataType).alias("v"))
    dealt = given.unionAll(asked).repartition(parts, "part").sortWithinPartitions("part", "side")
    found = dealt.mapInArrow(meet, f"query_id {kind}, neighbour {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def reciprocal_rank_fusion(lists: DataFrame, weights: dict[str, float] | None = None, k: int = RRF_CONSTANT) -> DataFrame:
    """(signal, position, id, group_key) to one row for each group: fused score, best rank and ranks by signal.

    A group has one vote in a signal: its first hit.  Ranks count the groups met
    before, not the hits.
    """
    first = lists.groupBy("signal", "group_key").agg(F.min("position").alias("position"), F.min_by("id", "position").alias("id"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("signal").orderBy("position")))
    weight = F.lit(1.0)
    for name, value in (weights or {}).items():
        weight = F.when(F.col("signal") == name, F.lit(float(value))).otherwise(weight)
    seen = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "signal", "rank"))), ",")
    fused = ranked.groupBy("group_key").agg(F.round(F.sum(weight / (k + F.col("rank"))), 8).alias("score"), F.min("rank").alias("best_rank"), seen.alias("ranks"), F.min("id").alias("id"))
    return fused


def project_to_parents(hits: DataFrame, parents: DataFrame, id_col: str = "id") -> DataFrame:
    """Replace a hit by its explicit parent where that is eligible: (id, parent_id, eligible) gives the target."""
    link = parents.select(F.col("child_id"), F.col("parent_id"), F.col("parent_ok"))
    return hits.join(link, hits[id_col] == link["child_id"], "left").withColumn("target_id", F.when(F.col("parent_ok"), F.col("parent_id")).otherwise(F.col(id_col))).drop("child_id", "parent_ok")


def tf_idf(tokens: DataFrame, features: int = 2500) -> DataFrame:
    """(id, normalized, weight) with (1 + ln tf) * ln(1 + N / (1 + df)) over the most frequent features."""
    df = tokens.groupBy("normalized").agg(F.countDistinct("id").alias("df")).orderBy(F.desc("df"), "normalized").limit(features)
    total = tokens.agg(F.countDistinct("id").alias("n"))
    tf = tokens.groupBy("id", "normalized").agg(F.sum("count").alias("tf"))
    weight = (1 + F.log("tf")) * F.log(1 + F.col("n") / (1 + F.col("df")))
    return tf.join(F.broadcast(df), "normalized").crossJoin(F.broadcast(total)).select("id", "normalized", weight.alias("weight"))  # df: at most `features` rows


def usage_space(weights: DataFrame, points: int = 150, dimensions: int = 3) -> list[tuple]:
    """Centred, normalised SVD projection of at most ``points`` texts, scaled to 1: (id, x, y, z) rows.

    The matrix has at most ``points`` rows and comes to the driver; more points are an error.
    """
    rows = weights.collect() if weights.select("id").distinct().limit(points + 1).count() <= points else None
    if rows is None:
        raise ValueError(f"more than {points} points")
    ids, names = sorted({r["id"] for r in rows}), sorted({r["normalized"] for r in rows})
    at, column = {x: i for i, x in enumerate(ids)}, {x: i for i, x in enumerate(names)}
    matrix = np.zeros((len(ids), max(1, len(names))))
    for r in rows:
        matrix[at[r["id"]], column[r["normalized"]]] = r["weight"]
    matrix -= matrix.mean(axis=0, keepdims=True) if len(ids) else 0
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
    u, s, _ = np.linalg.svd(matrix, full_matrices=False) if len(ids) else (np.zeros((0, 0)), np.zeros(0), None)
    flat = np.zeros((len(ids), dimensions))
    flat[:, : min(dimensions, len(s))] = (u * s)[:, :dimensions]
    flat /= max(1e-12, np.abs(flat).max()) if flat.size else 1
    return [(i, *map(float, row)) for i, row in zip(ids, flat, strict=True)]


def pool_windows(windows: DataFrame) -> DataFrame:
    """(id, weight, vector) windows to one unit vector for each id: the weighted mean."""
    cells = windows.select("id", "weight", F.posexplode("vector").alias("place", "value"))
    summed = cells.groupBy("id", "place").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))
    vector = summed.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("vector"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v))
    return vector.select("id", F.transform("vector", lambda v: v / F.greatest(norm, F.lit(1e-12))).alias("vector"))


def rank_of_target(results: DataFrame, credit: DataFrame, cutoff: int = 10) -> DataFrame:
    """(query_id, position, id) and (query_id, id, credit_key, is_target): the rank of the first target, counting each credit set once."""
    joined = results.join(credit, ["query_id", "id"], "left").withColumn("_key", F.coalesce("credit_key", F.col("id").cast("string")))
    once = joined.groupBy("query_id", "_key").agg(F.min("position").alias("position"), F.max(F.coalesce("is_target", F.lit(False))).alias("hit"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("position")))
    return ranked.where(F.col("hit") & (F.col("rank") <= cutoff)).groupBy("query_id").agg(F.min("rank").alias("rank"))


def recall_and_mrr(ranks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Recall at 1, 5 and 10 and mean reciprocal rank at 10 of (query_id, rank or null)."""
    share = lambda k: F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 4)
    mrr = F.round(F.avg(F.when(F.col("rank") <= 10, 1.0 / F.col("rank")).otherwise(0.0)), 4)
    return ranks.groupBy(*by).agg(F.count(F.lit(1)).alias("queries"), share(1).alias("recall_1"), share(5).alias("recall_5"), share(10).alias("recall_10"), mrr.alias("mrr_10"))


def stratified_sample(rows: DataFrame, stratum: str, id_col: str, n: int, most_share: float = 1 / 3, seed: str = "7") -> DataFrame:
    """n rows in turn from all strata, in an order fixed by a hash of the identifier; no stratum gives more than its share."""
    order = F.md5(F.concat(F.lit(seed + ":"), F.col(id_col).cast("string")))
    turn = F.row_number().over(Window.partitionBy(stratum).orderBy(order, id_col))
    return rows.withColumn("turn", turn).where(F.col("turn") <= max(1, int(n * most_share))).orderBy("turn", stratum).limit(n)


def held_out_works(works: DataFrame, id_col: str, size_col: str, budget: float = 0.1, most: float = 0.02) -> DataFrame:
    """Works in hash order until the sizes before reach the budget; works of more than ``most`` of all are passed over."""
    total = works.agg(F.sum(size_col).alias("_total"))
    small = works.crossJoin(F.broadcast(total)).where(F.col(size_col) <= F.col("_total") * most)
    order = Window.orderBy(F.md5(F.col(id_col).cast("string")), id_col)
    before = F.coalesce(F.sum(size_col).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return small.withColumn("before", before).where(F.col("before") < F.col("_total") * budget).drop("_total")


def hard_negatives(candidates: DataFrame, keep: int) -> DataFrame:
    """(query_id, id, score, same_work, overlap) to the best-scoring near misses: other works, overlap below one half."""
    open_ = candidates.where(~F.col("same_work") & (F.col("overlap") < 0.5))
    return open_.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= keep)
