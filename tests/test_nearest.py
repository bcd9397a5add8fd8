"""Nearest vectors against the SQL, on vectors without a direction, with entries missing, of several lengths and with one identifier twice."""

import duckdb
import numpy as np

import __spark_entry__ as entry
from tessera.operators import retrieval


def _agree(spark, path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet/*.parquet'")
    found = duck.execute(entry.oracle_sql()["dense_neighbours"])
    names = [d[0] for d in found.description]
    mine = entry.queries()["dense_neighbours"](spark, str(path)).select(*names).collect()
    theirs = found.fetchall()
    assert len(theirs) > 0 and sorted(map(repr, map(tuple, mine))) == sorted(map(repr, theirs))


def test_dense_neighbours_of_odd_vectors(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(size=8).round(1)], 0) for i in range(400)]
    rows += [(400, [0.0] * 8, 0), (401, None, 0), (402, [None] * 8, 0), (403, [1.0, None, *[0.5] * 6], 0), (404, [1.0, 2.0], 0), (420, [], 0), (440, [None, 1.0], 0), (405, [1.0] * 8, 0)]
    rows += [(460, [float("nan")] * 8, 0), (480, [1e-30] * 8, 0), (481, [1e30] * 8, 0), (20, [float(v) for v in range(8)], 0), (21, [2.0] * 9, 0), (None, [1.0] * 8, 0)]
    _agree(spark, tmp_path, rows)


def test_dense_neighbours_of_copies_and_ties(spark, tmp_path):
    rng = np.random.default_rng(5)
    few = [[float(v) for v in rng.integers(-1, 2, 6)] for _ in range(30)]
    _agree(spark, tmp_path, [(i, few[i % 30], 0) for i in range(3000)])


def test_likely_rows_hold_the_nearest():
    rng = np.random.default_rng(7)
    unit = lambda n: (lambda v: (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32))(rng.normal(size=(n, 16)))
    asked, given = unit(40), unit(3000)
    row, place = retrieval._likely(asked, given, [(3, np.array([5, 6]))], 4)
    for r in range(40):
        scores = asked[r].astype(float) @ given.T.astype(float)
        if r == 3:
            scores[[5, 6]] = -np.inf
        found = place[row == r]
        assert set(np.argsort(-scores)[:4]) <= set(found) and len(found) < 200 and (r != 3 or not {5, 6} & set(found))
