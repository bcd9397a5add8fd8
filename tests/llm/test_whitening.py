"""Whitened vectors against numpy over all distinct vectors at once."""

import math

import numpy as np
import pytest

from tessera.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n string, x string"


def brute(rows, components=4):
    kept = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = {}
    for d in {len(x) for _, x in kept} - {0}:
        fit = np.array(sorted({x for _, x in kept if len(x) == d}), object)
        n, sums = len(fit), fit.sum(axis=0)
        centred = (fit - sums / n).astype(float)
        values, vectors = np.linalg.eigh(centred.T @ centred / n)
        for i, x in kept:
            if len(x) == d:
                deviation = int(((n * np.array(x, object) - sums) ** 2).sum())
                z = (np.array(x, float) - (sums / n).astype(float)) @ vectors[:, ::-1][:, :components] / np.sqrt(np.maximum(values[::-1][:components], 1e-300))
                out[i] = (n, deviation, z, values[::-1][:components] / values.sum() if values.sum() > 0 else None)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 12)) * np.linspace(3, 0.3, 12) + 1000
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(1000 + i, base[i % 7].tolist()) for i in range(200)]  # copies count once in the fit
    rows += [(2000, None), (2001, []), (2002, [1.0, None, *[0.0] * 10]), (2003, [float("nan")] + [0.0] * 11), (2004, [float("inf")] + [0.0] * 11)]
    return rows + [(3000 + i, [float(i), float(i * i % 7)]) for i in range(20)] + [(4000, [5.0]), (4001, [5.0])]


def test_whitening_against_numpy(spark, rows):
    frame = spark.createDataFrame([(i, v, 0, "n", "x") for i, v in rows], SCHEMA).repartition(7)
    found = whitening.whiten(frame).collect()
    expected = brute(rows)
    assert {r["vec_id"] for r in found} == set(expected)
    by = {}
    for r in found:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    signs = {}
    for i, own in by.items():
        n, deviation, z, share = expected[i]
        assert sorted(own) == list(range(1, min(4, len(z)) + 1))
        for k, r in own.items():
            assert (r["n"], r["deviation"]) == (n, deviation)
            if share is None:  # one distinct vector
                assert r["whitened"] is None and r["explained"] is None and r["identity_error"] is None
                continue
            assert r["explained"] == pytest.approx(share[k - 1], rel=1e-9)
            assert r["identity_error"] < 1e-9
            if abs(z[k - 1]) > 1e-6:
                assert signs.setdefault((len(z), n, k), math.copysign(1, z[k - 1] * r["whitened"])) * r["whitened"] == pytest.approx(z[k - 1], rel=1e-6, abs=1e-6)


def test_deviation_beyond_machine_words():
    x = np.array([[1 << 40, -3], [0, 5]])
    assert whitening.deviations(x, 1000, [7, 9]) == [None, 7**2 + (5000 - 9) ** 2]
    assert whitening.exact_sums(np.array([[1 << 62], [1 << 62]])) == [1 << 63]


def test_merging_is_the_whole(spark):
    x = np.random.default_rng(1).integers(-500, 500, size=(1000, 9))
    parts = None
    for lo in range(0, 1000, 37):
        parts = whitening.merged(parts, whitening.moments_of(x[lo : lo + 37], whitening.exact_sums(x[lo : lo + 37])))
    whole = whitening.moments_of(x, whitening.exact_sums(x))
    assert parts.n == 1000 and parts.sums == whole.sums
    assert np.allclose(parts.scatter, whole.scatter, rtol=1e-12)


def test_no_rows_and_repeated_rows(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, 0, "", "")], SCHEMA)).count() == 0
    twice = spark.createDataFrame([(None, [1.0, 2.0], 0, "", ""), (1, [3.0, 1.0], 0, "", ""), (1, [3.0, 1.0], 0, "", "")], SCHEMA)
    found = whitening.whiten(twice).collect()
    assert len(found) == 6 and {r["n"] for r in found} == {2}
    assert {r["whitened"] is None for r in found if r["component"] == 2} == {True}  # two points have one direction
