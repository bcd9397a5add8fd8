"""Positional search against plain loops, and the tables it is stored in."""

import itertools
import random
import re

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from tessera.functions import query as q
from tessera.functions.text import readable
from tessera.operators import sequence as seq
from tessera.sources import stored


def plain_tokens(text):
    """(segment, place, word) of a text, read off its mask."""
    mask = q.editorial_mask(text)
    shown = "".join("…" if m else c for m, c in zip(mask, text, strict=True))
    return [(s, i, w) for s, piece in enumerate(re.split(r"(?:[…†‡-]|\.\.+)+", shown)) for i, w in enumerate(re.findall(r"[^\W\d_]+", piece.lower()))]


def assigned(groups, tokens):
    return any(all(t[2] in g for g, t in zip(groups, some, strict=True)) for some in itertools.permutations(tokens, len(groups)))


def plain(text, groups, relation, slop):
    tokens, n = plain_tokens(text), len(groups)
    keys = set().union(*groups)
    fit = [t for t in tokens if t[2] in keys]
    if relation == "all":
        return assigned(groups, fit)
    for s, first, w in fit:
        near = [t for t in fit if t[0] == s and first <= t[1] < first + n + slop]
        if relation == "near":
            if assigned(groups, near):
                last = next(k for k in range(1, len(near) + 1) if assigned(groups, near[:k]))
                return first, near[last - 1][1], " ".join(t[2] for t in near[:last])
        elif w in groups[0]:
            chain = [(first, w)]
            for g in groups[1:]:
                later = [t for t in near if t[1] > chain[-1][0] and t[2] in g]
                if not later:
                    break
                chain.append(later[0][1:])
            if len(chain) == n:
                return first, chain[-1][0], " ".join(c[1] for c in chain)
    return None


HAND = ["alpha extra beta", "beta alpha", "alpha [gap] beta", "alpha … beta", "[alpha] beta", "alpha", "alpha … alpha", "Alpha, (beta) gamma", "alpha] beta gamma\nalpha beta", "a [b <alpha> c] beta alpha", "", "alpha..beta alpha-beta"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    made = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "x", "y", "…", "[a", "b]", "z,", "Alpha"]) for _ in range(rng.randint(1, 30))) for _ in range(150)]
    return list(enumerate(HAND + made))


@pytest.fixture(scope="module")
def index(spark, texts):
    return seq.positional_index(spark.createDataFrame([*texts, (-1, None)], "doc_id int, text string")).cache()


GROUPS = [
    [{"alpha"}, {"beta"}],
    [{"alpha"}, {"alpha"}],
    [{"alpha", "beta"}, {"beta"}, {"beta", "gamma"}],
    [{"alpha", "beta"}, {"alpha", "beta"}, {"gamma"}, {"gamma", "delta"}],
    [{"delta"}],
]


@pytest.mark.parametrize("groups", GROUPS)
@pytest.mark.parametrize("slop", [0, 2])
def test_places_against_loops(texts, index, groups, slop):
    ordered = {r["id"]: (r["first"], r["last"], r["forms"].lower()) for r in seq.in_order(index, groups, slop).collect()}
    near = {r["id"]: (r["first"], r["last"], r["forms"].lower()) for r in seq.near_each_other(index, groups, slop).collect()}
    everywhere = {r["id"] for r in seq.all_words(index, groups).collect()}
    assert ordered == {i: w for i, t in texts if (w := plain(t, groups, "ordered", slop))}
    assert near == {i: w for i, t in texts if (w := plain(t, groups, "near", slop))}
    assert everywhere == {i for i, t in texts if plain(t, groups, "all", 0)}


def test_hall_sets_are_enough():
    assert sorted(seq.hall_sets([{"a"}, {"b"}, {"a"}])) == [(1, 2), (2, 1)]
    assert sorted(seq.hall_sets([{"a", "b"}, {"b", "c"}, {"d"}])) == [(1, 1), (2, 1), (3, 2), (4, 1)]
    with pytest.raises(seq.TooMuchWork):
        seq.hall_sets([{"a", f"b{i}"} for i in range(11)])
    with pytest.raises(ValueError):
        seq.hall_sets([{"a"}, set()])


def test_too_much_work_is_refused(spark):
    index = seq.positional_index(spark.createDataFrame([(1, "a " * 100)], "doc_id int, text string"))
    assert seq.in_order(index, [{"a"}, {"a"}], 0, budget=200).count() == 1
    for search in (seq.in_order, seq.near_each_other):
        with pytest.raises(SparkRuntimeException, match="refused"):
            search(index, [{"a"}, {"a"}], 0, budget=199).collect()


def test_readable_texts(spark):
    cases = [("a [b [c] d] e", "a … e"), ("a b] c\nd", "… c\nd"), ("a [b\nc", "a …\nc"), ("⸢a⸣ ‹b", "… …"), ("(a) b", "(a) b"), (None, None)]
    found = spark.createDataFrame([(t,) for t, _ in cases], "t string").select(readable(F.col("t"))).collect()
    assert [r[0] for r in found] == [r for _, r in cases]


def test_tables_are_stored_once_for_each_version(spark, tmp_path):
    built = []
    spark.range(3).write.parquet(f"{tmp_path}/t")

    def twice(df):
        built.append(1)
        return df.selectExpr("id * 2 AS id")

    read = lambda: sorted(r[0] for r in stored.remembered(spark.read.parquet(f"{tmp_path}/t"), "twice", twice).collect())
    assert read() == read() == [0, 2, 4] and len(built) == 1
    spark.range(5, 6).write.mode("append").parquet(f"{tmp_path}/t")
    assert read() == [0, 2, 4, 10] and len(built) == 2
    assert stored.remembered(spark.createDataFrame([(1,)], "id long"), "twice", twice).count() == 1 and len(built) == 3
