"""The network against a plain one, its windows, its held-out accuracy, and texts at the edges."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import language_id as lid
from tessera.llm.quality_knn import held_out

SCHEMA = "doc_id long, text string, lang string, source string, _lowered string, _lettered int"


@pytest.fixture(scope="module")
def net():
    rng = np.random.default_rng(3)
    d, f = 5, 4
    return lid.Network(["x", "y", "z"], rng.normal(size=(256, d)), [rng.normal(size=(w * d, f)) for w in lid.WIDTHS], rng.normal(size=12), rng.normal(size=(12, 3)), rng.normal(size=3))


def plain(net, row):
    """Probabilities of one window, filter by filter and place by place."""
    e, kept = net.embedding[row], []
    for w, table in zip(lid.WIDTHS, net.filters, strict=True):
        for f in range(table.shape[1]):
            kept.append(max(float(e[i : i + w].ravel() @ table[:, f]) for i in range(len(row) - w + 1)))
    logits = np.maximum(np.array(kept) + net.bias, 0) @ net.dense + net.offset
    return np.exp(logits) / np.exp(logits).sum()


def test_tables_of_pairs_are_the_filters(net):
    x = np.random.default_rng(4).integers(0, 256, size=(6, lid.WINDOW)).astype(np.uint8)
    assert np.allclose(lid.Scorer(net).windows(x), [plain(net, r) for r in x], atol=1e-4)


def test_windows_cover_whole_texts():
    sizes = [0, 1, 127, 128, 129, 253, 254, 1000, 0, 5]
    offsets = np.r_[0, np.cumsum(sizes)]
    owner, start, length = lid.window_places(offsets)
    for t, n in enumerate(sizes):
        own = [(s - offsets[t], k) for s, k in zip(start[owner == t], length[owner == t], strict=True)]
        assert len(own) == (0 if n == 0 else 1 if n <= 128 else 1 + -(-(n - 128) // 125))
        assert {i for s, k in own for i in range(s, s + k)} == set(range(n))
        assert all(0 <= s and s + k <= n for s, k in own)
        for i in range(n - 3):  # every four bytes in a row lie in one window
            assert any(s <= i and i + 4 <= s + k for s, k in own)


def test_text_scores_are_means_of_windows(net):
    texts = ["", None, "123 $$$", "a" * 500, "été où " * 60, "b"]
    found = lid.Scorer(net).texts(pa.array(texts, pa.string()), block=3)
    for t, got in zip(texts, found, strict=True):
        data = np.frombuffer((t or "").encode(), np.uint8)
        _, start, length = lid.window_places(np.array([0, len(data)]))
        total, weight = np.zeros(3), 0
        for s, k in zip(start, length, strict=True):
            row = np.zeros(lid.WINDOW, np.uint8)
            row[:k] = data[s : s + k]
            letters = sum(97 <= b <= 122 or b >= 128 for b in row[:k].tolist())
            total, weight = total + letters * plain(net, row), weight + letters
        assert np.allclose(got, total / max(weight, 1), atol=1e-4)


def test_held_out_accuracy_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), 3, 1)
    extra = [(-1, None, "en"), (-2, "", "en"), (-3, "12 $$ 3", "fr"), (-4, "The " * 40_000, None), (None, "der und die ", "de"), (-5, "Ünicode", None), (-6, "Ünicode", "fr"), (-6, "Ünicode", "fr")]
    more = spark.createDataFrame(extra, "doc_id long, text string, lang string")
    found = lid.identify_languages(docs.union(more).withColumns({"_lowered": F.lit(1), "_lettered": F.lit("x")}).repartition(5), ~out).withColumn("out", out).collect()
    assert len(found) == docs.count() + len(extra)
    judged = [r for r in found if r["out"] and r["lang"] and r["lang_pred"] != "und"]
    assert len(judged) > 300 and sum(r["lang"] == r["lang_pred"] for r in judged) >= 0.98 * len(judged)
    by = {r["doc_id"]: r for r in found}
    assert [(by[i]["lang_pred"], by[i]["score"]) for i in (-1, -2, -3)] == [("und", 0.0)] * 3
    assert len({(r["lang_pred"], r["score"]) for r in found if r["text"] == "Ünicode"}) == 1
    assert all(0 <= r["score"] <= 1 for r in found)
    assert {r["lang_pred"] for r in found} <= {"en", "fr", "de", "es", "und"}


def test_labels_decide_nothing_where_held_out(spark):
    """Other languages, sources and identifiers of held-out rows change no prediction."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), 3, 1)
    changed = docs.withColumn("lang", F.when(out, "zz").otherwise(F.col("lang")))
    one, two = ({r["doc_id"]: (r["lang_pred"], r["score"]) for r in lid.identify_languages(d, ~out, steps=60).collect()} for d in (docs, changed))
    assert one == two


def test_nothing_to_learn_and_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert lid.identify_languages(empty, F.lit(True)).count() == 0
    rows = spark.createDataFrame([(1, "text", None, "s", "", 1), (None, "mots", "fr", "s", "", 1)], SCHEMA)
    assert {(r["lang_pred"], r["score"]) for r in lid.identify_languages(rows, F.lit(True)).collect()} == {("und", 0.0)}
    with pytest.raises(ValueError):
        lid.identify_languages(rows.withColumn("score", F.lit(1)), F.lit(True))


def test_bounded_sample(spark):
    rows = spark.createDataFrame([(i % 700, f"text number {i} of many", "en" if i % 9 else "fr", "s", "", 1) for i in range(1400)], SCHEMA)
    x, labels = lid.labelled_windows(rows, F.lit(True), per_language=50, max_labelled=80)
    assert 20 < len(x) <= 80 and len(labels) == len(x) and set(labels) == {"en", "fr"}
