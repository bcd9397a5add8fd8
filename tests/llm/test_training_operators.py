"""Every operator against brute force on small rows that hold nulls, empty and long texts, copies and repeated rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import class_lm, components, exact_dedup, fingerprints, line_dedup, mixing, ngram_join, quality_knn, sentencepiece_codec, sharding, tokens, url_filter
from tessera.llm.queries import MODEL_FILE, URL_RULES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _sum double, kept string"
BASE = "the quick brown fox jumps over the lazy dog while seven wizards brew a potion of green tea near the old stone bridge at noon".split()


def ugly():
    near = " ".join(BASE[:-1] + ["midnight"])
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    texts = [
        (1, " ".join(BASE)), (2, " ".join(BASE)), (3, near), (4, " ".join(BASE).upper()), (5, ""), (6, None), (7, "   \t\n "), (8, "one two"), (9, "one two"), (10, "two one"),
        (11, long), (12, long + " end"), (13, "Ça été — 日本 \U0001f600 x y z"), (14, "first line\nsecond line of text\nfirst line"), (14, "first line\nsecond line of text\nfirst line"),
        (None, "no identifier at all here"), (None, " ".join(BASE)), (15, "a" * 70_000), (16, "# $ % ! !! ### $$$ %%%"), (17, "first line \n\nsecond line of texts"),
    ]
    return [(i, t, None if i in (3, 8) else "en", [None, "b", "a"][k % 3], len(t or ""), 0.0, "clash") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ugly(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def low(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", low(text))


def shingle_set(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


class Forest:
    def __init__(self, nodes):
        self.parent = {x: x for x in nodes}

    def find(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def test_words_and_shingles_of_arrow_texts():
    import pyarrow as pa

    texts = [t for _, t, *_ in ugly()]
    found = tokens.words_of(pa.array(texts, pa.string()))
    seen = {}
    for i, t in enumerate(texts):
        mine = found.hashes[found.bounds[i] : found.bounds[i + 1]].tolist()
        assert len(mine) == len(words(t))
        for w, h in zip(words(t), mine, strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert [len(s) for s in tokens.shingle_sets(found)] == [len(shingle_set(t)) for t in texts]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (100, 102), (7, 7)] + [(200, i) for i in range(201, 400)]
    forest = Forest({x for e in edges for x in e})
    for a, b in edges:
        forest.link(a, b)
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: forest.find(x) for x in forest.parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_url_filters(spark):
    urls = [
        "http://a.com/x", "https://EXAMPLE.com/en/1?q#f", "http://www.example.com/en/2", "http://sub.www.example.com/en/", "http://notexample.com/en/", "http://x.net/es/", "http://x.net/esx", "ftp://net/fr/1", None, "", "no scheme/en",
        "http://", "http://example.com", "http://example.com:80/en/", "http://a..com/", "http://www.example.com/en", "http://b.org/://com/", "http://example.com/en/1\nx", "http://a.com/x",
    ]
    pages = spark.createDataFrame([(i if i != 3 else None, u, "host", "x") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")

    def brute(i, u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = low(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fit = [(len(h + p), len(h), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit) if fit else (0, 0, None, "allow")
        return (i if i != 3 else None, host, path, best[2], best[3])

    found = url_filter.judge_urls(pages, rules)
    assert Counter(map(tuple, found.collect())) == Counter(brute(i, u) for i, u in enumerate(urls))
    assert url_filter.judge_urls(pages.where("false"), rules).count() == 0
    assert {tuple(r) for r in url_filter.judge_urls(pages, rules.where("false")).select("rule", "verdict").collect()} == {(None, "allow")}


def test_hosts_of_very_many_labels(spark):
    import time

    host = "a." * 100_000 + "www.example.com"
    pages = spark.createDataFrame([(1, f"http://{host}/en/x"), (2, f"http://{'b' * 100_000}.net/es/")], "page_id long, url string")
    begun = time.time()
    found = {r["page_id"]: r["rule"] for r in url_filter.judge_urls(pages, spark.createDataFrame(URL_RULES, "host string, path string, verdict string")).collect()}
    assert found == {1: "www.example.com/en/", 2: "net/es/"} and time.time() - begun < 20


def test_nested_url_rules_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BLOCK", 7)
    rules = [(h, "/" + "a" * k + ("/" if k else ""), "block" if k % 2 else "allow") for h in ("com", "x.com", "y.x.com", "org") for k in range(12)]
    urls = [f"http://{h}/{'a' * k}{t}" for h in ("com", "x.com", "y.x.com", "z.y.x.com", "b.org", "net") for k in range(14) for t in ("", "/", "/b")]
    out = {r["page_id"]: r["rule"] for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    for i, u in enumerate(urls):
        host, _, path = u.removeprefix("http://").partition("/")
        fit = [(len(h + p), len(h), h + p) for h, p, _ in rules if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        assert out[i] == (max(fit)[2] if fit else None)


def test_line_dedup(spark, docs, none):
    extra = [(50 + k, f"{' '.join(BASE)}\n{' '.join([*BASE[:k], 'changed', *BASE[k + 1 :]])}\nunique {k} line {k * 7} number {k * 13}", "en", "s", 1, 0.0, "x") for k in range(12)]
    frame = docs.union(spark.createDataFrame(extra, SCHEMA))
    lines = {}
    for i, t, *_ in [*ugly(), *extra]:
        for n, line in enumerate((t or "").split("\n")):
            if line.strip(" "):
                lines[(i is None, i or 0, n, line.strip(" "))] = line.strip(" ")
    sets = {x: {x[i : i + 8] for i in range(max(1, len(x) - 7))} for x in set(lines.values())}
    forest = Forest(sets)
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                forest.link(a, b)
    first = {}
    for key in sorted(lines):
        first.setdefault(forest.find(lines[key]), key[:3])
    found = line_dedup.dedup_lines(frame).collect()
    assert len(found) == len(lines) + 3  # one row is there twice, with three lines
    kept = {(r["doc_id"] is None, r["doc_id"] or 0, r["line_no"]) for r in found if r["kept"]}
    assert kept == set(first.values())
    report = line_dedup.line_report(frame)
    assert report.count() == frame.count()
    clean = line_dedup.clean_documents(frame, report)
    assert clean.columns == frame.columns and clean.count() == frame.count()
    assert line_dedup.line_report(none).count() == 0


def test_ngram_join(spark, docs, none):
    rng = np.random.default_rng(3)
    pool = [f"v{i}" for i in range(4000)]
    more = []
    for g in range(6):
        text = list(rng.choice(pool, 120))
        for k in range(15):
            copy = list(text)
            for at in rng.choice(120, rng.integers(0, 6), replace=False):
                copy[at] = f"m{g}_{k}_{at}"
            more.append((1000 + g * 50 + k, " ".join(copy), "en", "s", 1, 0.0, "x"))
    shared = " ".join(rng.choice(pool, 60))
    more += [(2000 + k, shared + " " + " ".join(rng.choice(pool, 30)), "en", "s", 1, 0.0, "x") for k in range(40)]
    rows = [*ugly(), *more]
    sets = [shingle_set(r[1]) for r in rows]
    forest = Forest(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                forest.link(a, b)
    members = defaultdict(list)
    for k, r in enumerate(rows):
        members[forest.find(k)].append(r[0])
    names = {k: min([i for i in ids if i is not None], default=None) for k, ids in members.items()}
    expected = Counter((r[0], len(sets[k]), names[forest.find(k)]) for k, r in enumerate(rows))
    assert Counter(map(tuple, ngram_join.ngram_components(docs.union(spark.createDataFrame(more, SCHEMA))).collect())) == expected
    assert ngram_join.ngram_components(none).count() == 0


def test_divide_skip_against_brute_force():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(6):
        base = rng.choice(10_000, 80, replace=False)
        for _ in range(5):
            s = set(base.tolist())
            for x in rng.choice(base, rng.integers(0, 14), replace=False).tolist():
                s.discard(x)
                s.add(int(rng.integers(20_000, 30_000)))
            sets.append(np.array(sorted(s), np.uint64))
    forest, found = Forest(range(len(sets))), Forest(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            i = len(np.intersect1d(sets[a], sets[b]))
            if 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
                forest.link(a, b)
    for a, b in ngram_join.divide_skip(sets, [len(s) for s in sets], 80):
        found.link(a, b)
    assert [forest.find(k) for k in range(len(sets))] == [found.find(k) for k in range(len(sets))]


def test_class_lm(docs, none):
    held = quality_knn.held_out(F.col("doc_id"), of=7)
    rows = class_lm.class_lm_scores(docs, ~held, frequent=20, classes=4).collect()
    assert len(rows) == len(ugly())
    is_held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter()
    for i, t, *_ in ugly():
        if not is_held(i):
            counts.update([*words(t), None])
    total, size = sum(counts.values()), len(counts)
    base = lambda t: sum(math.log10((counts[w] + 1) / (total + size + 1)) for w in [*words(t), None])
    expected = Counter((i, is_held(i), len(words(t)) + 1, sum(counts[w] > 0 for w in [*words(t), None]), total, round(base(t), 4)) for i, t, *_ in ugly())
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in rows) == expected
    assert all(r["score"] <= 0 and r["perplexity"] >= 1 for r in rows)
    assert class_lm.class_lm_scores(none, ~held).count() == 0
    untrained = class_lm.class_lm_scores(docs.limit(2), F.lit(False)).collect()
    assert [r["train_tokens"] for r in untrained] == [0, 0]


def test_class_lm_against_brute_force(docs):
    """Scores, and the class of every word, from counts in plain dictionaries."""
    frequent, rare, classes, least = 12, 7, 4, 2
    held = quality_knn.held_out(F.col("doc_id"), of=7)
    texts = [(i, words(t)) for i, t, *_ in ugly()]
    learn = [w for i, w in texts if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for line in learn for w in line)
    told = {w: tokens.words_of(pa.array([w])) for _, line in texts for w in line}
    code = {w: int(x.hashes[0]) for w, x in told.items()}
    ending = {w: int(tokens.suffix_buckets(x, rare)[0]) for w, x in told.items()}
    top = sorted(counts, key=lambda w: (-counts[w], int(np.uint64(code[w]).view(np.int64))))[:frequent]
    atom = {w: top.index(w) if w in top else len(top) + ending[w] for w in told}
    end = len(top) + rare
    pairs = Counter(p for line in learn for p in zip([None, *line], [*line, None], strict=True))
    table = np.zeros((end + 1, end + 1))
    for (a, b), n in pairs.items():
        table[atom.get(a, end), atom.get(b, end)] += n
    own = class_lm.exchange(table, classes)
    member = np.eye(classes + 1)[own]
    grid = member.T @ table @ member
    f = lambda x: x * math.log(x) if x > 0 else 0.0
    first = {w: int(own[atom[w]]) for w in told} | {None: classes}
    of = dict(first)
    for w in counts:
        if w in top or counts[w] < least:
            continue
        to, fro = np.zeros(classes + 1), np.zeros(classes + 1)
        for (a, b), n in pairs.items():
            to[first[b]] += n * (a == w)
            fro[first[a]] += n * (b == w)
        gain = []
        for k in range(classes):
            own_row, own_column = to * (k == first[w]), fro * (k == first[w])
            row, column = np.maximum(grid[k] - own_row, 0), np.maximum(grid[:, k] - own_column, 0)
            g = sum(f(x + y) - f(x) for x, y in zip(row, to, strict=True)) + sum(f(x + y) - f(x) for x, y in zip(column, fro, strict=True))
            out, into = max(grid[k].sum() - own_row.sum(), 0), max(grid[:, k].sum() - own_column.sum(), 0)
            gain.append(g - f(out + to.sum()) + f(out) - f(into + fro.sum()) + f(into))
        if max(gain) > gain[first[w]] + 1e-9:
            of[w] = int(np.argmax(gain))
    steps, size, mass = Counter(), Counter(), Counter()
    for (a, b), n in pairs.items():
        steps[of[a], of[b]] += n
        size[of[a]] += n
    for w, n in counts.items():
        mass[of[w]] += n + 1

    def score(line):
        total = 0.0
        for a, b in zip([None, *line], [*line, None], strict=True):
            total += math.log10((steps[of[a], of[b]] + 0.1) / (size[of[a]] + 0.1 * (classes + 1)))
            if b is not None:
                total += math.log10((counts[b] + 1) / (mass[of[b]] + 1))
        return total

    rows = class_lm.class_lm_scores(docs, ~held, frequent=frequent, rare=rare, classes=classes, least=least).collect()
    assert sorted(round(r["score"], 6) for r in rows) == pytest.approx(sorted(round(score(line), 6) for _, line in texts), abs=1e-5)
    assert sum(of[w] != first[w] for w in counts) > 0


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(2)
    counts = rng.poisson(1, (41, 41)).astype(float)
    counts[:20, :20] += 20
    counts[20:40, 20:40] += 20

    def likelihood(own):
        member = np.zeros((41, 3))
        member[np.arange(41), own] = 1
        t = member.T @ counts @ member
        f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-9)), 0).sum()
        return f(t) - f(t.sum(axis=0)) - f(t.sum(axis=1))

    own = class_lm.exchange(counts, 2)
    assert likelihood(own) >= likelihood(np.r_[np.arange(40) % 2, 2])
    assert len(set(own[:20])) == 1 and len(set(own[20:40])) == 1 and own[0] != own[20]


def test_quality(spark, docs, none):
    good = [(i, " ".join(np.random.default_rng(i).permutation(BASE)), 1) for i in range(100, 160)]
    bad = [(i, " ".join(f"{w}$$$ ###" for w in np.random.default_rng(i).permutation(BASE)), 0) for i in range(200, 260)]
    frame = docs.select("doc_id", "text").union(spark.createDataFrame([r[:2] for r in good + bad], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad] + [(None, 1), (100, None)], "doc_id long, quality int")
    learn = ~quality_knn.held_out(F.col("doc_id"))
    rows = quality_knn.score_quality(frame, labels, learn).collect()
    truth = {i: q for i, _, q in good + bad}
    assert all(r["_predicted"] == truth[r["doc_id"]] for r in rows if r["doc_id"] in truth)
    assert all(0 <= r["_score"] <= 1 for r in rows) and len(rows) == len(ugly()) + 120
    by_text = defaultdict(set)
    for r in rows:
        by_text[r["text"] or ""].add(r["_score"])
    assert all(len(s) == 1 for s in by_text.values())
    assert quality_knn.score_quality(none, labels, learn).count() == 0
    assert {r["_score"] for r in quality_knn.score_quality(docs.select("doc_id", "text"), labels.where("false"), learn).collect()} == {0.0}


def test_votes_against_brute_force():
    import pyarrow as pa

    rng = np.random.default_rng(8)
    texts = [" ".join(rng.permutation(BASE)[: rng.integers(4, 20)]) for _ in range(60)] + [f"{k}$$ ## {k * 7}%%" for k in range(60)]
    labels = np.r_[np.ones(60), np.zeros(60)]
    model = quality_knn.fit(quality_knn.text_features(pa.array(texts)), labels, 16)
    asked = ["", "ab", None, texts[3], texts[3], texts[70], "over the stone bridge $$ 5"]
    x = quality_knn.text_features(pa.array(asked))
    got = quality_knn.vote(x, model, 25)
    for k in range(len(asked)):
        z = quality_knn.latent(quality_knn.weighted(x[k : k + 1], model["idf"]), model["projection"])[0]
        similar = [(-max(float(z @ v), 0) / quality_knn.GRAIN**2, i) for i, v in enumerate(model["vectors"])]
        near = sorted(similar)[:25]
        weight = sum((-s) ** 8 for s, _ in near)
        want = sum((-s) ** 8 * labels[i] for s, i in near) / weight if weight and x[k].any() else labels.mean()
        assert abs(got[k] - want) < 1e-12
    # nothing to look at: the overall share, whatever stands beside; one text alone has the score it has in company
    assert got[0] == got[1] == got[2] == 0.5 and (quality_knn.vote(quality_knn.text_features(pa.array([""])), model) == 0.5).all()
    assert all(quality_knn.vote(x[k : k + 1], model, 25)[0] == got[k] for k in range(len(asked)))


def test_quality_of_repeated_rows_and_clashing_names(spark):
    rows = [(i, " ".join(np.random.default_rng(i).permutation(BASE)), "x") for i in range(40)] * 2 + [(i, f"{i} $$$ ### {i}", "x") for i in range(40, 80)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _score string")
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(80)] * 2, "doc_id long, quality int")
    with pytest.raises(ValueError):
        quality_knn.score_quality(frame, labels, F.lit(True))
    told = quality_knn.score_quality(frame, labels, F.lit(True), score_col="s", predicted_col="p").collect()
    assert len(told) == 120 and all(r["p"] == int(r["doc_id"] < 40) for r in told)


def test_fingerprints(docs, none):
    found = fingerprints.fingerprint_documents(docs).collect()
    assert len(found) == len(ugly())
    prints = defaultdict(set)
    plain = sorted(((i, t or "") for i, t, *_ in ugly() if i is not None and i not in (1, 14)), key=lambda r: r[0])
    for r in found:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    by_id = {r["doc_id"]: r for r in found}
    order = sorted((i, t or "") for i, t, *_ in ugly() if i is not None)
    follow = {order[k][0]: order[k + 1][1] for k in range(len(order) - 1)}
    for i, t in plain:
        if i != order[-1][0]:
            half = len(t) // 2
            edited = t[: len(t) - half] + follow[i][:half]
            assert by_id[i]["n_chars"] == len(t) and by_id[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    texts = {i: t or "" for i, t in order}
    for i, r in by_id.items():
        if i is not None:
            prints[texts[i]].add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values()) and len({*map(min, prints.values())}) == len(prints)
    assert fingerprints.fingerprint_documents(none).count() == 0
    assert fingerprints.fingerprint_documents(docs.where("doc_id = 8")).first()["near_next"] == 1.0


def test_likeness_follows_exact_similarity(spark, docs):
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(rng.choice([f"w{i}" for i in range(60)], 400 + 40 * k))) for k in range(8)]
    rows += [(8 + k, rows[k][1][: 300 * (k + 1)] + " " + rows[7][1]) for k in range(4)]
    frame = spark.createDataFrame([(f"id{k:03}", t) for k, t in rows], "doc_id string, text string")
    found = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(frame).collect()}
    for k, t in rows:
        after, r = rows[(k + 1) % len(rows)][1], found[f"id{k:03}"]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()  # the last is followed by the first
        for told, other in ((r["near_next"], after), (r["near_edited"], edited)):
            a, b = shingle_set(t), shingle_set(other)
            assert abs(told - len(a & b) / len(a | b)) < 0.15


def test_sketches_merge_and_tell_containment(spark):
    w = [f"q{i}" for i in range(6000)]
    df = spark.createDataFrame([(" ".join(w), " ".join(w[:600]))], "a string, b string")
    s = df.select(fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b")).first()
    assert set(s["b"]) <= set(s["a"]) and abs(len(s["a"]) - 5996 / 4) < 200
    assert df.select(fingerprints.containment(fingerprints.sketch(F.col("b")), fingerprints.sketch(F.col("a")))).first()[0] == 1.0


def test_sentencepiece(docs, none):
    from sentencepiece import SentencePieceProcessor

    judge = SentencePieceProcessor(model_file=MODEL_FILE)
    rows = sentencepiece_codec.encode_documents(docs, MODEL_FILE).collect()
    assert Counter((r["doc_id"], tuple(r["token_ids"])) for r in rows) == Counter((i, tuple(judge.encode(t or ""))) for i, t, *_ in ugly())
    assert all(r["round_trip"] and r["parity"] and r["n_tokens"] == len(r["token_ids"]) for r in rows)
    texts = {r["doc_id"]: r["text"] for r in sentencepiece_codec.decode_documents(sentencepiece_codec.encode_documents(docs.where("doc_id is not null"), MODEL_FILE), MODEL_FILE).collect()}
    assert texts == {i: t or "" for i, t, *_ in ugly() if i is not None}
    assert sentencepiece_codec.encode_documents(none, MODEL_FILE).count() == 0
    model = sentencepiece_codec.parse_model(open(MODEL_FILE, "rb").read())
    assert len(model.pieces) == judge.get_piece_size() and model.byte_fallback and sentencepiece_codec.separable(model)


@pytest.mark.parametrize("texts", [["x\n\n y\t z ", "▁ odd ▁▁x", "<s> </s> <0x0A>", "\x00�", "ﬁ ½ é", "  a", "a  ", " "]])
def test_strange_texts_have_the_library_s_ids(texts):
    from sentencepiece import SentencePieceProcessor

    data = open(MODEL_FILE, "rb").read()
    judge = SentencePieceProcessor(model_proto=data)
    ids, back, same = sentencepiece_codec.Codec(data, 1, True).encode(texts)
    assert [np.frombuffer(x, "<i4").tolist() for x in ids] == judge.encode(texts) and all(same)
    assert back == [judge.decode(judge.encode(t)) == t for t in texts]


def test_exact_dedup(docs, none):
    texts = defaultdict(list)
    for i, t, *_ in ugly():
        texts[t or ""].append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in texts.items()}
    expected = Counter((i, keep[t or ""], len(texts[t or ""]), i == keep[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in ugly())
    assert Counter(map(tuple, exact_dedup.exact_duplicates(docs, runs=4, fan_in=2).collect())) == expected
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert Counter((r["doc_id"], r["text"] or "") for r in kept.collect()) == Counter((i, t) for t, i in keep.items())
    merged = exact_dedup.merge_runs(exact_dedup.digests(docs.repartition(7), runs=7), runs=7, fan_in=2).collect()
    assert len(merged) == len(texts) and {(r["keep_id"], r["group_size"]) for r in merged} == {(keep[t], len(ids)) for t, ids in texts.items()}
    smallest = {r["keep_id"] for r in exact_dedup.exact_duplicates(docs, keep="smallest").where("doc_id = 2").collect()}
    assert smallest == {1}
    assert exact_dedup.exact_duplicates(none).count() == 0 and exact_dedup.drop_exact_duplicates(none).count() == 0


def test_sharding(spark, docs, none):
    more = spark.createDataFrame([(100 + i, "t" * (i % 300), "en", "s", 1, 0.0, "x") for i in range(3000)] + [(7, "same", "en", "s", 1, 0.0, "x")] * 500, SCHEMA)
    frame = docs.where("length(text) < 1000 or text is null").union(more)
    rows = sharding.shard_documents(frame, shards=5, cells=256).collect()
    assert len(rows) == frame.count()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in frame.collect())
    for s in range(5):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    loads = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(5)]
    assert max(loads) < 1.01 * sum(loads) / 5 and min(loads) > 0.97 * sum(loads) / 5
    copies = sharding.shard_documents(spark.createDataFrame([(1, "same text")] * 4000, "doc_id long, text string").repartition(6), shards=4, cells=64).groupBy("shard").count().collect()
    assert sum(r["count"] for r in copies) == 4000 and max(r["count"] for r in copies) < 1040
    assert sharding.shard_documents(none).count() == 0
    assert sharding.shard_documents(docs).count() == len(ugly())


def test_ring_moves_little():
    at = [(c, c, 10, 1) for c in range(4096)]
    for epsilon, most in ((0.25, 0.035), (0.0005, 0.1)):
        owner = lambda n: {c: s for c, o, s in reversed(sharding.walk(at, n, 64, 4096, epsilon)) if o == 0}  # noqa: B023, E731
        one, two = owner(40), owner(41)
        assert sum(one[c] != two[c] for c in one) < 4096 * most


def water_level(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, budget = set(), share * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        left = budget - sum(most * sizes[s] for s in full)
        goal = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if goal[s] > most * sizes[s]]
        if not over:
            return goal | {s: most * sizes[s] for s in full}
        full.update(over)


def test_mixing(spark, docs, none):
    rng = np.random.default_rng(1)
    more = [(1000 + i, " ".join(["w"] * int(rng.integers(1, 60))), "en", "hot" if i % 2 else f"s{i % 9}", 1, 0.0, "x") for i in range(3000)]
    rows = [*ugly(), *more]
    frame = docs.union(spark.createDataFrame(more, SCHEMA))
    found = mixing.mix_sources(frame, fan_in=8).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    goals = water_level(sizes)
    assert len(found) == len(rows)
    taken = Counter()
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - goals[r["source"]]) < 1e-6 * max(1, goals[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - goals[s]) <= max(len(words(r[1])) for r in rows if r[3] == s)
    again = mixing.mix_sources(frame.repartition(5), fan_in=8)
    assert Counter((r["doc_id"], r["taken"]) for r in again.collect()) == Counter((r["doc_id"], r["taken"]) for r in found)
    assert mixing.mix_sources(none).count() == 0
    mixed = mixing.mixed_documents(frame)
    assert mixed.columns == frame.columns
    given = Counter()  # the draws differ, as rows are told apart by their texts too; the sums don't by more than a document
    for r in mixed.collect():
        given[r["source"]] += len(words(r["text"]))
    for s in sizes:
        assert abs(given[s] - goals[s]) <= max(len(words(r[1])) for r in rows if r[3] == s)
    assert {r["taken"] for r in mixing.mix_sources(docs.where("doc_id in (5, 6, 7)")).collect()} == {0}


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    columns = frame.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, frame = frame, stage(spark, frame, sf).cache()
        assert frame.columns == columns, name
        assert {r["doc_id"] for r in frame.collect()} <= {r["doc_id"] for r in before.collect()}
        if name == "exact_dedup":
            assert frame.count() == before.select("text").distinct().count()
    out = corpus_pipeline.STAGES[-1][1](spark, frame, sf)
    assert out.count() == frame.count() and out.where("not round_trip or not parity").count() == 0
    nothing = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, sf).count() == 0
