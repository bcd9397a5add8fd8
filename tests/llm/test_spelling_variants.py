"""Words one edit apart against all pairs, whatever the ranges; words and counts against plain loops."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import spelling_variants as sv

SCHEMA = "doc_id long, text string, word string, n long, form string"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def brute(n):
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def made_words(seed, count, letters, low=6, high=9):
    rng = random.Random(seed)
    words = set()
    while len(words) < count:
        w = "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))
        words.add(w)
        if rng.random() < 0.6:
            i = rng.randrange(len(w))
            words.add(rng.choice([w[:i] + w[i + 1 :] + "", w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]]))
    return sorted(words)


@pytest.mark.parametrize(("letters", "count"), [("ab", 200), ("abcé", 500), ("abcdefghijÿ", 700)])
@pytest.mark.parametrize("parts", [1, 7])
def test_merging_finds_each_pair_once(letters, count, parts):
    """Ranges merged one by one, and what they leave to others met by hand."""
    words = made_words(count, count, letters)
    size = -(-len(words) // parts)
    ranges = [words[k : k + size] for k in range(0, len(words), size)]
    sides = [[ranges[k - 1][-1]] * (k > 0) + ([ranges[k + 1][0]] if k + 1 < len(ranges) else []) for k in range(len(ranges))]
    weight = Counter()
    for own, path in zip(ranges, sides, strict=True):
        for prefix, shared, _, children in sv.nodes(own, path):
            if shared:
                weight.update({(prefix, c): hi - lo for c, lo, hi in children})
    heavy = {p: sv.heaviest([(c, k) for (q, c), k in weight.items() if q == p]) for p, _ in weight}
    pairs, sought, wild = Counter(), [], {}
    for own, path in zip(ranges, sides, strict=True):
        for w, _, key, *inside in sv.merge(own, [1] * len(own), path, heavy):
            if inside:
                pairs[tuple(sorted((w, key)))] += 1
            elif sv.WILD in key:
                wild.setdefault(key, []).append(w)
            else:
                sought.append((w, key))
    there = set(words)
    pairs.update(tuple(sorted(p)) for p in sought if p[1] in there)
    pairs.update(tuple(sorted((a, b))) for mates in wild.values() for i, a in enumerate(mates) for b in mates[:i])
    assert pairs == Counter((a, b) for i, a in enumerate(words) for b in words[i + 1 :] if one_edit(a, b))


@pytest.mark.parametrize("least", [500, 3])
def test_variants_against_all_pairs(spark, least):
    rng = random.Random(3)
    chains = [("common", 250), ("commmon", 40), ("commmmon", 5), ("Comoné", 5), ("commoñ", 5), ("ÉtÉzzz", 7), ("étézzz", 6), ("aaaaaa", 40), ("aaaaaaa", 8), ("aaaaaaaaaaaaaaaa", 9), ("short", 99)]
    bag = [w for w, k in chains for _ in range(k)] + [w for w in made_words(9, 90, "abc") for _ in range(rng.randint(3, 40))] + ["x" * 70_000] * 6 + ["x" * 70_001] * 5
    rng.shuffle(bag)
    rows = [(i, " ".join(bag[i * 20 : i * 20 + 20])) for i in range(len(bag) // 20 + 1)]
    rows += [(None, "common common 123 common-Common"), (7, None), (8, ""), (9, "... 12 你好"), (rows[3][0], rows[3][1]), (rows[3][0], rows[3][1])]
    docs = spark.createDataFrame([(i, t, "word", 1, "form") for i, t in rows], SCHEMA).repartition(5)
    found = sv.spelling_variants(docs, least_range=least).collect()
    expected = brute(brute_words(rows))
    assert len(found) == len(expected)
    assert {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found} == expected
    assert {r["root"] for r in found if r["word"] == "commmmon"} == {"common"}


def test_no_words(spark):
    assert sv.spelling_variants(spark.createDataFrame([], SCHEMA)).count() == 0
    assert sv.spelling_variants(spark.createDataFrame([(1, None, "", 1, ""), (2, "few words", "", 1, "")], SCHEMA)).count() == 0


def test_words_of_a_real_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    found = {r["word"]: r["n"] for r in sv.word_counts(docs).collect()}
    assert found == brute_words([tuple(r) for r in docs.collect()]) and found
    near = sv.near_words(sv.word_counts(docs), 20).select(F.least("word", "other").alias("a"), F.greatest("word", "other").alias("b")).collect()
    words = sorted(found)
    assert Counter(map(tuple, near)) == Counter((a, b) for i, a in enumerate(words) for b in words[i + 1 :] if one_edit(a, b))
