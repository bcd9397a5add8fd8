"""Stated alternatives against a token-by-token reading, and claims worked out by hand."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from tessera.operators.alternatives import GRAMMAR, alternatives, qualified_claims


def read(text):
    """Positions of tokens, runs by a set of allowed words, cut at the joiner."""
    tokens = [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"\w+|[^\w\s]", text)]
    allowed, out, at = {*GRAMMAR, "or", "a", "an", ".", ","}, [], 0
    while at < len(tokens):
        if tokens[at][0] not in GRAMMAR:
            at += 1
            continue
        end = next((k for k in range(at, len(tokens)) if tokens[k][0] not in allowed), len(tokens))
        cuts = [at - 1, *(k for k in range(at, end) if tokens[k][0] == "or"), end]
        spans = [[t for t in tokens[a + 1 : b] if t[0] in GRAMMAR] for a, b in zip(cuts, cuts[1:], strict=False)]
        if len(spans) > 1 and all(spans):
            branches = []
            for s in spans:
                high = s[-1][2] + (text[s[-1][2] : s[-1][2] + 1] == ".")
                said = {}
                for word, *_ in s:
                    said.setdefault(GRAMMAR[word][0], set()).add(GRAMMAR[word][1])
                branches.append((text[s[0][1] : high], s[0][1], high, {k: min(v) for k, v in said.items() if len(v) == 1}, sorted(k for k, v in said.items() if len(v) > 1)))
            out.append((branches[0][1], branches[-1][2], text[branches[0][1] : branches[-1][2]], branches))
        at = end
    return out


def found(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string").repartition(3).select("k", alternatives(F.col("text")).alias("a")).orderBy("k").collect()
    return [None if r["a"] is None else [(a["start"], a["end"], a["text"], [(b["label"], b["start"], b["end"], b["features"], b["unresolved"]) for b in a["branches"]]) for a in r["a"]] for r in rows]


def test_against_reading_by_tokens(spark):
    rng = random.Random(2)
    words = ["nom", "acc.", "Gen.", "pl", "or", "OR", "or", "a", "an", ",", ".", "word", "é", "fem", "3rd", "-", "orb", "\U0001f600", "nominative"]
    texts = ["".join(w + rng.choice([" ", " ", "  ", "\n", ""]) for w in rng.choices(words, k=rng.randrange(0, 25))) for _ in range(1000)]
    texts += ["", "or", "nom. or", "or acc.", "nom. or acc. pl.", "xnom or acc", "nom or accé", "nom. acc. or gen."]
    results = found(spark, texts)
    assert results == [read(t) for t in texts]
    assert sum(map(len, results)) > 100
    assert results[-1][0][3][0] == ("nom. acc.", 0, 9, {}, ["case"])
    assert found(spark, [None]) == [None]


def test_a_run_of_any_length(spark):
    rows = found(spark, ["gen. pl., " * 30_000 + "or acc. sg."])
    assert len(rows[0]) == 1 and len(rows[0][0][3]) == 2 and rows[0][0][1] == 300_011


def test_claims_on_alternatives(spark):
    quote = "here nom. or acc. pl.; also gen. or dat. of it"
    case = lambda v, **more: {"case": v, **more}
    one, other = [("r1", quote)], [("r2", quote)]
    rows = [
        ("a", "s", True, "nom.", case("nominative"), None, None, one),
        ("b", "s", True, "acc. pl.", case("accusative", number="plural"), None, None, one),
        ("c", "s", True, "gen.", case("genitive"), None, None, one),  # dat. is shown by none that is accepted
        ("d", "s", False, "dat.", case("dative"), None, None, one),
        ("e", "t", True, "nom.", case("nominative"), None, None, other),  # another subject
        ("f", "t", True, "acc.", {"gender": "feminine"}, None, None, other),  # nothing against it, not complete
        ("g", "t", True, "nom.", {}, None, None, other),
        ("h", "t", True, None, case("nominative"), None, None, other),
        ("i", "t", True, "nom.", case("nominative"), 3, 7, other),  # not there
        ("j", "t", True, "here", case("nominative"), None, None, other),
        ("k", None, True, "nom.", case("nominative"), 5, 9, one),
        ("l", "t", True, "nom.", case("nominative"), None, None, [(None, None)]),
    ]
    kind = "claim_id string, subject string, accepted boolean, label string, features map<string,string>, start int, end int, evidence array<struct<record_id:string,quote:string>>"
    out = {r["claim_id"]: (r["status"], r["n_complete"], r["conflicting"]) for r in qualified_claims(spark.createDataFrame(rows, kind)).collect()}
    assert out == {
        "a": ("represented", 1, ["case"]), "b": ("represented", 1, ["case"]), "c": ("incomplete", 0, ["case"]), "d": ("incomplete", 0, ["case"]),
        "e": ("incomplete", 0, ["case"]), "f": ("partial", 0, []), "k": ("incomplete", 0, ["case"]),
    }
    assert qualified_claims(spark.createDataFrame([], kind)).count() == 0
