"""Nearest passages and grounding against plain Python."""

import difflib
import random
import re

import numpy as np
import pytest

from tessera.functions.similarity import _candidates, ground
from tessera.operators import retrieve
from tessera.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("by_document", [False, True])
def test_nearest(spark, monkeypatch, by_document):
    rng = np.random.default_rng(3)
    vectors = [(int(d), i, v) for i, (d, v) in enumerate(zip(rng.integers(0, 7, 400), [*rng.normal(size=(390, 8)).round(1).tolist(), *[[1.0] * 8] * 5, None, [1.0, 2.0], [0.0] * 8, *rng.normal(size=(2, 8)).tolist()]))]
    asked = [(q, v, int(k)) for q, (v, k) in enumerate(zip([*rng.normal(size=(20, 8)).tolist(), [1.0] * 8, None, [0.0] * 8], [3] * 18 + [0, 7, 5, 2, 2]))]
    monkeypatch.setattr(retrieve, "QUESTIONS", 6)
    passages = spark.createDataFrame(vectors, "document long, passage long, vector array<double>").repartition(5)
    got = retrieve.nearest(passages, spark.createDataFrame(asked, "question long, vector array<double>, k int"), by_document)
    unit = lambda v: np.array(v) / (np.sqrt(np.dot(v, v)) + 1e-8)
    want = set()
    for q, v, k in asked:
        for d in range(7) if by_document else [None]:
            own = [(-round(float(unit(v) @ unit(x)), 9), -i, e) for e, i, x in vectors if v is not None and x is not None and len(x) == len(v) and d in (None, e)]
            want |= {(q, *([e] if by_document else []), -i, n) for n, (_, i, e) in enumerate(sorted(own)[:k], 1)}
    cols = ["question", *(["document"] if by_document else []), "passage", "rank"]
    assert {tuple(r) for r in got.select(*cols).collect()} == want and len(want) > 50
    assert got.columns[-1] == "rank" and retrieve.nearest(passages.where("false"), spark.createDataFrame(asked, "question long, vector array<double>, k int"), by_document).count() == 0


def naive(excerpt, source):
    if not excerpt or not source:
        return "not_found", -1, -1
    if excerpt in source:
        return "exact", source.find(excerpt), source.find(excerpt) + len(excerpt)
    at = source.lower().find(excerpt.lower())
    if at >= 0:
        return "case_insensitive", at, at + len(excerpt)
    words, have = excerpt.split(), source.split()
    n, target = len(words), set(excerpt.lower().split())
    best, place = 0.0, None
    for i in range(len(have) - n + 1 if n >= 3 else 0):
        window = have[i : i + n]
        own = {w.lower() for w in window}
        if len(own & target) / len(own | target) < 0.3:
            continue
        r = difflib.SequenceMatcher(None, excerpt.lower(), " ".join(window).lower()).ratio()
        if r > best:
            best, place = r, i
    if place is not None and best >= 0.6:
        found = " ".join(have[place : place + n])
        if found in source:
            return "fuzzy", source.find(found), source.find(found) + len(found)
    return "not_found", -1, -1


def test_ground_is_the_plain_search():
    rng = random.Random(5)
    words = ["the", "The", "model", "models", "was", "trained", "on", "data", "datum,", "a", "I", "é", "x"]
    statuses = set()
    for _ in range(1500):
        source = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\n"]) for _ in range(rng.randint(0, 60)))
        own = source.split()
        at = rng.randint(0, max(0, len(own) - 8))
        piece = own[at : at + rng.randint(1, 12)]
        for _ in range(rng.randint(0, 4)):
            if piece:
                piece[rng.randrange(len(piece))] = rng.choice(words)
        excerpt = rng.choice([" ", " ", "  "]).join(piece) + rng.choice(["", "", " "])
        got = ground(excerpt, source)
        assert got == naive(excerpt, source), (excerpt, source)
        statuses.add(got[0])
    assert statuses == {"exact", "case_insensitive", "fuzzy", "not_found"}
    long = " ".join(rng.choice(words) for _ in range(3000))
    piece = long.split()[1000:1060]
    piece[7], piece[30] = "other", "thing"
    assert ground(" ".join(piece), long) == naive(" ".join(piece), long)


def test_ground_query(spark):
    """Every document against the excerpt the query makes of it."""
    got = {r.doc_id: (r.status, r.char_start, r.char_end) for r in QUERIES["sim_12_ground_fuzzy"](spark, SF).collect()}
    seen = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        words = re.split(r"\s+", r.text)
        excerpt = " ".join([*words[:6], "other", *words[7:]][2:14] if len(words) > 6 else words[2:14])
        if len(words) < 1500:
            assert got[r.doc_id] == naive(excerpt, r.text), r.doc_id
            seen.add(got[r.doc_id][0])
    assert "fuzzy" in seen


def test_candidates_count_near_words_only():
    """Letters are counted in the words of windows that are near, not in all of a long text."""
    counted = []

    class Word(str):
        def count(self, *args):
            counted.append(str(self))
            return super().count(*args)

    want = "one two three four five".split()
    have = [Word(f"far{i}") for i in range(500)] + [Word(w) for w in "one two other four five".split()] + [Word(f"off{i}") for i in range(500)]
    near, most = _candidates(want, have, 0.3)
    assert near.tolist() == [499, 500, 501] and most.argmax() == 1
    assert set(counted) == {"far499", "one", "two", "other", "four", "five", "off0"}
