"""Models: their parts against brute force, their results on held-out rows."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import crf, hpy, langid

from .test_exact import folded

SF = "/root/testdata/sf0.001"


def test_language(spark, make, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert len(held) > 200 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.99
    assert all(0 <= r.score <= 1 for r in out)
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.predict(make(odd), model).collect()}
    assert got[5].lang_pred == got[6].lang_pred == got[7].lang_pred == "und" and got[5].score == 0
    assert got[1].lang_pred in model and got[1].source == "src"
    assert {r.lang_pred for r in langid.predict(make(odd), {}).collect()} == {"und"}
    assert langid.fit(make([(1, "x", None)])) == {} and langid.predict(make([]), model).count() == 0


def test_bundles_by_brute_force(make, odd):
    """Every trigram's vector bound letter by letter and summed; then cosines with prototypes made of them."""
    import pyarrow as pa

    from tessera.llm.textcore import text_buffer

    def vector(text):
        marks = [0, *(ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 0 for c in text), 0]
        out = np.zeros(langid.DIM)
        for a, b, c in zip(marks, marks[1:], marks[2:]):
            if b:
                v = [langid.letter_vector(z).astype(float) for z in (a, b, c)]
                out += np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
        return out

    texts = [(t or "")[:400] for _, t in odd] + ["a", "ab", "Élan vital!", "x" * 50]
    want = np.array([vector(t) for t in texts])
    assert np.allclose(langid.bundles(*text_buffer(pa.array(texts))), want)
    rows = [(i, t, ["en", "fr", None][i % 3]) for i, t in enumerate(texts)]
    model = langid.fit(make(rows))
    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    for name in ("en", "fr"):
        assert np.allclose(model[name], sum(unit(want[i]) for i, _, lang in rows if lang == name), atol=1e-4)
    for r in langid.predict(make(rows), model).collect():
        cos = {k: float(unit(want[r.doc_id]) @ unit(model[k])) for k in model}
        if not want[r.doc_id].any():
            assert (r.lang_pred, r.score) == ("und", 0)
        else:
            assert r.score == pytest.approx(max(0, max(cos.values())), abs=1e-4) and cos[r.lang_pred] == pytest.approx(max(cos.values()), abs=1e-4)


def test_fit_draws_whole_documents_by_size(spark, make):
    rows = [(i, "good line here\n" * 40 if i % 2 else "@@ ## !!\n" * 60) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(1, 1, 0)], "doc_id long, quality int, toxic int")
    for chars in (10**9, 8000):
        field = crf.fit(make([*rows, (1000, "z" * (crf.LONGEST + 1))]), labels, chars=chars)
        got = {r.doc_id: r.score for r in crf.score(make(rows), field).collect()}
        assert got[1] > 0.5 > got[0]


def test_chain_marginals():
    rng = np.random.default_rng(0)
    unary, trans = rng.normal(size=7), rng.normal(size=(2, 2))
    first = np.array([0, 4, 5, 7])
    p, pairs = crf.marginals(unary, trans, first)
    want, count = [], np.zeros((2, 2))
    for a, b in zip(first, first[1:]):
        u, z, m, c = unary[a:b], 0.0, np.zeros(b - a), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=b - a):
            w = math.exp(sum(u[i] * y[i] for i in range(len(u))) + sum(trans[y[i], y[i + 1]] for i in range(len(u) - 1)))
            z, m = z + w, m + w * np.array(y)
            for i in range(len(u) - 1):
                c[y[i], y[i + 1]] += w
        want.append(m / z)
        count += c / z
    assert np.allclose(p, np.concatenate(want)) and np.allclose(pairs, count)


def test_quality_of_many_lines(spark, make):
    """Lines bound what is learnt from as documents and characters do, and a document of very many is left out."""
    rng = random.Random(1)
    good = lambda: "\n".join("the words of a line that says something" + str(rng.random()) for _ in range(40))
    rows = [(i, good() if i % 2 else "\n" * 40 + "| x |" * 5) for i in range(80)] + [(2000, "\n" * (crf.MOST_LINES + 1))]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)] + [(2000, 1, 0)], "doc_id long, quality int, toxic int")
    for most in (800, 10**6):
        field = crf.fit(make(rows), labels, lines_at_most=most)
        got = {r.doc_id: r.score for r in crf.score(make(rows), field).collect()}
        assert field is not None and sum((got[i] >= 0.5) == (i % 2 == 1) for i in range(80)) > 70 and 0 <= got[2000] <= 1


def test_quality(spark, make, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = crf.quality(docs, labels).join(labels, "doc_id").where("held_out and quality is not null").collect()
    assert len(out) > 80 and sum(r.quality == r.predicted for r in out) / len(out) > 0.97
    field = crf.fit(docs, labels)
    got = {r.doc_id: r.score for r in crf.score(make(odd), field).collect()}
    assert len(got) == len(odd) and all(0 <= s <= 1 for s in got.values())
    assert {r.score for r in crf.score(make(odd), crf.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert crf.score(make([]), field).count() == 0


def test_stirling_numbers_count_seatings():
    # two customers: one table with weight 1 - d, or two
    s = np.exp(hpy.stirling(0.5))
    assert s[2, 1] == pytest.approx(0.5) and s[2, 2] == pytest.approx(1) and s[3, 1] == pytest.approx(0.75) and s[3, 2] == pytest.approx(1.5)


def test_tables_follow_their_conditional():
    rng = np.random.Generator(np.random.Philox(1))
    n, c, p0, d, theta = 20_000, 3, 0.1, 0.8, 1.0
    draws = hpy.sweep_tables(np.full(n, c), np.ones(n, np.int64), np.arange(n), np.ones(n), np.full(n, p0), d, theta, rng)
    s = np.exp(hpy.stirling(d))
    w = np.array([s[c, t] * p0**t * np.prod([theta + d * k for k in range(t)]) for t in (1, 2, 3)])
    assert np.allclose(np.bincount(draws, minlength=4)[1:] / n, w / w.sum(), atol=0.02)


@pytest.mark.parametrize("frequent", [100_000, 4])
def test_scores(spark, make, odd, frequent, monkeypatch):
    monkeypatch.setattr(hpy, "FREQUENT", frequent)
    rows = [(100 + i, t) for i, t in enumerate(["a b a b c", "A b", None, "", "c c c d", "a b a b c", "new words here", "a b"] * 6)] + odd
    out = {r.doc_id: r for r in hpy.scores(make(rows)).collect()}
    assert len(out) == len(rows)
    tokens = {d: [*folded(t), "\0"] for d, t in rows}
    train = [d for d in tokens if zlib.crc32(str(d).encode()) % 7 != 2]
    count = Counter(w for d in train for w in tokens[d])
    n, v = sum(count.values()), len(count)
    for d, w in tokens.items():
        r = out[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (d not in train, len(w), sum(count[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)) and r.score < 0
    assert sum(r.score for r in out.values()) > sum(r.base_score for r in out.values())
    assert hpy.scores(make([])).count() == 0


def test_scores_of_rows_with_no_or_the_same_id(make):
    rows = [(1, "a b"), (1, "a b"), (1, "c"), (None, "a b c d"), (None, None), (2, "a")]
    out = sorted((r.doc_id or -1, r.n_tokens, round(r.base_score, 6)) for r in hpy.scores(make(rows)).collect())
    assert [x[:2] for x in out] == [(-1, 1), (-1, 5), (1, 2), (1, 3), (1, 3), (2, 2)]
    assert out[3] == out[4]


def test_predictive_probabilities_sum_to_one():
    """Over all words and one never seen: of the parent with words of both kinds, of a restaurant, and of one in parts."""
    rng = np.random.default_rng(3)
    words = np.sort(rng.integers(1, 2**63, 40).astype(np.uint64))
    counts = rng.integers(1, 50, 40)
    parent = hpy.Parent(words, counts, 5, int(counts.sum()), 40)
    assert parent.p.sum() + parent.open == pytest.approx(1)
    few = rng.integers(1, 4, 30)
    parent = hpy.Parent(words, counts, 5, int(counts.sum() + few.sum()), 70)
    tables = parent.seat_rare(few, 1)
    parent.seat(counts, few.sum(), tables.sum())
    assert parent.p.sum() + parent.rare(few, tables).sum() + parent.open == pytest.approx(1, abs=1e-6)
    p0 = np.concatenate([parent.p, parent.rare(few, tables), [parent.open]])
    c = np.append(rng.integers(0, 4, 70), 0)
    zero = np.zeros(len(c))
    assert hpy.Restaurants(zero.astype(np.uint64), c, p0, zero, zero, 1).predictive().sum() == pytest.approx(1, abs=1e-6)
    part = np.arange(len(c)) % 3
    order = np.argsort(part, kind="stable")
    whole = hpy.Restaurants(zero.astype(np.uint64), c, p0, zero, zero, 2)
    whole.sweep()
    r = hpy.Restaurants(part[order].astype(np.uint64), c[order], p0[order], np.full(len(c), c.sum()), np.full(len(c), whole.t.sum()), 3)
    assert r.predictive().sum() == pytest.approx(1, abs=0.05)


def _exact(children, v):
    """Predictive probabilities of words in contexts under the whole posterior, all seatings enumerated."""
    from itertools import product

    s = {d: np.exp(hpy.stirling(d)) for d in (hpy.DISCOUNT, hpy.PARENT_DISCOUNT)}

    def weight(c, t, d, theta):
        n, k = sum(c), sum(t)
        up = np.prod([theta + d * i for i in range(1, k)]) if k else 1.0
        return up / np.prod([theta + i for i in range(1, n)]) * np.prod([s[d][x, y] for x, y in zip(c, t) if x])

    total, mass = np.zeros((len(children), v)), 0.0
    seats = [list(product(*[range(1, x + 1) if x else [0] for x in c])) for c in children]
    for ts in product(*seats):
        own = np.prod([weight(c, t, hpy.DISCOUNT, hpy.STRENGTH) for c, t in zip(children, ts)])
        top = [sum(t[w] for t in ts) for w in range(v)]
        for tops in product(*[range(1, x + 1) if x else [0] for x in top]):
            p = own * weight(top, tops, hpy.PARENT_DISCOUNT, hpy.PARENT_STRENGTH) * (1 / (v + 1)) ** sum(tops)
            norm = hpy.PARENT_STRENGTH + sum(top)
            p0 = (np.array(top) - hpy.PARENT_DISCOUNT * np.array(tops)) / norm + (hpy.PARENT_STRENGTH + hpy.PARENT_DISCOUNT * sum(tops)) / norm / (v + 1)
            for u, (c, t) in enumerate(zip(children, ts)):
                total[u] += p * ((np.array(c) - hpy.DISCOUNT * np.array(t)) + (hpy.STRENGTH + hpy.DISCOUNT * sum(t)) * p0) / (hpy.STRENGTH + sum(c))
            mass += p
    return total / mass


def test_sampler_against_all_seatings():
    """The chain of parent, children, parent, children, averaged over seeds, is near the exact posterior."""
    children, v = [[3, 1, 0], [1, 0, 2], [2, 0, 0]], 3
    want = _exact(children, v)
    counts = np.sum(children, 0)
    key, word = np.repeat(np.arange(3), v), np.tile(np.arange(v), 3)
    c = np.ravel(children)
    zero = np.zeros(len(c))
    got, rounds = np.zeros((3, v)), 200
    for seed in range(rounds):
        parent = hpy.Parent(np.arange(1, v + 1).astype(np.uint64), counts, 1, int(counts.sum()), v)
        r = hpy.Restaurants(key.astype(np.uint64), c, parent.p[word], zero, zero, seed)
        for _ in range(hpy.BURN_IN + 1):
            r.sweep()
        parent.seat(np.bincount(word, r.t, v), 0, 0)
        got += hpy.Restaurants(key.astype(np.uint64), c, parent.p[word], zero, zero, 1000 + seed).predictive().reshape(3, v) / rounds
    print(np.round(got, 3), np.round(want, 3), np.abs(got - want).max())
    assert np.abs(got - want).max() < 0.03


def test_held_out_perplexity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = [r for r in hpy.scores(docs).collect() if r.held_out]
    per_token = lambda name: sum(getattr(r, name) for r in held) / sum(r.n_tokens for r in held)
    assert per_token("score") > per_token("base_score") + 0.3
