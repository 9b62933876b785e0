"""Near-duplicate passages among variants, against brute force."""

import random

import numpy as np

from tessera.llm import windows

PER = 46


def word(rng):
    return "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))


def edited(rng, passage, every, first):
    out = list(passage)
    for i in range(first, len(out), every):
        out[i] = word(rng)
    return out


def alike(own, other):
    """Starts of 46-shingle stretches of ``own`` that share 41 shingles or more, place by place, with a stretch of ``other``: similarity 0.8."""
    w, v = ([hash(tuple(x[i : i + 5])) for i in range(len(x) - 4)] for x in (own, other))
    same = np.array(w)[:, None] == np.array(v)[None, :]
    found = set()
    for shift in range(-len(w) + PER, len(v) - PER + 1):
        d = np.diagonal(same, shift).astype(int)
        sums = np.cumsum(np.append(0, d))
        if len(d) >= PER:
            found |= {int(i) + max(0, -shift) for i in np.flatnonzero(sums[PER:] - sums[:-PER] >= 41)}
    return found


def test_exact_copy_among_variants(make):
    """Ten variants of a passage, none like another; then the passage twice: the last document's only source is the one before it."""
    rng = random.Random(5)
    rows, want = [], {}
    for g in range(20):
        passage = [word(rng) for _ in range(200)]
        for v in range(12):
            body = edited(rng, passage, 24, 2 * v) if v < 10 else passage
            filler = [word(rng) for _ in range(120)]
            rows.append((100 * g + v, " ".join([*filler[:60], *body, *filler[60:]])))
        want[100 * g + 11] = 100 * g + 10
    out = {r.doc_id: r for r in windows.passage_dedup(make(rows)).collect()}
    for d, source in want.items():
        assert source in out[d].partners
        assert sum(min(s.last_word, 260) - max(s.first_word, 60) for s in out[d].spans) >= 195
    assert not any(out[d].spans for d in out if d % 100 == 0)


def test_recall_by_brute_force(make):
    """Passages of 50 to 120 words from a pool, with edits of their own, among other text."""
    rng = random.Random(11)
    pool = [[word(rng) for _ in range(rng.randint(50, 120))] for _ in range(12)]
    texts = []
    for _ in range(90):
        body = [word(rng) for _ in range(rng.randint(20, 60))]
        for p in rng.sample(pool, 2):
            every = rng.choice([1000, 70, 50, 30, 22])
            body += [*edited(rng, p, every, rng.randint(0, every - 1)), *[word(rng) for _ in range(rng.randint(5, 40))]]
        texts.append(body)
    out = {r.doc_id: r for r in windows.passage_dedup(make([(i, " ".join(t)) for i, t in enumerate(texts)])).collect()}
    stretches = caught = with_source = with_partner = wrong = spans = 0
    for m, own in enumerate(texts):
        by = {p: found for p in range(m) if (found := alike(own, texts[p]))}
        covered = set()
        for s in out[m].spans:
            covered |= set(range(s.first_word, s.last_word))
        truth = set().union(*by.values()) if by else set()
        stretches += len(truth)
        caught += sum(set(range(i + 4, i + PER)) <= covered for i in truth)
        with_source += bool(by)
        with_partner += bool(by) and bool(set(out[m].partners) & set(by))
        spans += len(out[m].partners)
        wrong += len(set(out[m].partners) - set(by))
    print("stretches", caught, stretches, "documents", with_partner, with_source, "partners", spans, "of them not alike place by place", wrong)
    assert caught >= 0.9 * stretches and with_partner >= 0.9 * with_source and wrong <= 0.1 * spans


def test_matches_with_two_alignments():
    """Half of a run is found elsewhere in the other document."""
    own = np.arange(100, dtype=np.uint32)
    other = np.concatenate([own[50:], np.arange(1000, 2000, dtype=np.uint32), own[:50]])
    assert sorted(windows.matches(own, other)) == [(0, 50), (50, 100)]
    assert windows.matches(own, own) == [(0, 100)] and windows.matches(own, own + 5000) == []


def test_cover_by_brute_force():
    rng = np.random.default_rng(3)
    n = 4000
    member, partner, k, shift = rng.integers(0, 12, n), rng.integers(20, 26, n), rng.integers(0, 8, n), rng.integers(-5, 6, n)
    i = rng.integers(0, 400, n)
    j = i + rng.integers(0, 40, n)
    got = {(m, p): tuple(x) for m, p, *x in zip(*(c.tolist() for c in windows.covered(member, partner, k, shift, i, j)))}
    want = {}
    for m in range(12):
        for p in range(20, 26):
            own = np.flatnonzero((member == m) & (partner == p))
            on = np.zeros((8, 500), bool)
            for x in own:
                on[k[x], i[x] : j[x] + 1] = True
            at = np.flatnonzero(on.sum(0) >= windows.ENOUGH)
            if len(at):
                want[m, p] = (at[0], at[-1], max(0, at[0] - shift[own].max()), at[-1] - shift[own].min())
    assert got == want
    assert all(len(c) == 0 for c in windows.covered(*[np.zeros(0, np.int64)] * 6))


def test_no_source_is_left_out(make):
    """Every document that has a passage of an earlier one finds one that holds it, however many variants share its signatures."""
    rng = random.Random(11)
    pool = [[word(rng) for _ in range(rng.randint(50, 120))] for _ in range(12)]
    texts = []
    for _ in range(90):
        body = [word(rng) for _ in range(rng.randint(20, 60))]
        for p in rng.sample(pool, 2):
            every = rng.choice([1000, 70, 50, 30, 22])
            body += [*edited(rng, p, every, rng.randint(0, every - 1)), *[word(rng) for _ in range(rng.randint(5, 40))]]
        texts.append(body)
    out = {r.doc_id: r for r in windows.passage_dedup(make([(i, " ".join(t)) for i, t in enumerate(texts)])).collect()}
    for m, own in enumerate(texts):
        by = {p for p in range(m) if alike(own, texts[p])}
        assert not by or by & set(out[m].partners), m


def test_alike_contents_by_brute_force():
    """Small groups give all pairs; in large ones what a window has alike with any earlier one is covered by the pairs."""
    rng = np.random.default_rng(2)
    s, doc, size, left, data = [], [], [], [], []
    for g, m in ((1, 40), (2, 150), (3, 1), (4, 70)):
        base = [rng.integers(0, 256, 91) for _ in range(5)]
        for d in range(m):
            own = base[rng.integers(5)].copy()
            own[rng.integers(0, 91, rng.integers(0, 12))] = rng.integers(0, 256)
            a, b = rng.choice([(0, 91), (0, 46), (0, 60), (20, 91), (20, 70), (45, 91)])
            s.append(g), doc.append(d // 2), size.append(b - a), left.append(45 - a), data.append(own[a:b])
    size, doc = np.array(size), np.array(doc)
    at = np.cumsum(size) - size
    a, b = windows.alike_contents(np.array(s, np.uint64), doc, at, size, np.concatenate(data).astype(np.uint8), np.array(left))
    got = set(zip(a.tolist(), b.tolist()))

    def covered(x, y):
        hit = np.isin(data[x], data[y])
        return {i + q for i in range(len(hit) - 45) if hit[i : i + 46].sum() >= windows.ALIKE for q in range(46)}

    for x in range(len(s)):
        want = {y: found for y in range(x) if s[y] == s[x] and doc[y] != doc[x] and (found := covered(x, y))}
        mine = {y for p, y in got if p == x}
        assert mine <= set(want)
        if s[x] in (1, 3):
            assert mine == set(want)
        else:
            assert set().union(*(want[y] for y in mine)) == set().union(*want.values())


def test_source_behind_many_that_seem_alike(make):
    """Three hundred documents have a passage of 50 words with two words of their own, 40 of its 46 shingles; behind them one has all of it, and a last one too: its source is found."""
    rng = random.Random(3)
    rows = []
    for g in range(5):
        passage = [f"p{rng.randrange(10**9)}" for _ in range(50)]
        for v in range(302):
            body = list(passage)
            if v < 300:
                body[rng.choice([0, 49])] = body[rng.randrange(5, 45)] = f"e{rng.randrange(10**9)}"
            around = [f"f{rng.randrange(10**9)}" for _ in range(50)]
            rows.append((1000 * g + v, " ".join([*around[:25], *body, *around[25:]])))
    out = {r.doc_id: r for r in windows.passage_dedup(make(rows)).collect()}
    for g in range(5):
        assert out[1000 * g + 301].partners == [1000 * g + 300], g
        assert [(s.first_word, s.last_word) for s in out[1000 * g + 301].spans] == [(25, 75)], g


def test_proved_by_brute_force():
    """In a large group proved places are those that 41 of 46 shingles hold place by place, and all that an earlier window proves lies in what is given."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**32, 91, dtype=np.uint32)
    rows, doc, size, left = [], [], [], []
    for d in range(150):
        own = base.copy()
        for e in rng.integers(0, 91, rng.integers(0, 4)):
            own[e : e + 5] = rng.integers(0, 2**32, len(own[e : e + 5]), dtype=np.uint32)
        own[45] = base[45]
        a, b = [(0, 91), (0, 60), (20, 91), (20, 70), (45, 91)][rng.integers(5)]
        rows.append(own[a:b]), doc.append(d // 2), size.append(b - a), left.append(45 - a)
    size, left, doc, codes = np.array(size), np.array(left), np.array(doc), np.concatenate(rows)
    at = np.cumsum(size) - size
    w = windows.Held(at, size, windows.slot(codes, 8), left, codes, at)
    a, b, first, last, _ = windows.compared(np.ones(150, np.uint64), doc, w)
    full = [dict(zip(range(45 - x, 45 - x + y), r.tolist())) for x, y, r in zip(left.tolist(), size.tolist(), rows)]

    def places(x, y):
        hit = [p in full[x] and full[x][p] == full[y].get(p) for p in range(91)]
        out = set()
        for p in range(46):
            if p in full[x] and p + 45 in full[x] and p in full[y] and p + 45 in full[y] and sum(hit[p : p + 46]) >= 41:
                own = [q for q in range(p, p + 46) if hit[q]]
                out |= set(range(own[0], own[-1] + 1))
        return out

    given = {}
    for x, y, i, j in zip(a.tolist(), b.tolist(), first.tolist(), last.tolist()):
        if j >= 0:
            assert set(range(i, j + 1)) == places(x, y)
            given.setdefault(x, set()).update(range(i, j + 1))
    for x in range(150):
        assert given.get(x, set()) == set().union(*(places(x, y) for y in range(x) if doc[y] != doc[x]))


def test_needed_with_proved_parts():
    """Partners whose proved parts others hold are not asked, and stretches of one partner that touch count as one."""
    proved = windows.SURE + windows.COPY + windows.PROVED
    rows = [(9, 1, proved, 0, 50, 20), (9, 1, proved, 51, 99, 70), (9, 2, proved, 0, 60, 20), (9, 3, proved, 40, 99, 70), (9, 2, windows.SURE + windows.SPARE, 0, 80, 20), (9, 4, windows.SURE, 80, 120, 100), (9, 1, windows.SURE + windows.SPARE, 0, 99, 20)]
    member, partner, k, i, j, c = (np.array(x) for x in zip(*rows))
    assert windows.needed(member, partner, k, i, j, c).tolist() == [True, True, False, False, False, True, True]


def test_runs_of_one_word(make):
    """A word over and over is found in whoever says it often; what stands beside it is found behind many that only say it."""
    rng = random.Random(8)
    passage = [f"p{rng.randrange(10**9)}" for _ in range(60)]
    rows = []
    for d in range(150):
        body = ["na"] * rng.randint(60, 90) + (passage if d in (140, 149) else [])
        rows.append((d, " ".join([*[f"f{rng.randrange(10**9)}" for _ in range(20)], *body, *[f"f{rng.randrange(10**9)}" for _ in range(20)]])))
    out = {r.doc_id: r for r in windows.passage_dedup(make(rows)).collect()}
    words = {d: t.split() for d, t in rows}
    for d in range(1, 150):
        kept = set(range(len(words[d])))
        for s in out[d].spans:
            kept -= set(range(s.first_word, s.last_word))
        assert not any(words[d][i] == "na" for i in kept), d
    assert not any(words[149][i] in passage for i in kept) and 140 in out[149].partners and not out[0].spans
