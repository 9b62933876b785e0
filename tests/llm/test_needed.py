"""Partners that hold nothing but what copies hold are not asked; nothing that a copy covers is lost."""

import numpy as np

from tessera.llm import windows


def test_needed_by_brute_force():
    rng = np.random.default_rng(6)
    n = 1500
    member, partner = rng.integers(0, 12, n), rng.integers(20, 60, n)
    k = np.where(rng.random(n) < 0.95, windows.SURE + windows.COPY, windows.SURE)
    c = rng.integers(60, 900, n)
    i, j = c - rng.integers(0, 60, n), c + rng.integers(0, 60, n)
    keep = windows.needed(member, partner, k, i, j, c)
    kept, every = ({*zip(member[x].tolist(), partner[x].tolist())} for x in (keep, np.ones(n, bool)))
    assert len(kept) < len(every) and keep.tolist() == [p in kept for p in zip(member.tolist(), partner.tolist())]

    def copied(x):
        out = set()
        for m, u, v in zip(member[x].tolist(), np.maximum(i, c - windows.REACH)[x].tolist(), np.minimum(j, c + windows.REACH)[x].tolist()):
            out |= {(m, y) for y in range(u, v + 1)}
        return out

    copies = k >= windows.COPY
    assert copied(copies & keep) == (whole := copied(copies))
    for x in np.flatnonzero(~keep):
        assert all((member[x], y) in whole for y in range(i[x], j[x] + 1))


def test_spans_among_growing_copies(make):
    """Documents that hold ever more of two passages, and one that holds both: every shared word is in a span."""
    rng = np.random.default_rng(7)
    passages = [[f"w{x}" for x in rng.integers(0, 10**9, 300)] for _ in range(2)]
    rows = [(d, " ".join([f"x{d}_{y}" for y in range(20)] + passages[d % 2][: 100 + 10 * d] + [f"y{d}_{y}" for y in range(20)])) for d in range(20)]
    rows.append((99, " ".join(passages[0] + passages[1])))
    out = {r.doc_id: r for r in windows.passage_dedup(make(rows)).collect()}
    assert [sum(s.last_word - s.first_word for s in out[d].spans) for d in (0, 1, 2, 99)] == [0, 0, 100, 570]
    assert len(out) == 21
