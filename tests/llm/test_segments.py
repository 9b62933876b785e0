"""Distinct segments by one sort of packed numbers."""

import numpy as np

from tessera.llm import textcore


def test_distinct_is_unique():
    rng = np.random.default_rng(4)
    wide = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    low = np.uint64(1 << 60) + rng.integers(0, 8, 3000, dtype=np.uint64)  # differ in bits that a place takes
    for key in (wide[rng.integers(0, 400, 5000)], low, np.append(wide, low), np.full(7, 5, np.uint64), wide[:1]):
        got, want = textcore.distinct(key), np.unique(key, return_index=True, return_inverse=True)
        assert all((x == y).all() and len(x) == len(y) for x, y in zip(got, want, strict=True))
