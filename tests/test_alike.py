"""Ratio joins, allowed values and unit groups against plain Python."""

import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import alike, units
from tessera.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "alpah", "gama", "gamma", "delta", "x", "ßé"]) for _ in range(n))


@pytest.mark.parametrize("threshold", [0.6, 0.8, 1.0])
def test_ratio_pairs(spark, threshold):
    rng = random.Random(1)
    left = [(rng.choice("pq"), words(rng, rng.randint(0, 4))) for _ in range(80)] + [("p", None), ("q", "a" * 250), ("q", "ab" * 120)]
    right = [(rng.choice("pq"), words(rng, rng.randint(0, 4))) for _ in range(80)] + [("q", "ab" * 110), ("q", "a" * 249)]
    got = {(r.grp, r.a, r.b): r.ratio for r in alike.ratio_pairs(spark.createDataFrame(left, "grp string, a string"), spark.createDataFrame(right, "grp string, b string"), threshold).collect()}
    want = {(g, a, b): ratio(a, b) for g, a in left for h, b in right if g == h and a and b and ratio(a, b) >= threshold}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def number(text):
    try:
        return float(text)
    except ValueError:
        return None


def limits(text):
    p = text.strip().split("-")
    if len(p) == 2 and p[0] and p[1]:
        low, high = number(p[0]), number(p[1])
    elif len(p) == 3 and not p[0]:
        low, high = number(p[1]), number(p[2])
        low = None if low is None else -low
    else:
        return None
    return None if low is None or high is None else (low, high)


def allowed(answer, values):
    if not values or not answer:
        return answer, False, None
    if len(values) == 1:
        kind = values[0].lower().strip()
        clean = answer.strip().rstrip("%").strip()
        if kind == "number":
            return (clean, True, None) if number(clean) is not None else (answer, False, answer)
        if limits(kind):
            (low, high), n = limits(kind), number(clean)
            return (answer, False, answer) if n is None else (str(low) if n < low else str(high) if n > high else clean, True, None)
    low = answer.lower().strip()
    for v in values:
        if v.lower().strip() == low:
            return v, True, None
    best = max(values, key=lambda v: ratio(low, v.lower()))
    return (best, True, None) if ratio(low, best.lower()) >= 0.8 else (answer, False, answer)


def test_allowed_values(spark):
    rng = random.Random(3)
    catalog = {"c": ["Alpha beta", "alpha beat", "Gamma", "gamma ", "", "Delta X"], "d": [words(rng, 2) for _ in range(12)], "n": ["Number"], "r": ["0.5-10"], "neg": ["-10-10"], "e": [], "one": ["alpha"], "dash": ["well-known"]}
    answers = [*catalog["c"], "ALPHA BETA", " gamma", "gama", "alpha bet", "12", "12 %", "11", "-12", "-5%%", "1e1", "many", "", None, " ", "well known", "delta-x", "aplha"] + [words(rng, 2) for _ in range(30)]
    rows = [(i, c, a, "v") for i, (c, a) in enumerate((c, a) for c in [*catalog, "none"] for a in answers)] * 2
    got = alike.allowed_values(spark.createDataFrame(rows, "id int, column string, answer string, allowed_by string"), spark.createDataFrame(list(catalog.items()), "column string, allowed array<string>")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.value, r.matched, r.unmatched) == allowed(r.answer, catalog.get(r.column)), r


def test_allowed_values_query(spark):
    """Every part against the lists the query makes."""
    got = {r.p_partkey: r for r in QUERIES["sim_11_allowed_values"](spark, SF).collect()}
    parts = spark.read.parquet(f"{SF}/part.parquet").collect()
    lists = {f"name{k}": sorted({p.p_name for p in parts if p.p_partkey % 3 == k}) for k in range(3)} | {"number": [" Number "], "range": ["10-40"], "below": ["-10-20"], "odd": ["a-b"]}
    kinds = set()
    for p in parts:
        r = got[p.p_partkey]
        assert (r.value, r.matched, r.unmatched) == allowed(r.answer, lists.get(r.column))
        kinds.add((r.column[:4], r.matched, r.value == r.answer))
    assert len(got) == len(parts) and len(kinds) > 8


def test_numeric_range(spark):
    texts = ["0-100", "0.0-1.0", "-10-10", "10", "a-b", "1-", "-1", "1-2-3", "-1-x", " 5 - 6 ", "", None]
    got = [r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select(alike.numeric_range(F.col("t")).alias("x")).collect()]
    assert [None if x is None else tuple(x) for x in got] == [None if t is None else limits(t) for t in texts]


def greedy(own):
    """Groups of (seq, name, vector, confidence, passages) as (seed, best name, members, passages)."""
    own, taken, out = sorted(own), set(), []
    rank = {c: i for i, c in enumerate(units.CONFIDENCE)}
    unit = [np.asarray(u[2] or [0.0], float) for u in own]
    unit = [v / (np.linalg.norm(v) + 1e-8) for v in unit]
    for i, u in enumerate(own):
        if i in taken:
            continue
        group = [i]
        for j in range(i + 1, len(own)):
            a, b = (u[1] or "").lower().strip(), (own[j][1] or "").lower().strip()
            near = len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.85
            if j not in taken and (near or min(len(a), len(b)) > 2 and (a in b or b in a)):
                group.append(j)
                taken.add(j)
        group.sort(key=lambda k: rank.get(own[k][3] or "medium", 2))
        seen = {}
        for k in group:
            for p in own[k][4] or []:
                seen.setdefault(p[:200], p)
        passages = list(own[group[0]][4] or []) if len(group) == 1 else list(seen.values())
        out.append((u[0], own[group[0]][1], [own[k][1] for k in group], passages))
    return out


SCHEMA = "document long, seq long, name string, vector array<double>, confidence string, passages array<string>"


def test_dedup_units(spark):
    rng = random.Random(8)
    rows = []
    for d in range(12):
        base = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
        for s in range(rng.randint(1, 40)):
            v = [x + rng.gauss(0, 0.45) for x in rng.choice(base)]
            name = rng.choice(["Mouse", "mouse model", "rat", "Rat A", "ab", "zz top", "control", "control group B", f"u{s}x"])
            rows.append((d, s * 3, name, rng.choice([v, v, v, None, []]), rng.choice([*units.CONFIDENCE, "odd", None]), rng.choice([None, [], ["p"], [f"q{s % 3}", "p"], ["p" * 200 + str(s)]])))
    # a chain, each like the next only: the second joins the first, the third is a seed
    for s in range(40):
        a = s * 0.5
        rows.append((99, s, f"n{s}_", [float(np.cos(a)), float(np.sin(a))], "low", [str(s)]))
    got = {}
    for r in units.dedup_units(spark.createDataFrame(rows, SCHEMA)).orderBy("document", "seq").collect():
        got.setdefault(r.document, []).append((r.seq, r.name, r.members, r.passages))
    for d in {r[0] for r in rows}:
        assert got[d] == greedy([r[1:] for r in rows if r[0] == d]), d
    assert len(got[99]) > 5
    assert units.dedup_units(spark.createDataFrame([], SCHEMA)).count() == 0


def test_dedup_units_query(spark):
    """All vectors, forty a document."""
    e = {r.vec_id: r for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    own = {}
    for n, r in e.items():
        last = e.get(n - 1)
        v = [float(np.float32(np.float32(x) * np.float32(0.3)) + np.float32(y)) for x, y in zip(r.embedding, last.embedding)] if n % 4 == 1 and last else list(r.embedding)
        name = f"Unit {r.label}" + ("" if n % 7 == 0 else f" no {n}")
        own.setdefault(n // 40, []).append((n, name, v, [*units.CONFIDENCE, "odd"][n % 5], [f"passage {n % 3}"]))
    got = {}
    for r in QUERIES["sim_09_dedup_units"](spark, SF).orderBy("document", "seq").collect():
        got.setdefault(r.document, []).append((r.seq, r.name, r.members, r.passages))
    assert got == {d: greedy(x) for d, x in own.items()}
    assert any(len(g[2]) > 1 for x in got.values() for g in x)
