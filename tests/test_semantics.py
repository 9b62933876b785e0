"""Schemas merged and fields aligned by meaning, against plain Python; the registered ways to score; metrics of a fold."""

import random

import numpy as np
import pytest

from tessera.operators import merge, order, quality, semantics
from tessera.plans.catalogue import QUERIES
from tessera.plans.semantics import schemas_of

SF = "/root/testdata/sf0.001"


def cos(a, b):
    if a is None or b is None or len(a) != len(b):
        return 0.0
    a, b = np.array(a, float), np.array(b, float)
    return round(float(a @ b / ((np.sqrt(a @ a) + 1e-8) * (np.sqrt(b @ b) + 1e-8))), 12)


def merged(old, new):
    out = [dict(c, rationale=c["rationale"] or "") for c in old]
    for c in new:
        c = dict(c, rationale=c["rationale"] or "")
        i = next((k for k, x in enumerate(out) if x["name"].lower() == c["name"].lower()), None)
        if i is None:
            i = next((k for k, x in enumerate(out) if cos(c["vector"], x["vector"]) >= 0.9), None)
        if i is None:
            out.append(c)
            continue
        if len(c["rationale"]) > len(out[i]["rationale"]):
            out[i]["rationale"] = c["rationale"]
        if c["allowed"]:
            out[i]["allowed"] = [v for v in dict.fromkeys([*(out[i]["allowed"] or []), *c["allowed"]]) if v is not None] or None
    return [(c["name"], c["rationale"], c["allowed"]) for c in out]


def aligned(predicted, gold):
    free, out = list(gold), []
    for f, v in predicted:
        best = None
        for k, (g, w) in enumerate(free):
            a, b = f.lower().strip(), g.lower().strip()
            s = 1.0 if a == b else 0.8 if a in b or b in a else max(0.0, cos(v, w))
            if s > 0.6 and (best is None or s > best[0]):
                best = (s, k)
        if best:
            out.append((f, free.pop(best[1])[0], round(best[0], 9)))
    return out


def test_merge_schemas_query(spark):
    old, new = (d.orderBy("seq").collect() for d in schemas_of(spark.read.parquet(f"{SF}/embeddings.parquet")))
    got = {}
    for r in QUERIES["sim_10_merge_schemas"](spark, SF).orderBy("schema", "seq").collect():
        got.setdefault(r.schema, []).append((r.name, r.rationale, r.allowed))
    want = {}
    for s in {r.schema for r in [*old, *new]}:
        want[s] = merged([r.asDict() for r in old if r.schema == s], [r.asDict() for r in new if r.schema == s])
    assert got == want and sum(map(len, got.values())) < len(old) + len(new) - 30


def test_align_fields_query(spark):
    gold, predicted = (d.orderBy("seq").collect() for d in schemas_of(spark.read.parquet(f"{SF}/embeddings.parquet")))
    got = {}
    for r in QUERIES["jon_08_by_meaning"](spark, SF).collect():
        got.setdefault(r.table, []).append((r.pred_field, r.gold_field, r.score))
    for s in {r.schema for r in gold}:
        want = aligned([(r.name, r.vector) for r in predicted if r.schema == s], [(r.name, r.vector) for r in gold if r.schema == s])
        assert sorted(got.get(s, [])) == sorted(want)


def test_one_side_and_nulls(spark):
    kind = "schema int, seq int, name string, rationale string, allowed array<string>, vector array<double>"
    old = spark.createDataFrame([(1, 0, "a", None, None, None), (2, 0, "b", "long one", ["x"], [1.0, 0.0])], kind)
    new = spark.createDataFrame([(2, 0, "c", "short", [None, "y"], [1.0, 0.01]), (3, 0, "d", "r", [], None), (3, 1, "D", "longer", ["z"], [1.0])], kind)
    got = sorted((r.schema, r.name, r.rationale, r.allowed) for r in semantics.merge_schemas(old, new).collect())
    assert got == [(1, "a", "", None), (2, "b", "long one", ["x", "y"]), (3, "d", "longer", ["z"])]
    assert semantics.merge_schemas(old.where("false"), new.where("false")).count() == 0


@pytest.mark.parametrize("scorer", sorted(quality.SCORERS))
def test_registered_scores(spark, scorer):
    cells = lambda *names: spark.createDataFrame([("t", n, v) for n in names for v in ("red", "blue", None)], "table string, column string, value string")
    assert quality.schema_recall(cells("Age", "size of it"), cells("age", "weight"), "name", scorer, 1.0).first().recall == 0.5
    assert quality.schema_recall(cells("Age"), cells("age"), "values", "jaccard", 0.9).first().recall == 1.0
    assert quality.schema_recall(cells("x").where("false"), cells("age"), "name", scorer).first().recall == 0.0


def test_order(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 50), i, rng.choice([None, 1, 5])) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, i int, v int")
    got = {r.i: r.position for r in order.numbered(df, ["k", "i"]).collect()}
    assert got == {i: n for n, (_, i, _) in enumerate(sorted(rows, key=lambda r: r[:2]))}
    total, want = 0, {}
    for k, i, v in sorted(rows, key=lambda r: r[:2]):
        total += v or 0
        want[i] = total
    assert {r.i: r.t for r in order.running_totals(df, ["k", "i"], {"t": "v"}).collect()} == want
    assert order.numbered(df.where("false"), ["k"]).count() == 0


def test_fold_is_a_stream(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 2, 3, None]), rng.randint(0, 9), rng.choice(["a", "b", "abc", "", None, "abcdef", "x" * 30])) for _ in range(300)]
    got = {r.k: r.v for r in merge.fold_rows(spark.createDataFrame(rows, "k int, o int, v string"), "k", "o", "v").collect()}
    for key in (1, 2, 3, None):
        a = None
        for _, _, x in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2] is not None, r[2] or "")):
            if not a:
                a = x
            elif x and x != a:
                a = x if len(x) > len(a) else f"{a}; {x}"
        assert got[key] == a
    assert merge.fold_rows(spark.createDataFrame([], "k int, o int, v string"), "k", "o", "v").count() == 0
