"""The history of schemas against a replay of the log, and streams that are stopped and go on."""

import random

import pytest

from tessera.operators import history
from tessera.plans.history import _schema
from tessera.plans.catalogue import QUERIES
from tessera.streaming import progress

SF = "/root/testdata/sf0.001"
COLUMNS = "schema int, seq int, name string, definition string, rationale string, allowed array<string>"
EDITS = "schema int, at long, column string, new_name string, definition string, rationale string, allowed array<string>"


def replay(columns, edits, upto=None):
    """schema: the list of its columns after the edits up to a time; and what each edit did."""
    now, said = {}, []
    for c in sorted(columns, key=lambda c: (c["schema"], c["seq"])):
        now.setdefault(c["schema"], []).append([c["name"], c["definition"], c["rationale"], c["allowed"]])
    for e in sorted(edits, key=lambda e: (e["schema"], e["at"])):
        if e["schema"] not in now or upto is not None and e["at"] > upto:
            continue
        hit = next((c for c in now[e["schema"]] if c[0] == e["column"]), None)
        said.append((e["schema"], e["at"], e["new_name"] or e["column"], e["column"], hit is not None))
        if hit:
            hit[0] = e["new_name"] or hit[0]
            for i, f in ((1, "definition"), (2, "rationale")):
                hit[i] = hit[i] if e[f] is None else e[f]
            hit[3] = hit[3] if e["allowed"] is None else e["allowed"] or None
    return now, said


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(3)
    columns = [dict(schema=s, seq=i, name=f"c{i}", definition=rng.choice(["d", None]), rationale="r", allowed=rng.choice([None, ["a", "b"]])) for s in range(6) for i in range(rng.randint(1, 5))]
    some = lambda *v: rng.choice([None, None, *v])
    edits = [dict(schema=rng.randint(0, 6), at=at, column=f"c{rng.randint(0, 5)}", new_name=some("", f"c{rng.randint(0, 5)}"), definition=some("", "x", "y"), rationale=some("z"), allowed=some([], ["b", "a"], ["q"])) for at in rng.sample(range(1, 500), 150)]
    frame = lambda rows, kind: spark.createDataFrame([tuple(r.values()) for r in rows], kind)
    return columns, edits, frame(columns, COLUMNS), frame(edits, EDITS)


def test_versions_are_a_replay(spark, log):
    columns, edits, c, e = log
    found = history.versions(c, e)
    times = [0, 1, 50, 123, 250, 499, 500]
    got = {}
    for r in history.as_of(found, spark.createDataFrame([(s, t) for s in range(6) for t in times], "schema int, at long")).collect():
        got.setdefault((r.schema, r.at), {})[r.id] = [r.name, r.definition, r.rationale, r.allowed]
    for t in times:
        for s, want in replay(columns, edits, t)[0].items():
            assert [got[s, t][i] for i in range(len(want))] == want
    said = sorted((r.schema, r.at, r.column_name, r.original_name, r.found) for r in history.actions(c, e).collect())
    assert said == sorted(replay(columns, edits)[1])
    assert history.versions(c, e.where("false")).count() == len(columns) and history.versions(c.where("false"), e).count() == 0


def test_changes_since(spark, log):
    columns, edits, c, e = log
    base_at, found = 200, history.versions(c, e)
    ids = {s: range(len(x) - (s % 2)) for s, x in replay(columns, edits)[0].items() if s < 5}
    baselines = spark.createDataFrame([(s, base_at, i) for s, x in ids.items() for i in x], "schema int, at int, id int")
    now, was = replay(columns, edits)[0], replay(columns, edits, base_at)[0]
    filled = [(s, x[-1][0]) for s, x in now.items() if s in (1,)]
    got = [tuple(r) for r in history.changes_since(found, baselines, spark.createDataFrame(filled, "schema int, name string")).collect()]
    want = []
    for s, own in ids.items():
        if not len(own):
            continue
        for i, n in enumerate(now[s]):
            if i not in own:
                if (s, n[0]) not in filled:
                    want.append((s, n[0], "new", None, n[1] or ""))
                continue
            o = was[s][i]
            kinds = [("renamed", 0), ("definition", 1), ("rationale", 2)]
            kind = next((k for k in kinds if (o[k[1]] or "") != (n[k[1]] or "")), None)
            if kind:
                want.append((s, n[0], kind[0], o[kind[1]], n[kind[1]]))
            elif set(o[3] or []) != set(n[3] or []):
                want.append((s, n[0], "allowed_values", ", ".join(o[3] or []), ", ".join(n[3] or [])))
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(want) > 5


def test_query_of_every_customer(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    columns, edits = (x.collect() for x in _schema(orders))
    middle = max(r.o_orderkey for r in orders.collect()) // 2
    got = {}
    for r in QUERIES["ddl_01_as_of"](spark, SF).collect():
        got.setdefault(r.schema, {})[r.id] = [r.name, r.definition, r.rationale, r.allowed]
    want = replay(columns, edits, middle)[0]
    assert {s: [x[i] for i in sorted(x)] for s, x in got.items()} == want
    last = {}
    for r in QUERIES["ddl_01_versions"](spark, SF).where("valid_to IS NULL").collect():
        last.setdefault(r.schema, {})[r.id] = [r.name, r.definition, r.rationale, r.allowed]
    now = replay(columns, edits)[0]
    assert {s: [x[i] for i in sorted(x)] for s, x in last.items()} == now
    first = {s: x for s, x in replay(columns, edits, 0)[0].items()}
    want = set()
    for s, own in now.items():
        for i, n in enumerate(own):
            if s % 5 and (i == 2 and s % 2 or i < 2 and (n[:3] != first[s][i][:3] or set(n[3] or []) != set(first[s][i][3] or []))):
                want.add((s, n[0]))
    got = {(r.schema, r.name): r.change_type for r in QUERIES["ddl_08_changes"](spark, SF).collect()}
    # of two columns of one name, one that has data speaks for both
    assert want - got.keys() <= {(s, x[2][0]) for s, x in now.items() if s % 2 == 0} | {(s, n) for s, n in want if [x[0] for x in now[s]].count(n) > 1} and got.keys() <= want


def test_deltas_after_a_restart(spark, tmp_path):
    rows = lambda *names: spark.createDataFrame([(n,) for n in names], "document string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: progress.events(spark, f"{tmp_path}/in", "document string", files=1)
    rows("a", "b", "a", None)
    rows("b", "c")
    progress.deltas(stream(), "document", f"{tmp_path}/out", f"{tmp_path}/state")
    rows("c", "a")
    rows("d")
    progress.deltas(stream(), "document", f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted(map(tuple, progress.read_batches(spark, f"{tmp_path}/out").select("batch", "document").collect())) == [(0, "a"), (0, "b"), (1, "c"), (3, "d")]
    assert [(r.batch, r.newly, r.completed) for r in progress.counts(progress.read_batches(spark, f"{tmp_path}/out")).orderBy("batch").collect()] == [(0, 2, 2), (1, 1, 3), (3, 1, 4)]
    progress.snapshots(stream(), ["document"], f"{tmp_path}/snap", f"{tmp_path}/state2")
    assert progress.read_batches(spark, f"{tmp_path}/snap").where("batch = 3 AND document IS NOT NULL").count() == 4
