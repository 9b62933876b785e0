"""Column clusters, pairs and suggestions against plain Python."""

import math
import re
from collections import Counter

import pytest

from tessera.functions.features import DOMAINS, TYPES
from tessera.operators import clusters
from tessera.plans.catalogue import QUERIES
from tessera.plans.schemas import columns_of

SF = "/root/testdata/sf0.001"


def name_words(name):
    return [w for w in re.split(r"\s+", re.sub("[_-]", " ", re.sub("([a-z])([A-Z])", r"\1 \2", name)).lower()) if len(w) > 1]


def text_words(text):
    return [w for w in re.split(r"\s+", re.sub(r"[^a-z0-9\s]", " ", (text or "").lower())) if len(w) > 2 and w not in clusters.STOP_WORDS]


def common_of(columns):
    df = Counter(w for c in columns for w in set(name_words(c.name)))
    return {w for w, n in df.items() if n >= math.ceil(len(columns) / 2)}


def features(columns, common):
    words = [Counter(w for w in name_words(c.name) + text_words(c.definition) + text_words(c.rationale) if w not in common) for c in columns]
    df = Counter(w for own in words for w in own)
    out = []
    for c, own in zip(columns, words):
        v = {w: n / sum(own.values()) * (math.log(len(columns) / df[w]) + 1) for w, n in own.items()}
        text = f"{c.name} {c.definition or ''} {c.rationale or ''}".lower()
        for i, t in enumerate(TYPES):
            v[i] = float((c.data_type or "").lower() == t)
        v["allowed"] = 2.0 if c.allowed else 0.0
        for d, marks in DOMAINS.items():
            v[d, 0] = 2.0 if any(m in text for m in marks) else 0.0
        out.append(v)
    return out


def cosine(a, b):
    norm = math.sqrt(sum(x * x for x in a.values())) * math.sqrt(sum(x * x for x in b.values()))
    return sum(x * b.get(k, 0) for k, x in a.items()) / norm if norm else 0.0


def greedy(similar, n):
    found = [([i], 1.0) for i in range(n)]
    while True:
        best, pair = -1, None
        for i in range(len(found)):
            for j in range(i + 1, len(found)):
                a, b = found[i][0], found[j][0]
                if len(a) + len(b) <= 8:
                    average = sum(similar[x][y] for x in a for y in b) / (len(a) * len(b))
                    if average > best:
                        best, pair = average, (i, j)
        if pair is None or best < 0.25 * 10**12:
            return found
        i, j = pair
        found = [f for k, f in enumerate(found) if k not in pair] + [(found[i][0] + found[j][0], best / 10**12)]


def title(text):
    return " ".join(w[:1].upper() + w[1:] for w in text.split(" "))


def label(columns, members, common):
    own = [[w for w in name_words(columns[i].name) if w not in common and len(w) > 2] for i in members]
    times, cover = Counter(w for x in own for w in x), Counter(w for x in own for w in set(x))
    order = sorted(dict.fromkeys(w for x in own for w in x), key=lambda w: (-cover[w], -cover[w] * times[w]))
    top = [w for k, w in enumerate(order) if k == 0 or cover[w] / len(members) >= 0.25][:2]
    return title(" & ".join(top)) if top else f"Group {members[0] + 1}"


def unique(base, used, columns, members, common):
    tries = [base]
    for i in members:
        own = [w for w in name_words(columns[i].name) if w not in common and len(w) > 2]
        if len(own) >= 2:
            tries.append(title(" ".join(own[:2])))
    tries += [f"{base} {k}" for k in range(2, len(used) + 3)]
    used.append(next(t for t in tries if t not in used))
    return used[-1]


def brute_clusters(columns):
    common = common_of(columns)
    v = features(columns, common)
    similar = [[round(cosine(a, b) * 10**12) for b in v] for a in v]
    found, used, out = greedy(similar, len(columns)), [], []
    for members, score in found[:10]:
        out.append((unique(label(columns, members, common), used, columns, members, common), [columns[i].name for i in members], score))
    rest = sorted(i for members, _ in found[10:] for i in members)
    for k in range(0, len(rest), 8):
        own = rest[k : k + 8]
        alone = title(" ".join([w for w in name_words(columns[own[0]].name) if w not in common and len(w) > 2][:3]))
        base = (alone or f"Group {min(10, len(found)) + 2 * (k // 8) + 1}") if len(own) == 1 else label(columns, own, common)
        out.append((unique(base, used, columns, own, common), [columns[i].name for i in own], None))
    return out


@pytest.fixture(scope="module")
def schemas(spark):
    rows = columns_of(spark.read.parquet(f"{SF}/part.parquet")).orderBy("schema", "seq").collect()
    out = {}
    for r in rows:
        out.setdefault(r.schema, []).append(r)
    return out


def test_similar_columns(spark, schemas):
    got = {(r.schema, r.a, r.b): r.score for r in QUERIES["sim_18_similar_columns"](spark, SF).collect()}
    want = {}
    for s, own in schemas.items():
        v = features(own, common_of(own))
        want |= {(s, a.seq, b.seq): cosine(x, y) for i, (a, x) in enumerate(zip(own, v)) for b, y in zip(own[i + 1 :], v[i + 1 :]) if cosine(x, y) >= 0.8}
    assert got.keys() == want.keys() and len(want) > 20
    assert all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_column_clusters(spark, schemas):
    got = {}
    for r in QUERIES["sim_19_column_clusters"](spark, SF).orderBy("schema", "nth").collect():
        got.setdefault(r.schema, []).append((r.name, r.columns, r.score))
    for s, own in schemas.items():
        want = brute_clusters(own)
        assert [g[:2] for g in got[s]] == [w[:2] for w in want]
        assert all(w[2] is None and g[2] is None or abs(g[2] - w[2]) < 1e-8 for g, w in zip(got[s], want))


def made(spark, names, schema="s"):
    rows = [(schema, i, n, d, None, t, None) for i, (n, d, t) in enumerate(names)]
    return spark.createDataFrame(rows, "schema string, seq int, name string, definition string, rationale string, data_type string, allowed array<string>")


def test_ties_leftovers_and_names(spark):
    names = [(f"col_{'abcdefghij'[i % 10] * 3}{i}", None, None) for i in range(37)] + [("colTwinUnit", "red wine", "string"), ("col-twin-unit", "red wine", "string"), ("COL", "", "date"), ("x", None, None)]
    docs = made(spark, names)
    got = [(r.name, r.columns, r.score) for r in clusters.clusters(docs).orderBy("nth").collect()]
    want = brute_clusters(docs.orderBy("seq").collect())
    assert [g[:2] for g in got] == [w[:2] for w in want] and len({g[0] for g in got}) == len(got)
    assert sorted(c for g in got for c in g[1]) == sorted(n[0] for n in names)
    assert clusters.clusters(docs.where("false")).count() == 0
    one = clusters.clusters(made(spark, [("age", None, None)])).collect()
    assert [(r.name, r.columns, r.score) for r in one] == [("Group 1", ["age"], 1.0)]


def test_suggested_cluster(spark, schemas):
    got = {r.schema: (r.column, r.name, r.score) for r in QUERIES["sim_20_suggested_cluster"](spark, SF).collect()}
    parts = {r.p_partkey: r for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    assert got.keys() == schemas.keys()
    for s, own in schemas.items():
        p = parts[own[0].seq]
        new = type(own[0])(schema=s, seq=-1, name="new_" + p.p_name.split(" ")[-1], definition=p.p_type, rationale=None, data_type="number", allowed=None)
        v = features([*own, new], common_of(own))
        score = {c.name: cosine(v[-1], x) for c, x in zip(own, v)}
        best, at = None, 0.3
        for name, members, _ in brute_clusters(own):
            average = sum(round(score[m] * 10**12) for m in members) / len(members) / 10**12
            if average > at:
                best, at = name, average
        assert got[s][:2] == (new.name, best)
        assert best is None and got[s][2] is None or abs(got[s][2] - at) < 1e-8


def test_suggested_cluster_of_every_nation(spark, schemas):
    """Every schema has a new column for each nation of suppliers, and its own; all of them as plain Python suggests."""
    parts = {r.p_partkey: r for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    nations = {r.s_nationkey for r in spark.read.parquet(f"{SF}/supplier.parquet").collect()} - {None}
    got = {(r.schema, r.column): (r.name, r.score) for r in QUERIES["sim_20_suggested_cluster"](spark, SF).collect()}
    asked, best_of = 0, {}
    for s, own in schemas.items():
        common, found = common_of(own), brute_clusters(own)
        word = parts[own[0].seq].p_name.split(" ")[-1]
        for nation in [None, *nations]:
            name = f"new_{word}" if nation is None else f"new_{word}_nation_{nation}"
            p = parts[own[0 if nation is None else nation % len(own)].seq]
            v = features([*own, type(own[0])(schema=s, seq=-1, name=name, definition=p.p_type, rationale=None, data_type="number", allowed=None)], common)
            score = {c.name: round(cosine(v[-1], x) * 10**12) for c, x in zip(own, v)}
            best, at = None, 0.3
            for cluster, members, _ in found:
                average = sum(score[m] for m in members) / len(members) / 10**12
                if average > at:
                    best, at = cluster, average
            asked += 1
            best_of.setdefault(s, set()).add(best)
            assert got[s, name][0] == best
            assert best is None and got[s, name][1] is None or abs(got[s, name][1] - at) < 1e-8
    assert len(got) == asked == len(schemas) * (len(nations) + 1) and any(len(b) > 1 for b in best_of.values())


def test_joins_of_columns_go_around_the_driver(spark, monkeypatch):
    """Spark takes columns that compress well for small; no join may send them through the driver."""
    plans, written = [], clusters._written

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(clusters, "_written", seen)
    for name in ("sim_18_similar_columns", "sim_19_column_clusters", "sim_20_suggested_cluster"):
        plans.append(QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString())
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
