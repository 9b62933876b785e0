"""Queries that SQL cannot express, and joins on grams, against plain Python on the smallest tables."""

import difflib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tessera.functions import documents, features
from tessera.operators import match, units
from tessera.plans.catalogue import QUERIES
from tessera.streaming import progress

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def read(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet").collect()


def windows_of(words, width, overlap):
    return [words[i : i + width] for i in range(0, len(words), width - overlap)]


def test_chunks(spark, read):
    got = {}
    for r in QUERIES["doc_10_chunks"](spark, SF).collect():
        got.setdefault(r.doc_id, {})[r.pos] = r.passage
    for r in read("documents"):
        passages, now = [], []
        for sentence in re.split(r"(?<=[.?!])\s+", r.text):
            for piece in windows_of(sentence.split(), 133, 0):
                if len(now) + len(piece) > 133:
                    passages.append(now)
                    now = []
                now = now + piece
        want = [" ".join(w) for p in [*passages, now] if p for w in windows_of(p, 133, 64)]
        assert [got.get(r.doc_id, {})[i] for i in range(len(got.get(r.doc_id, {})))] == want


def test_nfkc(spark):
    texts = ["ﬁne ①", "a\x00b\tc\nd", "Å", "ｆｕｌｌ", "", None, "é"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.x for r in df.select("i", documents.nfkc(F.col("t")).alias("x")).collect()}
    for i, t in enumerate(texts):
        want = None if t is None else "".join(c for c in unicodedata.normalize("NFKC", t) if c in "\n\t" or unicodedata.category(c) != "Cc")
        assert got[i] == want


def likeness(a, b):
    x, y = a.lower().strip(), b.lower().strip()
    wx, wy = set(x.split()), set(y.split())
    return 0.7 * difflib.SequenceMatcher(None, x, y).ratio() + 0.3 * len(wx & wy) / max(len(wx), len(wy), 1)


def test_similar_units(spark, read):
    names = sorted({r.p_name for r in read("part")})[:120] + ["Alpha one", "ALPHA ONE", "alpha two", "x", "X"]
    got = {(r.a, r.b): r.score for r in units.similar_units(spark.createDataFrame([(n,) for n in names], "name string"), 0.7).collect()}
    want = {}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            x, y = sorted((a, b), key=lambda n: (n.lower(), n))
            if (s := likeness(x, y)) >= 0.7:
                want[x, y] = s
    assert set(got) == {k for k, s in want.items()} and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in got)
    assert got["ALPHA ONE", "Alpha one"] == 1.0 and got["X", "x"] == 1.0
    with pytest.raises(ValueError):
        units.similar_units(spark.createDataFrame([("a",)], "name string"), 0.5)


def test_ratio(spark, read):
    got = {r.p_partkey: r.ratio for r in QUERIES["sim_02_ratio"](spark, SF).collect()}
    for r in read("part"):
        assert got[r.p_partkey] == pytest.approx(difflib.SequenceMatcher(None, r.p_name.lower(), r.p_type.lower()).ratio(), abs=1e-6)


def test_grounding_by_grams(spark, read):
    texts = [(r.doc_id, r.text) for r in read("documents")] + [(9001, None), (9002, ""), (9003, "One TWO three four five six seven"), (9003, "again one two Three four five six seven eight")]
    excerpts = [(r.item_id, r.text) for r in read("benchmark")] + [(901, "two three four five six seven"), (902, "TWO"), (903, ""), (904, None), (905, "no such words in any of these texts"), (906, "e TWO three four five six sev"), (907, "two  three four five six seven")]
    got = {(r.inner, r.outer, r.text_out) for r in match.grounded(spark.createDataFrame(excerpts, "inner long, text_in string"), spark.createDataFrame(texts, "outer long, text_out string")).collect()}
    want = {(i, d, t) for i, x in excerpts for d, t in texts if x is not None and t is not None and x.lower() in t.lower()}
    assert got == want


def test_matched_rows(spark):
    truth = ["abc", "abcdef", "xy", "q", "", "zzz"]
    found = ["abcd", "ab", "abcdefgh", "xyz", "wxyz", "zzz", "q"]
    df = lambda v: spark.createDataFrame([(x,) for x in v], "n string")
    got = {r.key: (r.match, round(r.score, 6)) for r in match.match_rows(df(truth), df(found), "n").collect()}
    want = {}
    for t in truth:
        held = [(min(len(t), len(m)) / max(len(t), len(m)), m) for m in found if t and m and (t in m or m in t)]
        if held and (best := max(s for s, _ in held)) > 0.3:
            want[t] = (min(m for s, m in held if s == best), round(best, 6))
    assert got == want


def fitted(header, blocks, budget):
    join = lambda own: header + "\n\nPapers:\n\n" + "\n\n".join(own)
    small = lambda t: len(t) // 4 <= budget
    if small(join(blocks)):
        return join(blocks)
    for cap in (11, 9, 7, 5, 3, 1):
        own = []
        for b in blocks:
            title, mark, said = b.partition("Paper content:")
            own.append(f"{title}{mark} {' '.join(re.split(r'(?<=[.!?])\s+', said.strip(' '))[:cap])}" if mark else b)
        if small(join(own)):
            return join(own)
    for n in range(len(blocks) - 1, -1, -1):
        if small(join(blocks[:n])):
            return join(blocks[:n])
    return header[: 4 * budget]


def test_prompts_fit(spark, read):
    turns = {}
    for r in sorted(read("conversations"), key=lambda r: (r.conv_id, r.turn, r.text)):
        turns.setdefault(r.conv_id, []).append(f"Turn {r.turn}\nPaper content: {r.text}")
    got = {r.conv_id: r.prompt for r in QUERIES["doc_11_fit_prompt"](spark, SF).collect()}
    assert got == {k: fitted(f"Conversation {k}", b, 120) for k, b in turns.items()}
    tiny = spark.range(1).select(features.fit_prompt(F.lit("a header of some length"), F.array(F.lit("x" * 100)), 3).alias("p")).first().p
    assert tiny == fitted("a header of some length", ["x" * 100], 3) == "a header of "


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(1, 120)] + [(500, 600), (600, 700), (900, 900), (None, 3)]
    got = {r.node: r.root for r in units.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 121)}, 500: 500, 600: 500, 700: 500, 900: 900}
    assert units.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stop_keeps_what_was_done(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(4):
        spark.range(i * 10, i * 10 + 10).write.mode("append").parquet(source)
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
    done = progress.run_until(stream, out, str(tmp_path / "state"), lambda n: n >= 2)
    kept = spark.read.parquet(out).count()
    assert done == 2 and 0 < kept < 40
    progress.run_until(stream, out, str(tmp_path / "state"), lambda n: False)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(40))
