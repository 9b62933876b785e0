"""Python literals and excerpts against ast and json."""

import ast
import json
import random
import re

from pyspark.sql import functions as F

from tessera.functions import literals
from tessera.operators import merge


def value(rng, depth=3):
    kind = rng.randint(0, 9 if depth else 5)
    text = lambda: "".join(rng.choice(["a", "it's", '"', "\\", "\n", "\t", ", ", "{'", "}", "]", ":", "é", "😀", "\x00", "\x7f", "None", "\u2028", " "]) for _ in range(rng.randint(0, 6)))
    if kind <= 2:
        return text()
    if kind <= 5:
        return rng.choice([None, True, False, 0, -7, 12345678901, 1.5, -0.25, 1e22, 3.0])
    if kind == 9:
        return tuple(value(rng, depth - 1) for _ in range(rng.choice([0, 2, 3])))
    if kind >= 7:
        return [value(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice([text(), text(), 3, None]): value(rng, depth - 1) for _ in range(rng.randint(0, 3))}


def plain(v):
    if isinstance(v, dict):
        return {k if isinstance(k, str) else str(k): plain(x) for k, x in v.items()}
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def test_python_literals(spark):
    rng = random.Random(4)
    made = [value(rng) for _ in range(400)]
    texts = [repr(v) for v in made]
    odd = ["['a', ]", "{'a': 1,}", "[1, 2", "{'a'}", "['a' b]", "open('x')", "", None, "[1] [2]", "{'a': [}", r"['\x41\101\u00e9\U0001F600\q\'']", '["\\\n"]', "[+1, 1., .5, 1_000, 007.5]", "( 'a' , 'b' )", "'it\\'s'"]
    got = [r.j for r in spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *odd])], "i int, t string").repartition(3).select("i", literals.python_json(F.col("t")).alias("j")).orderBy("i").collect()]
    for t, v, j in zip(texts, made, got):
        assert j is not None and json.loads(j) == plain(v), t
    bad = {"[1, 2", "{'a'}", "['a' b]", "open('x')", "", None, "[1] [2]", "{'a': [}"}
    for t, j in zip(odd, got[len(texts) :]):
        if t in bad:
            assert j is None, t
        else:
            assert json.loads(j) == plain(ast.literal_eval(t)), t


def excerpts(v, source):
    """What the five encodings give, in plain Python."""
    out = []
    if not v:
        return out
    if " | " in v and "{'text':" in v:
        for p in filter(None, (x.strip() for x in v.split(" | "))):
            try:
                item = ast.literal_eval(p)
                out.append((item["text"], item.get("source")) if isinstance(item, dict) and "text" in item else (item if isinstance(item, str) else p, source))
            except (ValueError, SyntaxError):
                text, own = re.search(r"'text'\s*:\s*'(.*?)'(?:\s*,\s*'source'|\s*})", p, re.DOTALL), re.search(r"'source'\s*:\s*'(.*?)'", p)
                out.append((text[1], own[1] if own else source) if text else (p, source))
        return out
    if v.startswith("[") and "] " in v:
        for p in filter(None, (x.strip() for x in v.split(" | "))):
            at = p.find("] ")
            out.append((p[at + 2 :], p[1:at]) if p.startswith("[") and at > 0 else (p, source))
        return out
    try:
        found = json.loads(v)
    except ValueError:
        return [(v, source)]
    if isinstance(found, list):
        return [(x["text"], x.get("source")) if isinstance(x, dict) else (x, source) for x in found if isinstance(x, str) or isinstance(x, dict) and "text" in x]
    return [(found if isinstance(found, str) else v, source)]


def test_excerpt_encodings(spark):
    rng = random.Random(7)
    word = lambda: rng.choice(["it's", 'a "b"', "plain", "x, y", "[z] w", "{q}", "é😀", "a\\b"])
    cells = [None, "", "plain", "[odd", '"quoted"', "12", "[]", '["a"]x', "[a] b", "[a] b | c | [d] e", "{'text': 'don't', 'source': 's'} | {'text': 'a'}", "{'text': 'a'} | 'b' | c", "{'text':  'x' } | {'other': 1}"]
    for _ in range(120):
        items = [rng.choice([{"text": word(), "source": word()}, {"text": word()}, word()]) for _ in range(rng.randint(1, 3))]
        cells += [json.dumps(items), " | ".join(repr(x) for x in [{"text": word(), "source": "s"}, *items]), " | ".join(f"[{x['source']}] {x['text']}" if isinstance(x, dict) and "source" in x else word() for x in items)]
    got = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string").select("i", literals.excerpt_items(F.col("c"), F.lit("file")).alias("x")).orderBy("i").collect()
    for r in got:
        assert [tuple(x) for x in r.x] == excerpts(cells[r.i], "file"), cells[r.i]


def test_upsert_by_row(spark):
    """Rows of one name, of none, and repeated ones keep to their own papers."""
    base = [("r", "old", ["doc1_v2.txt"]), ("r", "old", ["doc2.pdf"]), (None, "old", ["x.txt", "DOC1_a"]), (None, "old", []), ("exact", "old", ["doc1_x"]), ("r", "old", ["doc2.pdf"]), ("q", "old", None), ("s", "old", ["a.b.txt"])]
    patch = [("doc1", "1", 0), ("doc2", "2", 1), ("exact", "e", 2), ("doc1", "1 again", 3), ("Doc2", None, 4), ("", "nothing", 5), (None, "nothing", 6), ("A.B", "ab", 7)]
    out = merge.upsert(spark.createDataFrame(base, "name string, v string, papers array<string>"), spark.createDataFrame(patch, "name string, v string, seq int"), "name", ["v"], "seq", papers="papers")
    got = sorted(((r.name, r.v, tuple(r.papers or ())) for r in out.collect()), key=repr)
    want = [("r", "1 again", ("doc1_v2.txt",)), ("r", "old", ("doc2.pdf",)), (None, "1 again", ("x.txt", "DOC1_a")), (None, "old", ()), ("exact", "e", ("doc1_x",)), ("r", "old", ("doc2.pdf",)), ("q", "old", ()), ("s", "ab", ("a.b.txt",))]
    assert got == sorted(want, key=repr)


def test_json_of_a_cell_is_made_once(spark):
    """A cell's lexemes are parted for the cell and for an answer that is itself JSON; and windows part their text once."""
    from pyspark.sql import functions as F

    from tessera.functions import documents, replies

    parted = lambda c, call: spark.createDataFrame([("a",)], "x string").select(c.alias("y"))._jdf.queryExecution().analyzed().toString().count(call)
    assert parted(replies.normal_cell(F.concat(F.col("x"), F.lit("!"))), "concat(x") == 1
    assert parted(documents.windows(documents.words(F.col("x")), 4, 2), "split(x") == 1
    cells = ["{'answer': 'y', 'quotes': ['a', None]}", '{"value": "[{\'text\': \'in\'}]", "evidence": ["p", "q"]}', "[]", "plain", "", None, '{"answer": null, "excerpt": ""}', '["a", "b"]', "{'x': 1}"]
    got = [tuple(r) for r in spark.createDataFrame([(c,) for c in cells], "x string").select(replies.answer_of(F.col("x")).alias("a"), replies.excerpts_of(F.col("x")).alias("e"), replies.normal_cell(F.col("x")).alias("c")).collect()]
    assert [(a, e) for a, e, _ in got] == [tuple(c) for *_, c in got]
    assert got[0][:2] == ("y", ['["a",null]']) and got[1][:2] == ("in", ["p", "q"]) and got[3][:2] == ("plain", [])
