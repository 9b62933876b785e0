"""Traps of the table engine, on rows written for them."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import cells, documents, similarity
from tessera.operators import catalog, extract, filters, merge, retrieve, table, units
from tessera.operators.filters import Rule
from tessera.sources import readers, writers

CELLS = [(1, None), (2, ""), (3, " "), (4, "None"), (5, "N/A"), (6, "not found"), (7, "[]"), (8, "{}"), (9, "12"), (10, "12%"), (11, "nan"), (12, "True"), (13, "TRUE"), (14, "0"), (15, "abc (x")]


@pytest.fixture(scope="module")
def cell_rows(spark):
    return spark.createDataFrame(CELLS, "id int, v string")


def ids(df):
    return sorted(r.id for r in df.collect())


@pytest.mark.parametrize(
    ("policy", "empty"),
    [("N1", [1, 2, 4, 5, 7, 8]), ("N2", [1, 2, 3, 4, 5, 6, 7, 8]), ("N3", [1, 2, 4, 7]), ("N4", [1, 2, 4, 5, 6, 7]), ("N5", [1]), ("N6", [1, 2, 3, 4, 5, 6, 7, 14])],
)
def test_emptiness(cell_rows, policy, empty):
    assert ids(cell_rows.where(cells.is_empty(F.col("v"), policy))) == empty


@pytest.mark.parametrize(
    ("rule", "kept"),
    [
        (Rule("v", "isNull"), [1, 2, 4, 5, 7, 8]),
        (Rule("v", "isTrue"), [12]),
        (Rule("v", "isFalse"), [14]),
        (Rule("v", "contains", "ABC"), [15]),
        (Rule("v", "contains", "ABC", True), []),
        (Rule("v", "regex", "("), []),
        (Rule("v", "gte", 12), [9]),
        (Rule("v", "eq", "x"), []),
        (Rule("v", "between", [0, 12]), [9, 14]),
        (Rule("v", "between", [0]), [3, 6, 9, 10, 11, 12, 13, 14, 15]),
        (Rule("v", "in", ["true"]), [12, 13]),
        (Rule("v", "notIn", ["true"]), [3, 6, 9, 10, 11, 14, 15]),
        (Rule("v", "nonsense"), [3, 6, 9, 10, 11, 12, 13, 14, 15]),
    ],
)
def test_rules(cell_rows, rule, kept):
    assert ids(filters.apply_rules(cell_rows, [rule])) == kept


def test_ui_dialect_and_strict(cell_rows):
    assert ids(filters.apply_rules(cell_rows, [Rule("v", "gte", 12)], "ui")) == [9, 10]
    with pytest.raises(ValueError):
        filters.apply_rules(cell_rows, [Rule("v", "nonsense")], strict=True)


def test_sort_puts_empty_last_both_ways(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "10"), (4, "9"), (5, ""), (6, "A")], "id int, v string")
    assert [r.id for r in df.orderBy(*table.sort_keys("v", "string"), "id").collect()] == [4, 3, 6, 1, 2, 5]
    assert [r.id for r in df.orderBy(*table.sort_keys("v", "string", True), "id").collect()] == [3, 4, 1, 6, 2, 5]


def test_page_plan_is_top_k_and_filters_are_pushed(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = table.Table(df, table.TableRequest(rules=[Rule("n_chars", "gte", 500)], sort=[("n_chars", "desc")], documents=["src1"])).page()._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "GreaterThanOrEqual(n_chars" in plan and "In(source" in plan or "EqualTo(source" in plan


def test_fold(spark):
    rows = [("k", i, a) for i, a in enumerate(["ab", "abcd", "xy", "xy", None, ""])]
    out = merge.fold_rows(spark.createDataFrame(rows, "k string, i int, a string"), "k", "i", "a")
    assert out.collect()[0].a == "abcd; xy; xy"
    e = spark.range(1).select(merge.fold_excerpts(F.array(F.lit("A"), F.lit(" a "), F.lit("b"))).alias("e")).collect()[0].e
    assert e == ["A", "b"]


def test_upsert_by_first_paper(spark):
    base = spark.createDataFrame([("r1", 1, ["zz.txt", "Doc_a.txt"]), ("r2", 2, []), ("r3", 3, None)], "name string, v int, papers array<string>")
    patch = spark.createDataFrame([("doc", 10, 1), ("r2", 20, 2), ("r2", 21, 3)], "name string, v int, seq int")
    out = {r.name: r.v for r in merge.upsert(base, patch, "name", ["v"], "seq", papers="papers").collect()}
    assert out == {"r1": 10, "r2": 21, "r3": 3}


def test_schema():
    a = catalog.TableSchema(columns=(catalog.ColumnDef("x", "d", "short", ("a",)),))
    b = catalog.TableSchema(columns=(catalog.ColumnDef("X", "d", "longer text", ("b", "a")), catalog.ColumnDef("y")))
    m = a.merge(b)
    assert [c.name for c in m.columns] == ["x", "y"] and m.columns[0].rationale == "longer text" and m.columns[0].allowed_values == ("a", "b")
    assert a.columns[0].checksum() == catalog.ColumnDef("n", "d", "short", ("a",)).checksum()
    assert catalog.TableSchema.loads(m.dumps()).columns[1].name == "y" and catalog.TableSchema.loads("{").columns == ()
    with pytest.raises(ValueError):
        m.add(catalog.ColumnDef("Y"))
    assert m.problems()["warnings"] == ["x", "y"] and m.converged(m)


def test_grounding():
    text = "The quick brown fox jumps over the lazy dog near the river"
    assert similarity.ground("quick brown", text)[0] == "exact"
    assert similarity.ground("QUICK brown", text)[0] == "case_insensitive"
    assert similarity.ground("quick brown fax jumps over", text)[0] == "fuzzy"
    assert similarity.ground("nothing of the kind here", text)[0] == "not_found"
    assert similarity.ground("", text)[0] == "not_found" and similarity.ground("two words", "")[0] == "not_found"


def test_units(spark):
    rows = [("d", "alpha", [1.0, 0.0], "high", 0), ("d", "beta", [0.8, 0.6], "high", 1), ("d", "gamma", [0.28, 0.96], "high", 2), ("d", "alph", [0.0, 1.0], "low", 3)]
    df = spark.createDataFrame(rows, "doc string, name string, v array<double>, confidence string, seq int")
    out = sorted((r.name, r.members) for r in units.dedup_units(df, "doc", "name", "v", "confidence", 0.79).collect())
    assert out == [("alpha", ["alpha", "beta", "alph"]), ("gamma", ["gamma"])]
    chain = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a long, b long")
    assert sorted(map(tuple, units.components(chain).collect())) == [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)]


def test_tables_and_chunks(spark):
    text = "Table 1. Scores\nname | score\n--- | ---\na | 1\nb | 2 | 3\n\nrest"
    (caption, rows), = documents.find_tables(text)
    assert caption == "Table 1. Scores" and len(rows) == 3 and documents.markdown(caption, rows).startswith("**Table 1. Scores**")
    assert documents.find_tables("Table 2. Short\na | b\nc | d") == [] and documents.find_tables(None) == []
    long = " ".join(f"w{i}" for i in range(300)) + "."
    df = spark.createDataFrame([(1, long), (2, ""), (3, "One. Two.")], "id int, t string")
    out = {r.id: r.c for r in df.select("id", documents.chunks(F.col("t"), 128, 64).alias("c")).collect()}
    assert out[2] == [] and out[3] == ["One. Two."] and all(len(c.split()) <= 128 for c in out[1])
    assert set(" ".join(out[1]).split()) == set(long.split())


def test_retrieval_k(spark):
    df = spark.createDataFrame([("d", i, s) for i, s in enumerate([0.9, 0.5, 0.9, 0.1])], "doc string, pos int, similarity double")
    assert [r.pos for r in retrieve.top_k(df, "doc", "pos", 2).orderBy("rank").collect()] == [2, 0]
    assert retrieve.top_k(df, "doc", "pos", 0).count() == 0
    assert retrieve.dynamic_k(df, "doc", "pos", 0.4, 1).count() == 3
    passages = spark.createDataFrame([(1, 0, "red apples"), (1, 1, "blue sky")], "doc_id int, pos int, text string")
    assert retrieve.HashingRetriever().query(passages, "apples", 1).first().text == "red apples"


def test_preamble_round_trip(spark, tmp_path):
    meta = {"session_id": "s1", "query": "what?", "unit": {"name": "drug"}, "columns": [{"name": "dose", "definition": "in mg", "rationale": "asked", "allowed_values": ["1", "2"]}]}
    path = tmp_path / "a.csv"
    path.write_text("\n".join([*writers.preamble(meta), "", "dose,note", '1,"a, b"', "2,# not a comment", "", "dose,note", "# Session ID: s1,x", '3,"two\nlines"']))
    lines = readers.preamble_lines(spark, str(path))
    assert readers.parse_preamble(lines) == meta
    assert sorted(map(tuple, readers.read_csv(spark, str(path)).collect())) == [("# Session ID: s1", "x"), ("1", "a, b"), ("2", "# not a comment"), ("3", "two\nlines"), ("dose", "note")]
    typed = tmp_path / "typed.csv"
    typed.write_text("# Query: q\na,b\n1,2.5\n")
    plain = tmp_path / "plain.csv"
    plain.write_text("a,b\n1,2.5\n")
    assert readers.read_csv(spark, str(typed)).dtypes == readers.read_csv(spark, str(plain)).dtypes == [("a", "int"), ("b", "double")]
    (tmp_path / "wide.json").write_text('{"a": 1, "b": 1, "c": 1, "d": 1, "e": 1, "f": 1, "data": [{"x": 1}, {"x": 2}]}')
    assert [r.x for r in readers.read_json(spark, str(tmp_path / "wide.json")).collect()] == [1, 2]
    files = {r.filename: r for r in readers.validate_files(spark, str(tmp_path / "*.csv")).collect()}
    assert files["plain.csv"].n_rows == 1 and files["plain.csv"].n_columns == 2 and files["plain.csv"].errors == []


def test_jsonl_modes(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"a": 1}\n\n{bad\n{"a": 2}\n')
    assert readers.read_jsonl(spark, str(path), "a int", strict=False).count() == 2
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(path), "a int").collect()


def test_discovery_and_replies():
    model = extract.RuleModel()
    schema, snaps = extract.discover([["dose: 1"], ["dose: 2"], ["name: x"]], model, catalog.TableSchema())
    assert [c.name for c in schema.columns] == ["dose"] and len(snaps) == 2 and snaps[1]["new_columns"] == []
    schema, snaps = extract.discover([["dose: 1"], ["dose: 2"], ["name: x"]], model, catalog.TableSchema(), patience=5)
    assert [c.name for c in schema.columns] == ["dose", "name"]
    assert extract.parse_reply('say ```json\n{"a": 1,}\n```') == {"a": 1} and extract.parse_reply("none") == {}
    assert extract.cells_of({"a": {"answer": "not reported", "excerpts": []}, "b": "x"}, ["a", "b"]) == {"b": {"answer": "x", "excerpts": []}}


def test_exports():
    assert writers.export_columns(["b", "a", "row_name", "_x"], ["b"]) == ["row_name", "b", "a"]
    assert "dose" in writers.schema_csv([{"name": "dose"}])


def test_paper_signs_have_their_ranges(spark):
    pad = "word " * 2000
    texts = {
        1: ("Abstract " + pad + "method results conclusion " + pad + "references", 7), 2: (pad + "abstract introduction " + pad, 0), 3: ("word " * 500 + "abstract introduction " + pad, 1),
        4: ("references " + pad, 0), 5: (pad + "Bibliography " + "x" * 4000, 2), 6: (pad + "methodology " + pad, 1), 7: (pad + "experimental " + pad, 1), 8: ("doi arxiv et al methodical éabstract", 0), 9: (None, 0), 10: ("reference", 2),
    }
    df = spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "id int, text string")
    assert {r.id: r.s for r in df.select("id", filters.paper_score(F.col("text")).alias("s")).collect()} == {i: s for i, (_, s) in texts.items()}


@pytest.mark.parametrize("rows", [50_000, 7])
def test_excerpts_and_prices_of_any_number(spark, tmp_path, rows, monkeypatch):
    from tessera.operators import blocks, cost
    from tessera.plans.catalogue import QUERIES

    monkeypatch.setattr(blocks, "ROWS", rows)
    n = 100_400 if rows > 7 else 100
    items = spark.range(n).select(F.col("id").alias("item_id"), F.format_string("Item <%d>", "id").alias("text"))
    items.repartition(2).write.parquet(f"{tmp_path}/benchmark.parquet")
    held = list(range(0, n, n // 50))
    text = " ".join(f"Item <{i}>" for i in held)
    spark.createDataFrame([(1, text), (2, text.upper()), (3, None), (4, "other")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["jon_19_ground_plain"](spark, str(tmp_path))
    want = {(i, d, s) for i in held for d, s in ((1, "exact"), (2, "case_insensitive"))}
    assert sorted(tuple(r) for r in got.select("item_id", "doc_id", "status").collect()) == sorted(want)
    assert {tuple(r) for r in QUERIES["agg_11_grounding_stats"](spark, str(tmp_path)).collect()} == {("exact", len(held)), ("case_insensitive", len(held))}
    few = 12_000 if rows > 7 else 60
    prices = spark.range(few).select(F.format_string("m<%d>", "id").alias("model"), F.col("id").cast("double").alias("price_in"), F.lit(2.0).alias("price_out"))
    models = [(f"m<{i}>",) for i in range(0, few, few // 30)] + [(f"m<{few - 1}>",), (f"the m<{few - 2}> model",), ("none",), (None,)]
    out = {r.model: r.price_in for r in cost.price_of(spark.createDataFrame(models, "model string"), prices, (-1.0, 3.0)).collect()}
    assert out == {m: float(m.split("<")[1].split(">")[0]) if m and "<" in m else -1.0 for (m,) in models}


def test_discovery_reads_every_document(spark, tmp_path):
    from tessera.plans.catalogue import QUERIES

    rows = [(i, "plain text", "en", "src") for i in range(40)] + [(40, "Dose: 3\nunit: mg", "en", "src"), (41, "dose: 4", "en", "src"), (42, None, "en", "src")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.name for r in QUERIES["llm_05_discovery"](spark, str(tmp_path)).collect()) == ["dose", "lang", "source", "unit"]
    assert {r.name: r.n_documents for r in extract.propose(docs, extract.RuleModel).collect()} == {"dose": 2, "unit": 1}


def test_longest_runs(spark):
    """As the runs say, from one sort and in partitions that grow with those read."""
    from tessera.plans.catalogue import QUERIES

    rng = random.Random(8)
    rows = spark.createDataFrame([(rng.choice([None, *range(60)]), i, rng.choice("AAB") if i % 9 else None, "x") for i in range(900)], "k int, o int, v string, other string").repartition(9)
    got = table.longest_runs(rows, ["o"], "v", "k")
    want = table.runs(rows, ["o"], "v", "k").groupBy("k", "run").count().groupBy("k").agg(F.max("count").alias("longest"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 61
    assert got.rdd.getNumPartitions() == 36
    assert "Aggregate" not in QUERIES["win_06_unchanged_runs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
