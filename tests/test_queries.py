"""Every query of the library against its SQL, on the smallest tables."""

import duckdb
import pytest

from tessera.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return round(v, 5) if isinstance(v, float) else v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert df.columns
        return
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, got) == rows(names, want.fetchall())


@pytest.mark.parametrize("n, over", [(53868, False), (53869, True), (200000, True)])
def test_warnings_of_many_documents(spark, tmp_path, n, over):
    """13,468 calls cost just under 10 dollars: both sides warn from the next one on."""
    spark.range(n).selectExpr("id AS doc_id", "'x' AS text").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = [tuple(r) for r in QUERIES["agg_23_warnings"](spark, str(tmp_path)).collect()]
    assert got == con.execute(ORACLES["agg_23_warnings"]).fetchall()
    assert ("over 10 dollars" in got[0][1]) == over


def test_paper_signs_by_place(spark, tmp_path):
    """Each sign in, at the edge of and beyond its part of a text, alone and within words, on both sides."""
    pad = "\u00e9 " * 3000
    texts = [None, "", "Abstract", "abstracts", pad[:1992] + "abstract" + " " + pad, pad[:1994] + "abstract", pad + "abstract", pad[:4000] + "Introduction" + pad, pad + "introduction", "References" + pad, pad + "REFERENCES", pad + "reference [1]", "references " + pad + "bibliography", pad + "conclusion" + " " + pad, "methods", "methodology", "methodical", "experiment", "experimental", "experiments", "result", "results.", "\u00e9results", "results\u00e9", "result\u0301", "result_s", "result\u2014 method", "doi arxiv et al", "abstract introduction conclusion method results references"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = {r.doc_id: r.score for r in QUERIES["flt_27_paper_classifier"](spark, str(tmp_path)).collect()}
    assert got == dict(con.execute(ORACLES["flt_27_paper_classifier"]).fetchall())
    assert got[0] == 0 and got[2] == 2 and got[13] == 1 and got[len(texts) - 1] == 8


def test_truth_metrics_by_any_order(spark):
    """A mean of exactly 0.0499185, however the rows lie."""
    from tessera.operators import quality

    rows = spark.range(0, 60000, 1, 8).selectExpr("'x' AS predicted", "'y' AS truth", "CASE WHEN id % 2 = 0 THEN 0.05D ELSE 0.049837D END AS confidence")
    got = {r.avg_confidence for n in (1, 7, 16) for r in quality.truth_metrics(rows.repartition(n)).collect()}
    assert got == {0.049919}
