"""The pipeline's stages, each on its own input, and the run as a whole."""

import pytest

import corpus_pipeline as pipeline

from .test_exact import folded

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def folder(spark, make, odd, tmp_path):
    """Tables with every odd text, near copies, benchmark passages and columns of clashing names."""
    words = odd[9][1].split()
    item = " ".join(words[3000:3040])
    extra = [(50, "before " + item + " after " + " ".join(words[100:160])), (51, odd[10][1] + " " + " ".join(words[5000:5100])), (51, odd[10][1] + " " + " ".join(words[5000:5100])), (None, odd[10][1])]
    docs = make([*odd, *extra])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "two words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), docs


def test_stages(spark, folder):
    path, docs = folder
    names = docs.columns
    known = pipeline.language(spark, docs, path)
    assert known.columns == names
    ids = [r.doc_id for r in known.collect()]
    assert not {5, 6, 7} & set(ids) and {1, 2, 3, 4, 10, 50} <= set(ids) and None in ids

    near = pipeline.near_duplicates(spark, docs, path)
    assert near.columns == names
    ids = [r.doc_id for r in near.collect()]
    assert {1, 5, 6, 7, 10} <= set(ids) and not {2, 3} & set(ids) and ids.count(51) == 2 and None in ids

    left = pipeline.passages(spark, docs, path)
    assert left.columns == names
    rows = {r.doc_id: r for r in left.collect()}
    assert rows[1].text == docs.where("doc_id = 1").first().text and 3 not in rows and rows[5].text is None
    assert len(folded(rows[50].text)) < 62 and rows[50].n_chars == len(rows[50].text)

    clean = pipeline.decontamination(spark, docs, path)
    assert clean.columns == names
    ids = [r.doc_id for r in clean.collect()]
    assert not {10, 50} & set(ids) and {1, 2, 5, 51} <= set(ids)

    tokens = pipeline.tokens(spark, docs, path)
    assert tokens.count() == docs.count() and "ids" in tokens.columns


def test_decontamination_by_row(spark, folder, make):
    """Rows without doc_id, and rows that share one, are judged by their own text."""
    path, docs = folder
    item = spark.read.parquet(f"{path}/benchmark.parquet").where("item_id = 1").first().text
    mixed = make([(None, "a " + item), (None, "clean words of no item at all"), (7, item + " b"), (7, "clean too, this one of them"), (7, None), (8, "")])
    got = sorted(((r.doc_id, r.text) for r in pipeline.decontamination(spark, mixed, path).collect()), key=repr)
    assert got == sorted([(None, "clean words of no item at all"), (7, "clean too, this one of them"), (7, None), (8, "")], key=repr)


def test_run_keeps_clean_documents_and_bounds(spark, folder):
    path, docs = folder
    out = pipeline.run(spark, path)
    ids = {r.doc_id for r in out.collect()}
    assert {1, 11} <= ids and not {2, 3, 5, 6, 7, 10, 50} & ids


def test_stages_of_no_documents(spark, folder):
    path, docs = folder
    none = docs.limit(0)
    for name, stage in pipeline.STAGES:
        assert stage(spark, none, path).count() == 0, name
    bare = spark.createDataFrame([], COLUMNS)
    assert pipeline.passages(spark, bare, path).columns == bare.columns
