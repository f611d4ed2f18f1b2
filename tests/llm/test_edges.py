"""Defined results for odd and for empty tables, for every dealt query and the pipeline."""

import collections

import pytest

import corpus_pipeline
from quillmill.llm.common import documents, prepare, stored
from quillmill.llm.queries import QUERIES

A_ROW_EACH = [n for n in QUERIES if n.split("_")[0] not in ("op3", "op4", "op11", "op13")]


@pytest.mark.parametrize("name", list(QUERIES))
def test_odd_tables(spark, odd_dir, name):
    rows = QUERIES[name](spark, odd_dir).collect()
    ids = collections.Counter(d["doc_id"] for d in documents(spark, odd_dir).collect())
    if name in A_ROW_EACH:
        assert collections.Counter(r["doc_id"] for r in rows) == ids
        by_id = collections.defaultdict(set)
        for r in rows:
            if r["doc_id"] is not None:
                by_id[r["doc_id"]].add(r)
        assert all(len(v) == 1 for v in by_id.values())  # repeated rows repeat their result
    elif name.startswith("op4"):
        assert set(ids) == {r["doc_id"] for r in rows} and sum(r["piece"] == 0 for r in rows) == sum(ids.values())
    elif name.startswith("op11"):
        found = {i: [r["doc_id"] for r in rows if r["item_id"] == i] for i in (1, 2, 3, None)}
        assert set(found[1]) >= {1, 7, 8} and found[1].count(1) == 2 and not found[2] and not found[3] and found[None] == [14]
    elif name.startswith("op13"):
        assert sorted(map(str, (r["conv_id"] for r in rows))) == ["1", "2", "3", "None"]
    else:
        assert {r["doc_id"] for r in rows} == {5, 6, 7, 8}


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, empty_dir, name):
    df = QUERIES[name](spark, empty_dir)
    assert df.count() == 0 and ("conv_id" if name.startswith("op13") else "doc_id") in df.columns


@pytest.mark.parametrize("folder", ["odd_dir", "empty_dir"])
def test_stages(spark, folder, request):
    sf_dir = request.getfixturevalue(folder)
    docs = documents(prepare(spark), sf_dir)
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stored(stage(spark, docs, sf_dir), "test")
        if k < 4:
            assert out.columns == columns, name
            assert out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        docs = out
    if folder == "empty_dir":
        assert docs.count() == 0
    else:
        ids = {r["doc_id"] for r in docs.collect()}
        assert 14 not in ids and 1 in ids and 7 in ids  # toxic gone, clean kept
        assert len({5, 6} & ids) == 1  # one of two equal texts


def test_names():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 14)]
    assert len(corpus_pipeline.STAGES) == 5
