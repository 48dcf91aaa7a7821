import os

import pytest

import corpus_pipeline
from foliospark.llm import decontam, queries
from foliospark.llm.store import materialize

from . import brute

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@needs_data
def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [(r.item_id, decontam.words_of(r.text)) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    toward = {}
    for name, stage in corpus_pipeline.STAGES:
        before, out = docs.collect(), materialize(stage(spark, docs, DATA))
        toward[name] = (before, out.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            docs = out
    before, after = toward["quality rules"]
    kept = {r.doc_id for r in after}
    assert not any(brute.statistics(r.text)[5] for r in after) and kept < {r.doc_id for r in before}
    before, after = toward["line dedup"]
    want = brute.common_blocks([(r.doc_id, r.text) for r in before])
    assert {r.doc_id: r.text for r in after} == {d: t for d, (t, n) in want.items() if not n or t.split()}
    assert all(r.n_chars == len(r.text) for r in after if want[r.doc_id][1])
    before, after = toward["n-gram Jaccard join"]
    groups = brute.jaccard_groups([(r.doc_id, r.text) for r in before], 5, 80, 100)
    assert {r.doc_id for r in after} == {d for d, (_, top) in groups.items() if d == top}
    before, after = toward["benchmark decontamination"]
    held = {r.doc_id for r in before if any(decontam.edit_hits(w, decontam.words_of(r.text), 0) for _, w in items)}
    assert held and not held & {r.doc_id for r in after}
    before, after = toward["SentencePiece encoding"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before} and all(len(r.ids) == r.n_tokens > 0 for r in after)


@needs_data
def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")) == list(range(1, 14))
    assert set(queries.ORACLES) < set(queries.QUERIES)


@needs_data
@pytest.mark.parametrize("name", ["op6_url_filter", "quality_statistics"])
def test_same_rows_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    got = queries.QUERIES[name](spark, DATA)
    found = con.execute(f"select {', '.join(got.columns)} from ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, found)) and found
