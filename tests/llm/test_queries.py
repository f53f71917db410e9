"""The registered queries against their SQL, and the pipeline's stages against what each must keep."""

import os

import pytest

import corpus_pipeline
from sendero.llm.oracles import ORACLES
from sendero.llm.queries import QUERIES
from tests.llm.test_operators import brute_hits, components, sets_of
from tests.oracle import connect, duck_rows, spark_rows, types

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query(spark, key):
    con = connect(FOLDER)
    df = QUERIES[key](spark, FOLDER)
    assert types(df, con, ORACLES[key]) == {}
    assert spark_rows(df) == duck_rows(con, ORACLES[key])


def test_sampled_pieces_are_lossless(spark):
    rows = QUERIES["op10_piece_sampling"](spark, FOLDER).collect()
    assert rows and all(r["lossless"] for r in rows)


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, docs, FOLDER)
        df.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        out[name] = ({r["doc_id"]: r for r in before.collect()}, {r["doc_id"]: r for r in docs.collect()})
        assert set(out[name][1]) <= set(out[name][0])
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    before, after = out["n-gram jaccard join"]
    ids = sorted(before)
    comps = components(sets_of([before[k]["text"] for k in ids]))
    assert sorted(after) == sorted({ids[c] for c in comps})
    before, after = out["benchmark decontamination"]
    for k, row in before.items():
        n, hit, _ = brute_hits(row["text"], items)
        assert (k in after) == (not (hit > 0 and 20 * hit >= n))
    before, after = out["piece sampling"]
    assert set(before) == set(after) and len(out["toxicity"][1]) < len(out["toxicity"][0])


def test_stages_take_empty_and_null_documents(spark):
    docs = spark.createDataFrame(
        [(None, None, None, None, None), (1, "", "en", "s", 0), (2, None, "en", "s", None), (2, None, "en", "s", None)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint",
    )
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
        assert stage(spark, docs, FOLDER).count() in (3, 4)
