import os

import corpus_pipeline
import pytest

from cargofile.llm.queries import ORACLE, QUERIES, vocabulary

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_stages_on_their_own_input(spark, tmp_path):
    from tests.llm.test_contamination import brute as hit
    from tests.llm.test_linededup import brute as lines
    from tests.llm.test_neardup import brute as near

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        columns, docs = docs.columns, spark.read.parquet(str(tmp_path / str(k)))
        rows = docs.collect()
        kept[name] = len(rows)
        if name == "packing":
            assert {r.doc_id for r in rows} == {d for d, _ in before}
            continue
        assert docs.columns == columns
        after = sorted((r.doc_id, r.text) for r in rows)
        if name == "line_dedup":
            assert after == sorted((d, t) for d, _, _, t in lines(before))
            assert all(r.n_chars == len(r.text) for r in rows)
        elif name == "near_dedup":
            assert {d for d, _ in after} == {d for d, _, _, stays in near(before, 80) if stays}
        elif name == "decontamination":
            assert {d for d, _ in after} == {d for d, *_, found in hit(before, bench, 10) if not found}
    assert kept["toxicity"] > 150 and kept["near_dedup"] > 100


def test_stages_take_odd_tables(spark, frame, corner_texts):
    for pairs in (corner_texts, []):
        docs = frame(pairs).withColumnRenamed("lang", "_row").withColumnRenamed("source", "text_score")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, DATA)
            assert out.columns == docs.columns and out.count() <= len(pairs)


def test_queries_are_registered():
    assert [k.split("_")[0] for k in QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(ORACLE) <= set(QUERIES) and os.path.exists(vocabulary())
