import pytest

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_operators import ROWS, edge_rows


@pytest.fixture(scope="module", params=["tiny", "edge", "empty"])
def docs(request, spark, tiny):
    if request.param == "tiny":
        return spark.read.parquet(f"{tiny}/documents.parquet")
    return spark.createDataFrame(edge_rows() if request.param == "edge" else [], ROWS)


def texts(df):
    return sorted((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect() if r.doc_id is not None)


def test_stages(spark, docs, tmp_path):
    before = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, "").write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert after.columns == docs.columns
        rows = {r.doc_id: r for r in before.collect() if r.doc_id is not None}
        kept = texts(after)
        if name == "quality_rules":
            want = brute.quality([(d, r.source, r.text) for d, r in rows.items()])
            assert {d for d, _ in kept} == {d for d, x in want.items() if not x[6] and not x[7]}
        elif name == "line_dedup":
            if len(rows) > 60:  # the brute force is too slow: only that no line is new is held
                assert all(set(t.split("\n")) <= set((rows[d].text or "").split("\n")) for d, t in kept)
                before = after
                continue
            want = brute.line_dedup([(d, r.text) for d, r in rows.items()])
            assert set(kept) == {(d, t) for d, (_, gone, t) in want.items() if not gone or brute.WORD.search(t)}
        elif name == "ngram_join":
            want = brute.jaccard([(d, r.text) for d, r in rows.items()], percent=80, size=5)
            assert [d for d, _ in kept] == sorted(d for d, (_, c) in want.items() if d == c)
        elif name == "mix_sources":
            assert set(kept) <= {(d, r.text or "") for d, r in rows.items()} and all(sum(1 for x in kept if x[0] == d) <= 2 for d in rows)
        else:
            assert kept == sorted((r.doc_id, r.text or "") for r in before.collect() if r.doc_id is not None) and after.filter("not round_trip").count() == 0
        before = after
    assert before.count() > 0 or not docs.count()


def test_run(spark, tiny):
    out = corpus_pipeline.run(spark, tiny)
    assert out.count() > 0 and {"piece_ids", "n_pieces"} < set(out.columns)
