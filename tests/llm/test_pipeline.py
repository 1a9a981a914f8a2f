"""The five stages on a small corpus, each on what the one before kept."""

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
os = pytest.importorskip("os")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not found")


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline

    from causalbars.plans.staging import stage

    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(("documents", docs))
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, SF), name)
        out.append((name, docs))
    return out


def test_columns_stay_until_the_last_stage(stages):
    names = stages[0][1].columns
    assert all(d.columns == names for _, d in stages[1:-1])
    assert [n for n, _ in stages[1:]] == ["quality_classifier", "near_duplicates", "personal_data", "mixture", "packing"]


def test_good_documents_stay(spark, stages):
    kept = {r.doc_id for r in stages[1][1].select("doc_id").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    good = [r.doc_id in kept for r in labels if r.quality == 1]
    bad = [r.doc_id in kept for r in labels if r.quality == 0]
    assert np.mean(good) > 0.9 and np.mean(bad) < 0.4


def test_one_document_of_each_group_stays(stages):
    from causalbars.llm.minhash import shingles_of

    before = {r.doc_id: shingles_of(r.text, 5) for r in stages[1][1].collect()}
    after = [r.doc_id for r in stages[2][1].collect()]

    def alike(a, b):
        both = len(before[a] & before[b])
        return both and 100 * both >= 80 * (len(before[a]) + len(before[b]) - both)

    assert len(set(after)) == len(after)
    assert not any(alike(a, b) for i, a in enumerate(after) for b in after[:i])
    gone = set(before) - set(after)
    assert gone and all(any(alike(g, other) for other in before if other != g) for g in gone)


def test_no_personal_data_is_left(stages):
    from causalbars.llm import pii

    spans = pii.find_spans(stages[3][1]).selectExpr("sum(size(pii_spans))").first()[0]
    assert spans == 0 and stages[3][1].count() == stages[2][1].count()


def test_mixture_and_sequences_hold_whole_documents(stages):
    mixed = stages[4][1].groupBy("doc_id").count().collect()
    assert mixed and max(r["count"] for r in mixed) <= 3
    pieces = stages[5][1].groupBy("doc_id").agg({"length": "sum"}).collect()
    tokens = {r.doc_id: r.n for r in stages[5][1].where("start = 0").groupBy("doc_id").agg({"doc_tokens": "sum"}).withColumnRenamed("sum(doc_tokens)", "n").collect()}
    assert {r.doc_id: r["sum(length)"] for r in pieces} == tokens
