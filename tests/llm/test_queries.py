"""Every query against its SQL on the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not found")
NAMES = ["op12_decontaminate", "op13_repair_conversations", "op1_quality_rules", "op4_pii", "op5_mix_sources", "op6_feistel_shards", "op9_url_filter"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from causalbars.llm.queries import LLM_ORACLES, LLM_QUERIES

    assert sorted(LLM_ORACLES) == NAMES
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = LLM_QUERIES[name](spark, SF)
    result = con.execute(LLM_ORACLES[name])
    names = [d[0] for d in result.description]
    want = [dict(zip(names, row, strict=True)) for row in result.fetchall()]
    got = [r.asDict() for r in df.collect()]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, (sorted(r.items()) for r in got))) == sorted(map(repr, (sorted(r.items()) for r in want)))


def test_every_operator_has_a_query():
    from causalbars.llm.queries import LLM_QUERIES

    assert sorted(int(n[2:].split("_")[0]) for n in LLM_QUERIES) == [*range(1, 14)]
