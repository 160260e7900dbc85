"""Every numbered query: its SQL where there is one, the contract's columns, and no Python where none is allowed."""

import pytest

from check import compare, connect
from lapforge.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_same_rows_as_sql(spark, name):
    _, problem = compare(spark, connect(FOLDER), QUERIES[name], ORACLES[name], FOLDER)
    assert problem is None, problem


COLUMNS = {
    "op2_": "query_id rank vec_id score", "op3_": "doc_id size text_crc32 law shard slot grown_shard",
    "op4_": "doc_id piece start length ids_crc32 sequence_id offset", "op5_": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op6_": "page_id payload_bytes payload_digest record_type refers_to", "op7_": "doc_id n_shingles component_id kept",
    "op8_": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op9_": "doc_id size source_size target taken",
    "op10_": "doc_id held_out score predicted", "op11_": "word form root n n_near form_n", "op12_": "doc_id n_bytes n_tokens over_limit",
    "op13_": "doc_id leaf subroot root proof_sha256 folded_root verified",
}


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{k}" for k in range(1, 14)]


@pytest.mark.parametrize("start", list(COLUMNS))
def test_columns_and_rows(spark, start):
    name = next(n for n in QUERIES if n.startswith(start))
    df = QUERIES[name](spark, FOLDER)
    assert set(COLUMNS[start].split()) <= set(df.columns)
    if start not in ("op2_", "op4_", "op11_"):
        source = "pages" if start == "op6_" else "documents"
        assert df.count() == spark.read.parquet(f"{FOLDER}/{source}.parquet").count()


@pytest.mark.parametrize("start", ["op1_", "op8_", "op9_"])
def test_native_operators_run_no_python(spark, start):
    name = next(n for n in QUERIES if n.startswith(start))
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"))
