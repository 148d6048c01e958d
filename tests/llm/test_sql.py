import duckdb
import pytest

from fitspark.llm.queries import ORACLE_SQL, QUERIES

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{D}/documents.parquet'")
    df = QUERIES[name](spark, D)
    columns = sorted(df.columns)
    want = c.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(x) for x in columns]
    assert sorted(repr(tuple(r[x] for x in columns)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_contract_columns(spark):
    for name, head in {
        "op2_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        "op3_simhash": ["doc_id", "fingerprint", "component_id"],
        "op4_quality": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
        "op5_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op6_mixing": ["doc_id", "size", "source_size", "target", "taken"],
        "op7_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op8_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
        "op9_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        "op10_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    }.items():
        df = QUERIES[name](spark, D)
        assert df.columns[: len(head)] == head and df.count() == 200, name
