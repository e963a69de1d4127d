"""Every registered query: its columns, one row per row of its table, and SQL where there is some."""

import duckdb
import pytest

from opsdeck.llm.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": ("documents", {"doc_id": "bigint", "source": "string", "copy": "int", "n_copies": "int"}),
    "op2": ("documents", {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint",
                          "base_score": "double", "score": "double"}),
    "op3": ("documents", {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"}),
    "op4": ("documents", {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}),
    "op5": ("documents", {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint",
                          "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"}),
    "op6": ("documents", {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}),
    "op7": ("embeddings", {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}),
    "op8": ("documents", {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}),
    "op9": ("documents", {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"}),
    "op11": ("documents", {"doc_id": "bigint", "n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint",
                           "output_sha256": "string", "restored_sha256": "string"}),
    "op12": ("documents", {"lang": "string", "rank": "bigint", "phrase": "string", "a": "bigint", "l": "bigint", "r": "bigint",
                           "n": "bigint", "score": "bigint"}),
    "op13": ("documents", {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"}),
    "op10": ("pages", {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"}),
}


def test_one_query_for_each_operator():
    assert [q.split("_")[0] for q in QUERIES] and {q.split("_")[0] for q in QUERIES} == set(COLUMNS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    table, columns = COLUMNS[name.split("_")[0]]
    out = QUERIES[name](spark, SF)
    assert columns.items() <= dict(out.dtypes).items()
    rows, key = out.toPandas(), next(iter(columns))
    source = spark.read.parquet(f"{SF}/{table}.parquet")
    if name.startswith("op7"):
        assert len(rows) == 50 and set(rows[key]) == {0, 100, 200, 300, 400}
    elif name.startswith("op1_"):
        assert 100 < len(rows) < 400
    elif name.startswith("op12_"):  # ranks from 1 without gaps in each language
        assert all(sorted(part) == list(range(1, len(part) + 1)) for _, part in rows.groupby("lang")["rank"])
    else:
        assert sorted(rows[key]) == sorted(r[0] for r in source.select(key).collect())
    assert not rows[[c for c in columns if c not in ("rule", "source", "prefix_chars", "middle_chars")]].isna().any().any()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    rows = QUERIES[name](spark, SF)
    want = con.execute(ORACLE_SQL[name]).df()
    assert sorted(rows.columns) == sorted(want.columns)
    got, want = rows.collect(), con.execute(f"select {', '.join(rows.columns)} from ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
