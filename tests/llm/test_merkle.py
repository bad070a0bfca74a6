"""The manifest against its SQL (its own recursion over single levels) on odd rows, at several widths and strides."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from oracle_check import rows_of
from retentia.llm import merkle, oracle, queries

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree int"


def rows(n):
    out = [
        (None, "no id", "en", "a", 5, "x", 1), (None, None, None, None, None, None, None), (7, "", "en", None, 0, "y", 2),
        (7, "", "en", None, 0, "y", 2), (7, "other", "en", None, 0, "y", 2), (2**62 + 1, "ünïcode " * 30_000, "zz", "b", 240_000, "z", 3),
        (-5, "below zero", "Zz", "b", 2**63 - 1, None, None), (30, "tampered", "ß", "", None, None, None),
    ]
    return out + [(i, f"text {i}", "hot", f"s{i % 3}", i, None, None) for i in range(n)]


def at(spark, tmp_path, data):
    spark.createDataFrame(data, COLUMNS).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    res = con.execute(oracle.OP13)
    return spark.read.parquet(f"{tmp_path}/documents.parquet"), rows_of([d[0] for d in res.description], res.fetchall())


@pytest.mark.parametrize("n, stride", [(0, 10), (37, 2), (70, 1), (64, 3)])
def test_manifest_equals_its_sql(spark, tmp_path, n, stride):
    docs, want = at(spark, tmp_path, rows(n))
    got = merkle.manifest(docs, F.coalesce(F.expr("crc32(cast(doc_id AS string)) % 7 = 0"), F.lit(False)), stride=stride)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == want


def test_query_marks_tampered_rows(spark, tmp_path):
    docs, want = at(spark, tmp_path, rows(50))
    got = queries.op13_merkle(spark, str(tmp_path))
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == want
    bad = {r.doc_id for r in got.filter("NOT verified").collect()}
    assert bad and all(__import__("zlib").crc32(str(i).encode()) % 7 == 0 for i in bad)
    assert 30 not in bad  # its n_chars is null


def test_wider_runs(spark, tmp_path):
    docs, _ = at(spark, tmp_path, rows(0)[:1] + [(i, "t", "en", "a", 1, None, None) for i in range(1, 12)])
    got = merkle.manifest(docs, F.lit(False), fan=5, stride=1).orderBy(F.col("doc_id").asc_nulls_first()).collect()
    level = [r.leaf for r in got]
    while len(level) > 1:
        level = [hashlib.sha256("".join(level[k : k + 5]).encode()).hexdigest() for k in range(0, len(level), 5)]
    assert {r.root for r in got} == {level[0]} and all(r.verified for r in got)


def test_empty_and_single(spark, tmp_path):
    docs, _ = at(spark, tmp_path, rows(0)[:1])
    assert merkle.manifest(docs.limit(0), F.lit(False)).collect() == []
    one = merkle.manifest(docs, F.lit(False)).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == hashlib.sha256(b"").hexdigest()
