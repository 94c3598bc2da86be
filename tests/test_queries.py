"""Registered queries against their SQL; all of them with AUDITLOOM_ALL=1."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from auditloom.catalog import REGISTRY
from compare import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SOME = (
    "plan_secret_exposure", "r1_line_rules", "r1_pack_code", "r2_pack_webconfig", "r5_pack_websec_functions", "r6_indented_block_rules",
    "r7_repo_absence_prose", "r11_secret_scan", "w1_dedup_findings", "w4_merge_runs", "j3_vulnerable_packages", "j4_accept",
    "j5_attack_chains", "j11_in_scope", "a7_ready", "f7_req_matches", "f24_commit_score", "i3_monotonic", "i6_reentrant_traces", "w13_allocate_credits",
)
NAMES = sorted(n for n, q in REGISTRY.items() if q.sql) if os.environ.get("AUDITLOOM_ALL") else SOME


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, con, name):
    df = REGISTRY[name].run(spark, SF)
    rel = con.sql(REGISTRY[name].sql)
    assert rows_of(df.columns, df.collect()) == rows_of(rel.columns, rel.fetchall())


def test_entry_contract(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["repo", "exploitability", "critical", "high", "medium", "low", "info", "total"]
    assert df.count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
