"""Registered queries against their SQL on the smallest scale (a selection that runs in a minute)."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

BASE = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ("a1_pos", "a1_invoices", "b12_parse_date", "c6_reconcile", "c11_route_invoice", "d8_resolve_routing", "d11_buyer_verdict", "e5_append_ledger", "i5_classify_row", "j7_candidates_exact_po",
         "j10_candidates_vendor_amount", "l7_check_balance", "q1_work_items", "q4_run_stats", "v6_prior_is_blocking", "sequential_po_balance", "a7_upsert_by_key", "b22_apply_field_corrections")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{BASE}/{t}.parquet'")
    return con


def canon(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(f"{r[i]:.9g}" if isinstance(r[i], float) else r[i] for i in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, BASE)
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(cur.fetchall(), names)


def test_every_query_has_a_stable_name():
    assert all(sql in entry.queries() for sql in entry.oracle_sql())
