"""Stateful streams: state outlives a run, and batches read the state of their keys only."""

from datetime import datetime

from paymatch.streaming import stream as st

SCHEMA = "company_id string, po_number string, ts timestamp, document_id string, amount bigint"


def files(spark, path, rows):
    spark.createDataFrame([(c, p, datetime(2024, 1, d), i, a) for c, p, d, i, a in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_a_stopped_stream_goes_on_from_its_state(spark, tmp_path):
    source = f"{tmp_path}/in"
    files(spark, source, [("C", "P", 1, "a", 60), ("C", "P", 2, "b", 50), ("D", "P", 1, "c", 60)])
    balances = spark.createDataFrame([("C", "P", 100), ("D", "P", 70)], "company_id string, po_number string, remaining bigint")
    balance = lambda: {r.document_id: (r.accepted, r.remaining) for r in st.po_balance(st.read_submissions(spark, source, SCHEMA), balances, f"{tmp_path}/st3").collect()}
    guard = lambda: {r.document_id: r.duplicate for r in st.duplicate_guard(st.read_submissions(spark, source, SCHEMA), f"{tmp_path}/st2", ["company_id", "po_number"]).collect()}
    late = lambda: {r.document_id for r in st.route_late(st.read_submissions(spark, source, SCHEMA), f"{tmp_path}/late").collect()}
    first = {"a": (True, 40), "b": (False, 40), "c": (True, 10)}
    assert balance() == first and guard() == {"a": False, "b": True, "c": False} and late() == set()
    files(spark, source, [("C", "P", 3, "d", 40), ("D", "P", 20, "e", 11), ("D", "Q", 20, "f", 1)])
    assert balance() == first | {"d": (True, 0), "e": (False, 10)}
    assert guard() == {"a": False, "b": True, "c": False, "d": True, "e": True, "f": False}
    files(spark, source, [("D", "Q", 2, "g", 1)])
    assert late() == {"g"}


ARRIVALS = "document_id string, ts timestamp, vendor string, number string, amount bigint, invoice_date date"


def arrivals(spark, path, rows):
    data = [(i, datetime(2024, 1, d, h), v, n, a, None if d is None else datetime(2024, 1, x).date() if x else None) for i, d, h, v, n, a, x in rows]
    spark.createDataFrame(data, ARRIVALS).coalesce(1).write.mode("append").parquet(path)


def test_three_duplicate_tests_in_arrival_order(spark, tmp_path):
    source = f"{tmp_path}/in"
    run = lambda: {r.document_id: (r.n_exact, r.n_number, r.n_near, r.status) for r in
                   st.three_duplicate_tests(st.read_submissions(spark, source, ARRIVALS), f"{tmp_path}/out", lag=5).collect()}
    arrivals(spark, source, [("a", 1, 1, "V", "1", 10, 1), ("b", 1, 2, "V", "1", 10, 1), ("c", 1, 3, "V", "1", 11, 1), ("d", 1, 4, "V", "2", 10, 4), ("e", 1, 5, "V", "3", 10, 5),
                             ("f", 1, 6, None, "1", 10, 1), ("g", 1, 7, "V", None, 10, 1), ("h", 1, 8, "V", "1", None, 1)])
    first = {"a": (0, 0, 0, "PASS"), "b": (1, 0, 0, "FAIL"), "c": (0, 2, 0, "FLAG"), "d": (0, 0, 2, "FLAG"), "e": (0, 0, 1, "FLAG"), "g": (0, 0, 3, "FLAG"), "h": (0, 3, 0, "FLAG")}
    assert run() == first
    arrivals(spark, source, [("i", 2, 1, "V", "1", 10, 2), ("j", 20, 1, "W", "9", 1, 20)])  # after a restart; the watermark moves on
    second = first | {"i": (2, 2, 3, "FAIL"), "j": (0, 0, 0, "PASS")}
    assert run() == second
    arrivals(spark, source, [("k", 21, 1, "V", "7", 10, 2)])  # its days were dropped: more than band and lag before the watermark
    assert run() == second | {"k": (0, 0, 0, "PASS")}


ITEMS = "item string, ts timestamp, opened boolean, queue string, hours int"


def test_items_open_at_their_due_time(spark, tmp_path):
    source = f"{tmp_path}/in"
    add = lambda rows: spark.createDataFrame([(i, datetime(2024, 1, d, h), o, "q", 24) for i, d, h, o in rows], ITEMS).coalesce(1).write.mode("append").parquet(source)
    run = lambda: {r.item: r.due_at for r in st.sla_breaches(st.read_submissions(spark, source, ITEMS), f"{tmp_path}/out").collect()}
    due = lambda d, h: int((datetime(2024, 1, d, h) - datetime(1970, 1, 1)).total_seconds())
    add([("done", 1, 0, True), ("late", 1, 0, True), ("never", 1, 1, True), ("before", 1, 0, False), ("edge", 1, 2, True)])
    add([("done", 1, 20, False), ("late", 2, 1, False), ("before", 1, 3, True), ("edge", 2, 2, False)])
    assert run() == {}
    add([("x", 6, 0, True)])
    assert run() == {"late": due(2, 0), "never": due(2, 1)}
    add([("never", 7, 0, False), ("y", 12, 0, True)])
    assert run() == {"late": due(2, 0), "never": due(2, 1), "x": due(7, 0)}
