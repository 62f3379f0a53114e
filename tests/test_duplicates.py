"""Near duplicates against brute force, and which side is spread over the days."""

import datetime as dt
from itertools import product

from paymatch.operators import checks as ck
from paymatch.policy import CHECKS

COLS = "company_id string, document_id string, vendor_name string, invoice_number string, total_cents bigint, invoice_date date"


def tables(spark):
    day, far = dt.date(2024, 1, 20), CHECKS.near_duplicate_days
    inv = [("C", f"D{i}", "Acme", n, a, None if d is None else day + dt.timedelta(d))
           for i, (n, a, d) in enumerate(product(("N1", "N2", None), (100, 200, None), (0, far, far + 1, -far, None)))]
    # three of them are their own priors, one of those with another date
    priors = [("C", "P1", "ACME", "N1", 100, day), ("C", "P2", "Acme", "N3", 100, day), ("C", "P3", "Acme", None, 200, day),
              inv[0], inv[6], (*inv[16][:5], day + dt.timedelta(2))]
    return inv, priors, spark.createDataFrame(inv, COLS), spark.createDataFrame([(*p, True) for p in priors], COLS + ", blocking boolean")


def test_near_duplicates_equal_brute_force(spark):
    inv, priors, i, p = tables(spark)
    got = {r.document_id: r.n_near for r in ck.duplicate_counts(i, p).collect()}
    near = lambda x, q: (x[1] != q[1] and x[4] is not None and x[4] == q[4] and x[5] is not None and q[5] is not None
                         and abs((x[5] - q[5]).days) <= CHECKS.near_duplicate_days and not (x[3] is not None and x[3] == q[3]))
    assert got == {x[1]: sum(near(x, q) for q in priors) for x in inv} and any(got.values())


def test_priors_are_spread_over_days_not_invoices(spark):
    _, _, i, p = tables(spark)
    x = i.withColumn("invoice_mark", i.document_id).drop("document_id").withColumnRenamed("invoice_mark", "document_id")
    lines = ck.duplicate_counts(x, p)._jdf.queryExecution().analyzed().toString().split("\n")
    depth = lambda s: len(s) - len(s.lstrip(" :+-"))
    for at, line in enumerate(lines):
        if "Generate explode" in line:
            below = [t for k, t in enumerate(lines[at + 1:], at + 1) if all(depth(u) > depth(line) for u in lines[at + 1:k + 1])]
            assert below and not any("invoice_mark" in t for t in below)
