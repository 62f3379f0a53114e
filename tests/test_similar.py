"""The blocked string joins find exactly what brute force finds."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from paymatch.functions.similarity import sequence_ratio
from paymatch.functions.text import word_set
from paymatch.operators import candidates as cand
from paymatch.operators import similar as sim
from paymatch.operators import vendors as ven

rng = random.Random(7)


def keys(n, letters="ABC1", lo=1, hi=7):
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(lo, hi))) for _ in range(n)})


def frame(spark, values, name):
    return spark.createDataFrame([("C", v) for v in values], f"c string, {name} string")


def test_containment_pairs(spark):
    a, b = keys(60) + [""], keys(60) + ["AB"]
    got = {(r.x, r.y) for r in sim.containment_pairs(frame(spark, a, "x"), frame(spark, b, "y"), ["c"], "x", "y").collect()}
    assert got == {(x, y) for x in a for y in b if x in y or y in x}


def test_containment_in_groups_of_all_sizes(spark):
    # many groups of a key or two beside one that holds hundreds of pairs, with keys shorter and longer than the grams
    a = [("H", k) for k in keys(40, lo=1, hi=12)] + [(f"G{i}", k) for i in range(60) for k in keys(2, "AB", 1, 8)] + [("L", "A"), ("H", "")]
    b = [("H", k) for k in keys(40, lo=1, hi=12)] + [(f"G{i}", k) for i in range(60) for k in keys(2, "AB", 1, 8)] + [("R", "A"), ("G1", "")]
    x, y = (spark.createDataFrame([("C", *r) for r in rows], f"c string, h string, {n} string") for rows, n in ((a, "x"), (b, "y")))
    got = sim.containment_pairs(x, y, ["c", "h"], "x", "y")
    pairs = [(r.h, r.x, r.y) for r in got.collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(g, k, m) for g, k in a for h, m in b if g == h and (k in m or m in k)}


def test_containment_without_group_columns(spark):
    a, b = keys(60) + [""], keys(60) + ["AB"]
    x, y = (spark.createDataFrame([(v,) for v in values], f"{n} string") for values, n in ((a, "x"), (b, "y")))
    got = [(r.x, r.y) for r in sim.containment_pairs(x, y, [], "x", "y").collect()]
    assert len(got) == len(set(got)) and set(got) == {(m, n) for m in a for n in b if m in n or n in m}


def rows_through(df, *nodes):
    """Rows that the named plan nodes of a query put out when it runs, largest first."""
    df.collect()
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        name = plan.nodeName()
        if name.startswith(nodes) and plan.metrics().contains("numOutputRows"):
            out.append(plan.metrics().apply("numOutputRows").value())
        inner = plan.executedPlan() if name == "AdaptiveSparkPlan" else plan.plan() if name.endswith("QueryStage") else None
        todo += [inner] if inner is not None else [plan.children().apply(i) for i in range(plan.children().size())]
    return sorted(out, reverse=True)


def test_small_groups_of_keys_are_not_indexed(spark):
    rows = [("C", f"G{i}", f"NORTHWIND STEEL {i}") for i in range(300)]
    x, y = (spark.createDataFrame(rows, f"c string, h string, {n} string") for n in "xy")
    pairs = sim.containment_pairs(x, y, ["c", "h"], "x", "y")
    assert pairs.count() == 300 and max(rows_through(pairs, "Generate"), default=0) == 0


def test_word_pairs_meet_under_two_words(spark):
    rows = sorted({f"{a} {b} {i}" for i in range(3) for a in "ABCDEFGH" for b in "PQRST"} | {"A", "A P", "B Q R"})
    pairs = ven.fuzzy_pairs(spark.createDataFrame([("C", r) for r in rows], "company_id string, vendor_name string"),
                            spark.createDataFrame([("C", f"V{i}", r, r, [], "active") for i, r in enumerate(rows)],
                                                  "company_id string, vendor_id string, name string, normalized_name string, aliases array<string>, status string"))
    got = [(r.lk, r.rk) for r in pairs.collect()]
    need = lambda a, b: len(set(a.split()) & set(b.split())) >= (len(a.split()) + len(b.split())) // 5 + 1
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in rows for b in rows if need(a, b)}
    assert rows_through(pairs, "SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin")[0] <= len(got)


def test_equal_vendor_keys_are_settled_without_comparison(spark):
    rows = [("C", f"V{i}", n, n.upper(), [], "active") for i, n in enumerate(["Acme Steel 1", "Acme Steel 2", "ACME, STEEL 1", "Delta Paper 7"])]
    vendors = spark.createDataFrame(rows, "company_id string, vendor_id string, name string, normalized_name string, aliases array<string>, status string")
    names = spark.createDataFrame([("C", n) for n in ("Acme Steel 1", "Acm Steel 2", "Inc.", "Delta Papr 7", "Zeta 9")], "company_id string, vendor_name string")
    got = {r.vendor_name: (r.vendor_id, r.confidence) for r in ven.resolve_fuzzy(names, vendors).collect()}
    score = lambda a, b: len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split())) * 0.4 + SequenceMatcher(None, a, b).ratio() * 0.6
    assert set(got) == {"Acme Steel 1", "Acm Steel 2", "Delta Papr 7"} and got["Acme Steel 1"] == ("V0", 0.85)
    assert got["Acm Steel 2"] == ("V1", round(score("ACM STEEL 2", "ACME STEEL 2") * 0.85, 2)) and got["Delta Papr 7"][0] == "V3"


def test_word_overlap_pairs_lose_nothing(spark):
    words = ["STEEL", "PAPER", "NORTH", "ACME", "1", "2", "3", "4", "5"]
    names = lambda: sorted({" ".join(rng.sample(words, rng.randint(1, 4))) for _ in range(80)})
    a, b = names(), names()
    got = {(r.x, r.y) for r in sim.overlap_pairs(frame(spark, a, "x"), frame(spark, b, "y"), ["c"], "x", "y", word_set, ven._shared,
                                                 lambda n: (n / F.lit(4)).cast("int") + 1, lambda n: (n * 4 - 1).cast("int")).collect()}
    jac = lambda x, y: len(set(x.split()) & set(y.split())) / len(set(x.split()) | set(y.split()))
    assert {(x, y) for x in a for y in b if jac(x, y) > 0.25} == got


def test_deletion_pairs_lose_nothing(spark):
    a, b = keys(80, "PO0123", 4, 9), keys(80, "PO0123", 4, 9)
    for floor in (0.88, 0.75):
        pairs, skipped = sim.deletion_pairs(frame(spark, a, "x"), frame(spark, b, "y"), ["c"], "x", "y", floor)
        got = {(r.x, r.y) for r in pairs.collect()}
        assert skipped.count() == 0
        assert {(x, y) for x in a for y in b if SequenceMatcher(None, x, y).ratio() >= floor} <= got


def fuzzy_numbers(spark, want, stock):
    inv = spark.createDataFrame([("C", f"D{i}", w) for i, w in enumerate(want)], "company_id string, document_id string, po_value string")
    pos = spark.createDataFrame([("C", s, "open", False) for s in stock], "company_id string, po_number string, status string, import_derived boolean")
    flags = spark.createDataFrame([("C", False, False)], "company_id string, has_import boolean, open_import boolean")
    got = {}
    for r in cand.by_fuzzy_number(inv, pos, flags).collect():
        got.setdefault(r.document_id, []).append((-r.confidence, r.po_number))
    for i, w in enumerate(want):
        scored = sorted((-SequenceMatcher(None, w, s).ratio(), s) for s in stock)
        assert sorted(got.get(f"D{i}", [])) == [p for p in scored if p[0] <= -0.6][:5], w


def test_fuzzy_numbers_equal_brute_force(spark):
    fuzzy_numbers(spark, keys(25, "PO012XZ", 4, 10) + ["QQQQ"], keys(150, "PO012X", 5, 10))


def test_fuzzy_numbers_of_any_length_equal_brute_force(spark):
    """Digits alone, few hits each: the last tier decides; long ones have more variants than may be expanded."""
    stock = keys(120, "0123456789", 6, 9) + keys(20, "0123456789", 15, 20)
    want = keys(20, "0123456789", 5, 9) + keys(4, "0123456789", 14, 18) + [stock[-1][:-3], stock[-2] + "77"]
    fuzzy_numbers(spark, sorted(set(want)), sorted(set(stock)))


def test_last_tier_pairs_are_few(spark):
    """Seven-digit numbers share most of their digits, in one order or another, but few a long enough subsequence."""
    stock, want = keys(2000, "0123456789", 7, 7), keys(20, "0123456789", 7, 7)
    pairs, skipped = sim.deletion_pairs(frame(spark, want, "x"), frame(spark, stock, "y"), ["c"], "x", "y", 0.6)
    assert skipped.count() == 0 and pairs.count() < len(stock) * len(want) / 20


def test_sequence_ratio_keeps_argument_order(spark):
    x = spark.createDataFrame([("tide", "diet"), ("diet", "tide")], "a string, b string").select(sequence_ratio("a", "b").alias("r"))
    assert [r.r for r in x.collect()] == [0.25, 0.5]


def test_fuzzy_vendor_equals_brute_force(spark):
    names = ["Nrthwind Steel 12", "Acme Papr 7", "Global Freight", "Unknown Thing 9"]
    vendors = spark.createDataFrame(
        [("C", f"V{i}", n, [], "active") for i, n in enumerate(["Northwind Steel 12", "Acme Paper 7", "Global Freight 3", "Acme Paper 8"])],
        "company_id string, vendor_id string, name string, aliases array<string>, status string").withColumn("normalized_name", ven.vendor_key("name"))
    inv = spark.createDataFrame([("C", n) for n in names], "company_id string, vendor_name string")
    got = {r.vendor_name: r.vendor_id for r in ven.resolve_fuzzy(inv, vendors).collect()}

    def score(a, b):
        ta, tb = set(a.split()), set(b.split())
        return 0.4 * len(ta & tb) / len(ta | tb) + 0.6 * SequenceMatcher(None, a, b).ratio()
    book = [(r.vendor_id, r.normalized_name) for r in vendors.collect()]
    for n in names:
        best = max(((score(n.upper(), k), -i, v) for i, (v, k) in enumerate(book)))
        assert got.get(n) == (best[2] if best[0] >= 0.70 else None)
