"""The bounded line assignment against the plain one."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from paymatch.functions.similarity import common_subsequence
from paymatch.operators import lines as ln


def test_bounds_hold():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc é𝒳") for _ in range(rng.randint(0, 20))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert common_subsequence(a, b) == table[-1][-1]
        blocks = sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks())
        assert blocks <= table[-1][-1]


def test_blended_assignment_equals_the_plain_one(spark):
    rng = random.Random(2)
    words = ["steel", "bolt", "paper", "ream", "large", "blue", "STEEL", "item", "SKU-1", "SKU-2", "  ", "été"]
    text = lambda: rng.choice([None, "", " ".join(rng.choice(words) for _ in range(rng.randint(1, 5)))]) if rng.random() < 0.2 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 5)))
    number = lambda: rng.choice([None, 0, 1, 5, 7, 100])
    inv, po, pairs = [], [], []
    for d in range(60):
        pairs.append(("C", f"D{d}", f"P{d}"))
        inv += [("C", f"D{d}", k + 1, text(), number(), number()) for k in range(rng.randint(0, 5))]
        po += [("C", f"P{d}", k + 1, text(), rng.choice([None, "", "sku-1", "SKU-2"]), number(), number()) for k in range(rng.randint(0, 6))]
    inv = spark.createDataFrame(inv, "company_id string, document_id string, line_no bigint, description string, quantity bigint, unit_price bigint")
    po = spark.createDataFrame(po, "company_id string, po_number string, line_number bigint, description string, sku string, quantity bigint, unit_price bigint")
    pairs = spark.createDataFrame(pairs, "company_id string, document_id string, po_number string")
    got = {r.document_id: r.maps for r in ln.match_lines(pairs, inv, po).collect()}
    i = ln.line_arrays(inv, "document_id", "line_no", False).withColumnRenamed("lines", "inv_lines")
    p = ln.line_arrays(po, "po_number", "line_number", True).withColumnRenamed("lines", "po_lines")
    x = pairs.join(i, ["company_id", "document_id"], "left").join(p, ["company_id", "po_number"], "left")
    x = x.withColumns({"inv_lines": F.coalesce("inv_lines", F.array().cast(i.schema["inv_lines"].dataType)), "po_lines": F.coalesce("po_lines", F.array().cast(p.schema["po_lines"].dataType))})
    want = {r.document_id: r.maps for r in ln.assign_lines(ln.score_matrix(x)).collect()}
    assert got == want and any(m.match_type == "exact" for maps in got.values() for m in maps)
