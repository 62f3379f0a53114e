"""Line matching inside one (invoice, order) pair, and what follows from it.

A pair's lines sit in two arrays, because the greedy assignment is a fold over the lines of one document.  The
arrays hold one document's lines each; nothing is collected across documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paymatch.functions.expr import true
from paymatch.functions.similarity import line_assigner, ratio_matrix
from paymatch.functions.text import description_key, jaccard, word_set
from paymatch.policy import MATCH, MatchPolicy

MAPPING = "array<struct<invoice_line:bigint,po_line:bigint,match_type:string,milli:bigint>>"


def line_arrays(lines: DataFrame, key: str, number: str, with_sku: bool) -> DataFrame:
    """One row per document: its lines in order, with the description keys worked out once."""
    k = description_key("description")
    x = lines.withColumn("_k", k)
    fields = [F.col(number).cast("bigint").alias("no"), F.coalesce("description", F.lit("")).alias("d"),
              F.upper(F.coalesce("description", F.lit(""))).alias("u"), F.col("_k").alias("k"), word_set("_k").alias("w"),
              F.col("quantity").cast("double").alias("q"), F.col("unit_price").cast("double").alias("p")]
    if with_sku:
        fields.append(F.upper(F.coalesce("sku", F.lit(""))).alias("sku"))
    return x.groupBy("company_id", key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("lines"))


def _ratio(a: Column, b: Column) -> Column:
    return F.least(a, b) / F.greatest(a, b)


def _sku_hit(i: Column, p: Column) -> Column:
    return (p["sku"] != "") & (i["d"] != "") & F.contains(i["u"], p["sku"])


def pair_score(i: Column, p: Column, similarity: Column) -> Column:
    """L3."""
    sku_hit = _sku_hit(i, p)
    s = F.when(sku_hit, F.lit(0.4)).otherwise(F.lit(0.0)) + similarity * 0.35
    s = s + F.coalesce(F.when(p["q"] > 0, _ratio(i["q"], p["q"])), F.lit(0.0)) * 0.15
    s = s + F.coalesce(F.when(p["p"] > 0, _ratio(i["p"], p["p"])), F.lit(0.0)) * 0.10
    return F.struct(s.alias("s"), (-p["no"]).alias("n"), F.when(sku_hit, "exact").otherwise("semantic").alias("t"))


def token_similarity(i: Column, p: Column) -> Column:
    """The token half of L2; an empty description has no similarity."""
    return F.when((i["d"] != "") & (p["d"] != ""), jaccard(i["w"], p["w"])).otherwise(F.lit(0.0))


def score_matrix(pairs: DataFrame, policy: MatchPolicy = MATCH) -> DataFrame:
    """Adds `scores`: per invoice line the scored order lines.  Needs `inv_lines` and `po_lines` arrays."""
    if policy.similarity == "tokens":
        return pairs.withColumn("scores", F.transform("inv_lines", lambda i: F.transform(
            F.col("po_lines"), lambda p: pair_score(i, p, token_similarity(i, p)))))
    pairs = pairs.withColumn("_r", ratio_matrix(F.transform("inv_lines", lambda i: i["k"]), F.transform("po_lines", lambda p: p["k"])))
    width = F.size("po_lines")

    def blended(i: Column, p: Column, x: Column, y: Column) -> Column:
        sim = token_similarity(i, p) * 0.5 + F.get(F.col("_r"), x * width + y) * 0.5
        return pair_score(i, p, F.when((i["d"] != "") & (p["d"] != ""), sim).otherwise(F.lit(0.0)))

    return pairs.withColumn("scores", F.transform("inv_lines", lambda i, x: F.transform(
        F.col("po_lines"), lambda p, y: blended(i, p, x, y)))).drop("_r")


def assign_lines(pairs: DataFrame, policy: MatchPolicy = MATCH) -> DataFrame:
    """L4.  Greedy 1:1 in invoice line order; the first best order line wins; below the minimum stays unmatched."""
    start = F.struct(F.array().cast("array<bigint>").alias("used"), F.array().cast(MAPPING).alias("maps"))

    def taken(acc: Column, row: Column, best: Column) -> Column:
        hit = true(best["s"] >= policy.line_min_score)
        milli = F.floor(F.coalesce(best["s"], F.lit(0.0)) * 1000.0 + 0.5).cast("bigint")
        mapping = F.struct(row["no"].alias("invoice_line"), F.when(hit, -best["n"]).otherwise(F.lit(0)).cast("bigint").alias("po_line"),
                           F.when(hit, best["t"]).otherwise(F.lit("unmatched")).alias("match_type"), milli.alias("milli"))
        return F.struct(F.when(hit, F.array_append(acc["used"], -best["n"])).otherwise(acc["used"]).alias("used"),
                        F.array_append(acc["maps"], mapping).alias("maps"))

    def step(acc: Column, row: Column) -> Column:
        free = F.filter(row["r"], lambda o: ~F.array_contains(acc["used"], -o["n"]))
        # a one-element array binds the best line, which would be searched anew for each use
        return F.get(F.transform(F.array(F.array_max(free)), lambda best: taken(acc, row, best)), F.lit(0))

    rows = F.zip_with("inv_lines", "scores", lambda i, r: F.struct(i["no"].alias("no"), r.alias("r")))
    return pairs.withColumn("maps", F.aggregate(rows, start, step, lambda a: a["maps"]))


def assign_blended(pairs: DataFrame, policy: MatchPolicy = MATCH) -> DataFrame:
    """L2-L4 of the full similarity: the same `maps` as `assign_lines` over `score_matrix`, with few exact ratios.

    The assignment works on whole lines and bounds the ratios, so that only few are worked out.
    """
    each = lambda c, f: F.transform(c, lambda line: line[f])
    x = pairs.withColumn("_b", line_assigner(policy.line_min_score)(*[each("inv_lines", f) for f in "kuqp"], *[each("po_lines", f) for f in ("k", "u", "sku", "q", "p")]))

    def mapping(i: Column, b: Column) -> Column:
        at, s = F.get(b, F.lit(0)).cast("int"), F.get(b, F.lit(1))
        hit = (at >= 0) & (s >= policy.line_min_score)
        p = F.get("po_lines", at)
        return F.struct(i["no"].alias("invoice_line"), F.when(hit, p["no"]).otherwise(F.lit(0)).cast("bigint").alias("po_line"),
                        F.when(hit, F.when(_sku_hit(i, p), "exact").otherwise("semantic")).otherwise(F.lit("unmatched")).alias("match_type"),
                        F.floor(s * 1000.0 + 0.5).cast("bigint").alias("milli"))

    return x.withColumn("maps", F.zip_with("inv_lines", "_b", mapping)).drop("_b")


def matched(maps: Column) -> Column:
    return F.filter(maps, lambda m: m["match_type"] != "unmatched")


def line_coverage(maps: Column) -> Column:
    """L5."""
    return F.when(F.size(maps) > 0, F.size(matched(maps)) / F.size(maps)).otherwise(F.lit(0.0))


def match_lines(pairs: DataFrame, invoice_lines: DataFrame, po_lines: DataFrame, policy: MatchPolicy = MATCH,
                findings: dict | None = None) -> DataFrame:
    """L2-L4 for (company_id, document_id, po_number) pairs; keeps the columns of `pairs` and adds `maps`.

    `findings` are further columns over `maps`, `inv_lines` and `po_lines`, taken before the arrays are dropped.
    """
    i = line_arrays(invoice_lines, "document_id", "line_no", False).withColumnRenamed("lines", "inv_lines")
    p = line_arrays(po_lines, "po_number", "line_number", True).withColumnRenamed("lines", "po_lines")
    x = pairs.join(i, ["company_id", "document_id"], "left").join(p, ["company_id", "po_number"], "left")
    x = x.withColumns({"inv_lines": F.coalesce("inv_lines", F.array().cast(i.schema["inv_lines"].dataType)),
                       "po_lines": F.coalesce("po_lines", F.array().cast(p.schema["po_lines"].dataType))})
    done = assign_lines(score_matrix(x, policy), policy) if policy.similarity == "tokens" else assign_blended(x, policy)
    return done.withColumns(findings or {}).drop("inv_lines", "po_lines", "scores")


def balance_flags(total: Column, remaining: Column, line_flags: Column | None = None) -> Column:
    """L7.  Warnings only; the invoice is not rejected here."""
    over = true(total > remaining)
    cents = (total - remaining) % 100
    amount = F.concat(((total - remaining) / 100).cast("bigint").cast("string"), F.lit("."), F.lpad(cents.cast("string"), 2, "0"))
    base = F.when(over, F.array(F.lit("potential_overbilling"), F.concat(F.lit("overage_"), amount))).otherwise(
        F.array().cast("array<string>"))
    return base if line_flags is None else F.concat(base, line_flags)


def quantity_flags(allocated: DataFrame, po_lines: DataFrame) -> DataFrame:
    """L7 with allocated quantities: one flag per order line that is over-consumed, per document and order."""
    x = allocated.join(po_lines.select("company_id", "po_number", F.col("line_number").alias("po_line"), "quantity", "invoiced_quantity"),
                       ["company_id", "po_number", "po_line"])
    x = x.filter(F.col("allocated_quantity") > F.col("quantity") - F.col("invoiced_quantity") + 1e-6)
    return x.groupBy("company_id", "document_id", "po_number").agg(F.array_join(F.array_sort(F.collect_set(
        F.concat(F.lit("line_"), "po_line", F.lit("_qty_exceeded")))), ",").alias("flags"))


def resolve_multi_po(candidates: Column, policy: MatchPolicy = MATCH) -> Column:
    """L6.  ARRAY<STRUCT<po_number, maps>> of the orders the lines fall on, in the order of their first line.

    `candidates` is the ranked array; each line goes to the order with the highest similarity, earlier on ties.
    """
    top = F.slice(candidates, 1, policy.multi_po_top)
    options = F.flatten(F.transform(top, lambda c, r: F.transform(matched(c["maps"]), lambda m: F.struct(
        m["invoice_line"].alias("line"), m["milli"].alias("milli"), (-r).alias("r"), c["po_number"].alias("po"), m.alias("m")))))
    lines = F.array_sort(F.array_distinct(F.transform(options, lambda o: o["line"])))
    chosen = F.transform(lines, lambda n: F.array_max(F.filter(options, lambda o: o["line"] == n)))
    orders = F.array_distinct(F.transform(chosen, lambda o: o["po"]))
    return F.transform(orders, lambda po: F.struct(
        po.alias("po_number"), F.transform(F.filter(chosen, lambda o: o["po"] == po), lambda o: o["m"]).alias("maps")))
