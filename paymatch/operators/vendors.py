"""Vendor resolution against the master: normalized name, alias, then fuzzy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paymatch.functions.expr import half_up
from paymatch.functions.similarity import sequence_ratio
from paymatch.functions.text import jaccard, vendor_key, word_set
from paymatch.operators.similar import overlap_pairs
from paymatch.policy import MATCH, MatchPolicy


def active_names(vendors: DataFrame) -> DataFrame:
    """One row per (active vendor, name or alias): key, method, confidence and the master order."""
    v = vendors.filter("status = 'active'")
    forms = F.array(
        F.struct(vendor_key("name").alias("key"), F.lit("normalized").alias("method"), F.lit(0.90).alias("conf")),
        F.struct(vendor_key("normalized_name").alias("key"), F.lit("normalized").alias("method"), F.lit(0.90).alias("conf")))
    aliases = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(
        vendor_key(a).alias("key"), F.lit("alias").alias("method"), F.lit(0.85).alias("conf")))
    return v.select("company_id", "vendor_id", F.explode(F.array_distinct(F.concat(forms, aliases))).alias("n")).select(
        "company_id", "vendor_id", "n.key", "n.method", "n.conf")


def resolve_normalized(names: DataFrame, vendors: DataFrame) -> DataFrame:
    """J1/J2.  Equal keys; the first vendor in master order wins, its own name before its alias."""
    book = active_names(vendors).groupBy("company_id", "key").agg(F.min(F.struct(
        "vendor_id", (-F.col("conf")).alias("o"), "method", "conf")).alias("m"))
    x = names.select("company_id", "vendor_name").filter("vendor_name <> ''").distinct()
    return x.withColumn("key", vendor_key("vendor_name")).join(book, ["company_id", "key"]).select(
        "company_id", "vendor_name", F.col("m.vendor_id").alias("vendor_id"), F.col("m.method").alias("method"),
        F.col("m.conf").alias("confidence"))


def _shared(n: Column, s: Column) -> Column:
    """.4 J + .6 R >= .70 with R < 1 for unequal keys forces J > .25, hence this many common tokens."""
    return F.floor((n + s) / F.lit(5)).cast("int") + 1


def fuzzy_pairs(names: DataFrame, vendors: DataFrame) -> DataFrame:
    """Candidate (name key, vendor key) pairs with their token overlap; no pair at or above .70 is missing."""
    left = names.select("company_id", vendor_key("vendor_name").alias("lk"))
    right = active_names(vendors).select("company_id", F.col("key").alias("rk"))
    pairs = overlap_pairs(left, right, ["company_id"], "lk", "rk", word_set, _shared,
                          lambda n: (n / F.lit(4)).cast("int") + 1, lambda n: (n * 4 - 1).cast("int"), together=2)
    return pairs.withColumn("token_overlap", jaccard(word_set("lk"), word_set("rk")))


def resolve_fuzzy(names: DataFrame, vendors: DataFrame, policy: MatchPolicy = MATCH) -> DataFrame:
    """J3.  Best of token overlap and sequence ratio over names and aliases; the first best vendor wins.

    Equal keys alone score 1, so a name that has one is settled and only the others are compared.
    """
    x = names.select("company_id", "vendor_name").filter("vendor_name <> ''").distinct().withColumn("lk", vendor_key("vendor_name"))
    same = active_names(vendors).filter("key <> ''").groupBy("company_id", F.col("key").alias("lk")).agg(
        F.struct(F.lit(-1.0).alias("o"), F.min("vendor_id").alias("vendor_id")).alias("m"))
    scored = fuzzy_pairs(x.join(same, ["company_id", "lk"], "left_anti"), vendors).withColumn(
        "score", F.col("token_overlap") * 0.4 + sequence_ratio("lk", "rk") * 0.6)
    scored = scored.filter(F.col("score") >= policy.vendor_fuzzy_min)
    book = active_names(vendors).select("company_id", "vendor_id", F.col("key").alias("rk")).distinct()
    best = scored.join(book, ["company_id", "rk"]).groupBy("company_id", "lk").agg(
        F.min(F.struct((-F.col("score")).alias("o"), "vendor_id")).alias("m"))
    return x.join(same.unionByName(best), ["company_id", "lk"]).select(
        "company_id", "vendor_name", F.col("m.vendor_id").alias("vendor_id"), F.lit("fuzzy").alias("method"),
        half_up(-F.col("m.o") * 0.85, 2).alias("confidence"))


def resolve_vendor(names: DataFrame, vendors: DataFrame, policy: MatchPolicy = MATCH) -> DataFrame:
    """J4.  One row per distinct (company, printed name) that resolves."""
    hit = resolve_normalized(names, vendors)
    if policy.similarity == "tokens":
        return hit
    rest = names.select("company_id", "vendor_name").filter("vendor_name <> ''").distinct().join(
        hit, ["company_id", "vendor_name"], "left_anti")
    return hit.unionByName(resolve_fuzzy(rest, vendors, policy))
