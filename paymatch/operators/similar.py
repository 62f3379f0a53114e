"""Equi-join blocking for inexact string joins.

None of these joins pairs everything with everything, and none loses a true pair:

* `containment_pairs` - a contained key shares every one of its q-grams with the longer key, so the shorter
  side is indexed under its single rarest gram.  Small groups are compared directly.
* `overlap_pairs` - prefix filtering: if two token sets must share at least `o` tokens, they share one among
  the `n - o + 1` rarest tokens of either side, and two among the `n - o + 2` rarest.  Frequent tokens are therefore hardly ever join keys.
* `deletion_pairs` - two strings with a common subsequence of length m share a variant with all but m
  characters deleted.  The number of partners per variant is bounded by the alphabet, not by the table.
"""

from __future__ import annotations

import sys
from functools import reduce
from itertools import combinations

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paymatch.plans.runtime import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def grams(s: Column, q: int) -> Column:
    n = F.length(s)
    starts = F.sequence(F.lit(1), F.greatest(n - (q - 1), F.lit(1)))
    return F.when(n >= q, F.transform(starts, lambda i: F.substring(s, i, F.lit(q)))).otherwise(
        F.array().cast("array<string>"))


def tagged(tokens: Column) -> Column:
    """Make a multiset a set: the second occurrence of `x` becomes `x#2`."""
    return F.transform(tokens, lambda x, i: F.concat_ws(
        "#", x, F.size(F.filter(F.slice(tokens, F.lit(1), i + 1), lambda y: y == x)).cast("string")))


#: Lengths of the grams that keys are found by: the longest that a short key has room for.  Long grams are rare in any table.
WIDTHS = (0, 1, 2, 3, 6)
#: Groups with at most so many pairs are compared directly.
FEW_PAIRS = 64


def _contained(short: DataFrame, long: DataFrame, on: list[str]) -> DataFrame:
    """Pairs with `short.sk` contained in `long.lk`; both inputs hold distinct keys."""
    sk, lk = F.col("sk"), F.col("lk")
    cut = lambda s, w: grams(s, w) if w else F.array(F.lit(""))
    width = F.element_at(F.filter(F.array(*map(F.lit, WIDTHS)), lambda w: w <= F.length(sk)), -1)
    short = short.withColumn("w", width)
    own = reduce(lambda c, w: c.when(F.col("w") == w, cut(sk, w)), WIDTHS, F)
    # a group is indexed under those lengths only that its short keys ask for
    asked = short.groupBy(*on).agg(F.collect_set("w").alias("ws"))
    every = F.concat(*[F.when(F.array_contains("ws", w), cut(lk, w)).otherwise(F.array().cast("array<string>")) for w in WIDTHS])
    met = long.join(asked, on) if on else long.crossJoin(F.broadcast(asked))  # without group columns there is one group
    lg = met.select(*on, "lk", F.explode(F.array_distinct(every)).alias("g"))
    freq = lg.groupBy(*on, "g").agg(F.count(F.lit(1)).alias("n"))
    sg = short.select(*on, "sk", F.explode(F.array_distinct(own)).alias("g"))
    # a short key whose rarest gram is missing on the long side has no partner and drops out here
    seed = sg.join(freq, [*on, "g"], "left").groupBy(*on, "sk").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("m")).select(*on, "sk", "m.g")
    # exploded grams are many times what Spark takes them for, hence no broadcast
    return seed.join(lg.hint("merge"), [*on, "g"]).filter(F.contains("lk", "sk")).select(*on, "sk", "lk")


def containment_pairs(left: DataFrame, right: DataFrame, on: list[str], lkey: str, rkey: str) -> DataFrame:
    """Distinct (on, lkey, rkey) where either key contains the other."""
    l, r = left.select(*on, lkey).dropna().distinct(), right.select(*on, rkey).dropna().distinct()
    few = None
    if len(on) > 1:  # selective group columns: most groups hold a key or two, and only the others are worth an index
        count = lambda side, n: side.groupBy(*on).agg(F.count(F.lit(1)).alias(n))
        # each of these is read four times or more: written once, they do not multiply in the plan, which the driver holds
        l, r = stage(l), stage(r)
        large = stage(count(l, "nl").join(count(r, "nr"), on).filter(F.col("nl") * F.col("nr") > FEW_PAIRS).select(*on))
        few = l.join(large, on, "left_anti").join(r, on).filter(F.contains(lkey, rkey) | F.contains(rkey, lkey)).select(*on, lkey, rkey)
        l, r = l.join(large, on, "left_semi"), r.join(large, on, "left_semi")
    a = _contained(l.withColumnRenamed(lkey, "sk"), r.withColumnRenamed(rkey, "lk"), on)
    b = _contained(r.withColumnRenamed(rkey, "sk"), l.withColumnRenamed(lkey, "lk"), on)
    found = a.select(*on, F.col("sk").alias(lkey), F.col("lk").alias(rkey)).unionByName(
        b.select(*on, F.col("lk").alias(lkey), F.col("sk").alias(rkey))).distinct()
    return found if few is None else found.unionByName(few)


def overlap_pairs(left: DataFrame, right: DataFrame, on: list[str], lkey: str, rkey: str,
                  tokens, need, lo, hi, together: int = 1) -> DataFrame:
    """Distinct (on, lkey, rkey) whose token sets may share `need(n, s)` of `n` and `s` tokens.

    `tokens(key)` gives a token set, `lo(n)`..`hi(n)` the partner sizes worth indexing.  With `together` 2, sets that must share two
    tokens meet under two of them, which share both in a prefix one token longer: a frequent word pairs nothing by itself.
    """
    l, r = left.select(*on, lkey).dropna().distinct(), right.select(*on, rkey).dropna().distinct()
    lt = l.select(*on, lkey, F.explode(tokens(F.col(lkey))).alias("t"))
    rt = r.select(*on, rkey, F.explode(tokens(F.col(rkey))).alias("t"))
    freq = rt.groupBy(*on, "t").agg(F.count(F.lit(1)).alias("f"))

    def prefixes(side: DataFrame, key: str, mine: str, other: str) -> DataFrame:
        ranked = side.join(freq, [*on, "t"], "left").groupBy(*on, key).agg(F.array_sort(F.collect_list(
            F.struct(F.coalesce("f", F.lit(0)).alias("f"), "t"))).alias("ts")).withColumn("n", F.size("ts"))
        n = F.col("n")
        sized = ranked.withColumn("s", F.explode(F.sequence(lo(n), F.greatest(hi(n), lo(n)))))
        o = F.greatest(need(n, F.col("s")), F.lit(1))
        m = F.least(o, F.lit(together))
        sized = sized.filter((o <= n) & (o <= F.col("s"))).withColumn("p", F.slice("ts", F.lit(1), (n - o + m).cast("int"))["t"])
        two = F.flatten(F.transform("p", lambda x, i: F.transform(F.slice(F.col("p"), i + 2, F.size("p")), lambda y: F.array(x, y))))
        met = F.transform("p", lambda x: F.array(x)) if together == 1 else F.when(m > 1, two).otherwise(F.transform("p", lambda x: F.array(x)))
        return sized.select(*on, key, F.col("n").alias(mine), F.col("s").alias(other), F.col("p").alias(f"p_{mine}"), F.explode(met).alias("t"))

    a, b = prefixes(lt, lkey, "ln", "rn"), prefixes(rt, rkey, "rn", "ln")
    # both prefixes are in the same order, so a pair counts only where its first common tokens brought it together
    first = F.slice(F.array_intersect("p_ln", "p_rn"), F.lit(1), F.size("t")) == F.col("t")
    common = F.size(F.array_intersect(tokens(F.col(lkey)), tokens(F.col(rkey))))
    return a.join(b, [*on, "t", "ln", "rn"]).filter(first & (common >= need(F.col("ln"), F.col("rn")))).select(*on, lkey, rkey)


MAX_VARIANTS = 4096


@F.pandas_udf(T.ArrayType(T.StringType()))
def _deletions(s: pd.Series, keep: pd.Series) -> pd.Series:
    """Distinct subsequences of the given length."""
    return pd.Series([sorted({"".join(c) for c in combinations(x, k)}) for x, k in zip(s, keep)])


def _n_variants(n: Column, keep: Column) -> Column:
    """log of n choose keep, from tabulated log factorials, so that oversize expansions can be told apart."""
    lf = lambda x: F.aggregate(F.sequence(F.lit(1), F.greatest(x, F.lit(1))), F.lit(0.0), lambda a, i: a + F.log(i.cast("double")))
    return lf(n) - lf(keep) - lf(n - keep)


def deletion_pairs(left: DataFrame, right: DataFrame, on: list[str], lkey: str, rkey: str,
                   min_ratio: float) -> tuple[DataFrame, DataFrame]:
    """(pairs, skipped): all distinct pairs that share a common subsequence long enough for the ratio.

    `skipped` lists the left keys that meet a partner length whose expansion would exceed MAX_VARIANTS; the
    pairs of those lengths are not in `pairs`, so the caller must search them another way.
    """
    t = min_ratio / 2.0
    l, r = left.select(*on, lkey).dropna().distinct(), right.select(*on, rkey).dropna().distinct()
    l, r = l.filter(F.length(lkey) > 0), r.filter(F.length(rkey) > 0)
    ll = l.select(*on, F.length(lkey).alias("ln")).distinct()
    combos = ll.join(r.select(*on, F.length(rkey).alias("rn")).distinct(), on).withColumn(
        "keep", F.ceil((F.col("ln") + F.col("rn")) * t).cast("int")).filter("keep <= ln and keep <= rn")
    limit = F.log(F.lit(float(MAX_VARIANTS)))
    combos = combos.withColumn("big", F.greatest(_n_variants(F.col("ln"), F.col("keep")),
                                                 _n_variants(F.col("rn"), F.col("keep"))) > limit)
    small = combos.filter("not big").drop("big")

    def expand(side: DataFrame, key: str, n: str) -> DataFrame:
        x = side.withColumn(n, F.length(key)).join(small, [*on, n])
        return x.withColumn("v", F.explode(_deletions(F.col(key), F.col("keep")))).drop("keep")

    pairs = expand(l, lkey, "ln").join(expand(r, rkey, "rn"), [*on, "v", "ln", "rn"]).select(*on, lkey, rkey).distinct()
    skipped = l.withColumn("ln", F.length(lkey)).join(combos.filter("big"), [*on, "ln"], "left_semi").select(*on, lkey)
    return pairs, skipped
