"""Benchmark decontamination (operator 3): winnowing, a join of test and document fingerprints, extension of the hits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paymatch.llm import sketches
from paymatch.llm.words import alnum_words, gram_hashes, signed, winnow
from paymatch.plans.runtime import stage

_ANCHORS = "array<struct<hash:bigint,pos:int,k:int,before:array<binary>,gram:array<binary>,after:array<binary>>>"
_ARROW = pa.list_(pa.struct([("hash", pa.int64()), ("pos", pa.int32()), ("k", pa.int32()), ("before", pa.list_(pa.binary())),
                             ("gram", pa.list_(pa.binary())), ("after", pa.list_(pa.binary()))]))


def _salted(hashes: np.ndarray, k: int) -> np.ndarray:
    return hashes ^ np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)


def _anchor(words, h, pos, k, reach):
    """An anchor with the words within `reach` on both sides; those before it in reverse."""
    return {"hash": int(h), "pos": pos, "k": k, "before": words[max(0, pos - reach):pos][::-1], "gram": words[pos:pos + k],
            "after": words[pos + k:pos + k + reach]}


def _item_anchors(window: int, gram: int):
    """The winnowed anchors of each item; an item shorter than a window is one anchor as a whole."""
    def run(frames):
        for frame in frames:
            out = []
            for text in frame.column(1).to_pylist():
                words = alnum_words(text)
                if 0 < len(words) < window:
                    h = signed(_salted(gram_hashes(words, len(words)), len(words)))
                    out.append([_anchor(words, h[0], 0, len(words), 0)])
                    continue
                hashes = gram_hashes(words, gram)
                at = np.unique(winnow(hashes, window - gram + 1))
                out.append([_anchor(words, h, int(p), gram, window - gram) for h, p in zip(signed(hashes[at]), at)])
            yield pa.RecordBatch.from_arrays([frame.column(0), pa.array(out, _ARROW)], names=["item_id", "anchors"])
    return run


def _doc_anchors(window: int, gram: int, sent):
    """Word counts and those anchors of each document that may meet an anchor of an item."""
    def run(frames):
        packed, short = sent.value
        for frame in frames:
            n_words, out = [], []
            for text in frame.column(1):
                words = alnum_words(text.as_py())
                n_words.append(len(words))
                hashes = gram_hashes(words, gram)
                at = np.unique(winnow(hashes, window - gram + 1))
                at = at[sketches.member(packed, hashes[at])]
                found = [_anchor(words, h, int(p), gram, window - gram) for h, p in zip(signed(hashes[at]), at)]
                for k in short:
                    hashes = _salted(gram_hashes(words, k), k)
                    at = np.flatnonzero(sketches.member(packed, hashes))
                    found += [_anchor(words, h, int(p), k, 0) for h, p in zip(signed(hashes[at]), at)]
                out.append(found)
            yield pa.RecordBatch.from_arrays([frame.column(0), pa.array(n_words, pa.int64()), pa.array(out, _ARROW)],
                                             names=["doc", "n_words", "anchors"])
    return run


def _common(a: str, b: str):
    """Length of the common start of two arrays."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True)
    return F.when(differs > 0, differs - 1).otherwise(F.least(F.size(a), F.size(b)))


def _met(docs: DataFrame, items: DataFrame, window: int, gram: int, carried: list[str]) -> tuple[DataFrame, DataFrame]:
    """Staged rows (row, doc_id, n_words) with the `carried` columns as struct `doc`, and (row, item_id, start, end) of matches."""
    if not 0 < gram <= window:
        raise ValueError("gram must be between 1 and window")
    spark = docs.sparkSession
    item_kind = items.schema["item_id"].dataType.simpleString()
    tests = stage(items.select("item_id", "text").mapInArrow(_item_anchors(window, gram), f"item_id {item_kind}, anchors {_ANCHORS}")
                  .select("item_id", F.explode("anchors").alias("i")).select("item_id", "i.*"))
    short = [r.k for r in tests.select("k").where(F.col("k") < window).where(F.size("after") + F.size("before") == 0).distinct().collect()]
    sent = spark.sparkContext.broadcast((sketches.bitmap(tests, "hash"), sorted(short)))
    doc = docs.select(F.struct(*(F.col(f"`{c}`") for c in carried)).alias("doc"), "text")
    seen = stage(doc.mapInArrow(_doc_anchors(window, gram, sent), f"doc {doc.schema['doc'].dataType.simpleString()}, n_words bigint, anchors {_ANCHORS}")
                 .withColumn("row", F.monotonically_increasing_id()))
    hits = seen.select("row", F.explode("anchors").alias("d")).select("row", "d.*")
    met = (hits.join(tests.select("hash", "k", "item_id", *(F.col(c).alias(f"i_{c}") for c in ("before", "gram", "after"))), ["hash", "k"])
           .where(F.col("gram") == F.col("i_gram"))
           .withColumns({"left": _common("before", "i_before"), "right": _common("after", "i_after")})
           .where((F.col("left") + F.col("k") + F.col("right") >= window) | ((F.size("i_before") + F.size("i_after") == 0) & (F.col("k") < window)))
           .select("row", "item_id", (F.col("pos") - F.col("left")).alias("start"), (F.col("pos") + F.col("k") + F.col("right")).alias("end")))
    return seen.drop("anchors"), stage(met.distinct())


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, gram: int = 5) -> DataFrame:
    """Rows (doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one for each row of `docs` (doc_id, text).

    `items` (item_id, text) holds the benchmark.  A document word is hit if it lies in an occurrence of `window` consecutive
    item words; an item with fewer words is one window, one without words none.  Of each window both sides keep the k-gram
    with the smallest hash (k = `gram`), so each shared window shares an anchor.  Documents send only anchors that pass a
    bit map of the item anchors (fixed size) into the join, each with the words around it; a hit is extended word by word
    on both sides, so hashes decide nothing, and counts if the match reaches the window.

    Null or empty texts have no words and no hits; repeated rows get a row each; repeated items, and null item ids (left out of
    the list), are one id; empty tables give no rows or no hits; other columns are ignored.
    """
    seen, met = _met(docs, items, window, gram, ["doc_id"])
    by_row = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    words = (met.select("row", "start", "end").distinct().withColumn("reached", F.coalesce(F.max("end").over(by_row), F.lit(0)))
             .groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "reached"))).alias("n_hit")))
    lists = (met.where("item_id is not null").groupBy("row").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items")))
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return (seen.select("row", "doc.doc_id", "n_words").join(words, "row", "left").join(lists, "row", "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_).cast("long").alias("n_items"),
                    F.sha2(F.concat_ws(",", items_), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated")))


def keep_clean(docs: DataFrame, items: DataFrame, window: int = 10, gram: int = 5) -> DataFrame:
    """The rows of `docs` in which no window of an item occurs, all columns kept; null and empty texts stay."""
    seen, met = _met(docs, items, window, gram, docs.columns)
    clean = seen.join(met.select("row").distinct(), "row", "left_anti")
    return clean.select(*(F.col(f"doc.`{c}`").alias(c) for c in docs.columns))
