"""Target-distribution importance resampling (operator 11): hashed n-gram counts of whole batches, Gumbel-perturbed weights, a draw."""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paymatch.operators.ledger import number_rows
from paymatch.plans.runtime import stage

BATCH = 1 << 19  # bytes of text concatenated at a time, about
ACCURACY = 10_000  # of the quantile that leaves out what cannot be drawn
SENTINEL = b"\x00"  # between texts: never part of a word

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


def batches(texts: list[str | None], size: int = BATCH) -> Iterator[tuple[list[int], list[bytes]]]:
    """(text numbers, parts) of about `size` bytes; texts, with A-Z as a-z, are cut between words where they are longer.

    A text goes on in the next batch if its number comes first there again.
    """
    rows, parts, held = [], [], 0
    for i, text in enumerate(texts):
        data, start = (text or "").encode("utf-8", "surrogatepass").lower(), 0
        while True:
            cut = _GAP.search(data, start + size - held) if len(data) - start > size - held else None
            part = data[start:cut.start() if cut else len(data)]
            rows.append(i), parts.append(part)
            held += len(part) + 1
            if held >= size:
                yield rows, parts
                rows, parts, held = [], [], 0
            if cut is None:
                break
            start = cut.end()
    if rows:
        yield rows, parts


def batch_features(parts: list[bytes], orders: int, skip: int = 0) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each part, and for n = 1 to `orders` the (part, crc32) of its runs of n words joined by one space.

    The parts are joined with sentinels and one pass of the pattern finds all words; the part of a word is found by its
    offset, and runs whose ends lie in different parts are masked.  The first `skip` words only begin runs: what ends with
    them is not given.
    """
    data = SENTINEL.join(parts)
    offsets = np.cumsum([0] + [len(p) + 1 for p in parts[:-1]])
    found = list(_WORD.finditer(data))
    words = list(map(re.Match.group, found))
    part = np.searchsorted(offsets, np.fromiter(map(re.Match.start, found), np.int64, len(found)), side="right") - 1
    spaced = [b" " + w for w in words]
    out, sums = [], list(map(crc32, words))
    for n in range(1, orders + 1):
        if n > 1:
            sums = list(map(crc32, spaced[n - 1:], sums))  # the sum of a longer run goes on from that of the run before
        last = part[n - 1:]
        inside = (last == part[:len(last)]) & (np.arange(n - 1, n - 1 + len(last)) >= skip)
        out.append((last[inside], np.array(sums[:len(last)], np.uint32)[inside]))
    return np.bincount(part[skip:], minlength=len(parts)), out


def text_features(texts: list[str | None], orders: int, size: int = BATCH) -> Iterator[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """For each batch the words of each text and, for each n, (text, crc32) of its runs; texts that go on keep their runs whole."""
    last, tail = -1, b""
    for rows, parts in batches(texts, size):
        skip = 0
        if rows[0] == last and tail:
            skip = tail.count(b" ") + 1
            parts[0] = tail + b" " + parts[0]
        words, found = batch_features(parts, orders, skip)
        yield np.bincount(rows, weights=words, minlength=len(texts)).astype(np.int64), [(np.array(rows)[p], c) for p, c in found]
        last, tail = rows[-1], b" ".join(_WORD.findall(parts[-1])[-(orders - 1):]) if orders > 1 else b""


def bucket_counts(texts: DataFrame, buckets: int = 10_000, orders: int = 3) -> DataFrame:
    """Rows (bucket, n) of the features of all rows of `texts` (text); each task counts in one array of `buckets` numbers."""
    def count(frames):
        total = np.zeros(buckets, np.int64)
        for frame in frames:
            for _, found in text_features(frame.column(0).to_pylist(), orders):
                for _, sums in found:
                    total += np.bincount(sums % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """The gain of each bucket, floor(1000 ln(target share / source share)) with one feature added to every bucket.

    As many numbers as there are buckets come to the driver, whatever the size of the tables.
    """
    spark = source.sparkSession
    side = lambda df, name: df.select("bucket", F.col("n").alias(name))
    rows = (spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(side(source, "s"), "bucket", "left").join(side(target, "t"), "bucket", "left")
            .select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")).collect())
    s, t = np.zeros(buckets), np.zeros(buckets)
    for row in rows:
        s[row.bucket], t[row.bucket] = row.s, row.t
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, orders: int = 3) -> DataFrame:
    """Rows (doc_id, n_words, n_features, weight), one for each row of `docs` (doc_id, text)."""
    sent, kind = docs.sparkSession.sparkContext.broadcast(gains), docs.schema["doc_id"].dataType.simpleString()

    def run(frames):
        gain = sent.value
        for frame in frames:
            texts = frame.column(1).to_pylist()
            n_words, n, weight = (np.zeros(len(texts), np.int64) for _ in range(3))
            for words, found in text_features(texts, orders):
                n_words += words
                for row, sums in found:
                    n += np.bincount(row, minlength=len(texts))
                    weight += np.bincount(row, weights=gain[sums % np.uint32(len(gain))], minlength=len(texts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([frame.column(0), pa.array(n_words), pa.array(n), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = 10_000, orders: int = 3) -> DataFrame:
    """Rows (doc_id, n_features, weight, score, rank, n_words), one for each row of `docs` (doc_id, text): rank is null where not drawn.

    Features are the runs of 1 to `orders` words of a text; a document's weight is the sum of its features' bucket gains, which
    compare `target` (text) with `docs`.  A Gumbel variate from a hash of seed and doc_id is added, and of the N documents with
    at least `least_words` words the floor(percent N / 100) of highest score are drawn, without replacement, ties to the smaller doc_id.

    Null and empty texts have no features, weight 0, and are never drawn; a null doc_id hashes as an empty one and comes first among ties;
    repeated rows are documents each, with neighbouring ranks; empty tables give no rows (an empty target: gains against even
    shares); other columns are ignored.

    Texts are read twice, in batches.  Only rows above a quantile just below the drawn share are sorted, in ranges.
    """
    gains = bucket_gains(bucket_counts(docs, buckets, orders), bucket_counts(target, buckets, orders), buckets)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(key, 1, 8), 16, 10).cast("double")
    luck = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = stage(weigh(docs, gains, orders).withColumn("score", F.col("weight") + luck))
    may = F.col("n_words") >= least_words
    n, cut = scored.where(may).agg(F.count("*"), F.percentile_approx("score", max(0.0, 1 - percent / 100 - 2 / ACCURACY), ACCURACY)).first()
    drawn = n * percent // 100
    none = F.lit(None).cast("bigint").alias("rank")
    columns = ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    if not drawn:
        return scored.select("*", none).select(columns)
    if scored.where(may & (F.col("score") >= cut)).count() < drawn:  # the quantile's error is bounded, so this is not met
        cut = scored.where(may).agg(F.min("score")).first()[0]
    top = may & (F.col("score") >= cut)
    ranked = number_rows(scored.where(top), [F.desc("score"), F.asc("doc_id"), F.desc("n_features"), F.desc("weight"), F.desc("n_words")])
    return (scored.where(~top).select("*", none).select(columns)
            .unionByName(ranked.withColumn("rank", F.when(F.col("seq") <= drawn, F.col("seq"))).select(columns)))
