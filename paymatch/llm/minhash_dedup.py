"""MinHash near-duplicates (operator 12): many universal hash minima, banding, signature verification, full sets, star components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paymatch.llm import sketches
from paymatch.llm.star_components import star_components
from paymatch.llm.words import gram_hashes, mix, signed, space_words
from paymatch.plans.runtime import stage

BANDS, ROWS = 40, 4  # at a similarity of 0.8 no band agrees with a probability of 7e-10
SLACK = 0.2  # of the estimate below the threshold: more than six standard deviations of 160 minima
PART = 2048  # sets of a bucket (or with one leader) in one task, about
MEMBERS = 1 << 22  # members of the sets of one part, about
_CELLS = 1 << 14  # shingles hashed at a time
_SEEN = 1 << 16

_RNG = np.random.Generator(np.random.PCG64(20))
_MULTIPLY = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a shorter text is one, a text without words none."""
    words = space_words(text, lower=True)
    return np.unique(gram_hashes(words, min(size, len(words)))) if words else np.empty(0, np.uint64)


def digest(members: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(members.tobytes()) - (1 << 63)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """For each non-empty set the minima of all hash functions x -> a x + b, of which the upper 32 bits count."""
    out = np.full((len(_ADD), len(sets)), np.iinfo(np.uint64).max, np.uint64)
    ends = np.cumsum([len(s) for s in sets])
    flat = mix(np.concatenate(sets)) if sets else np.empty(0, np.uint64)
    for at in range(0, len(flat), _CELLS):
        x = flat[at:at + _CELLS]
        first, last = np.searchsorted(ends, [at, at + len(x) - 1], side="right")
        cuts = np.maximum(np.append(0, ends[first:last]) - at, 0)
        least = np.minimum.reduceat(_MULTIPLY[:, None] * x + _ADD[:, None], cuts, axis=1)
        out[:, first:last + 1] = np.minimum(out[:, first:last + 1], least)
    return (out >> np.uint64(32)).astype(np.uint32).T.copy()


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key for each row and band."""
    key = np.zeros((len(signatures), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + signatures[:, k::ROWS].astype(np.uint64))
    return key


class Rule:
    """Two sets link when den * intersection >= num * union, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.least_equal = int(len(_ADD) * max(0.0, num / den - SLACK))

    def sizes(self, a, b):
        return self.den * np.minimum(a, b) >= self.num * np.maximum(a, b)

    def links(self, shared, a, b):
        return self.den * shared >= self.num * (a + b - shared)


def _sketch(size: int, kind):
    """Digest, size and signature of each document; copies of a set met before in the task come without a signature."""
    def run(frames):
        seen: set[int] = set()
        for frame in frames:
            sets = [shingle_set(text.as_py(), size) for text in frame.column(1)]
            cls = [digest(s) if len(s) else None for s in sets]
            new = {}
            for row, c in enumerate(cls):
                if c is not None and c not in seen:
                    new.setdefault(c, row)
            seen = (seen if len(seen) < _SEEN else set()) | new.keys()
            rows = sorted(new.values())
            signatures: list = [None] * len(sets)
            for row, signature in zip(rows, minima([sets[r] for r in rows])):
                signatures[row] = signature.tobytes()
            yield pa.RecordBatch.from_arrays([frame.column(0), pa.array(cls, pa.int64()), pa.array([len(s) for s in sets], pa.int32()),
                                              pa.array(signatures, pa.binary())], names=["doc_id", "cls", "n", "sig"])
    return run


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, BANDS * ROWS)


def _banded(frames):
    for frame in frames:
        keys = band_keys(_signatures(frame.column(1)))
        yield pa.RecordBatch.from_arrays([pa.array(signed(keys.ravel())), pa.array(np.tile(np.arange(BANDS, dtype=np.int8), len(keys))),
                                          pa.array(np.repeat(frame.column(0).to_numpy(), BANDS))], names=["key", "band", "cls"])


def _estimated(rule: Rule):
    """Pairs whose sizes and signatures leave a link possible."""
    def run(frames):
        for frame in frames:
            a, b = (_signatures(frame.column(c)) for c in ("sig_a", "sig_b"))
            good = (a == b).sum(axis=1) >= rule.least_equal
            good &= rule.sizes(*(frame.column(c).to_numpy().astype(np.int64) for c in ("n_a", "n_b")))
            yield frame.filter(pa.array(good)).select(["a", "b"])
    return run


def _wanted_sets(size: int, sent_ids, sent_cls):
    """(cls, members) of the documents whose hashed id, and then whose set, may be wanted."""
    def run(frames):
        for frame in frames:
            keep = sketches.member(sent_ids.value, frame.column(1).to_numpy().view(np.uint64))
            cls, sets = [], []
            for text in frame.column(0).filter(pa.array(keep)):
                members = shingle_set(text.as_py(), size)
                if len(members):
                    c = digest(members)
                    if sketches.member(sent_cls.value, np.array([c], np.int64).view(np.uint64))[0]:
                        cls.append(c), sets.append(members.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(sets, pa.binary())], names=["cls", "members"])
    return run


def shared_with(members: np.ndarray, other: np.ndarray) -> int:
    """How many members two sorted sets share."""
    short, long = (members, other) if len(members) < len(other) else (other, members)
    return int((long[np.minimum(np.searchsorted(long, short), len(long) - 1)] == short).sum())


def _with_leader(rule: Rule):
    """Links of leaders: rows come sorted by (leader, part), the leader's own set first."""
    def run(frames):
        group, leader = None, None
        for frame in frames:
            out = []
            for a, part, b, members in zip(*(frame.column(c).to_pylist() for c in ("a", "part", "b", "members"))):
                members = np.frombuffer(members, np.uint64)
                if a == b:
                    group, leader = (a, part), members
                elif (a, part) == group and rule.links(shared_with(leader, members), len(leader), len(members)):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
    return run


def possible_pairs(sig: np.ndarray, n: np.ndarray, label: np.ndarray, side: np.ndarray | None, band: int, rule: Rule):
    """Pairs of a bucket that are in different components, that signatures leave possible and that no earlier band has.

    With `side` only pairs of one row from each side count.
    """
    found = []
    for i in range(len(n) - 1):
        j = np.arange(i + 1, len(n))
        keep = (label[j] != label[i]) & rule.sizes(n[j], n[i])
        if side is not None:
            keep &= side[j] != side[i]
        j = j[keep]
        equal = sig[j] == sig[i]
        close = equal.sum(axis=1) >= rule.least_equal
        j, equal = j[close], equal[close]
        first = equal.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) if len(j) else j
        j = j[first == band]
        found.append(np.stack((np.full(len(j), i), j)))
    return np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)


def _buckets(frames, names):
    """(key of the part, columns) of rows sorted by (key, part, other)."""
    block, rows = None, []
    for frame in frames:
        for key, row in zip(zip(*(frame.column(c).to_pylist() for c in ("key", "part", "other"))), zip(*(frame.column(c).to_pylist() for c in names))):
            if key != block:
                if len(rows) > 1:
                    yield block, [list(c) for c in zip(*rows)]
                block, rows = key, []
            rows.append(row)
    if len(rows) > 1:
        yield block, [list(c) for c in zip(*rows)]


def _pairs_of(block, band, n, label, side, sig, rule: Rule):
    return possible_pairs(np.stack([np.frombuffer(s, np.uint32) for s in sig]), np.array(n, np.int64), np.array(label, np.int64),
                          np.array(side, bool) if block[1] != block[2] else None, band[0], rule)


_ROW = ("band", "n", "label", "side", "sig")


def _involved(rule: Rule):
    """The rows of open buckets that some possible pair needs."""
    def run(frames):
        for block, (cls, *rest) in _buckets(frames, ("cls", *_ROW)):
            ends = np.unique(_pairs_of(block, *rest, rule)).astype(np.int64)
            if len(ends):
                yield pa.RecordBatch.from_arrays([*(pa.array([block[k]] * len(ends), t) for k, t in ((0, pa.int64()), (1, pa.int32()), (2, pa.int32()))),
                                                  pa.array([cls[e] for e in ends], pa.int64())], names=["key", "part", "other", "cls"])
    return run


def _linked(rule: Rule):
    """Links between components of a bucket, by full sets; a pair already connected in the bucket is not compared."""
    def run(frames):
        for block, (cls, members, *rest) in _buckets(frames, ("cls", "members", *_ROW)):
            sets = [np.frombuffer(m, np.uint64) for m in members]
            root = {x: x for x in rest[2]}

            def top(x):
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            label, out = rest[2], []
            for i, j in _pairs_of(block, *rest, rule).T.tolist():
                x, y = top(label[i]), top(label[j])
                if x != y and rule.links(shared_with(sets[i], sets[j]), len(sets[i]), len(sets[j])):
                    root[x] = y
                    out.append((cls[i], cls[j]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
    return run


def link_sets(docs: DataFrame, size: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, classes, links): rows (doc_id, cls, n) of all documents, (cls, rep, n, sig) of all distinct non-empty sets,
    and links (a, b) between classes that connect what all links connect."""
    spark, rule = docs.sparkSession, Rule(num, den)
    send = spark.sparkContext.broadcast
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = stage(docs.mapInArrow(_sketch(size, kind), f"doc_id {kind}, cls bigint, n int, sig binary"))
    classes = stage(rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.max("sig").alias("sig")))

    # Buckets of two sets or more; the leader of one is the set with the most company in all its buckets, as an original among its copies.
    banded = classes.select("cls", "sig").mapInArrow(_banded, "key bigint, band tinyint, cls bigint")
    held = banded.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    shared = stage(banded.join(held, "key"))
    company = stage(shared.groupBy("cls").agg(F.sum("held").alias("company")))
    ranked = shared.join(company, "cls")
    leaders = stage(ranked.groupBy("key").agg(F.max(F.struct("company", "cls")).alias("x")).select("key", F.col("x.cls").alias("a")))
    star = stage(shared.join(leaders, "key").where("cls <> a").select("a", F.col("cls").alias("b")).distinct())

    side = lambda x: classes.select(F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    near = stage(star.join(side("a"), "a").join(side("b"), "b").mapInArrow(_estimated(rule), "a bigint, b bigint"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        ids = stage(classes.join(wanted, "cls").select("cls", F.xxhash64("rep").alias("id_hash")))
        found = docs.select("text", F.xxhash64("doc_id").alias("id_hash")).mapInArrow(
            _wanted_sets(size, send(sketches.bitmap(ids, "id_hash")), send(sketches.bitmap(ids, "cls"))), "cls bigint, members binary")
        return stage(found.join(wanted, "cls", "left_semi").dropDuplicates(["cls"]))

    sets = sets_of(near.select(F.col("a").alias("cls")).union(near.select("b")).distinct())
    held_by = F.greatest(F.count("*") / PART, F.sum(F.col("n").cast("long")) / MEMBERS)
    parts = near.join(classes.select(F.col("cls").alias("b"), "n"), "b").groupBy("a").agg(F.ceil(held_by).cast("int").alias("parts"))
    dealt = (near.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"))
             .union(parts.select("a", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))))
    links = stage(dealt.join(sets.withColumnRenamed("cls", "b"), "b").repartition("a", "part")
                  .sortWithinPartitions("a", "part", F.col("a") != F.col("b")).mapInArrow(_with_leader(rule), "a bigint, b bigint"))

    # What shares a bucket and is not yet in one component.
    labels = star_components(links)
    named = stage(shared.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("key", "band", "cls", F.coalesce("label", "cls").alias("label"))
                  .join(classes.select("cls", "n"), "cls"))
    open_ = (named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.ceil(held_by).cast("int").alias("parts"))
             .where("lo <> hi").select("key", "parts").join(leaders, "key"))
    mine = F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")
    split = stage(named.join(open_, "key").where("cls <> a").withColumn("mine", mine).withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
                  .select("key", F.least("mine", "theirs").alias("part"), F.greatest("mine", "theirs").alias("other"), "cls", "band", "n", "label",
                          (F.col("mine") < F.col("theirs")).alias("side")))

    def by_part(df: DataFrame) -> DataFrame:
        return df.repartition("key", "part", "other").sortWithinPartitions("key", "part", "other")

    signed_rows = split.join(classes.select("cls", "sig"), "cls")
    ends = stage(by_part(signed_rows).mapInArrow(_involved(rule), "key bigint, part int, other int, cls bigint"))
    more = sets_of(ends.select("cls").distinct())
    rest = stage(by_part(signed_rows.join(ends, ["key", "part", "other", "cls"]).join(more, "cls")).mapInArrow(_linked(rule), "a bigint, b bigint"))
    return rows.select("doc_id", "cls", "n"), classes, links.union(rest)


def near_duplicates(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each row of `docs` (doc_id, text).

    Two documents link when den * |A & B| >= num * |A | B| over the sets of their distinct word shingles of `size` words (A-Z as
    a-z; a text with fewer words is one shingle).  component_id is the smallest doc_id reachable over links, itself included;
    kept tells whether it is the document's own.

    Documents without words (null text included) link with nothing and are kept; repeated rows are copies of one another; null
    doc_ids lose against any other; an empty table gives no rows; other columns are ignored.  Sets are told apart by 64-bit
    digests of 64-bit shingle hashes.

    Each distinct set has 160 minima of universal hash functions, in 40 bands of four; a link of the default similarity agrees
    in no band with a probability of 7e-10.  The sets of a bucket are compared with its leader first: by signatures, then by full
    sets.  Large-star and small-star steps give the components, and what shares a bucket but not a component is compared
    inside the bucket the same way, a bucket over `PART` sets in parts, two by two.  No pairs of a bucket are written out.
    """
    rows, classes, links = link_sets(docs, size, num, den)
    labels = star_components(links)
    named = stage(classes.select("cls", "rep").join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "rep", F.coalesce("label", "cls").alias("label")))
    least = named.groupBy("label").agg(F.min("rep").alias("component"))
    known = stage(named.join(least, "label").select("cls", "component"))
    return rows.join(known, "cls", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
                                                  ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
