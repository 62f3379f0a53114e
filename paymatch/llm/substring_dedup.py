"""Substring dedup (operator 9): winnowed anchors meet across the corpus, and only where they do, matches are extended."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paymatch.llm.words import gram_hashes, mix, signed, space_words, winnow
from paymatch.plans.runtime import stage

_CHUNK = 1 << 20
_MET = "bucket int, th binary, start binary"
_ROW = f"hashes binary, {_MET}"
_NAMES = ["hashes", "bucket", "th", "start"]


def _cut(key: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by bucket of a 64-bit key, and (bucket, from, to) of those that occur."""
    bucket = (mix(key) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    values, first = np.unique(bucket[order], return_index=True)
    return order, list(zip(values.tolist(), first.tolist(), [*first[1:].tolist(), len(key)]))


def _places(th: np.ndarray, start: np.ndarray, buckets: int, known: bool):
    """Places as one row for each bucket of texts; a place that is known to recur has a negative bucket."""
    order, cuts = _cut(th.view(np.uint64), buckets)
    th, start = th[order], start[order].astype(np.int32)
    columns = [pa.array([-1 - c if known else c for c, _, _ in cuts], pa.int32()), *(pa.array([x[i:j].tobytes() for _, i, j in cuts], pa.binary()) for x in (th, start))]
    return pa.RecordBatch.from_arrays(([pa.nulls(len(cuts), pa.binary())] if known else []) + columns, names=_NAMES[0 if known else 1:])


class _Chunk:
    """Hashes of some texts.  A hash that occurs twice here is settled here for all its places; every hash leaves once."""

    def __init__(self, buckets: int):
        self.buckets, self.seen, self.parts, self.count = buckets, set(), [], 0

    def add(self, th: int, starts: np.ndarray, hashes: np.ndarray) -> None:
        self.seen.add(th)
        if len(starts):
            self.parts.append((hashes, np.full(len(starts), th, np.int64), starts.astype(np.int32)))
            self.count += len(starts)

    def flush(self):
        hashes, th, start = (np.concatenate(c) for c in zip(*self.parts))
        self.__init__(self.buckets)
        order = np.argsort(hashes, kind="stable")
        hashes, th, start = hashes[order], th[order], start[order]
        same = hashes[1:] == hashes[:-1]
        head, many = np.append(True, ~same), np.append(same, False) | np.append(False, same)
        out = np.where(many, -1 - start, start)[head]  # a negative start: settled for this text, and known to recur
        columns = hashes[head], th[head], out.astype(np.int32)
        order, cuts = _cut(columns[0], self.buckets)
        columns = [x[order] for x in columns]
        blobs = [pa.array([x[i:j].tobytes() for _, i, j in cuts], pa.binary()) for x in columns]
        yield pa.RecordBatch.from_arrays([blobs[0], pa.array([c for c, _, _ in cuts], pa.int32()), *blobs[1:]], names=_NAMES)
        if many.any():
            yield _places(th[many], start[many], self.buckets, known=True)


def _hashed(places, buckets: int):
    """Rows of `places(text, extra column) -> (starts, hashes)`, chunk by chunk; a text occurs once in a chunk."""
    def run(frames):
        chunk = _Chunk(buckets)
        for frame in frames:
            extra = frame.column(2) if frame.num_columns > 2 else [None] * frame.num_rows
            for th, text, more in zip(frame.column(0).to_pylist(), frame.column(1), extra):
                if th in chunk.seen:
                    continue
                chunk.add(th, *places(text.as_py(), more))
                if chunk.count >= _CHUNK:
                    yield from chunk.flush()
        if chunk.parts:
            yield from chunk.flush()
    return run


def _blobs(column, kind):
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in column])


def _meet(buckets: int):
    """The places whose hash occurs at two places; all rows of a bucket of hashes are in one partition."""
    def run(frames):
        parts = []
        for frame in frames:
            known = pa.compute.is_null(frame.column(0))
            rows = frame.filter(known)
            if rows.num_rows:
                back = pa.compute.subtract(pa.scalar(-1, pa.int32()), rows.column(1))
                yield pa.RecordBatch.from_arrays([back, rows.column(2), rows.column(3)], names=_NAMES[1:])
            rows = frame.filter(pa.compute.invert(known))
            if rows.num_rows:
                parts.append((_blobs(rows.column(0), np.uint64), _blobs(rows.column(2), np.int64), _blobs(rows.column(3), np.int32)))
        if not parts:
            return
        hashes, th, start = (np.concatenate(c) for c in zip(*parts))
        place = th.view(np.uint64) ^ mix(np.where(start < 0, -1 - start, start).astype(np.uint64))
        order = np.lexsort((place, hashes))
        hashes, th, start, place = hashes[order], th[order], start[order], place[order]
        first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        last = np.append(first[1:], len(hashes)) - 1
        again = (place[first] != place[last]) | (np.minimum.reduceat(start, first) < 0)
        keep = np.repeat(again, last - first + 1) & (start >= 0)
        if keep.any():
            yield _places(th[keep], start[keep], buckets, known=False)
    return run


def _gather(frames):
    """(th, starts), one row a text; all rows of a bucket of texts are in one partition."""
    parts = [(_blobs(f.column(1), np.int64), _blobs(f.column(2), np.int32)) for f in frames if f.num_rows]
    if not parts:
        return
    th, start = (np.concatenate(c) for c in zip(*parts))
    order = np.argsort(th, kind="stable")
    th, start = th[order], start[order]
    first = np.flatnonzero(np.append(True, th[1:] != th[:-1]))
    for at in range(0, len(first), 10_000):
        some = first[at:at + 10_001]
        ends = some[1:] if len(some) > 10_000 else np.append(some[1:], len(th))
        some = some[:10_000]
        lists = pa.ListArray.from_arrays(pa.array(np.append(some, ends[-1]) - some[0], pa.int32()), pa.array(start[some[0]:ends[-1]], pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(th[some]), lists], names=["th", "starts"])


def recurring(texts: DataFrame, places) -> DataFrame:
    """Staged rows (th, starts): the places of each text whose hash also occurs at another place, anywhere.

    Hashes and places travel as packed arrays, one row for each task and bucket, which costs far less than a row each.
    """
    buckets = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.mapInArrow(_hashed(places, 2 * buckets), _ROW)
    met = rows.repartition("bucket").mapInArrow(_meet(2 * buckets), _MET)
    return stage(met.repartition("bucket").mapInArrow(_gather, "th bigint, starts array<int>"))


def _anchors(window: int, gram: int):
    def places(text, _):
        words = space_words(text)
        hashes = gram_hashes(words, gram)
        at = np.unique(winnow(hashes, window - gram + 1))
        return at, hashes[at]
    return places


def _windows(window: int, gram: int):
    """The windows whose anchor recurs: a window recurs only if the anchor inside it does."""
    def places(text, anchors):
        words = space_words(text)
        anchor = winnow(gram_hashes(words, gram), window - gram + 1)
        marked = np.zeros(len(words) + 1, bool)
        marked[anchors.values.to_numpy()] = True
        starts = np.flatnonzero(marked[anchor])
        return starts, gram_hashes(words, window)[starts]
    return places


def _kept(window: int):
    def run(frames):
        for frame in frames:
            n_words, n_removed, n_spans, digest = [], [], [], []
            for text, starts, copied in zip(frame.column(1), frame.column(2), frame.column(3).to_pylist()):
                words = space_words(text.as_py())
                change = np.zeros(len(words) + 1, np.int64)
                if copied and len(words) >= window:
                    change[0] += 1
                elif starts.is_valid and len(starts):
                    at = np.unique(starts.values.to_numpy())
                    np.add.at(change, at, 1)
                    np.add.at(change, at + window, -1)
                gone = np.cumsum(change[:-1]) > 0
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                n_spans.append(int((gone & ~np.append(False, gone[:-1])).sum()) if len(gone) else 0)
                rest = [w for w, g in zip(words, gone.tolist()) if not g] if n_removed[-1] else words
                digest.append(hashlib.sha256(b" ".join(rest)).hexdigest())
            yield pa.RecordBatch.from_arrays([frame.column(0), *(pa.array(c, pa.int64()) for c in (n_words, n_removed, n_spans)), pa.array(digest, pa.string())],
                                             names=["doc_id", "n_words", "n_removed", "n_spans", "kept_sha256"])
    return run


def dedup_substrings(docs: DataFrame, window: int = 35, gram: int = 10) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, n_spans, kept_sha256), one for each row of `docs` (doc_id, text).

    A word goes if a window of `window` words of its document that covers it also starts anywhere else: in another document or
    at another place of the same one.  n_spans counts the maximal runs of removed words.  A null text has no words; rows with
    equal texts are copies of each other and lose all words if they have `window` or more; repeated rows count as copies; an
    empty table gives no rows; other columns are ignored.

    Each window keeps the leftmost smallest hash of its word `gram`-grams as anchor, so equal windows have equal anchors.  The
    anchors of all texts meet first; only around anchors that occur twice are matches extended to whole windows, which then
    meet in the same way.  A hash that a task sees several times is settled there and leaves the task once, so common passages
    do not pile up in one partition.  Texts are told apart, and windows compared, by 64-bit hashes.
    """
    docs = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    anchors = recurring(docs.select("th", "text"), _anchors(window, gram))
    near = docs.join(anchors.withColumnRenamed("th", "_th"), F.col("th") == F.col("_th")).select("th", "text", "starts")
    places = recurring(near, _windows(window, gram))
    copies = docs.groupBy("th").count().where("count > 1").select("th", F.array().cast("array<int>").alias("starts"), F.lit(True).alias("copied"))
    marks = stage(places.withColumn("copied", F.lit(False)).unionByName(copies)
                  .groupBy("th").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.max("copied").alias("copied")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return (docs.join(marks, "th", "left").select("doc_id", "text", "starts", "copied")
            .mapInArrow(_kept(window), f"doc_id {kind}, n_words bigint, n_removed bigint, n_spans bigint, kept_sha256 string"))
