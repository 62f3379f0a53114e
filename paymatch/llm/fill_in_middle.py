"""Fill-in-middle transformation (operator 13): cut ranks found in an indexable skip list, pieces put in a new order."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN = 16  # links of a lane that one link of the next lane spans
SLICE_BYTES = 2 << 20  # of a batch that are transformed at a time
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class SkipList:
    """The units of a text in order, with express lanes above them.

    Lane 0 has a link for every unit; a link of a higher lane spans `FAN` links of the lane below.  Every link carries how
    many units and how many code points it passes, so that a walk down the lanes adds both up and reaches any rank exactly.
    """

    def __init__(self, points: np.ndarray):
        """`points`: code points of each unit, in order."""
        self.lanes = [(np.ones(len(points), np.int64), points)]
        while len(self.lanes[-1][0]) > FAN:
            starts = np.arange(0, len(self.lanes[-1][0]), FAN)
            self.lanes.append(tuple(np.add.reduceat(width, starts) for width in self.lanes[-1]))

    def offset(self, rank: int) -> int:
        """Code points before unit `rank` (or all, for a rank of as many units as there are)."""
        passed, at, link = 0, 0, 0
        for units, points in reversed(self.lanes):
            while link < len(units) and passed + units[link] <= rank:
                passed += int(units[link])
                at += int(points[link])
                link += 1
            link *= FAN  # the first link below that this lane has not passed
        return at


def unit_points(text: str, unit: str | None) -> np.ndarray:
    """Code points of each unit of a text: single code points, or the matches of `unit` from left to right, each with what
    separates it from the next (before the first: a unit of its own)."""
    if unit is None:
        return np.ones(len(text), np.int64)
    starts = [m.start() for m in re.finditer(unit, text) if m.end() > m.start()]
    edges = np.unique([0, *starts, len(text)])
    return np.diff(edges)


def split(text: str, points: np.ndarray, first: int, second: int) -> tuple[str, str, str]:
    """Prefix, middle and suffix of a text of units: the numbers taken modulo the units and one more are the ranks of the two cuts."""
    lo, hi = sorted((first % (len(points) + 1), second % (len(points) + 1)))
    lanes = SkipList(points)
    a, b = lanes.offset(lo), lanes.offset(hi)
    return text[:a], text[a:b], text[b:]


def arrange(form: str, text: str, prefix: str, middle: str, suffix: str) -> str:
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    if form == "spm":
        return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return text


def restore(form: Column, output: Column) -> Column:
    """The text that an output was made of.  Marks are found as first of their kind: a transformed text holds none, and no
    mark can begin in a piece and end in the next mark."""
    def parted(text: Column, mark: str) -> tuple[Column, Column]:
        """What stands before the first `mark` and what stands after it (no mark: all and nothing)."""
        before = F.substring_index(text, mark, 1)
        return before, F.substr(text, F.length(before) + F.lit(len(mark) + 1))

    front, middle = parted(output, MIDDLE)
    prefix, suffix = parted(F.substr(front, F.lit(len(PREFIX) + 1)), SUFFIX)
    last, first = parted(F.substr(front, F.lit(len(SUFFIX) + 1)), PREFIX)
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix)).otherwise(F.concat(first, middle, last))


def slices(frame: pa.RecordBatch) -> list[pa.RecordBatch]:
    """A batch in slices of some `SLICE_BYTES`, none of no rows; a longer row stands alone."""
    rows = max(1, frame.num_rows * SLICE_BYTES // max(frame.nbytes, 1))
    return [frame.slice(at, rows) for at in range(0, frame.num_rows, rows)]


def transform(docs: DataFrame, plain_percent: int = 10, spm_percent: int = 20, seed: int = 1, unit: str | None = None) -> DataFrame:
    """Rows (doc_id, form, output, n, prefix_chars, middle_chars), one for each row of `docs` (doc_id, text).

    A hash of seed and doc_id gives four numbers: the ranks of the two cuts (taken modulo the number n of units and one more),
    whether the text stays plain and which of the two orders it takes.  Texts that are empty or null or hold a mark stay
    plain, and then prefix_chars and middle_chars are null.  Units are code points, or the matches of the pattern `unit`.

    A null doc_id hashes as an empty one; repeated rows give the same output each; an empty table gives no rows; other columns are ignored.
    Rows are independent: nothing is shuffled, and memory is that of a batch and of one slice's texts and outputs.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring("_digest", 8 * k + 1, 8), 16, 10).cast("bigint").alias(f"h{k + 1}") for k in range(4)]

    def run(frames):
        for frame in (part for whole in frames for part in slices(whole)):
            out = []
            for text, *h in zip(*(frame.column(k).to_pylist() for k in range(1, 6))):
                text, form = text or "", "psm"
                points = unit_points(text, unit)
                if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= 100 - plain_percent:
                    form = "plain"
                elif h[3] % 100 < spm_percent:
                    form = "spm"
                if form == "plain":
                    out.append((form, text, len(points), None, None))
                    continue
                prefix, middle, suffix = split(text, points, h[0], h[1])
                out.append((form, arrange(form, text, prefix, middle, suffix), len(points), len(prefix), len(middle)))
            form, output, n, prefix, middle = zip(*out) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [frame.column(0), pa.array(form, pa.string()), pa.array(output, pa.string()), *(pa.array(x, pa.int64()) for x in (n, prefix, middle))],
                names=["doc_id", "form", "output", "n", "prefix_chars", "middle_chars"])

    return (docs.select("doc_id", "text", digest.alias("_digest")).select("doc_id", "text", *numbers)
            .mapInArrow(run, f"doc_id {kind}, form string, output string, n bigint, prefix_chars bigint, middle_chars bigint"))


def with_restored(transformed: DataFrame) -> DataFrame:
    """Adds `restored`, the text rebuilt from `form` and `output` alone; all other columns stay."""
    return transformed.withColumn("restored", restore(F.col("form"), F.col("output")))


def digests(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of `transform`."""
    return with_restored(transform(docs)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                                                 F.sha2("restored", 256).alias("restored_sha256"))
