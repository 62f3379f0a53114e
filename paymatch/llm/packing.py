"""Packing (operator 8): non-negative least squares over shallow length combinations, then greedy filling of what is left."""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_SPECIAL = "<|endoftext|>"  # fixed value: the one special token of the vocabulary
_SPECIAL_ID = 50256
_LONG_SPACE = re.compile(r"\s{2000}")  # runs that the rank encoder's pattern cannot match; the tokenizer file is used for them


@functools.lru_cache(maxsize=2)
def _encoder(path: str):
    """The byte-level vocabulary as ranks: the same ids as the tokenizer file, several times faster."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=1)
def _tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def encode(text: str, path: str) -> np.ndarray:
    """Ids of a whole text; the special string in a text is its own id, as by the tokenizer's default."""
    if len(text) >= 2000 and _LONG_SPACE.search(text):
        return np.array(_tokenizer().encode(text, add_special_tokens=False).ids, dtype="<u4")
    encoder, parts = _encoder(path), []
    for i, part in enumerate(text.split(_SPECIAL)):
        if i:
            parts.append([_SPECIAL_ID])
        parts.append(encoder.encode_ordinary(part))
    return np.array([x for part in parts for x in part] if len(parts) > 1 else parts[0], dtype="<u4")


@functools.lru_cache(maxsize=4)
def combinations(bins: int, depth: int) -> np.ndarray:
    """Columns: how often each size 1..bins occurs in a multiset of at most `depth` sizes that adds up to `bins`."""
    found: list[tuple[int, ...]] = []

    def extend(chosen: tuple[int, ...], left: int) -> None:
        if left == 0:
            found.append(chosen)
        elif len(chosen) < depth:
            for size in range(min(left, chosen[-1] if chosen else bins), 0, -1):
                if size * (depth - len(chosen)) < left:
                    break
                extend((*chosen, size), left - size)

    extend((), bins)
    out = np.zeros((bins, len(found)))
    for j, sizes in enumerate(found):
        for size in sizes:
            out[size - 1, j] += 1
    return out


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, steps: int = 300) -> np.ndarray:
    """x >= 0 that nearly minimizes |ax - b|, for a and b without negative entries, by multiplicative steps."""
    x = np.full(a.shape[1], b.sum() / max(a.sum(), 1.0) + 1e-9)
    top = a.T @ b
    for _ in range(steps):
        x *= top / (a.T @ (a @ x) + 1e-9)
    return x


def plan(lengths: np.ndarray, window: int, bins: int = 64, depth: int = 4) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (piece, from, to) that hold every token of the pieces (each shorter than `window`) once.

    All sequences hold `window` tokens, but for the last few, whose sizes are the powers of two of what remains.
    """
    bins = min(bins, window)
    size = -(-lengths * bins // window)
    shelves: list[list[int]] = [[] for _ in range(bins + 1)]
    for i in np.argsort(lengths, kind="stable"):
        shelves[size[i]].append(int(i))
    a = combinations(bins, depth)
    repeats = np.floor(nonnegative_least_squares(a, np.bincount(size, minlength=bins + 1)[1:].astype(float)))
    rows: list[list[tuple[int, int, int]]] = []
    for j in np.argsort(-repeats, kind="stable"):
        if repeats[j] < 1:
            break
        need = [(s + 1, int(a[s, j])) for s in np.flatnonzero(a[:, j])]
        for _ in range(min(int(repeats[j]), *(len(shelves[s]) // m for s, m in need))):
            rows.append([(i, 0, int(lengths[i])) for s, m in need for i in (shelves[s].pop() for _ in range(m))])
    rest = [(i, 0, int(lengths[i])) for shelf in shelves for i in shelf]  # popped from the end: long ones first
    done: list[list[tuple[int, int, int]]] = []
    rows.sort(key=lambda row: sum(e - s for _, s, e in row))
    while rows:  # the fullest first; when nothing is left to fill with, the emptiest are opened again
        row = rows.pop()
        space = window - sum(e - s for _, s, e in row)
        while space:
            if not rest:
                if not rows:
                    break
                rest.extend(rows.pop(0))
            piece, start, end = rest.pop()
            take = min(space, end - start)
            row.append((piece, start, start + take))
            if start + take < end:
                rest.append((piece, start + take, end))
            space -= take
        if space:
            rest.extend(row)
        else:
            done.append(row)
    left = sum(e - s for _, s, e in rest)
    while left:
        space = size = window if left >= window else 1 << (left.bit_length() - 1)
        row = []
        while space:
            piece, start, end = rest.pop()
            take = min(space, end - start)
            row.append((piece, start, start + take))
            if start + take < end:
                rest.append((piece, start + take, end))
            space -= take
        done.append(row)
        left -= size
    return done


SCHEMA = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, window: int = 2048, end_id: int = 1, block_tokens: int = 1 << 22,
         ranks_path: str | None = None) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of the documents' token sequences.

    Every row of `docs` (doc_id, text) is one document: its ids, then `end_id`; a null text is empty, repeated rows are
    packed each, an empty table gives no pieces, other columns are ignored.  Each task cuts whole windows off its documents
    and packs the remainders in blocks of about `block_tokens` tokens: combinations of up to four remainders that fill a
    window are enumerated over 64 sizes, how often each is used is the rounded non-negative least squares solution against
    the block's histogram, and what is left fills the gaps, cut where needed.  No sequence needs padding: the last tokens of
    a block go to sequences whose sizes are powers of two.  A sequence number holds the partition's number in its upper
    bits, so the input must be a table whose partitions a repeated task reads alike (files, a written stage).
    """
    kind = docs.schema["doc_id"].dataType

    def run(frames):
        from pyspark import TaskContext

        path = ranks_path
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.tiktoken")
        sequence = TaskContext.get().partitionId() << 36
        pool: list[tuple[object, int, int, np.ndarray]] = []  # doc_id, tokens before, doc's tokens, ids
        held, out = 0, []

        def piece(doc, start, ids, total, number, offset):
            out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, number, offset))

        def close():
            nonlocal sequence, pool, held
            for row in plan(np.array([len(p[3]) for p in pool], dtype=np.int64), window) if pool else ():
                offset = 0
                for i, start, end in row:
                    doc, before, total, ids = pool[i]
                    piece(doc, before + start, ids[start:end], total, sequence, offset)
                    offset += end - start
                sequence += 1
            pool, held = [], 0

        def flush():
            nonlocal out
            columns = list(zip(*out))
            out = []
            return pa.RecordBatch.from_arrays([pa.array(columns[0], doc_type), *(pa.array(c, pa.int64()) for c in columns[1:])],
                                              names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        doc_type = None
        for frame in frames:
            doc_type = frame.schema.field(0).type
            for doc, text in zip(frame.column(0).to_pylist(), frame.column(1)):
                ids = np.append(encode(text.as_py() or "", path), np.array([end_id], dtype="<u4"))
                total, whole = len(ids), len(ids) // window * window
                for start in range(0, whole, window):
                    piece(doc, start, ids[start:start + window], total, sequence, 0)
                    sequence += 1
                if whole < total:
                    pool.append((doc, whole, total, ids[whole:].copy()))
                    held += total - whole
                if held >= block_tokens:
                    close()
                if len(out) >= 20_000:
                    yield flush()
        close()
        if out:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, {SCHEMA}")
