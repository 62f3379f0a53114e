"""Token counts (operator 1): batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A lone space between two characters that are neither space nor the piece mark: no piece of the vocabulary spans it, and
#: the mark that the encoder puts before each text stands for the space that is left out.
_SAFE = re.compile(r"(?<=[^ ▁]) (?=[^ ▁])")


def safe_pieces(text: str, most: int) -> list[str]:
    """Cuts a long text at safe boundaries into parts of about `most` characters whose counts add up to the text's.

    A text without a safe boundary stays whole.
    """
    parts, start = [], 0
    while len(text) - start > most:
        cut = _SAFE.search(text, start + most - 1)
        if cut is None:
            break
        parts.append(text[start:cut.start()])
        start = cut.end()
    parts.append(text[start:] if start else text)
    return parts


def batches(texts: list[str], piece_chars: int, batch_bytes: int) -> Iterator[tuple[list[int], list[str]]]:
    """Groups of (row number, part of its text) of about equal bytes each."""
    rows, parts, held = [], [], 0
    for i, text in enumerate(texts):
        for part in safe_pieces(text, piece_chars):
            rows.append(i)
            parts.append(part)
            held += len(part.encode("utf-8", "surrogatepass"))
            if held >= batch_bytes:
                yield rows, parts
                rows, parts, held = [], [], 0
    if rows:
        yield rows, parts


@functools.lru_cache(maxsize=4)
def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def count_tokens(docs: DataFrame, model_path: str | None = None, limit: int = 4096, piece_chars: int = 1 << 15,
                 batch_bytes: int = 1 << 20) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit), one for each row of `docs` (doc_id, text).

    A null text counts as empty and has 0 tokens; repeated rows are counted each; other columns of `docs` are ignored; an
    empty table gives no rows.  Texts are encoded whole: long ones in parts whose counts add up exactly.  The model file is
    read by each worker, by default at the place of the installed vocabulary package.
    """
    kind = docs.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, n_bytes bigint, n_tokens bigint"

    def count(frames):
        path = model_path
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        model = _model(path)
        for frame in frames:
            texts = [t or "" for t in frame.column(1).to_pylist()]
            counts = [0] * len(texts)
            for rows, parts in batches(texts, piece_chars, batch_bytes):
                for row, ids in zip(rows, model.encode(parts, num_threads=1)):
                    counts[row] += len(ids)
            sizes = pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([frame.column(0), sizes, pa.array(counts, pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    return (docs.select("doc_id", "text").mapInArrow(count, schema)
            .withColumn("over_limit", F.col("n_tokens") > F.lit(limit)))
