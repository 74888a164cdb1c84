"""Packing by power-of-two decomposition (operator 9).

A document's token stream is cut into pieces whose lengths are powers of two, at most ``max_length``: as many
full pieces as fit, then the binary digits of the rest, longest first.  Every piece is a training sequence of
its own, so no sequence crosses documents and none is padded; sequences of equal length form a bucket.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.llm import kernels
from codeweft.llm.encoding import WordEncoder

MAX_LENGTH = 2048
END_ID = 1


def decompose(n: int, max_length: int = MAX_LENGTH) -> list[int]:
    """Lengths of the pieces of a stream of ``n`` tokens."""
    out = [max_length] * (n // max_length)
    rest = n % max_length
    return out + [1 << k for k in range(max_length.bit_length() - 1, -1, -1) if rest >> k & 1]


_PIECE = "start long, length long, ids array<int>, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

def pack(docs: DataFrame, tokenizer: str, *, max_length: int = MAX_LENGTH, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece of every document: its place in the document, its ids, and its sequence.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  A null or empty text has the end id
    only.  Repeated rows are packed once each.  ``sequence_id`` is the task's number and a running count, so a
    task that is run again after a loss numbers its pieces as before.  An empty table gives no rows.
    ``max_length`` must be a power of two.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    names = [x for x in ("start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset") if with_ids or x != "ids"]
    source = docs.select(F.col("doc_id"), F.col("text"))
    key = source.schema["doc_id"].dataType.simpleString()
    spec = f"doc_id {key}, " + (_PIECE if with_ids else _PIECE.replace("ids array<int>, ", ""))

    @kernels.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.cached(tokenizer)
        end = np.array([end_id], np.uint32)
        sequence = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in kernels.slices(batch.column("text")):
                ids, offsets = encoder.encode(part)
                totals = np.diff(offsets) + 1
                ids = np.insert(ids, offsets[1:], end)
                lengths = [decompose(int(n), max_length) for n in totals]
                owner = np.repeat(np.arange(len(part)), [len(x) for x in lengths])
                length = np.concatenate(lengths).astype(np.int64)
                after = np.cumsum(length)
                before = after - length
                packed = memoryview(np.ascontiguousarray(ids, "<u4").tobytes())
                crc = [zlib.crc32(packed[4 * a : 4 * b]) for a, b in zip(before.tolist(), after.tolist(), strict=True)]
                first = np.cumsum(totals) - totals
                columns = {
                    "start": before - first[owner],
                    "length": length,
                    "ids": pa.ListArray.from_arrays(pa.array(np.append(0, after), pa.int32()), pa.array(ids.view(np.int32))) if with_ids else None,
                    "ids_crc32": np.array(crc, np.int64),
                    "doc_tokens": totals[owner],
                    "sequence_id": sequence + np.arange(len(length)),
                    "offset": np.zeros(len(length), np.int64),
                }
                sequence += len(length)
                key = batch.column("doc_id").take(pa.array(part.first + owner))
                yield pa.record_batch([key, *(pa.array(columns[name]) if name != "ids" else columns[name] for name in names)], names=["doc_id", *names])

    return source.mapInArrow(run, spec)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Writes the sequences as Parquet, one folder for each length, ready for length-bucketed batches."""
    pieces.write.mode("overwrite").partitionBy("length").parquet(path)
