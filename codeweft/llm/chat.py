"""Chat formatting at the token level (operator 4).

A turn is ``<|im_start|>`` role ``<|im_sep|>`` text ``<|im_end|>``.  Role and text are encoded apart, and the
marks are spliced in as ids above the vocabulary, so no text can make one.  In the formatted string the same
marks are written out, and control strings inside role and text are escaped: ``<|`` becomes ``<\\|`` and every
``<\\...\\|`` gets one more backslash, which can be taken back.  The loss mask is the prefix sum of +1 where an
assistant text begins and -1 where it ends.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.llm import kernels
from codeweft.llm.encoding import byte_encoding

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Ids over the vocabulary's own, by mark.
RESERVED = {START: 50257, SEP: 50258, END: 50259}
TRAINED_ROLE = "assistant"

_bar = re.compile(r"<(\\*)\|")
_escaped_bar = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _bar.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _escaped_bar.sub(r"<\1|", text)


def format_turns(turns: DataFrame, tokenizer: str) -> DataFrame:
    """``conv_id, turn, place, ids, loss_mask``: every turn's tokens and mask.

    A conversation's sequence is its rows by ``turn``, nulls last, then ``place``, which orders rows of the
    same turn by role and text; repeated rows are turns of their own.  Null roles and texts are empty.  ``conv_id``
    null is a conversation.  Texts of any length are encoded whole, other columns are ignored, and an empty table gives
    no rows.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn")]
    spec = f"conv_id {kinds[0]}, turn {kinds[1]}, place string, ids array<int>, loss_mask array<tinyint>"

    @kernels.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_encoding(tokenizer).encode_ordinary
        start, sep, end = RESERVED[START], RESERVED[SEP], RESERVED[END]
        for batch in batches:
            for low in range(0, len(batch), 1000):
                part = batch.slice(low, 1000)
                roles, texts = part.column("role").to_pylist(), part.column("text").to_pylist()
                ids, sizes, begins, ends, place = [], [], [], [], []
                for role, text in zip(roles, texts, strict=True):
                    head, body = encode(escape(role)), encode(escape(text))
                    row = [start, *head, sep, *body, end]
                    at = len(ids)
                    if role == TRAINED_ROLE:
                        begins.append(at + 2 + len(head))
                        ends.append(at + 2 + len(head) + len(body))
                    ids += row
                    sizes.append(len(row))
                    place.append(hashlib.md5(f"{role}\n{text}".encode()).hexdigest())
                steps = np.zeros(len(ids) + 1, np.int64)
                np.add.at(steps, begins, 1)
                np.add.at(steps, ends, -1)
                mask = np.cumsum(steps)[:-1].astype(np.int8)
                offsets = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(mask))]
                yield pa.record_batch([part.column("conv_id"), part.column("turn"), pa.array(place), *lists], names=["conv_id", "turn", "place", "ids", "loss_mask"])

    return rows.mapInArrow(run, spec)


def digests(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """What the formatted turns say, read back from their ids and masks alone.

    One row for each conversation: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, n_tokens``.  A conversation's rows pass one task in order and are not held, so its length
    takes time but no memory.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    ordered = formatted.repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.col("turn").asc_nulls_last(), F.col("place"))
    marks = {v: k for k, v in RESERVED.items()}
    fields = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]

    @kernels.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = byte_encoding(tokenizer).decode_bytes
        now, state, done = None, None, []

        def close() -> None:
            if state is not None:
                done.append([now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]])

        def rows() -> pa.RecordBatch:
            arrays = [pa.array([r[k] for r in done], key_type if not k else None) for k in range(len(fields))]
            out = pa.record_batch(arrays, names=fields)
            done.clear()
            return out

        key_type = None
        for batch in batches:
            key_type = batch.schema.field("conv_id").type
            keys = batch.column("conv_id").to_pylist()
            for i, key in enumerate(keys):
                if state is None or key != now:
                    close()
                    now, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                ids = batch.column("ids")[i].values.to_numpy()
                mask = batch.column("loss_mask")[i].values.to_numpy()
                edges = np.flatnonzero(ids >= min(marks))
                segments = [decode(ids[a + 1 : b].tolist()).decode("utf-8") for a, b in zip(edges[:-1], edges[1:], strict=True)]
                loss = unescape(decode(ids[mask > 0].tolist()).decode("utf-8"))
                role, text = map(unescape, segments)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += sum(map(len, segments)) + sum(len(marks[int(ids[e])]) for e in edges)
                state[5] += len(ids)
            if done:
                yield rows()
        close()
        if done:
            yield rows()

    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")


def formatted_text(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, formatted``: the turns as strings, with the marks written out."""
    safe = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"<(\\*)\|", r"<\\$1|")
    return turns.select("conv_id", "turn", F.concat(F.lit(START), safe("role"), F.lit(SEP), safe("text"), F.lit(END)).alias("formatted"))
