"""Importance resampling towards a target by sorted bucket streams (operator 12).

Every text becomes a stream of packed ``uint16`` buckets, one for each run of 1 to 3 words; streams are written
once, many texts to a row with the texts' offsets in it.  A task sorts each stream and run-length encodes it for
its counts, which Spark adds up; the gains of the buckets are then gathered along the written streams, and
``np.add.reduceat`` sums them between the offsets.  Texts are read once.

A bucket is the CRC-32 of the run's bytes, words joined by one space.  CRC-32 is linear, so that of a run follows
from those of its words: shift the first by the length of the second and add the second.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.llm import kernels
from codeweft.llm.frames import cut, small

#: Buckets; at most 65536, as they are packed.
MODULUS = 10_000
MIN_WORDS, PERCENT, SEED = 20, 5, "42"
#: Bins in which the lowest score that is drawn is sought.
BINS = 4096
#: Buckets in a row of streams, about, unless one text has more; Spark reads thousands of rows at a time.
STREAM_BUCKETS = 1 << 13
#: Words longer than this are rare; they are hashed one by one.
SHORT = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, out >> 1 ^ np.uint32(0xEDB88320), out >> 1)
    return out


_CRC = _crc_table()
_SPACE = np.uint32(zlib.crc32(b" "))


def _step(crc: np.ndarray) -> np.ndarray:
    """One byte of zeros after the register's content."""
    return _CRC[crc & 255] ^ crc >> 8


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map, given by its values for every byte at every place, on many registers."""
    return tables[..., 0, :][crc & 255] ^ tables[..., 1, :][crc >> 8 & 255] ^ tables[..., 2, :][crc >> 16 & 255] ^ tables[..., 3, :][crc >> 24]


def _shift_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables of the shifts by 0 to ``SHORT`` bytes, and by every power of two of bytes."""
    place = (np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    by_length = [place]
    for _ in range(SHORT):
        by_length.append(_step(by_length[-1]))
    powers = [by_length[1]]
    for _ in range(40):
        powers.append(_apply(powers[-1], powers[-1]))
    return np.stack(by_length), powers


_SHIFTS, _POWERS = _shift_tables()
_FLAT = _SHIFTS.reshape(-1)


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of texts moved ``length`` bytes to the front."""
    base = np.minimum(length, SHORT).astype(np.int64) * 1024
    out = _FLAT[base + (crc & 255)] ^ _FLAT[base + 256 + (crc >> 8 & 255)] ^ _FLAT[base + 512 + (crc >> 16 & 255)] ^ _FLAT[base + 768 + (crc >> 24)]
    far = np.flatnonzero(length > SHORT)
    if len(far):
        some, rest = crc[far], length[far].astype(np.int64)
        for power, tables in enumerate(_POWERS[: int(rest.max()).bit_length()]):
            some = np.where(rest >> power & 1, _apply(tables, some), some)
        out[far] = some
    return out


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of byte ranges, a byte of all of them at a time, those that end first falling out."""
    length = ends - starts
    order = np.argsort(-length, kind="stable")
    sizes, begin = length[order], starts[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    n_long = int(np.searchsorted(-sizes, -SHORT))
    left = np.searchsorted(-sizes, -np.arange(SHORT), "left")
    for at in range(SHORT):
        use = slice(n_long, left[at])
        if use.start >= use.stop:
            break
        crc[use] = _CRC[(crc[use] ^ data[begin[use] + at]) & 255] ^ crc[use] >> 8
    crc ^= np.uint32(0xFFFFFFFF)
    for k in range(n_long):
        crc[k] = zlib.crc32(data[begin[k] : begin[k] + sizes[k]])
    out = np.empty_like(crc)
    out[order] = crc
    return out


def features(part: kernels.Slice, modulus: int = MODULUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of a slice's texts in a row, each text's offset in them, and each text's number of words."""
    data = _LOWER[part.data]
    starts, ends, owner = part.runs(_INSIDE[data])
    n_words = kernels.per_text(owner, len(part))
    per_text = n_words + np.maximum(n_words - 1, 0) + np.maximum(n_words - 2, 0)
    offsets = np.zeros(len(part) + 1, np.int64)
    np.cumsum(per_text, out=offsets[1:])
    out = np.empty(offsets[-1], np.uint16)
    single, length = word_crcs(data, starts, ends), ends - starts
    nth = np.arange(len(owner)) - (np.cumsum(n_words) - n_words)[owner]
    crc, place = single, offsets[owner] + nth
    for run in (1, 2, 3):
        at = np.flatnonzero(nth + run <= n_words[owner]) if len(owner) else nth  # words that begin a run of this many
        if run > 1:
            after = at + run - 1
            crc_at = shifted(shifted(crc[at], np.ones(len(at), np.int64)) ^ _SPACE, length[after]) ^ single[after]
            crc = np.zeros(len(owner), np.uint32)
            crc[at] = crc_at
        out[place[at]] = crc[at] % np.uint32(modulus)
        place = place + np.maximum(n_words - run + 1, 0)[owner]
    return out, offsets, n_words


def streams(docs: DataFrame, modulus: int = MODULUS) -> DataFrame:
    """``doc_ids, n_words, offsets, buckets``: the packed buckets of many texts to a row, little-endian."""
    if not 1 <= modulus <= 1 << 16:
        raise ValueError("buckets are packed in 16 bits")
    source = docs.select("doc_id", "text")
    key = source.schema["doc_id"].dataType.simpleString()

    @kernels.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.slices(batch.column("text")):
                buckets, offsets, n_words = features(part, modulus)
                begin = np.flatnonzero(np.diff(offsets[:-1] // STREAM_BUCKETS, prepend=-1)).tolist()
                rows: list[list] = [[], [], [], []]
                for a, b in zip(begin, [*begin[1:], len(part)], strict=True):
                    values = (batch.column("doc_id").slice(part.first + a, b - a), n_words[a:b], offsets[a : b + 1] - offsets[a])
                    for column, value in zip(rows, values, strict=False):
                        column.append(value)
                    rows[3].append(buckets[offsets[a] : offsets[b]].astype("<u2").tobytes())
                ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in rows[0]])), pa.int32()), pa.concat_arrays(rows[0]))
                yield pa.record_batch([ids, pa.array(rows[1]), pa.array(rows[2]), pa.array(rows[3], pa.binary())], names=["doc_ids", "n_words", "offsets", "buckets"])

    return source.mapInArrow(run, f"doc_ids array<{key}>, n_words array<long>, offsets array<long>, buckets binary")


def counts(written: DataFrame, modulus: int = MODULUS) -> np.ndarray:
    """How often each bucket occurs in streams: sorted and run-length encoded in tasks, added up by Spark."""

    @kernels.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(modulus, np.int64)
        for batch in batches:
            for packed in batch.column("buckets"):
                ordered = np.sort(np.frombuffer(packed.as_buffer(), "<u2"))
                begin = np.flatnonzero(np.diff(ordered.astype(np.int32), prepend=-1))
                total[ordered[begin]] += np.diff(np.append(begin, len(ordered)))
        held = np.flatnonzero(total)
        yield pa.record_batch([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    out = np.zeros(modulus, np.int64)
    summed = written.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for bucket, n in summed.collect():  # at most ``modulus`` rows
        out[bucket] = n
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a bucket adds to a text's weight, in thousandths of a nat, rounded down; both counts are smoothed by one."""
    s_all, t_all, buckets = int(source.sum()), int(target.sum()), len(source)
    ratio = [((t + 1) * (s_all + buckets)) / ((s + 1) * (t_all + buckets)) for s, t in zip(source.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weights(written: DataFrame, gains: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every text of the streams."""
    key = written.schema["doc_ids"].dataType.elementType.simpleString()

    @kernels.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for row in range(len(batch)):
                offsets = batch.column("offsets")[row].values.to_numpy()
                gathered = gains[np.frombuffer(batch.column("buckets")[row].as_buffer(), "<u2")]
                weight, some = np.zeros(len(offsets) - 1, np.int64), np.flatnonzero(np.diff(offsets))
                if len(some):
                    weight[some] = np.add.reduceat(gathered, offsets[some])
                found.append(weight)
                sizes.append(np.diff(offsets))
            columns = [batch.column("doc_ids").flatten(), batch.column("n_words").flatten(), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(found))]
            yield pa.record_batch(columns, names=["doc_id", "n_words", "n_features", "weight"])

    return written.mapInArrow(run, f"doc_id {key}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths, rounded down, from the SHA-256 of ``seed:doc_id``; a null id is the empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, *, modulus: int = MODULUS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: str = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs``, drawn towards the texts of ``target``.

    ``docs`` needs ``doc_id`` and ``text``, ``target`` needs ``text``; other columns are ignored.  Of the rows with at
    least ``min_words`` words the ``percent`` in a hundred with the highest scores are drawn and ranked from 1; the
    others' rank is null.  Ties go to the smaller ``doc_id``, a null one first, and among rows of one id to the one
    written first.  Null and empty texts have no features and weight 0.  Repeated rows count and are drawn on their
    own.  Texts of any length are taken whole; an empty table gives no rows, an empty target equal counts.
    """
    written = cut(streams(docs, modulus))
    aim = cut(streams(target.select(F.lit(0).alias("doc_id"), "text"), modulus))
    gains = gains_of(counts(written, modulus), counts(aim, modulus))
    scored = weights(written, gains).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = cut(scored.withColumn("row", F.monotonically_increasing_id()))
    shown = ["doc_id", "n_features", "weight", "score"]
    drawn, last = _drawn(scored, scored.where(F.col("n_words") >= min_words), percent)
    if last is None:
        return scored.select(*shown, F.lit(None).cast("long").alias("rank"))
    key = scored.schema["doc_id"].dataType
    limit = F.struct(F.lit(-last["score"]).alias("a"), F.lit(last["doc_id"]).cast(key).alias("b"), F.lit(last["row"]).alias("c"))
    within = F.struct((-F.col("score")).alias("a"), F.col("doc_id").alias("b"), F.col("row").alias("c")) <= limit
    left = scored.where((F.col("n_words") < min_words) | ~within).select(*shown, F.lit(None).cast("long").alias("rank"))
    return drawn.select(*shown, "rank").unionByName(left)


def _drawn(scored: DataFrame, eligible: DataFrame, percent: int) -> tuple[DataFrame, dict | None]:
    """The drawn rows with their ranks, and the last of them.

    Only rows at and above the bin that holds the last drawn score are sorted, by range, so no task has them all;
    a row's rank is its place in its range and the number of rows in the ranges before.
    """
    n, low, high = eligible.agg(F.count("*"), F.min("score"), F.max("score")).first()
    k = percent * n // 100
    if not k:
        return scored, None
    width = (high - low) // BINS + 1
    bins = dict(eligible.groupBy(F.floor((F.col("score") - low) / width).cast("int").alias("bin")).agg(F.count("*").alias("n")).collect())
    edge, seen = max(bins) + 1, 0
    while seen < k:
        edge -= 1
        seen += bins.get(edge, 0)
    head = eligible.where(F.col("score") >= low + edge * width)
    order = [F.desc("score"), F.asc("doc_id"), F.asc("row")]
    ordered = cut(head.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = cut(sizes.select("part", before.alias("before")))  # as many rows as there are partitions
    ranked = ordered.join(small(starts), part == F.col("part")).withColumn("rank", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1)
    drawn = ranked.where(F.col("rank") <= k)
    return drawn, drawn.where(F.col("rank") == k).first().asDict()
