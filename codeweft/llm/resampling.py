"""Quality by importance resampling (operator 1).

Two generative models give n-grams of tokens independent probabilities by hash bucket: one is counted over
texts labelled good, one over the raw table.  A text's log importance weight is the sum of the log ratios of
its n-grams.  Weights plus Gumbel noise, cut at the k-th largest, are a sample of k texts without replacement
in proportion to the weights.

Weights of long texts are far apart, so among these the noise seldom decides; it does among texts of like weight,
such as short ones, and wherever fewer texts are kept than fit the target.

A token is a run of letters, of digits (by length only) or of one kind of symbol; a word that repeats one of
the last two tokens counts as a repetition, whatever it is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeweft.llm import kernels
from codeweft.llm.frames import cut

BUCKETS = 1 << 12
#: Labelled texts of each label that the target model and the size of the sample are fitted on, at most.
SAMPLE_ROWS = 20_000
SEED = 1

_KIND = np.full(256, 3, np.uint8)
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_KIND[[*range(0x30, 0x3A)]] = 2
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x00]] = 0
_REPEAT = np.uint64(0x5EED)


def ngram_buckets(part: kernels.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and texts of a slice's token unigrams and bigrams."""
    data, n = part.data, len(part.data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _KIND[data]
    same = np.zeros(n, bool)
    same[1:] = (kind[1:] == kind[:-1]) & ((kind[1:] != 3) | (data[1:] == data[:-1]))
    inner = part.offsets[part.offsets < n]
    same[inner] = False
    starts = np.flatnonzero(~same)
    ends = np.append(starts[1:], n)
    solid = kind[starts] > 0
    starts, ends = starts[solid], ends[solid]
    owner = np.searchsorted(part.offsets, starts, "right") - 1
    lowered = np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, data)
    token = kernels.RangeHash(lowered)(starts, ends)
    digits = kind[starts] == 2
    token[digits] = kernels.mix64((ends - starts)[digits].astype(np.uint64))
    again = np.zeros(len(token), bool)
    for back in (1, 2):
        again[back:] |= (token[back:] == token[:-back]) & (owner[back:] == owner[:-back])
    token = np.where(again & (kind[starts] == 1), _REPEAT, token)
    pair = np.flatnonzero(owner[1:] == owner[:-1])
    pairs = kernels.mix64(token[pair] * np.uint64(3) + kernels.mix64(token[pair + 1]))
    keys = np.concatenate([kernels.mix64(token), pairs])
    return (keys % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([owner, owner[pair]])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """N-grams of all texts by bucket; each task sums its own rows before anything is shuffled."""

    @kernels.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in kernels.slices(batch.column(0)):
                sums += np.bincount(ngram_buckets(part)[0], minlength=BUCKETS)
        some = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array(sums[some])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for row in texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    smooth = 1.0
    return np.log((target + smooth) / (target.sum() + smooth * BUCKETS)) - np.log((raw + smooth) / (raw.sum() + smooth * BUCKETS))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``text, quality`` of up to ``rows`` documents of each label, chosen by hash."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = cut(known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"))
    good, bad = (known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for q in (1, 0))
    chosen = cut(good.unionByName(bad))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "quality")


def best_cut(good: np.ndarray, bad: np.ndarray) -> float:
    """The weight from which texts count as good, with the smallest sum of the two labels' error rates."""
    if not len(good) or not len(bad):
        return -math.inf
    values = np.unique(np.concatenate([good, bad]))
    errors = np.searchsorted(np.sort(good), values) / len(good) + 1 - np.searchsorted(np.sort(bad), values) / len(bad)
    at = int(errors.argmin())
    return float(values[at] + values[at - 1]) / 2 if at else -math.inf


def weigh(docs: DataFrame, ratios: np.ndarray, seed: int = SEED, carry: Sequence[str] | None = None) -> DataFrame:
    """``docs``, or its columns in ``carry``, with ``log_weight`` and ``gumbel_key`` added; they replace columns of
    these names.

    The noise is a hash of the text, so reruns agree and equal texts tie.  A null or empty text has no
    n-grams and a weight of 0.
    """
    plain = docs.drop("log_weight", "gumbel_key")
    carried = plain.columns if carry is None else list(carry)
    names = [*carried, "log_weight", "gumbel_key"]
    schema = T.StructType([*(plain.schema[c] for c in carried), T.StructField("log_weight", T.DoubleType()), T.StructField("gumbel_key", T.DoubleType())])

    @kernels.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.select(carried)
            for part in kernels.slices(batch.column("text")):
                buckets, owner = ngram_buckets(part)
                weight = kernels.per_text(owner, len(part), ratios[buckets])
                code = kernels.RangeHash(part.data)(part.offsets[:-1], part.offsets[1:])
                key = weight - np.log(-np.log(kernels.uniform(kernels.mix64(code + np.uint64(seed)))))
                # A slice at a time, so that neither side holds a whole batch of texts for what is given back.
                yield pa.RecordBatch.from_arrays([*own.slice(part.first, len(part)).columns, pa.array(weight), pa.array(key)], names=names)

    return plain.select(*dict.fromkeys([*carried, "text"])).mapInArrow(run, schema)


def kth_largest(values: DataFrame, column: str, k: int, bins: int = 1024, rounds: int = 5) -> float:
    """The k-th largest value, by counting bins within ever smaller ranges; all of fewer values are at least it."""
    n, low, high = values.agg(F.count(column), F.min(column), F.max(column)).first()
    if low is None or k <= 0:
        return math.inf
    if k >= n:
        return low
    above = 0
    for _ in range(rounds):
        width = (high - low) / bins
        if width <= 0:
            break
        place = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
        counts = dict(values.where((F.col(column) >= low) & (F.col(column) <= high)).groupBy(place.alias("b")).count().collect())
        for b in range(bins - 1, -1, -1):
            n = counts.get(b, 0)
            if above + n >= k:
                break
            above += n
        low, high = low + b * width, low + (b + 1) * width
    # Edges are rounded, so the value itself is looked up, from the first that at least k values reach.
    while values.where(F.col(column) >= low).count() < k:
        low = values.where(F.col(column) < low).agg(F.max(column)).first()[0]
    return values.where(F.col(column) >= low).agg(F.min(column)).first()[0]


def resample(docs: DataFrame, labels: DataFrame, *, keep: int | None = None, seed: int = SEED, carry: Sequence[str] | None = None) -> tuple[DataFrame, float]:
    """``docs`` with weights and keys, and the key from which they are sampled.

    ``keep`` is the size of the sample.  If it is not given, it is the number of texts whose weight is at
    least the one that parts the labelled sample best.  Keys that tie with the last one, such as those of repeated
    rows, are all in the sample.  Without good labels the weights are 0 and everything is kept; an empty table stays
    empty.  With ``carry`` only these columns of ``docs`` are in the result, which is then written once, so that
    no text is weighed twice.  Texts of any length are weighed whole, and other columns are left as they are.
    """
    sample = cut(labelled_sample(docs, labels))
    good = bucket_counts(sample.where("quality = 1"))
    ratios = log_ratios(good, bucket_counts(docs)) if good.sum() else np.zeros(BUCKETS)
    scored = cut(weigh(docs, ratios, seed, carry or ()))
    if keep is None:
        known = weigh(sample, ratios, seed, ("quality",)).select("quality", "log_weight").toPandas()
        level = best_cut(*(known["log_weight"][known["quality"] == q].to_numpy() for q in (1, 0)))
        keep = scored.where(F.col("log_weight") >= level).count()
    return weigh(docs, ratios, seed) if carry is None else scored, kth_largest(scored, "gumbel_key", keep)
