"""Language identification by bit-sliced n-gram filters (operator 6).

Every language has a Bloom filter of its n-grams; the filters stand side by side, so that one row of bits
holds, for all languages, the bit at one place, and the AND of an n-gram's few rows is the set of languages
that contain it.  A text's languages are decided by how often each is in these sets, after taking off the hits
that a filter as full as this one gives by chance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeweft.llm import kernels
from codeweft.llm.frames import cut, small

UNKNOWN = "und"
WIDTHS = (3, 4)
#: Rows looked at for each n-gram, and the chance at most that the fullest filter has an n-gram it wasn't given.
PROBES, FALSE_POSITIVES = 3, 0.005
#: An n-gram belongs to a language where its share is at least this part of its share in any language.
BELONGS = 0.2


def grams(part: kernels.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and texts of a slice's letter n-grams, and whether each text has a letter.

    Text is lower-cased, every run of other characters counts as one blank, and each text stands between
    blanks; an n-gram may have a blank at its ends only.
    """
    points, offsets = kernels.code_points(part)
    starts, ends, owner = kernels.runs(kernels.letters()[points], offsets)
    lengths = ends - starts
    size = int(lengths.sum()) + len(starts) + 1
    padded, word_at = np.zeros(size, np.uint64), np.cumsum(lengths + 1) - lengths
    target = np.repeat(word_at - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
    source = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
    padded[target] = points[source]
    who = np.zeros(size, np.int64)
    who[target] = np.repeat(owner, lengths)
    who[word_at - 1] = owner
    hashes, owners = [], []
    for width in WIDTHS:
        n = size - width + 1
        if n <= 0:
            continue
        key = np.full(n, width, np.uint64)
        inner = np.ones(n, bool)
        for k in range(width):
            symbol = padded[k : k + n]
            key = (key ^ symbol) * np.uint64(0x100000001B3) + (key >> np.uint64(29))
            if 0 < k < width - 1:
                inner &= symbol != 0
        hashes.append(kernels.mix64(key[inner]))
        owners.append(who[1 : 1 + n][inner])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(part), bool)
    return np.concatenate(hashes), np.concatenate(owners), np.bincount(owner, minlength=len(part)) > 0


def rows_for(members: int) -> int:
    """Rows (a power of two) that hold so many n-grams of one language at ``FALSE_POSITIVES``."""
    least = -PROBES * members / math.log1p(-(FALSE_POSITIVES ** (1 / PROBES)))
    return 1 << max(10, math.ceil(math.log2(max(1.0, least))))


def probed(keys: np.ndarray, probe: int, rows: int) -> np.ndarray:
    """The row that each n-gram has at this probe."""
    width = rows.bit_length() - 1
    places = keys >> np.uint64(width * probe) if width * PROBES <= 64 else kernels.mix64(keys + np.uint64(probe))
    return (places & np.uint64(rows - 1)).astype(np.int64)


@dataclass
class Filters:
    languages: list[str]
    bits: np.ndarray
    chance: np.ndarray

    @classmethod
    def of(cls, languages: list[str], bits: np.ndarray) -> "Filters":
        full = np.array([(bits[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)).mean() for k in range(len(languages))])
        return cls(languages, bits, full**PROBES)

    def counts(self, keys: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
        """Corrected n-gram counts by text and language."""
        found = self.bits[probed(keys, 0, len(self.bits))]
        for probe in range(1, PROBES):
            found &= self.bits[probed(keys, probe, len(self.bits))]
        total = np.bincount(owners, minlength=n)
        out = np.empty((n, len(self.languages)))
        for k, chance in enumerate(self.chance):
            hit = (found[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)).astype(bool)
            out[:, k] = np.maximum(0, (np.bincount(owners[hit], minlength=n) - total * chance) / max(1e-9, 1 - chance))
        return out


def learn(examples: DataFrame) -> Filters:
    """Filters from ``text, lang`` rows; rows with a null in either are left out, and repeated rows count each.

    Every n-gram that belongs to a language enters its filter, whose rows are sized by a count.  The bits are put
    together by Spark; the driver gets the finished table, 8 bytes for a row and 64 languages, besides a name and a
    count for each language.
    """
    rows = examples.select("text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())

    @kernels.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for part in kernels.slices(batch.column("text")):
                keys, owners, _ = grams(part)
                names = langs[part.first : part.first + len(part)]
                for lang in set(names.tolist()):
                    own, n = np.unique(keys[(names == lang)[owners]], return_counts=True)
                    if lang in sums:
                        own, at = np.unique(np.concatenate([sums[lang][0], own]), return_inverse=True)
                        n = np.bincount(at, weights=np.concatenate([sums[lang][1], n])).astype(np.int64)
                    sums[lang] = own, n
        for lang, (own, n) in sums.items():
            yield pa.record_batch([pa.array([lang] * len(own), pa.string()), pa.array(own.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    counts = cut(rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total")).collect()
    languages = [r["lang"] for r in sorted(totals, key=lambda r: (-r["total"], r["lang"]))]
    if not languages:
        return Filters([], np.zeros((rows_for(0), 0), np.uint64), np.zeros(0))
    total = {r["lang"]: r["total"] for r in totals}
    sizes = examples.sparkSession.createDataFrame([(lang, k, total[lang]) for k, lang in enumerate(languages)], "lang string, number int, total long")
    shares = counts.join(small(sizes), "lang").withColumn("share", F.col("n") / F.col("total"))
    most = shares.groupBy("gram").agg(F.max("share").alias("most"))
    own = cut(shares.join(most, "gram").where(F.col("share") >= BELONGS * F.col("most")).select("number", "gram"))
    most_members = own.groupBy("number").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    rows_n = rows_for(most_members or 0)

    @kernels.released
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column("number").to_numpy()
            keys = batch.column("gram").to_numpy().view(np.uint64)
            at = np.concatenate([probed(keys, probe, rows_n) for probe in range(PROBES)])
            bit = (np.uint64(1) << (number % 64).astype(np.uint64)).view(np.int64)
            yield pa.record_batch([pa.array(at), pa.array(np.tile(number // 64, PROBES).astype(np.int32)), pa.array(np.tile(bit, PROBES))], names=["at", "word", "bits"])

    placed = own.mapInArrow(places, "at long, word int, bits long").groupBy("at", "word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros((rows_n, (len(languages) + 63) // 64), np.uint64)
    bits[placed["at"].to_numpy(), placed["word"].to_numpy()] = placed["bits"].to_numpy().view(np.uint64)
    return Filters.of(languages, bits)


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` added; they replace columns of these names.

    ``und`` with score 0 is given for null texts, texts without a letter, and all texts if nothing was learnt.
    The score is the language's part of all languages' counts; a text none of whose n-grams is known goes to
    the most common language with score 0; ties go to the more common language.  Texts of any length are read whole,
    repeated rows are predicted alike and each returned, other columns stay as they are, and an empty table gives no
    rows.
    """
    plain = docs.drop("lang_pred", "score")
    names = [*plain.columns, "lang_pred", "score"]
    schema = T.StructType([*plain.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    @kernels.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            langs: list[str] = []
            scores: list[np.ndarray] = []
            for part in kernels.slices(batch.column("text")):
                keys, owners, lettered = grams(part)
                if not known.languages:
                    langs += [UNKNOWN] * len(part)
                    scores.append(np.zeros(len(part)))
                    continue
                counts = known.counts(keys, owners, len(part))
                best, total = counts.argmax(axis=1), counts.sum(axis=1)
                share = np.divide(counts.max(axis=1), total, out=np.zeros(len(part)), where=total > 0)
                langs += [known.languages[k] if yes else UNKNOWN for k, yes in zip(best, lettered, strict=True)]
                scores.append(np.where(lettered, share, 0.0))
            if scores:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(np.concatenate(scores))], names=names)

    return plain.mapInArrow(run, schema)
