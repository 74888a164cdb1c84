"""Toxicity by noisy-channel deobfuscation (operator 3).

Words that may be disguised (letters mixed with digits or symbols, letters repeated three times, letters set
apart by blanks) are read as lattices: each run of a character stands for itself, for the letters it
resembles, for fewer of itself, or for nothing, at a cost.  A Viterbi search under a character trigram model of
all documents picks the likeliest word.  A word with one path through its lattice is its own reading.  Between
letters set apart a word may end or go on, and so at every blank between words: the same model decides, and words
that go on across blanks are added to the text.  The restored text is scored with a lexicon of words and word
beginnings learnt from labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeweft.llm import kernels
from codeweft.llm.frames import cut

#: Labelled texts of each class that the lexicon is learnt from, at most.
TRAIN_ROWS = 20_000
PREFIXES = (4, 5, 6)
MIN_WEIGHT = 2.5
#: Toxic examples that a feature must be in, at any number of examples.
MIN_TEXTS = 3
#: Log odds taken off, so that one word seen in a handful of toxic texts isn't enough.
MARGIN = 1.5
MEMO = 200_000
#: What a blank inside a word costs, where its pieces aren't all single characters.
JOIN = 3.0
#: What a word's end costs between letters set apart, besides the model's price; every reading counts.
ENDS = (0.0, 1.0, 2.0, 4.0)

#: What characters may stand for.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
_ALPHABET = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ"
SYMBOLS = len(_ALPHABET) + 1
_CODE = {c: k + 1 for k, c in enumerate(_ALPHABET)}
_CODES = np.zeros(0x110000, np.int64)
for _c, _k in _CODE.items():
    _CODES[ord(_c)] = _k

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_DISGUISE = np.zeros(256, bool)
_DISGUISE[list(b"0123456789@$!|+(*._-#~^")] = True


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Character trigrams of all texts, words standing between blanks; a table of fixed size."""

    @kernels.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for part in kernels.slices(batch.column(0)):
                code = _CODES[kernels.code_points(part)[0]]
                if len(code) > 2:
                    sums += np.bincount((code[:-2] * SYMBOLS + code[1:-1]) * SYMBOLS + code[2:], minlength=SYMBOLS**3)
        some = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array(sums[some])], names=["code", "n"])

    out = np.zeros(SYMBOLS**3, np.int64)
    rows = docs.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    out[rows["code"].to_numpy(np.int64)] = rows["n"]
    return out.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


class Channel:
    """Restores disguised words under a character model."""

    def __init__(self, counts: np.ndarray):
        n = counts.astype(np.float64)
        n[0, 0, :] = n[:, 0, :].sum(axis=0)  # what begins a word, whatever came before
        three = n / np.maximum(n.sum(axis=2, keepdims=True), 1)
        two = n.sum(axis=0) / np.maximum(n.sum(axis=(0, 2))[:, None], 1)
        one = n.sum(axis=(0, 1)) / max(n.sum(), 1)
        self.cost = -np.log(0.85 * three + 0.12 * two[None] + 0.02 * one[None, None] + 0.01 / SYMBOLS)
        self._memo: dict[str, str] = {}

    @staticmethod
    def readings(char: str, times: int) -> list[tuple[str, float]]:
        """What a run of one character may stand for, with costs."""
        if char.isalpha():
            if times == 1:
                return [(char, 0.0)]
            return [(char, 0.5 if times > 2 else 3.0), (char * 2, 1.0 if times > 2 else 0.0)]
        out = [(c * k, 1.0 + 0.5 * (times > 1)) for c in LOOKS.get(char, "") for k in range(1, min(times, 2) + 1)]
        return [*out, ("", 6.0 if char.isdigit() else 0.7)]

    def restore(self, word: str, end: float | None = None) -> str:
        """The likeliest reading; given the price of an ``end`` between any two characters, it may be several words."""
        key = word if end is None else f"{end} {word}"
        known = self._memo.get(key)
        if known is None:
            if len(self._memo) >= MEMO:
                self._memo.clear()
            known = self._memo[key] = self._search(word, end)
        return known

    def _search(self, word: str, end: float | None) -> str:
        beams: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        i = 0
        while i < len(word):
            times = 1
            while i + times < len(word) and word[i + times] == word[i]:
                times += 1
            after: dict[tuple[int, int], tuple[float, str]] = {}
            options = self.readings(word[i], times)
            if end is not None:
                options = [*options, *((f"{r[:k]} {r[k:]}", price + end) for r, price in options for k in range(len(r)))]
                if word[i].isalpha() and times > 1:
                    options += [(blank + " ".join(word[i] * times), end * (times - (not blank))) for blank in ("", " ")]
            for (a, b), (cost, text) in beams.items():
                for reading, price in options:
                    if reading[:1] == " " and text[-1:] in ("", " "):
                        continue
                    total, x, y = cost + price, a, b
                    for c in reading:
                        z = _CODE.get(c, 0)
                        total += self.cost[x, y, z] if z or c == " " else 8.0
                        x, y = y, z
                    if (x, y) not in after or total < after[x, y][0]:
                        after[x, y] = (total, text + reading)
            beams = after
            i += times
        return min((cost + self.cost[a, b, 0], text) for (a, b), (cost, text) in beams.items())[1]


def across(texts: list[str], channel: Channel) -> list[tuple[int, str]]:
    """Words that go on across blanks, with their texts.

    Pieces of two letters or more part the decisions from each other, so that comparing both sides of one blank
    is the Viterbi search; for a single letter both its blanks are compared at once too.
    """
    offsets = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
    starts, ends, owner = kernels.runs(kernels.letters()[points], offsets)
    if len(starts) < 2:
        return []
    blank = np.append(0, np.cumsum((points == 0x20) | ((points >= 0x09) & (points <= 0x0D))))
    first, last, one = _CODES[points[starts]], _CODES[points[ends - 1]], ends - starts == 1
    second = np.where(one, 0, _CODES[points[np.minimum(starts + 1, len(points) - 1)]])
    before = np.where(one, 0, _CODES[points[np.maximum(ends - 2, 0)]])
    open_ = (owner[1:] == owner[:-1]) & (blank[starts[1:]] - blank[ends[:-1]] == starts[1:] - ends[:-1]) & (last[:-1] > 0) & (first[1:] > 0)
    cost, a, b, c, d = channel.cost, before[:-1], last[:-1], first[1:], second[1:]
    gain = np.where(open_, cost[a, b, 0] + cost[b, 0, c] + cost[0, c, d] - cost[a, b, c] - cost[b, c, d] - JOIN, -np.inf)
    joined = gain > 0
    k = np.flatnonzero(one[1:-1] & open_[:-1] & open_[1:]) + 1
    a, b, c, d, e = before[k - 1], last[k - 1], first[k], first[k + 1], second[k + 1]
    both = cost[a, b, 0] + cost[b, 0, c] + cost[0, c, 0] + cost[c, 0, d] + cost[0, d, e] - cost[a, b, c] - cost[b, c, d] - cost[c, d, e] - 2 * JOIN
    whole = (both > 0) & (both > np.maximum(gain[k - 1], gain[k]))
    lesser = np.where(gain[k - 1] < gain[k], k - 1, k)[~whole]
    joined[lesser] = False  # a letter that goes with one side only goes with the better one
    joined[np.append(k[whole] - 1, k[whole])] = True
    edge = np.diff(np.concatenate([[0], joined.view(np.int8), [0]]))
    out = []
    for i, j in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        text = int(owner[i])
        out.append((text, "".join(texts[text][int(starts[i] - offsets[text]) : int(ends[j] - offsets[text])].split())))
    return out


def restored(part: kernels.Slice, channel: Channel) -> list[str]:
    """The slice's texts, lower-cased, with disguised words replaced by their readings and joined words added."""
    data = part.data
    raw = data.tobytes()
    starts, ends, owner = part.words()
    letters = np.append(0, np.cumsum(_LETTER[data]))
    odd = np.append(0, np.cumsum(_DISGUISE[data]))
    thrice = np.zeros(len(data), bool)
    if len(data) > 2:
        thrice[:-2] = (data[:-2] == data[1:-1]) & (data[1:-1] == data[2:]) & _LETTER[data[:-2]]
    thrice_sum = np.append(0, np.cumsum(thrice))
    has_letter = letters[ends] > letters[starts]
    disguised = has_letter & ((odd[np.maximum(ends - 1, starts)] > odd[starts]) | (_DISGUISE[data[ends - 1]] & (data[ends - 1] != 0x2E) & (data[ends - 1] != 0x21)) if len(ends) else has_letter)
    disguised |= thrice_sum[np.maximum(ends - 2, starts)] > thrice_sum[starts] if len(ends) else has_letter
    lone = (ends - starts == 1) | ((ends - starts == 2) & (data[starts] >= 0xC2)) if len(ends) else has_letter
    groups: list[tuple[int, int]] = [(k, k + 1) for k in np.flatnonzero(disguised & ~lone).tolist()]
    alone = np.flatnonzero(lone)
    if len(alone):
        breaks = np.flatnonzero((np.diff(alone) != 1) | (np.diff(owner[alone]) != 0)) + 1
        for run in np.split(alone, breaks):
            if len(run) >= 2 and letters[ends[run[-1]]] > letters[starts[run[0]]]:
                groups.append((int(run[0]), int(run[-1]) + 1))
    groups.sort()
    by_text: dict[int, list[tuple[int, int]]] = {}
    for first, last in groups:
        by_text.setdefault(int(owner[first]), []).append((first, last))
    out: list[str] = []
    extra: list[list[str]] = []
    for i, (a, b) in enumerate(zip(part.offsets[:-1].tolist(), part.offsets[1:].tolist(), strict=True)):
        pieces, at, more = [], a, []
        for first, last in by_text.get(i, ()):
            low, high = int(starts[first]), int(ends[last - 1])
            word = raw[low:high].decode("utf-8", "replace").lower()
            apart = last - first > 1
            if apart:
                word = "".join(word.split())
                more += {channel.restore(word, end): 0 for end in (*ENDS[1:], None)}
            pieces += [raw[at:low].decode("utf-8", "replace").lower(), channel.restore(word, ENDS[0] if apart else None)]
            at = high
        pieces.append(raw[at:b].decode("utf-8", "replace").lower())
        out.append("".join(pieces))
        extra.append(more)
    for i, word in across(out, channel):
        extra[i].append(word)
    return ["\n".join([text, *more]) for text, more in zip(out, extra, strict=True)]


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the texts' words and word beginnings, with their texts and word numbers."""
    offsets = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
    whole = "".join(texts)
    points = np.frombuffer(whole.encode("utf-32-le", "replace"), np.uint32)
    starts, ends, owner = kernels.runs(kernels.letters()[points], offsets)
    # Hashed as UTF-8, which is shorter: the byte at which each code point begins.
    at = np.zeros(len(points) + 1, np.int64)
    np.cumsum(1 + (points >= 0x80).view(np.int8) + (points >= 0x800) + (points >= 0x10000), out=at[1:])
    code = kernels.RangeHash(np.frombuffer(whole.encode("utf-8", "replace"), np.uint8))
    number = np.arange(len(starts))
    keys, owners, numbers = [code(at[starts], at[ends])], [owner], [number]
    for length in PREFIXES:
        long = np.flatnonzero(ends - starts > length)
        keys.append(kernels.mix64(code(at[starts[long]], at[starts[long] + length]) + np.uint64(length)))
        owners.append(owner[long])
        numbers.append(number[long])
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(numbers)


@dataclass
class Model:
    """Lexicon keys in order with their weights, and the log odds of a text without any of them."""

    trigrams: np.ndarray
    keys: np.ndarray
    weights: np.ndarray
    base: float

    def score(self, texts: list[str]) -> np.ndarray:
        """Words count by their best feature; a feature counts once, and half again for each further word, up to twice."""
        keys, owner, number = features(texts)
        word = keys[: number.max(initial=-1) + 1]
        total = np.full(len(texts), self.base)
        if len(self.keys):
            small = np.zeros(1 << 16, bool)
            small[self.keys & np.uint64(0xFFFF)] = True
            near = np.flatnonzero(small[keys & np.uint64(0xFFFF)])
            at = np.minimum(np.searchsorted(self.keys, keys[near]), len(self.keys) - 1)
            hit = self.keys[at] == keys[near]
            near, at = near[hit], at[hit]
            order = np.lexsort((-self.weights[at], number[near]))
            near, at = near[order], at[order]
            first = np.ones(len(near), bool)
            first[1:] = number[near][1:] != number[near][:-1]
            near, at = near[first], at[first]
            words = np.unique(np.stack([owner[near], at, word[number[near]].view(np.int64)], axis=1), axis=0)
            pairs, times = np.unique(words[:, :2], axis=0, return_counts=True)
            total += np.bincount(pairs[:, 0], weights=self.weights[pairs[:, 1]] * np.minimum(0.5 + 0.5 * times, 2), minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """The character model of all ``docs`` and a lexicon from those with a label in ``doc_id, toxic``.

    The lexicon is learnt from up to ``TRAIN_ROWS`` texts of each class, chosen by hash; of texts of one class that
    agree in the least hash of their long words, under either of two hash functions, the first by hash is used, so
    that copies of one text don't pass for many.  Null labels, labels other than 0 and 1 and null ids are left out, of
    several labels of one id the greatest counts, and without labelled texts the lexicon is empty.
    """
    trigrams = trigram_counts(docs)
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.join(docs.where(F.col("text").isNotNull()).select("doc_id").distinct(), "doc_id", "left_semi")
    known = cut(known)
    chosen = None
    for value in (0, 1):
        some = known.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
        chosen = some if chosen is None else chosen.unionByName(some)
    rows = docs.select("doc_id", "text").join(F.broadcast(cut(chosen)), "doc_id").select("text", "toxic")

    @kernels.released
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.slices(batch.column("text")):
                hashes, owner, starts, ends = kernels.word_hashes(part)
                long = np.flatnonzero(ends - starts >= 9)
                marks = []
                for seed in (1, 2):
                    least = np.full(len(part), np.iinfo(np.uint64).max, np.uint64)
                    np.minimum.at(least, owner[long], kernels.mix64(hashes[long] + np.uint64(seed)))
                    none = np.flatnonzero(np.bincount(owner[long], minlength=len(part)) == 0)
                    least[none] = kernels.RangeHash(part.data)(part.offsets[none], part.offsets[none + 1])
                    marks.append(pa.array(least.view(np.int64)))
                own = batch.slice(part.first, len(part))
                yield pa.RecordBatch.from_arrays([*own.columns, *marks], names=["text", "toxic", "mark1", "mark2"])

    kind = rows.schema["toxic"].dataType.simpleString()
    marked = rows.mapInArrow(mark, f"text string, toxic {kind}, mark1 long, mark2 long")
    first = F.min(F.struct(F.xxhash64("text").alias("code"), "text", "mark2"))
    once = marked.groupBy("toxic", "mark1").agg(first.alias("t")).select("toxic", "t.*").groupBy("toxic", "mark2").agg(F.min(F.struct("code", "text")).alias("t"))
    once = cut(once.select("t.text", "toxic"))
    sizes = {r["toxic"]: r["n"] for r in once.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)

    @kernels.released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel = Channel(trigrams)
        for batch in batches:
            toxic = batch.column("toxic").to_numpy()
            for part in kernels.slices(batch.column("text")):
                keys, owner, _ = features(restored(part, channel))
                order = np.lexsort((owner, keys))
                keys, owner = keys[order], owner[order]
                new = np.ones(len(keys), bool)
                new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
                keys, value = keys[new], toxic[part.first + owner[new]]
                if len(keys):
                    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                    ones = np.add.reduceat(value.astype(np.int64), first)
                    both = np.diff(np.append(first, len(keys)))
                    yield pa.record_batch([pa.array(keys[first].view(np.int64)), pa.array(ones), pa.array(both - ones)], names=["key", "df1", "df0"])

    counted = once.mapInArrow(count, "key long, df1 long, df0 long").groupBy("key").agg(F.sum("df1").alias("df1"), F.sum("df0").alias("df0"))
    weight = F.log((F.col("df1") - 1) / F.lit(n1 + 1.0)) - F.log((F.col("df0") + 0.5) / F.lit(n0 + 1.0))
    # Features of the examples, whose number is bounded; MIN_WEIGHT asks for more toxic texts where both classes are large.
    strong = counted.where(F.col("df1") >= MIN_TEXTS).withColumn("weight", weight).where(F.col("weight") >= MIN_WEIGHT)
    lexicon = strong.select("key", "weight").toPandas()
    keys = lexicon["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    base = float(np.log((n1 + 1.0) / (n0 + 1.0))) - MARGIN
    return Model(trigrams, keys[order], lexicon["weight"].to_numpy(float)[order], min(base, -MARGIN))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` added (0 to 1, higher: likelier toxic); it replaces a column of this name.

    Null and empty texts get the score of a text without toxic words.  Texts of any length are read whole, repeated
    rows are scored alike and each returned, other columns stay as they are, and an empty table gives no rows.
    """
    plain = docs.drop("score")
    names = [*plain.columns, "score"]
    schema = T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @kernels.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        channel = Channel(known.trigrams)
        for batch in batches:
            scores = [known.score(restored(part, channel)) for part in kernels.slices(batch.column("text"))]
            if scores:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores))], names=names)

    return plain.mapInArrow(run, schema)
