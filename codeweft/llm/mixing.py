"""Mixing sources to target weights by blocks (operator 8).

The documents of a source, in a fixed pseudorandom order, form one stream of words that is cut into blocks of
equal length.  The mix is a sequence of slots, dealt to output shards; a shard's slots are split over the
sources by a multinomial draw, and the j-th slot of a source maps to a block through a pseudorandom
permutation of the source's block indexes, a new permutation for every pass over the source.

The draws are conditioned on each source's total, so the totals meet the targets exactly: given their sums,
independent multinomial counts are multivariate hypergeometric, which is drawn by halving the range of shards
again and again.  Any shard finds its counts, and the slots of a source before it, by walking down that tree
of seeded draws, without a scan over the other shards.

The driver and each task hold a few numbers for each source; documents, blocks and slots stay in frames.
Texts of any length take part whole; documents of equal hash order are taken by id, then by row, and repeated rows are
documents of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.llm import kernels
from codeweft.llm.frames import columns, cut, row_identity, seed_of, small, unused

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
BLOCK_WORDS = 64
SLOTS_PER_SHARD = 4096
#: Documents, on average, in the parts into which a source is hashed, so that no window holds a whole source.
PART_ROWS = 4096
#: Documents that are cut into runs in one go, which bounds memory.
ROWS_AT_ONCE = 256
SEED = 20240501
#: Items from which numpy's hypergeometric draw is replaced by a rounded normal one; the two have the same mean,
#: variance and range, and at this size a skewness below 1e-4.
NORMAL_FROM = 500_000_000

_word = re.compile("[^ \t-\r]+")


def word_count(text: Column) -> Column:
    """The number of words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], *, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> list[tuple[str | None, int, float]]:
    """``(source, size, target)`` by code point, null last.

    ``share`` times all words is dealt by weight; a target stops at ``cap`` times its source's size and the
    excess is dealt again by weight among the rest, until no target is above.
    """
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    size = np.array([sizes[x] for x in names], float)
    weight = np.array([weights[i % len(weights)] for i in range(len(names))], float)
    most, full = size * cap, np.zeros(len(names), bool)
    target = np.zeros(len(names))
    while not full.all():
        level = max(0.0, share * size.sum() - most[full].sum()) / weight[~full].sum()
        target = np.where(full, most, weight * level)
        above = target > most
        if not above.any():
            break
        full |= above
        target = np.minimum(target, most)
    return [(x, sizes[x], float(t)) for x, t in zip(names, target, strict=True)]


@dataclass(frozen=True)
class Plan:
    """The sources' block counts and slots, by ``source_no``."""

    blocks: np.ndarray
    slots: np.ndarray
    seed: int

    @property
    def n_shards(self) -> int:
        return max(1, -(-int(self.slots.sum()) // SLOTS_PER_SHARD))

    def shard(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Slots of each source in the shard, and before it."""
        low, high = 0, self.n_shards
        own, before = self.slots.astype(np.int64), np.zeros(len(self.slots), np.int64)
        while high - low > 1:
            middle = (low + high) // 2
            left = _halve(own, (middle - low) * SLOTS_PER_SHARD, np.random.default_rng([self.seed & 0xFFFFFFFF, low, high]))
            if number < middle:
                own, high = left, middle
            else:
                own, before, low = own - left, before + left, middle
        return own, before


def _draw(good: int, bad: int, size: int, rng: np.random.Generator) -> int:
    """How many of ``good`` items are among ``size`` drawn without replacement from ``good + bad``."""
    total = good + bad
    if not good or not size:
        return 0
    if total < NORMAL_FROM:
        return int(rng.hypergeometric(good, bad, size))
    mean = size * (good / total)
    spread = (mean * (bad / total) * ((total - size) / max(total - 1, 1))) ** 0.5
    return min(max(round(rng.normal(mean, spread)), size - bad, 0), good, size)


def _halve(counts: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each kind are among ``size`` slots drawn without replacement, kind by kind."""
    rest = int(counts.sum())
    size, out = min(size, rest), np.zeros(len(counts), np.int64)
    for k, n in enumerate(counts.tolist()):
        rest -= n
        out[k] = _draw(n, rest, size, rng)
        size -= int(out[k])
    return out


def permute(index: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A pseudorandom permutation of range(n): a Feistel cipher on the next even number of bits, walked back into range."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(seed_of(seed, r)) for r in range(4)]
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for key in keys:
            left, right = right, left ^ (kernels.mix64(right + key) & mask)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def draw_slots(shards: DataFrame, plan: Plan) -> DataFrame:
    """``source_no, block, pass, shard`` for each slot of the shards ``id``.

    Spark takes the size of the result for that of ``shards``, so joins with it need a hint against broadcast.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for number in frame["id"]:
                own, before = plan.shard(int(number))
                source = np.repeat(np.arange(len(own)), own)
                j = np.concatenate([before[s] + np.arange(own[s]) for s in range(len(own))])
                turn, at = j // plan.blocks[source], j % plan.blocks[source]
                block = np.empty(len(j), np.int64)
                for s, t in set(zip(source.tolist(), turn.tolist(), strict=True)):
                    one = (source == s) & (turn == t)
                    block[one] = permute(at[one], int(plan.blocks[s]), seed_of(plan.seed, s, t))
                yield pd.DataFrame({"source_no": source, "block": block, "pass": turn, "shard": number})

    return shards.mapInPandas(run, "source_no long, block long, pass long, shard long")


def place(docs: DataFrame, *, block_words: int = BLOCK_WORDS, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Documents with their places in their source's stream, and the slots drawn from the streams.

    The first frame has ``doc_id, row_key, source, size, source_no, source_size, target, start``; the second
    ``source_no, block, pass, shard``.  ``row_key`` names the whole row, ``start`` counts the words before.  Null texts
    and texts without words have size 0, a null source is a source of its own, repeated rows are placed each, rows that
    differ only in where a null stands are different, and an empty table has no slots.
    """
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_identity(docs).alias("row_key")))
    totals = sized.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("docs")).collect()
    sizes, rows = {r["source"]: r["n"] for r in totals}, {r["source"]: r["docs"] for r in totals}
    aims = targets(sizes, weights=weights, share=share, cap=cap)
    blocks = np.array([-(-n // block_words) for _, n, _ in aims], np.int64)
    passes = np.array([int(t / n + 1e-9) if n else 0 for _, n, t in aims], np.int64)
    rest = np.array([max(0, round((t - k * n) / block_words)) for (_, n, t), k in zip(aims, passes, strict=True)], np.int64)
    plan = Plan(blocks, np.minimum(passes * blocks + rest, np.floor(cap * blocks).astype(np.int64)), seed)
    spark = docs.sparkSession
    kind = sized.schema["source"].dataType.simpleString()
    aims = spark.createDataFrame([(k, x, n, t, -(-rows[x] // PART_ROWS)) for k, (x, n, t) in enumerate(aims)], f"source_no long, source {kind}, source_size long, target double, n_parts long")

    placed = sized.alias("l").join(small(aims).alias("r"), F.col("l.source").eqNullSafe(F.col("r.source"))).drop(F.col("r.source"))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("row_key", F.lit(seed)), F.col("n_parts")))
    parts = placed.groupBy("source_no", "part").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source_no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut(parts.select("source_no", "part", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base")))
    within = Window.partitionBy("source_no", "part").orderBy("doc_id", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.join(small(parts), ["source_no", "part"]).withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.select("doc_id", "row_key", "source", "size", "source_no", "source_size", "target", "start")
    shards = spark.range(0, plan.n_shards if plan.slots.sum() else 0, 1, max(1, plan.n_shards // 32))
    slots = draw_slots(shards, plan)
    return placed, slots


def covered_blocks(placed: DataFrame, block_words: int) -> DataFrame:
    """A row for each document and block that it reaches into, with the words they share."""
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    spread = placed.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("start"), F.col("block") * block_words)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    return spread.withColumns({"low": low - F.col("start"), "high": high - F.col("start")})


def taken(docs: DataFrame, *, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """Words that the mix takes of each document, repeats counted.

    Returns ``doc_id, size, source_size, target, taken``, one row per row of ``docs``; documents without words
    take part with 0, a null source is a source of its own.
    """
    placed, slots = place(docs, block_words=block_words, seed=seed)
    times = slots.groupBy("source_no", "block").agg(F.count("*").alias("times")).hint("merge")
    key = ["doc_id", "row_key", "size", "source_no", "source_size", "target", "start"]
    spread = covered_blocks(placed, block_words).select(*key, "block", (F.col("high") - F.col("low")).alias("words"))
    used = spread.join(times, ["source_no", "block"], "left")
    sums = used.groupBy(*key).agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"))
    empty = placed.where("size = 0").select(*key, F.lit(0).cast("long").alias("taken"))
    return sums.unionByName(empty).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, *, block_words: int, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """The mix itself, as rows with the columns of ``docs``.

    Each row is a run of words of one document that one pass takes: blocks that follow one another in a pass
    stay together, so a document that a pass takes whole comes out unchanged.  ``n_chars``, where ``docs``
    has it, is the length of the run's text.  Documents without words are not in any block and go.
    """
    placed, slots = place(docs, block_words=block_words, weights=weights, share=share, cap=cap, seed=seed)
    spread = covered_blocks(placed, block_words).select("row_key", "source_no", "start", "block", "low", "high")
    hits = spread.join(slots.select("source_no", "block", "pass").hint("merge"), ["source_no", "block"])
    runs = hits.groupBy("row_key", "source_no", "start").agg(F.sort_array(F.collect_list(F.struct("pass", "low", "high"))).alias("runs"))
    whole = docs.select(F.struct(*columns(docs)).alias("row"), row_identity(docs).alias("row_key")).dropDuplicates(["row_key"])
    pieces_name = unused(docs, "runs")
    joined = whole.join(runs, "row_key").select("row.*", F.col("runs").alias(pieces_name))
    names, schema = docs.columns, docs.schema

    @kernels.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(low, ROWS_AT_ONCE) for whole in batches for low in range(0, len(whole), ROWS_AT_ONCE)):
            texts: list[str] = []
            origin: list[int] = []
            for i, (text, pieces) in enumerate(zip(batch.column("text"), batch.column(pieces_name), strict=True)):
                text = text.as_py()
                at = [m.start() for m in _word.finditer(text)]
                at[0] = 0
                at.append(len(text))
                for low, high in _joined(pieces.as_py()):
                    texts.append(text[at[low] : at[high]])
                    origin.append(i)
            out = batch.select(names).take(pa.array(origin, pa.int64()))
            out = out.set_column(names.index("text"), "text", pa.array(texts, out.schema.field("text").type))
            if "n_chars" in names:
                out = out.set_column(names.index("n_chars"), "n_chars", pa.array(list(map(len, texts)), out.schema.field("n_chars").type))
            yield out

    return joined.mapInArrow(run, schema)


def _joined(pieces: list[dict]) -> Iterator[tuple[int, int]]:
    """Word ranges of one document, sorted by pass and place, with neighbours of a pass joined."""
    held: list[int] = []
    for piece in pieces:
        if held and held[0] == piece["pass"] and held[2] == piece["low"]:
            held[2] = piece["high"]
            continue
        if held:
            yield held[1], held[2]
        held = [piece["pass"], piece["low"], piece["high"]]
    if held:
        yield held[1], held[2]
