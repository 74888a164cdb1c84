"""Near-duplicate classes by BagMinHash signatures (operator 5).

A text is the multiset of its five-word shingles; likeness is the weighted Jaccard index, the sum of the
smaller counts over the sum of the larger, and texts are near-duplicates from 0.8.

Signatures follow BagMinHash: every shingle owns Poisson processes over dyadic ranges of weight, 0 to 1, 1 to
2, 2 to 4 and so on, with a rate equal to the range's width; a point of a range has a cell in it, found by
halving, and counts for texts whose weight reaches that cell.  Each point belongs to one of the signature's
components at random, and a component keeps its earliest point.  Two texts agree in a component exactly as
often as their weighted Jaccard index says.  Only points earlier than the latest component matter, so a text
costs its number of shingles plus about ``m log m`` points.

Signatures are banded.  Within a bucket of a band every text is held against one pivot, by exact
multiset overlap; what that leaves apart is found in further rounds, see ``classes``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.llm import kernels
from codeweft.llm.frames import columns, cut, row_identity, small

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 5
#: Bits of each signature component in a sketch, and how many standard deviations of a sketch's distance are allowed.
SKETCH_BITS, DEVIATIONS = 4, 4.8
#: Pairs of texts held against each other in one go, which bounds memory.
PAIRS_AT_ONCE = 64
#: Pairs of one text, or texts of one residue token, that meet under one key on average; what has more is copied to more
#: keys.
PAIRS_PER_KEY = 1000
#: Rounds after the first; the last of them joins what is left by residues.
STAR_ROUNDS = 2


def bags(part: kernels.Slice, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of a slice's texts with their counts: hashes, texts, counts, ordered by text and hash.

    A text of 1 to ``width - 1`` words is one shingle; a text without words has none.
    """
    hashes, owner, _, _ = kernels.word_hashes(part)
    at, keys = kernels.windows(hashes, owner, width)
    owners = owner[at]
    words = kernels.per_text(owner, len(part))
    short = np.flatnonzero((words > 0) & (words < width))
    if len(short):
        first = np.searchsorted(owner, short)
        extra = np.array([_fold(hashes[a : a + n]) for a, n in zip(first, words[short], strict=True)], np.uint64)
        keys, owners = np.concatenate([keys, extra]), np.concatenate([owners, short])
    order = np.lexsort((keys, owners))
    keys, owners = keys[order], owners[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
    begin = np.flatnonzero(new)
    return keys[begin], owners[begin], np.diff(np.append(begin, len(keys)))


def _fold(hashes: np.ndarray) -> np.uint64:
    out = np.full(1, len(hashes), np.uint64)
    for h in hashes:
        out = kernels.mix64(out + h)
    return out[0]


def signatures(keys: np.ndarray, owners: np.ndarray, counts: np.ndarray, n: int, m: int = BANDS * ROWS) -> np.ndarray:
    """BagMinHash signatures of ``n`` bags as an ``n x m`` array of hashes; rows of empty bags are zero."""
    best = np.full((n, m), np.inf)
    mark = np.zeros((n, m), np.uint64)
    total = np.bincount(owners, weights=counts, minlength=n)
    limit = np.zeros(n)
    np.divide(m * (np.log(m) + 4.0), total, out=limit, where=total > 0)
    todo = total > 0
    while todo.any():
        use = todo[owners]
        _points(keys[use], owners[use], counts[use], limit, best, mark, m)
        todo = todo & ~np.isfinite(best).all(axis=1)
        best[todo], mark[todo] = np.inf, 0
        limit[todo] *= 2
    return mark


def _points(keys: np.ndarray, owners: np.ndarray, counts: np.ndarray, limit: np.ndarray, best: np.ndarray, mark: np.ndarray, m: int) -> None:
    """Draws each process's points up to its text's limit and keeps the earliest of each component."""
    level = 0
    while len(keys):
        width = 1 << max(0, level - 1)
        floor = 0 if level == 0 else width
        seed = kernels.mix64(keys + np.uint64(0xA0761D6478BD642F * (level + 1) & 2**64 - 1))
        time, live, step = np.zeros(len(keys)), np.arange(len(keys)), 0
        while len(live):
            step += 1
            bits = kernels.mix64(seed[live] + np.uint64(0xE7037ED1A0B428DB * step & 2**64 - 1))
            time[live] -= np.log(kernels.uniform(bits)) / width
            live_in = time[live] <= limit[owners[live]]
            live, bits = live[live_in], bits[live_in]
            if not len(live):
                break
            place = kernels.mix64(bits ^ np.uint64(0x8EBC6AF09C88C6E3))
            cell = floor + (place & np.uint64(width - 1)).astype(np.int64)
            hit = cell < counts[live]
            who, when = owners[live[hit]], time[live[hit]]
            slot = ((place[hit] >> np.uint64(32)) % np.uint64(m)).astype(np.int64)
            order = np.lexsort((when, slot, who))
            who, when, slot, code = who[order], when[order], slot[order], bits[hit][order]
            first = np.ones(len(who), bool)
            first[1:] = (who[1:] != who[:-1]) | (slot[1:] != slot[:-1])
            who, when, slot, code = who[first], when[first], slot[first], code[first]
            better = when < best[who, slot]
            best[who[better], slot[better]] = when[better]
            mark[who[better], slot[better]] = code[better]
        more = counts > floor + width if level else counts > 1
        keys, owners, counts = keys[more], owners[more], counts[more]
        level += 1


def _paired_bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of texts 0 and 1, 2 and 3, and so on: hashes, pairs, sides and counts, ordered by pair and hash."""
    found = [(keys, owners + part.first, counts) for part in kernels.slices(texts) for keys, owners, counts in [bags(part)]]
    keys, owners, counts = (np.concatenate(column) for column in zip(*found, strict=True))
    order = np.lexsort((keys, owners // 2))
    return keys[order], owners[order] // 2, owners[order] % 2, counts[order]


def likenesses(texts: pa.Array) -> np.ndarray:
    """Weighted Jaccard index of texts 0 and 1, 2 and 3, and so on; 0 where both are without words."""
    n = len(texts) // 2
    keys, pair, _, counts = _paired_bags(texts)
    total = np.bincount(pair, weights=counts, minlength=n)
    same = (keys[1:] == keys[:-1]) & (pair[1:] == pair[:-1])
    both = np.bincount(pair[1:][same], weights=np.minimum(counts[1:], counts[:-1])[same], minlength=n)
    return np.divide(both, total - both, out=np.zeros(n), where=total > 0)


def residues(texts: pa.Array, threshold: float) -> tuple[np.ndarray, ...]:
    """What texts 0, 2, 4, ... have over their pivots, texts 1, 3, 5, ..., or lack.

    Returned are the tokens' pairs, the tokens, and by pair the number of tokens, what it exceeds ``c * size`` by,
    how many tokens are short, how many are needed at all, and whether the text is linked to its pivot.  Texts differ by the size of their bags' difference; with
    ``c = (1 - threshold) / (1 + threshold)`` they are linked if that is at most ``c`` times the sum of their
    sizes.  With residues ``x`` and ``y`` against one pivot it is ``|x| + |y|`` less twice their overlap, so two
    texts are linked only if their residues overlap by half of ``|x| - c * size`` plus the same of ``y``.  In
    whatever order, sets that overlap by ``t`` share one of their first ``size - t + 1`` tokens.  A text that is
    not linked to the pivot has ``|x| > c * (size + pivot's size)``, hence these bounds: short tokens find
    partners that are not linked to the pivot, and a text that is not linked needs more tokens, which meet the
    short ones of linked texts.  Two texts linked to the pivot need not meet, and the pivot has no token.
    """
    n = len(texts) // 2
    keys, pair, side, counts = _paired_bags(texts)
    own, pivot = (np.bincount(pair[side == k], weights=counts[side == k], minlength=n) for k in (0, 1))
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (pair[1:] != pair[:-1])
    more = np.add.reduceat(np.where(side == 0, counts, -counts), np.flatnonzero(new)) if len(keys) else counts
    keys, pair = keys[new][more != 0], pair[new][more != 0]
    more = more[more != 0]
    times = np.abs(more)
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    lacks = np.repeat(more < 0, times).astype(np.uint64)
    tokens = kernels.mix64(np.repeat(keys, times) + np.uint64(0xD6E8FEB86659FD93) * (2 * nth + 1).astype(np.uint64) + lacks)
    pair = np.repeat(pair, times)
    size = np.bincount(pair, minlength=n)

    c = (1 - threshold) / (1 + threshold)
    excess = size - c * own
    linked = size <= c * (own + pivot) + 1e-9

    def first(overlap: np.ndarray) -> np.ndarray:
        return (size - np.maximum(1, np.ceil(overlap - 1e-9)) + 1).astype(np.int64)

    short = first((excess + c * pivot) / 2)
    within_reach = ~linked & (excess <= c * pivot + 2 * c * np.minimum(own, pivot) / threshold + 1e-9)
    return pair, tokens.view(np.int64), size, excess, short, np.where(within_reach, first((excess - c * pivot) / 2), short), linked


def _sketches(marks: np.ndarray) -> np.ndarray:
    """Some bits of every component of signatures, packed into longs."""
    per_word = 64 // SKETCH_BITS
    bits = np.pad(marks & np.uint64(2**SKETCH_BITS - 1), ((0, 0), (0, -marks.shape[1] % per_word)))
    bits = bits.reshape(len(marks), -(-marks.shape[1] // per_word), per_word) << (np.arange(per_word, dtype=np.uint64) * np.uint64(SKETCH_BITS))
    return np.bitwise_or.reduce(bits, axis=2).view(np.int64)


def _reach(m: int, threshold: float) -> int:
    """The largest distance in bits of sketches to be expected at ``threshold``; more comes about once in a million.

    A component that differs, with chance ``1 - threshold``, differs in a binomial number of its bits.
    """
    differs, k = 1 - threshold, SKETCH_BITS
    mean = differs * k / 2
    return round(m * mean + DEVIATIONS * (m * (differs * (k + k * k) / 4 - mean * mean)) ** 0.5)


def _signed(nodes: DataFrame, bands: int, rows: int) -> DataFrame:
    """``name, weight, keys, sketch`` for each row of ``name, text``; texts without words are left out.

    ``sketch`` is ``SKETCH_BITS`` bits of every signature component, 64 to a long.
    """

    @kernels.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.slices(batch.column("text")):
                shingles, owners, counts = bags(part)
                marks = signatures(shingles, owners, counts, len(part), bands * rows)
                weight = kernels.per_text(owners, len(part), counts).astype(np.int64)
                some = np.flatnonzero(weight)
                keys = np.empty((len(some), bands), np.uint64)
                for band in range(bands):
                    key = np.full(len(some), band + 1, np.uint64)
                    for row in range(rows):
                        key = kernels.mix64(key + marks[some, band * rows + row])
                    keys[:, band] = key
                values = pa.array(keys.view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * bands), values)
                name = batch.column("name").slice(part.first, len(part)).take(pa.array(some))
                sketches = _sketches(marks[some])
                sketch = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * sketches.shape[1]), pa.array(sketches.ravel()))
                yield pa.record_batch([name, pa.array(weight[some]), lists, sketch], names=["name", "weight", "keys", "sketch"])

    return nodes.mapInArrow(run, "name binary, weight long, keys array<long>, sketch array<long>")


def _with_text(rows: DataFrame, texts: DataFrame, node: str, text: str) -> DataFrame:
    """``rows`` with the text of their ``node``.

    A node of many rows, such as the pivot of a large group of copies, is copied to several keys, among which its
    rows are dealt, so that none of them meets all.
    """
    many = cut(rows.groupBy(node).agg(F.count("*").alias("n")).where(F.col("n") > PAIRS_PER_KEY).select(F.col(node).alias("many"), F.ceil(F.col("n") / PAIRS_PER_KEY).cast("int").alias("keys")))
    others = [F.col(c) for c in rows.columns if c != node]
    dealt = rows.join(small(many), F.col(node) == F.col("many"), "left").withColumn("deal", F.when(F.col("keys").isNull(), 0).otherwise(F.pmod(F.xxhash64(*others), F.col("keys")).cast("int"))).drop("many", "keys")
    copied = texts.select(F.col("node").alias(node), F.col("text").alias(text)).join(small(many), F.col(node) == F.col("many"), "left")
    copied = copied.withColumn("deal", F.explode(F.sequence(F.lit(0), F.coalesce("keys", F.lit(1)) - 1))).drop("many", "keys")
    return dealt.join(copied, [node, "deal"]).drop("deal")


def _compare(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Exact likeness of ``a, b`` pairs of nodes: ``a, b, likeness``."""
    pairs = cut(pairs)
    both = _with_text(_with_text(pairs, texts, "b", "text_b"), texts, "a", "text_a").select("a", "b", "text_a", "text_b")

    @kernels.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros(0)]
            for low in range(0, len(batch), PAIRS_AT_ONCE):
                part = batch.slice(low, PAIRS_AT_ONCE)
                sides = pa.concat_arrays([part.column("text_a"), part.column("text_b")])
                out.append(likenesses(sides.take(pa.array(np.arange(2 * len(part)).reshape(2, -1).T.ravel()))))
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(np.concatenate(out))], names=["a", "b", "likeness"])

    return both.mapInArrow(run, "a long, b long, likeness double")


def _meetings(groups: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``a, b`` of a pivot's texts of different components whose residues are alike enough to be linked.

    ``groups`` holds ``pivot, node, comp``.  Tokens are taken rarest first, so that what many copies have added
    or lack makes few pairs; the first token that a pair shares leaves room for an overlap of ``rest`` at most.
    """
    sides = _with_text(_with_text(groups.where("node <> pivot"), texts, "node", "text"), texts, "pivot", "pivot_text").select("pivot", "node", "comp", "text", "pivot_text")

    @kernels.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), PAIRS_AT_ONCE):
                part = batch.slice(low, PAIRS_AT_ONCE)
                both = pa.concat_arrays([part.column("text"), part.column("pivot_text")])
                pair, tokens, *bounds = residues(both.take(pa.array(np.arange(2 * len(part)).reshape(2, -1).T.ravel())), threshold)
                who = part.select(["pivot", "node", "comp"]).take(pa.array(pair))
                yield pa.record_batch([*who.columns, pa.array(tokens), *(pa.array(bound[pair]) for bound in bounds)], names=names)

    names = ["pivot", "node", "comp", "token", "size", "excess", "n_short", "n_needed", "linked"]
    tokens = cut(sides.mapInArrow(run, "pivot long, node long, comp long, token long, size long, excess double, n_short long, n_needed long, linked boolean"))
    often = tokens.groupBy("pivot", "token").agg(F.count("*").alias("often"))
    rarest = Window.partitionBy("pivot", "node").orderBy("often", "token")
    ranked = tokens.join(often, ["pivot", "token"]).withColumn("rank", F.row_number().over(rarest)).where("rank <= n_needed and often > 1")
    # A token of many texts is copied to several keys on one side, among which those of the other side are dealt.
    keys = F.ceil(F.col("often") / PAIRS_PER_KEY).cast("int")
    tokens = cut(ranked.select("pivot", "node", "comp", "token", "linked", "excess", F.expr("size - rank + 1").alias("rest"), F.expr("rank <= n_short").alias("short"), keys.alias("keys")))
    l = tokens.where("short").withColumn("deal", F.pmod(F.xxhash64("node"), F.col("keys")).cast("int")).alias("l")
    r = tokens.where("not linked").withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("keys") - 1))).alias("r")
    meet = (F.col("l.pivot") == F.col("r.pivot")) & (F.col("l.token") == F.col("r.token")) & (F.col("l.deal") == F.col("r.deal")) & (F.col("l.comp") != F.col("r.comp"))
    once = F.col("l.linked") | (F.col("r.short") & (F.col("l.node") < F.col("r.node")))
    enough = F.least("l.rest", "r.rest") >= (F.col("l.excess") + F.col("r.excess")) / 2 - 1e-9
    return l.join(r, meet & once & enough).select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, comp`` for the nodes of ``a, b`` links: the smallest node of each connected component.

    Labels move along links and then jump to their labels' labels, which halves the way to go each round.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")))
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        near = labels.join(seen.withColumnRenamed("a", "node"), "node", "left").select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("comp").alias("top"))
        after = cut(near.join(jump, "near", "left").select("node", "old", F.least("near", "top").alias("comp")))
        labels = after.select("node", "comp")
        if after.where("old <> comp").isEmpty():
            return labels


def name_of(text: Column) -> Column:
    """A text's name: 128 hash bits."""
    return F.unhex(F.md5(text))


def classes(docs: DataFrame, **options) -> DataFrame:
    """``name, comp``: the class of every text that has a near-duplicate, by the text's ``name_of``; see ``linked_classes``."""
    return linked_classes(docs, **options)[0]


def linked_classes(docs: DataFrame, *, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """The class of every text that has a near-duplicate, ``name, comp``, and the links that were verified on the way,
    ``name, other, likeness``, each both ways; texts go by their ``name_of``.

    Copies of one text are one node from the start.  Round one holds each bucket's texts against its pivot, the
    text that meets most others over all bands, which in a group of copies is the likeliest original.  A
    further round takes the buckets whose texts are still in several components and holds one more of their
    texts, unlike the pivot, against those of other components.  At last the texts of a pivot that are in
    different components are joined by what sets them apart from it, see ``residues``; no pair that could
    reach ``threshold`` is left out.  No round
    compares texts whose signatures agree too seldom.  So the
    components are those of all pairs that share a bucket and reach ``threshold``; a pair at 0.8 shares none of
    32 bands of 5 with a chance of 3 in a million.
    """
    named = docs.where(F.col("text").isNotNull()).select(name_of(F.col("text")).alias("name"), "text")
    # Nodes are numbered before they are written, so the numbers stay as they are.
    signed = cut(_signed(named, bands, rows).dropDuplicates(["name"]).withColumn("node", F.monotonically_increasing_id()))
    labels, links = _labels(named, signed, threshold, bands, rows)
    names = signed.select("node", "name")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "likeness"))
    both = both.join(names.select(F.col("node").alias("a"), "name"), "a").join(names.select(F.col("node").alias("b"), F.col("name").alias("other")), "b")
    return labels.join(names, "node").select("name", "comp"), both.select("name", "other", "likeness")


def _labels(named: DataFrame, signed: DataFrame, threshold: float, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """``node, comp`` for the nodes of ``signed`` that are linked to others, and the links ``a, b, likeness``."""
    placed = signed.select("node", "weight", F.explode("keys").alias("key"))
    sizes = placed.groupBy("key").agg(F.count("*").alias("n"))
    members = cut(placed.join(cut(sizes.where("n > 1")), "key"))
    met = members.groupBy("node").agg(F.sum("n").alias("met"))
    members = cut(members.join(met, "node"))
    pivots = members.groupBy("key").agg(F.max(F.struct("met", "node", "weight")).alias("p"))
    pivots = cut(pivots.select("key", F.col("p.node").alias("pivot"), F.col("p.weight").alias("pivot_weight")))
    members = cut(members.join(pivots, "key"))
    wanted = cut(members.select("node").distinct().join(signed.select("node", "name"), "node"))
    texts = cut(named.join(small(wanted), "name").select("node", "text").dropDuplicates(["node"]))

    def heavy_enough(a: str, b: str):
        """The lighter bag bounds the overlap, the heavier one the union."""
        return F.least(a, b) >= F.greatest(a, b) * threshold

    def agree(a: str, b: str) -> Column:
        longs = range(-(-bands * rows * SKETCH_BITS // 64))
        return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in longs), F.lit(0)) <= _reach(bands * rows, threshold)

    def agreeing(pairs: DataFrame) -> DataFrame:
        left = signed.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a"))
        right = signed.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b"))
        return pairs.distinct().join(left, "a").join(right, "b").where(agree("sketch_a", "sketch_b")).select("a", "b")

    def linked(pairs: DataFrame) -> DataFrame:
        return cut(_compare(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), texts))

    star = members.where((F.col("node") != F.col("pivot")) & heavy_enough("weight", "pivot_weight"))
    known = linked(agreeing(star.select(F.col("pivot").alias("a"), F.col("node").alias("b"))))
    links = known.where(F.col("likeness") >= threshold).select("a", "b")
    labels = components(links)
    both_ways = known.select(F.col("a").alias("pivot"), F.col("b").alias("node"), "likeness").unionByName(known.select(F.col("b").alias("pivot"), F.col("a").alias("node"), "likeness"))
    members = members.where("n > 2").join(both_ways, ["pivot", "node"], "left")
    members = cut(members.withColumn("likeness", F.when(F.col("node") == F.col("pivot"), 1.0).otherwise(F.col("likeness"))))

    for turn in range(STAR_ROUNDS):
        colored = members.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        span = cut(colored.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high"))
        if span.isEmpty():
            break
        open_members = cut(colored.join(span.select("key"), "key"))
        if turn == STAR_ROUNDS - 1:
            groups = cut(open_members.select("pivot", "node", "comp").distinct())
            pairs = agreeing(_meetings(groups, texts, threshold))
        else:
            next_pivot = F.max(F.struct(F.coalesce(F.col("likeness"), F.lit(0.0)) < threshold, "met", "node", "weight", "comp"))
            second = cut(open_members.groupBy("key").agg(next_pivot.alias("p")).select("key", F.col("p.node").alias("a"), F.col("p.weight").alias("w"), F.col("p.comp").alias("c")))
            pairs = open_members.join(second, "key").where((F.col("comp") != F.col("c")) & heavy_enough("weight", "w"))
            pairs = agreeing(pairs.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")))
        found = linked(pairs.join(known.select("a", "b"), ["a", "b"], "left_anti"))
        known = cut(known.unionByName(found))
        if not found.where(F.col("likeness") >= threshold).isEmpty():
            links = cut(links.unionByName(found.where(F.col("likeness") >= threshold).select("a", "b")))
            labels = components(links)
    return labels, known.where(F.col("likeness") >= threshold)


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, class_id, verified_links, linked_id, likeness`` for each row of ``docs``.

    ``class_id`` is the smallest ``doc_id`` of the class.  ``verified_links`` counts the unlike texts that the row's text
    was found near by exact comparison, at least one in a class of unlike texts; ``linked_id`` is the smallest ``doc_id``
    of the likest of them, of several the smallest, and ``likeness`` that text's.  A class's links connect it; pairs that
    it holds together without having been compared aren't counted.

    Null texts are in no class with others: their ``class_id`` is their own ``doc_id``.  Texts without words
    are alike only if they are equal.  Repeated rows are in one class, and each is returned.  Texts of any length are
    compared whole; an empty table gives no rows; other columns are ignored.
    """
    plain = docs.select("doc_id", "text")
    labels, links = linked_classes(plain, **options)
    ids = plain.select("doc_id", name_of(F.col("text")).alias("name")).join(labels, "name", "left")
    ids = cut(ids.select("doc_id", "name", "comp"))
    in_class = ids.where(F.col("comp").isNotNull())
    first = in_class.groupBy(F.col("name").alias("other")).agg(F.min("doc_id").alias("first_id"))
    best = F.min(F.struct((-F.col("likeness")).alias("far"), F.col("first_id").isNull().alias("nameless"), "first_id")).alias("best")
    nearest = cut(links.join(first, "other").groupBy(F.col("name").alias("near_name")).agg(F.count("*").alias("verified_links"), best))
    ids = ids.select("doc_id", F.when(F.col("comp").isNull(), F.col("name")).alias("name"), "comp", F.when(F.col("comp").isNotNull(), F.col("name")).alias("own"))
    known = F.col("comp").isNotNull() | F.col("name").isNotNull()
    smallest = cut(ids.where(known).groupBy("comp", "name").agg(F.min("doc_id").alias("class_id")))
    same = F.col("l.comp").eqNullSafe(F.col("r.comp")) & F.col("l.name").eqNullSafe(F.col("r.name"))
    class_id = F.when(F.col("l.comp").isNull() & F.col("l.name").isNull(), F.col("l.doc_id")).otherwise(F.col("r.class_id"))
    placed = ids.alias("l").join(smallest.alias("r"), same, "left").select("l.doc_id", "l.own", class_id.alias("class_id"))
    shown = placed.join(nearest, F.col("own") == F.col("near_name"), "left")
    return shown.select("doc_id", "class_id", F.coalesce("verified_links", F.lit(0)).cast("long").alias("verified_links"), F.col("best.first_id").alias("linked_id"), (-F.col("best.far")).alias("likeness"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class the row with the smallest ``doc_id`` stays, of
    equal ids one by a hash of the row.

    Null texts stay, but repeated rows are cut to one.  Texts of any length are compared whole.
    """
    row, name = row_identity(docs), name_of(F.col("text"))
    labels = classes(docs.select("text"), **options)
    ids = docs.select(name.alias("name"), F.col("doc_id").alias("id"), row.alias("row")).join(labels, "name", "left")
    # A null text is a class of its own, by its row.
    group = [F.col("comp"), F.when(F.col("comp").isNull(), F.col("name")), F.when(F.col("name").isNull(), F.col("row"))]
    kept = ids.groupBy(*(c.alias(f"g{k}") for k, c in enumerate(group))).agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("best"))
    whole = docs.select(F.struct(*columns(docs)).alias("doc"), row.alias("row"))
    return whole.join(kept.select(F.col("best.row").alias("row")), "row", "left_semi").dropDuplicates(["row"]).select("doc.*")
