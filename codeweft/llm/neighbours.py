"""Nearest neighbours by shifted space-filling curves (operator 7).

Vectors are scaled to length one and projected, by several random rotations, to a few dimensions, which are brought
to one scale by their mean and deviation over all rows, shifted at random and put in Hilbert order.  Spark
range-partitions the rows of all curves by key; along each curve every ``BLOCK_ROWS`` rows are a block.  A query is
held against the blocks around its own on each curve: in single precision, and exactly where that leaves it among the
nearest.  What the curves find is merged by the exact cosine, ties by the smallest id.

How many blocks to each side are searched is fitted: for a bounded sample of the queries the true neighbours are
found by brute force, and the window is the smallest in which the curves together have the share ``TARGET`` of them.
So the window follows the data: a few blocks where vectors lie near a surface of few dimensions or in clusters, and
many where they fill all dimensions evenly, as no order of such vectors keeps neighbours together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.llm import kernels
from codeweft.llm.frames import cut, identity, small

CURVES = 8
DIMENSIONS, BITS = 8, 7
BLOCK_ROWS = 256
#: Blocks of queries that meet a block of rows in one go.
GROUP = 64
#: Queries whose true neighbours the window is fitted to, at most, and the share of these that it must find.
SAMPLE_QUERIES, TARGET = 256, 0.97
#: Queries whose finds a task holds before it passes them on.
HELD_QUERIES = 20_000
#: How far a cosine in single precision is from the exact one at most, by the number of components.
SINGLE = 2.0**-23
SEED = 7


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of cells given as rows of ``bits``-bit integers (Skilling's transform)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> bit & 1)
    return key


def projections(size: int) -> np.ndarray:
    """For vectors of this size, the axes of each curve as a ``curves x size x axes`` array."""
    rng = np.random.default_rng([SEED, size])
    return np.stack([np.linalg.qr(rng.normal(size=(size, size)))[0][:, :DIMENSIONS] for _ in range(CURVES)])


def curve_keys(unit: np.ndarray, mean: np.ndarray, deviation: np.ndarray) -> np.ndarray:
    """Keys of unit vectors, a row for each curve; ``mean`` and ``deviation`` are those of each curve's axes."""
    shift = np.random.default_rng([SEED, unit.shape[1], 1]).uniform(-0.5, 0.5, mean.shape)
    out = []
    for axes, m, d, s in zip(projections(unit.shape[1]), mean, deviation, shift, strict=True):
        place = (unit @ axes - m) / np.where(d > 0, d, 1) + s
        cells = np.clip((place + 3.5) / 7 * (1 << BITS), 0, (1 << BITS) - 1)
        out.append(hilbert(cells.astype(np.int64), BITS))
    return np.stack(out)


def _by_size(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a list column and their places, vectors of one size at a time."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(lengths):
        at = np.flatnonzero(lengths == size)
        some = column.take(pa.array(at))
        yield at, some.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), -1)


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1)[:, None]  # so that squares stay finite
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of paired rows, in double precision, summed alike wherever the rows stand."""
    norms = np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b))
    return np.einsum("ij,ij->i", a, b) / norms


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, embedding`` (doubles) of the vectors that take part.

    Left out are null ids, null, zero or empty vectors, and vectors with null or non-finite components.
    """
    v = F.col("embedding")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))


def directed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``embedding`` brought to a largest component in [1, 2) by a power of two.

    This changes no cosine, not even its rounding, and makes vectors that differ by such a factor equal.
    """
    v = F.col("embedding")
    most = F.array_max(F.transform(v, F.abs))

    def times(df: DataFrame, factor: Column) -> DataFrame:
        return df.withColumn("__factor", factor).withColumn("embedding", F.transform(v, lambda x: x * F.col("__factor"))).drop("__factor")

    tame = F.when(most > 1e300, 2.0**-600).when(most < 1e-300, 2.0**600).otherwise(1.0)
    near = F.pow(F.lit(2.0), -F.floor(F.log2(most)))  # twice or half the right one, where the logarithm is rounded over an integer
    right = F.when(most >= 2, 0.5).when(most < 1, 2.0).otherwise(1.0)
    return times(times(times(rows, tame), near), right)


def search(vectors: DataFrame, *, k: int = 5, every: int = 50, target: float = TARGET, window: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found of each row whose id is divisible by ``every``.

    Nearness is the cosine; ties go to the smaller id; all rows are given if there are fewer.  Rows with the
    query's own id are never given.  Vectors meet those of their own size only.  Vectors that are equal but for a power
    of two, such as repeated rows, are one node that is searched once and keeps its ``k + 1`` smallest ids, which are all
    that can be among a result; nodes of one score count by their smallest id, however many there are.  Other columns
    are ignored; an empty table gives no rows.  ``window``, in blocks to each side, is fitted unless it is given.
    """
    rows = cut(directed(usable(vectors)).withColumn("node", identity(F.col("embedding"))))
    is_query = F.col("vec_id") % every == 0
    nodes = cut(rows.groupBy("node").agg(F.first("embedding").alias("embedding"), F.max(is_query).alias("asks"), F.min("vec_id").alias("least")))
    blocks = _blocks(nodes)
    if window is None:
        window = _fitted_window(nodes, blocks, k, target)
    scored = cut(_best(_along_curves(blocks, window, k + 1), k + 1))
    smallest = Window.partitionBy("node").orderBy("vec_id")
    ids = rows.select("node", "vec_id").withColumn("place", F.row_number().over(smallest)).where(F.col("place") <= k + 1).drop("place")
    named = scored.drop("least").join(ids, "node").select("asker", "score", "vec_id").distinct()
    order = Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id")
    named = named.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).drop("place")
    queries = rows.where(is_query).select(F.col("node").alias("asker"), F.col("vec_id").alias("query_id")).distinct()
    own = queries.join(named, "asker").where(F.col("vec_id") != F.col("query_id"))
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return own.select("query_id", F.row_number().over(rank).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _axes(nodes: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Mean and deviation of every curve's axes over all nodes, by the vectors' size."""

    @kernels.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, rows in _by_size(batch.column("embedding")):
                place = np.einsum("ij,cjk->ick", _unit(rows), projections(rows.shape[1])).reshape(len(rows), -1)
                own = np.stack([np.full(place.shape[1], len(rows)), place.sum(axis=0), (place**2).sum(axis=0)])
                sums[rows.shape[1]] = sums.get(rows.shape[1], 0) + own
        for size, (n, x, xx) in sums.items():
            yield pa.record_batch([pa.array(np.full(len(n), size)), pa.array(np.arange(len(n))), pa.array(n), pa.array(x), pa.array(xx)], names=["size", "axis", "n", "x", "xx"])

    sums = nodes.select("embedding").mapInArrow(run, "size long, axis long, n double, x double, xx double").groupBy("size", "axis").agg(F.sum("n").alias("n"), F.sum("x").alias("x"), F.sum("xx").alias("xx"))
    out = {}
    for size, own in sums.toPandas().sort_values("axis").groupby("size"):
        mean = (own["x"] / own["n"]).to_numpy().reshape(CURVES, -1)
        spread = np.sqrt(np.maximum(0, (own["xx"] / own["n"]).to_numpy().reshape(CURVES, -1) - mean**2))
        out[int(size)] = mean, spread
    return out


def _blocks(nodes: DataFrame) -> DataFrame:
    """The nodes in blocks along every curve: ``size, curve, block, names, ids, asks, packed``.

    ``names``, ``ids`` (the nodes' smallest) and ``asks`` are lists; ``packed`` are the vectors, in single precision if
    that holds all of the block exactly, else in double.  Blocks are numbered in order within a curve and size.
    """
    axes = _axes(nodes)

    @kernels.released
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows in _by_size(batch.column("embedding")):
                unit = _unit(rows)
                own = batch.take(pa.array(at))
                vectors = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * rows.shape[1]), len(at), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())
                short = (rows == rows.astype(np.float32)).all(axis=1)
                singles = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * rows.shape[1]), len(at), [None, pa.py_buffer(rows.astype(np.float32).tobytes())]).cast(pa.binary())
                vectors = pc.if_else(pa.array(short), singles, vectors)
                size = pa.array(np.full(len(at), rows.shape[1], np.int32))
                for curve, key in enumerate(curve_keys(unit, *axes[rows.shape[1]])):
                    yield pa.record_batch([own.column("node"), own.column("least"), own.column("asks"), vectors, size, pa.array(np.full(len(at), curve, np.int32)), pa.array(key)], names=["node", "least", "asks", "vector", "size", "curve", "key"])

    @kernels.released
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held = TaskContext.get().partitionId(), 0, []

        def block(rows: pa.Table, line: tuple[int, int]) -> pa.RecordBatch:
            columns = [pa.array([x], t) for x, t in ((part, pa.int32()), (number, pa.int32()), (line[0], pa.int32()), (line[1], pa.int32()))]
            lists = [pa.array([rows.column(c).to_pylist()]) for c in ("node", "least", "asks")]
            return pa.record_batch([*columns, *lists, pa.array([_packed(rows.column("vector").to_pylist(), line[0])], pa.binary())], names=["part", "number", "size", "curve", "names", "ids", "asks", "packed"])

        now = None
        for batch in batches:
            size, curve = (batch.column(c).to_numpy() for c in ("size", "curve"))
            edges = np.flatnonzero((np.diff(size) != 0) | (np.diff(curve) != 0)) + 1
            for low, high in zip([0, *edges], [*edges, len(batch)], strict=True):
                if low == high:
                    continue
                line = int(size[low]), int(curve[low])
                if line != now and held:
                    yield block(pa.Table.from_batches(held), now)
                    number, held = number + 1, []
                now = line
                while low < high:
                    take = min(high - low, BLOCK_ROWS - sum(map(len, held)))
                    held.append(batch.slice(low, take))
                    low += take
                    if sum(map(len, held)) == BLOCK_ROWS:
                        yield block(pa.Table.from_batches(held), now)
                        number, held = number + 1, []
        if held:
            yield block(pa.Table.from_batches(held), now)

    on_curves = nodes.mapInArrow(keyed, "node string, least long, asks boolean, vector binary, size int, curve int, key long")
    ordered = on_curves.repartitionByRange("size", "curve", "key").sortWithinPartitions("size", "curve", "key")
    blocks = cut(ordered.mapInArrow(packed, "part int, number int, size int, curve int, names array<string>, ids array<long>, asks array<boolean>, packed binary"))
    # A number for each part of a line of blocks; there are as many as shuffle partitions.
    parts = blocks.groupBy("size", "curve", "part").agg(F.count("*").alias("n"), F.min("number").alias("first"))
    earlier = Window.partitionBy("size", "curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("size", "curve", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("base"))
    return cut(blocks.join(small(cut(parts)), ["size", "curve", "part"]).withColumn("block", F.col("base") + F.col("number")).select("size", "curve", "block", "names", "ids", "asks", "packed"))


def _fitted_window(nodes: DataFrame, blocks: DataFrame, k: int, target: float) -> int:
    """The smallest window, in blocks to each side, that finds the share ``target`` of the sample's neighbours."""
    chosen = nodes.where("asks").orderBy(F.xxhash64("node"), "node").limit(SAMPLE_QUERIES).collect()
    asked: dict[int, tuple[list[str], np.ndarray]] = {}
    for size in {len(r["embedding"]) for r in chosen}:
        own = [r for r in chosen if len(r["embedding"]) == size]
        asked[size] = [r["node"] for r in own], _unit(np.array([r["embedding"] for r in own], float))

    @kernels.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Held(k)
        for batch in batches:
            node = np.array(batch.column("node").to_pylist(), object)
            for at, rows in _by_size(batch.column("embedding")):
                if rows.shape[1] in asked:
                    names, units = asked[rows.shape[1]]
                    least = batch.column("least").to_numpy()[at]
                    scores = units @ _unit(rows).T
                    scores[np.array(names, object)[:, None] == node[at][None, :]] = -3
                    best.add(np.array(names, object), node[at], least, scores)
        yield from best.batches()

    true = _best(nodes.select("node", "embedding", "least").mapInArrow(run, _FIND), k).select("asker", "node").collect()
    wanted = {r[c] for r in true for c in ("asker", "node")}

    @kernels.released
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for curve, block, names in zip(batch.column("curve").to_pylist(), batch.column("block").to_pylist(), batch.column("names").to_pylist(), strict=True):
                some = [x for x in names if x in wanted]
                yield pa.record_batch([pa.array(some, pa.string()), pa.array([curve] * len(some), pa.int32()), pa.array([block] * len(some), pa.int64())], names=["node", "curve", "block"])

    at: dict[str, np.ndarray] = {}
    for r in blocks.select("curve", "block", "names").mapInArrow(places, "node string, curve int, block long").collect():
        at.setdefault(r["node"], np.zeros(CURVES, np.int64))[r["curve"]] = r["block"]
    apart = np.sort([np.abs(at[r["asker"]] - at[r["node"]]).min() for r in true])
    return int(apart[min(len(apart) - 1, int(np.ceil(target * len(apart))) - 1)]) if len(apart) else 0


_FIND = "asker string, node string, least long, score double"


class _Held:
    """The best finds of some queries, by score, then the nodes' smallest id; a pair that is found again counts once."""

    def __init__(self, keep: int):
        self.keep, self.found = keep, {}

    def add(self, askers: np.ndarray, nodes: np.ndarray, ids: np.ndarray, scores: np.ndarray, slack: float = 0.0, exact: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> None:
        """``scores`` has a row for each asker and a column for each node; below -2 they don't count.

        Where they may be off by ``slack``, ``exact`` gives the scores of pairs of rows and columns that may be among the
        best.
        """
        k = min(self.keep, scores.shape[1])
        floor = np.array([self._least(x) for x in askers.tolist()])
        near = np.maximum(np.partition(scores, -k, axis=1)[:, -k], floor) - 2 * slack
        row, column = np.nonzero((scores >= near[:, None]) & (scores > -2))
        values = scores[row, column] if exact is None else exact(row, column)
        begin = np.searchsorted(row, np.arange(len(askers) + 1))
        for i in np.flatnonzero(np.diff(begin)).tolist():
            own = slice(begin[i], begin[i + 1])
            order = np.lexsort((ids[column[own]], -values[own]))[: self.keep]
            at, best = column[own][order], self.found.setdefault(askers[i], {})
            best.update(zip(nodes[at].tolist(), zip((-values[own][order]).tolist(), ids[at].tolist(), strict=True), strict=True))
            if len(best) > self.keep:
                self.found[askers[i]] = dict(sorted(best.items(), key=lambda x: x[1])[: self.keep])

    def _least(self, asker: str) -> float:
        best = self.found.get(asker, {})
        return -max(best.values())[0] if len(best) >= self.keep else -np.inf

    def batches(self) -> Iterator[pa.RecordBatch]:
        rows = [(asker, node, least, -score) for asker, best in self.found.items() for node, (score, least) in best.items()]
        self.found = {}
        if rows:
            askers, nodes, ids, scores = zip(*rows, strict=True)
            yield pa.record_batch([pa.array(askers), pa.array(nodes), pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], names=["asker", "node", "least", "score"])


def _best(found: DataFrame, keep: int) -> DataFrame:
    """``asker, node, least, score``: the ``keep`` best finds of each asker."""
    once = found.groupBy("asker", "node").agg(F.max("least").alias("least"), F.max("score").alias("score"))
    order = Window.partitionBy("asker").orderBy(F.desc("score"), "least", "node")
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep).drop("place")


def _packed(vectors: list[bytes], size: int) -> bytes:
    """Vectors in a row, each of them in single or double precision, as doubles if any of them is."""
    if all(len(v) == 4 * size for v in vectors):
        return b"".join(vectors)
    return b"".join(v if len(v) == 8 * size else np.frombuffer(v, np.float32).astype(np.float64).tobytes() for v in vectors)


def _vectors(packed: pa.Scalar, n: int, size: int) -> np.ndarray:
    """``n`` packed vectors as doubles."""
    buffer = packed.as_buffer()
    return np.frombuffer(buffer, np.float32 if buffer.size == 4 * n * size else np.float64).reshape(n, size).astype(np.float64)


def _along_curves(blocks: DataFrame, window: int, keep: int) -> DataFrame:
    """``asker, node, least, score`` of the blocks around each query's, with exact scores.

    The queries of a block go to all blocks of the window, ``GROUP`` such blocks to a row; what a row holds doesn't
    grow with the window.
    """
    asking = blocks.where(F.exists("asks", lambda x: x)).select("size", "curve", "block", "names", "asks", "packed")

    @kernels.released
    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, vectors = [], []
            for i, size in enumerate(batch.column("size").to_pylist()):
                use = np.flatnonzero(batch.column("asks")[i].values.to_numpy(zero_copy_only=False))
                own = batch.column("names")[i].as_py()
                names.append([own[j] for j in use.tolist()])
                packed = np.frombuffer(batch.column("packed")[i].as_buffer(), np.uint8).reshape(len(own), -1)
                vectors.append(packed[use].tobytes())
            yield pa.record_batch([*batch.select(["size", "curve", "block"]).columns, pa.array(names, pa.list_(pa.string())), pa.array(vectors, pa.binary())], names=["size", "curve", "block", "askers", "asked"])

    asking = asking.mapInArrow(asks, "size int, curve int, block long, askers array<string>, asked binary")
    sent = asking.withColumn("group", F.floor(F.col("block") / GROUP)).withColumn("to", F.explode(F.sequence(F.col("block") - window, F.col("block") + window)))
    met = sent.groupBy("size", "curve", F.col("to").alias("block"), "group").agg(F.collect_list(F.struct("askers", "asked")).alias("asking"))
    pairs = met.join(blocks.select("size", "curve", "block", "names", "ids", "packed"), ["size", "curve", "block"])

    @kernels.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Held(keep)
        for batch in batches:
            for i, size in enumerate(batch.column("size").to_pylist()):
                names, groups = batch.column("names")[i].as_py(), batch.column("asking")[i]
                askers = [x["askers"].as_py() for x in groups]
                asked = np.concatenate([_vectors(x["asked"], len(own), size) for x, own in zip(groups, askers, strict=True)])
                rows = _vectors(batch.column("packed")[i], len(names), size)
                scores = _unit(asked).astype(np.float32) @ _unit(rows).astype(np.float32).T
                ids = batch.column("ids")[i].values.to_numpy()
                best.add(np.array([x for own in askers for x in own], object), np.array(names, object), ids, scores, (size + 4) * SINGLE, lambda a, b, asked=asked, rows=rows: cosine(asked[a], rows[b]))
                if len(best.found) > HELD_QUERIES:
                    yield from best.batches()
        yield from best.batches()

    return pairs.mapInArrow(run, _FIND)
