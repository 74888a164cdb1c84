"""Base quality rules and host verdicts (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeweft.llm import kernels
from codeweft.llm.frames import cut, small

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: A host loses all its documents if the odds of its shrunken failure rate are more than so many times those of
#: the prior's mean, and the rate is above the floor.
HOST_ODDS, HOST_FLOOR = 8.0, 0.25
#: Prior strengths (in documents) allowed to the fitted beta distribution.
STRENGTH = (2.0, 1000.0)

RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def measure(part: kernels.Slice) -> dict[str, np.ndarray]:
    """The five counts of each text of a slice."""
    n, data, offsets = len(part), part.data, part.offsets
    hashes, owner, starts, ends = kernels.word_hashes(part)
    out = {"n_words": kernels.per_text(owner, n)}

    head = np.zeros(len(data) + 1, np.int64)  # code points before each byte
    np.cumsum((data & 0xC0) != 0x80, out=head[1:])
    out["word_chars"] = kernels.per_text(owner, n, head[ends] - head[starts]).astype(np.int64)

    symbols = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_SYMBOLS[data], out=symbols[1:])
    out["n_symbols"] = symbols[offsets[1:]] - symbols[offsets[:-1]]

    line_starts, line_ends, line_owner = part.runs(data != 0x0A)
    with_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, line_owner = line_starts[with_word], line_ends[with_word], line_owner[with_word]
    keys = kernels.RangeHash(data)(line_starts, line_ends)
    distinct = _distinct(line_owner, keys)
    out["n_dup_lines"] = kernels.per_text(line_owner, n) - kernels.per_text(line_owner[distinct], n)

    at, keys = kernels.windows(hashes, owner, WINDOW)
    order = np.lexsort((keys, owner[at]))
    same = (keys[order][1:] == keys[order][:-1]) & (owner[at][order][1:] == owner[at][order][:-1])
    twice = np.zeros(len(at), bool)
    twice[1:] |= same
    twice[:-1] |= same
    marked = at[order][twice]
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, marked, 1)
    np.add.at(cover, marked + WINDOW, -1)
    covered = np.cumsum(cover)[:-1] > 0
    out["n_repeat_words"] = kernels.per_text(owner[covered], n)
    return out


def _distinct(owner: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """One position for each (owner, key)."""
    order = np.lexsort((keys, owner))
    first = np.ones(len(order), bool)
    first[1:] = (keys[order][1:] != keys[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    return order[first]


def with_counts(docs: DataFrame, carry: Sequence[str] | None = None) -> DataFrame:
    """``docs``, or its columns in ``carry``, with the columns of ``RULES`` and ``base_failed`` added; they replace
    columns of these names.

    Null texts have no words and so fail.
    """
    plain = docs.drop(*RULES, "base_failed")
    schema = ", ".join(f"{name} long" for name in RULES)
    names = plain.columns if carry is None else list(carry)

    @kernels.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.select(names)
            for part in kernels.slices(batch.column("text")):
                counts = measure(part)
                yield pa.RecordBatch.from_arrays([*own.slice(part.first, len(part)).columns, *(pa.array(counts[name], pa.int64()) for name in RULES)], names=[*names, *RULES])

    out = T.StructType([*(plain.schema[c] for c in names), *T.StructType.fromDDL(schema).fields])
    words = F.col("n_words")
    failed = (words < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * words)
    return plain.select(*dict.fromkeys([*names, "text"])).mapInArrow(run, out).withColumn("base_failed", failed)


def host_verdicts(per_host: DataFrame, *, odds: float = HOST_ODDS, floor: float = HOST_FLOOR) -> DataFrame:
    """``host, n, failed`` to ``host, n, failed, rate, host_failed``.

    The failure rates of the hosts are taken as draws of one beta distribution, fitted by moments over hosts
    (each weighing alike, the binomial part of their variance taken off); ``rate`` is the posterior mean.
    A host fails whose rate is above ``floor`` and stands out against the prior: the odds of its rate are more than
    ``odds`` times those of the prior's mean.  A null host is a host of its own.
    """
    share = F.col("failed") / F.col("n")
    m, v, inverse = per_host.agg(F.avg(share), F.var_pop(share), F.avg(1 / F.col("n"))).first()
    m, v, inverse = m or 0.0, v or 0.0, 1.0 if inverse is None else inverse
    spread = m * (1 - m)
    between = (v - spread * inverse) / (1 - inverse) if inverse < 1 else 0.0
    strength = min(max(spread / between - 1, STRENGTH[0]), STRENGTH[1]) if between > 0 else STRENGTH[1]
    rate = (F.col("failed") + F.lit(m * strength)) / (F.col("n") + F.lit(strength))
    limit = max(floor, odds * m / (1 - m + odds * m))
    return per_host.select("host", "n", "failed", rate.alias("rate"), (rate > limit).alias("host_failed"))


def judge(docs: DataFrame, *, host: str = "source", carry: Sequence[str] | None = None, odds: float = HOST_ODDS, floor: float = HOST_FLOOR) -> DataFrame:
    """``docs``, or its columns in ``carry``, with its counts, ``base_failed`` and ``kept`` (false if the text or
    its whole host failed); all these replace columns of their names.

    Every text is measured once, whole, and written with its counts, from which the hosts are judged; so
    ``carry`` saves writing what isn't needed.  Repeated rows count as often as they occur and each is returned.  An
    empty table gives no rows.
    """
    plain = docs.drop("kept")
    carried = plain.columns if carry is None else list(carry)
    counted = cut(with_counts(plain, [c for c in dict.fromkeys([*carried, host]) if c not in (*RULES, "base_failed")]))
    hosts = cut(counted.groupBy(F.col(f"`{host}`").alias("host")).agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed")))
    bad = host_verdicts(hosts, odds=odds, floor=floor).where("host_failed").select(F.struct("host").alias("bad"))
    joined = counted.alias("l").join(small(bad).alias("r"), F.col(f"l.`{host}`").eqNullSafe(F.col("r.bad.host")), "left")
    kept = ~F.col("l.base_failed") & F.col("r.bad").isNull()
    return joined.select(*[F.col(f"l.`{c}`") for c in counted.columns if c in (*carried, *RULES, "base_failed")], kept.alias("kept"))
