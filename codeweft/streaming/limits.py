"""A sliding-window request limiter whose accepted requests alone count, for tables and for streams."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Window seconds and their limits, in the order of the checks, and the idle seconds after which a
# client is forgotten.
WINDOWS = ((10, 10), (60, 60), (3600, 1000))
IDLE = 3600


class Limiter:
    """One client's accepted requests: a queue for each window, so that a request costs what leaves the windows."""

    def __init__(self, windows: tuple[tuple[int, int], ...], times: list[int] | None = None):
        self.windows = [(seconds * 1_000_000, limit, deque(times or ())) for seconds, limit in windows]

    def accept(self, us: int) -> bool:
        for width, _, held in self.windows:
            while held and held[0] <= us - width:
                held.popleft()
        ok = all(len(held) < limit for _, limit, held in self.windows)
        if ok:
            for _, _, held in self.windows:
                held.append(us)
        return ok

    def times(self) -> list[int]:
        """The times in the longest window, which are all that later requests depend on."""
        return list(max(self.windows, key=lambda w: w[0])[2])


def limited(requests: DataFrame, windows: tuple[tuple[int, int], ...] = WINDOWS) -> DataFrame:
    """``request_id, client, allowed`` for requests by ``ts`` then id.

    Clients are sorted streams within a partition, held as the few timestamps of the longest window, so a
    client of any length passes in bounded memory.  Requests without a client are one client's.
    """
    rows = requests.select("request_id", "client", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).repartition("client").sortWithinPartitions("client", "us", "request_id")
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, limiter = object(), Limiter(windows)
        for batch in batches:
            verdicts = []
            for client, us in zip(batch.column("client").to_pylist(), batch.column("us").to_pylist(), strict=True):
                if client != now:
                    now, limiter = client, Limiter(windows)
                verdicts.append(limiter.accept(us))
            yield pa.record_batch([batch.column("request_id"), batch.column("client"), pa.array(verdicts, pa.bool_())], names=["request_id", "client", "allowed"])

    return rows.mapInArrow(run, f"request_id {kinds['request_id']}, client {kinds['client']}, allowed boolean")


def limited_stream(requests: DataFrame, windows: tuple[tuple[int, int], ...] = WINDOWS, idle: int = IDLE) -> DataFrame:
    """As ``limited``, for a stream: each client's state is its accepted times, dropped after ``idle`` seconds without
    requests.  Requests of one micro-batch are taken by time, then id.
    """
    rows = requests.select("request_id", "client", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    kinds = dict(rows.dtypes)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        limiter = Limiter(windows, list(state.get[0]) if state.exists else None)
        frame = pd.concat(list(frames)).sort_values(["us", "request_id"])
        verdicts = [limiter.accept(us) for us in frame["us"]]
        state.update((limiter.times(),))
        state.setTimeoutDuration(idle * 1000)
        yield frame[["request_id", "client"]].assign(allowed=verdicts)

    out = f"request_id {kinds['request_id']}, client {kinds['client']}, allowed boolean"
    return rows.groupBy("client").applyInPandasWithState(step, out, "times array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout)
