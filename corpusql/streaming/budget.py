"""A budget of requests and tokens over a sliding window: when each request may be sent.

A budget serves its requests in order. One is sent as soon as it has come, the one before is sent, and the window that ends
with it holds at most ``requests`` requests and ``tokens`` tokens; one that alone exceeds the tokens waits for an empty window.
What a budget must remember is its last ``requests`` sendings, so its state is bounded however many requests it has.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


class Window:
    """The sendings of the last ``seconds`` (times in microseconds)."""

    def __init__(self, requests: int, tokens: int, seconds: float, sent: list[tuple[int, int]] = ()):
        if requests < 1:
            raise ValueError("a budget has one request at least")
        self.requests, self.tokens, self.width = requests, tokens, int(seconds * 1_000_000)
        self.sent = deque(tuple(x) for x in sent)
        self.held = sum(n for _, n in self.sent)

    def send(self, at: int, n: int) -> int:
        """The time at which a request of ``n`` tokens that comes at ``at`` is sent."""
        if self.sent:
            at = max(at, self.sent[-1][0])
        while self.sent and (self.sent[0][0] + self.width <= at or len(self.sent) >= self.requests or self.held + n > self.tokens):
            before, m = self.sent.popleft()
            self.held -= m
            at = max(at, before + self.width)
        self.sent.append((at, n))
        self.held += n
        return at


def admitted(rows: DataFrame, key: str, at: str, order: str, tokens: str, requests: int, budget: int, seconds: float = 60.0) -> DataFrame:
    """``rows`` with sent_at, when the budget of their ``key`` lets them go, in order of time and ``order``.

    A budget's rows go through one task, as each depends on the one before; they pass it as a sorted stream, so the task holds one
    window and not the group. Null tokens count none; rows without a time come at the beginning.
    """
    kind = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, sent_us bigint"
    names = rows.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, window = object(), None
        for frame in frames:
            out = []
            for k, t, n in zip(frame["_key"], frame["_at"], frame["_n"], strict=True):
                if k != now or window is None:
                    now, window = k, Window(requests, budget, seconds)
                out.append(window.send(int(t), int(n)))
            yield frame[names].assign(sent_us=out)

    keyed = rows.withColumns({"_key": F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")), "_at": F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(0)), "_n": F.coalesce(F.col(tokens).cast("long"), F.lit(0))})
    dealt = keyed.repartition("_key").sortWithinPartitions("_key", "_at", order)
    return dealt.mapInPandas(run, kind).withColumn("sent_at", F.timestamp_micros("sent_us")).drop("sent_us")


def admitted_stream(rows: DataFrame, key: str, at: str, order: str, tokens: str, requests: int, budget: int, seconds: float = 60.0, late: str = "10 minutes") -> DataFrame:
    """The same of a stream: key, order and sent_at; each budget's window is kept as state between batches.

    A batch's rows of a budget are taken in order of their time; a budget whose last sending lies a window and ``late`` back is forgotten.
    """

    def send(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        window = Window(requests, budget, seconds, list(zip(*state.get, strict=True)) if state.exists else [])
        frame = pd.concat(list(frames)).sort_values(["_at", "_order"])
        times = [window.send(int(t), int(n)) for t, n in zip(frame["_at"], frame["_n"], strict=True)]
        state.update(tuple(map(list, zip(*window.sent, strict=True))))
        state.setTimeoutTimestamp(max(times[-1] // 1000 + int(seconds * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": k[0], "order": frame["_order"], "sent_us": times})

    timed = rows.select(F.col(key).cast("string").alias("_key"), F.col(at).cast("timestamp").alias("_ts"), F.unix_micros(F.col(at).cast("timestamp")).alias("_at"), F.col(order).cast("long").alias("_order"), F.coalesce(F.col(tokens).cast("long"), F.lit(0)).alias("_n"))
    grouped = timed.where("_ts is not null").withWatermark("_ts", late).groupBy("_key")
    sent = grouped.applyInPandasWithState(send, "key string, order bigint, sent_us bigint", "at array<bigint>, n array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
    return sent.select("key", "order", F.timestamp_micros("sent_us").alias("sent_at"))
