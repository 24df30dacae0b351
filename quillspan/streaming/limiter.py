"""Sliding-window rate limits, over tables and over streams.

A request is allowed if fewer than ``limit`` allowed requests of its key lie
within the window before it; refused requests leave no trace, so the decision
depends on earlier decisions and is a fold in time order per key.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

USER_LIMIT, TENANT_LIMIT, WINDOW = 30, 120, 60.0
_OUT = "event_id bigint, allowed boolean"


class SlidingWindow:
    """Allowed times of one key; those older than the window (strictly) are forgotten."""

    def __init__(self, limit: int, window: float, times=()):
        self.limit, self.window, self.times = limit, window, deque(times)

    def room(self, now: float) -> bool:
        while self.times and now - self.times[0] > self.window:
            self.times.popleft()
        return len(self.times) < self.limit

    def take(self, now: float) -> None:
        self.times.append(now)

    def allow(self, now: float) -> bool:
        if not self.room(now):
            return False
        self.take(now)
        return True


def _seconds() -> F.Column:
    return (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t")


def _stretches(rows: DataFrame, window: float) -> DataFrame:
    """Rows (k, t, ...) with the number ``s`` of the stretch of its key they lie in.

    Time is cut into cells of one window; a cell without rows between two
    stretches means that the later one remembers nothing of the earlier, so
    each is a fold of its own and a busy key is split where it pauses. Only
    the distinct cells are put in order.
    """
    c = rows.withColumn("c", F.floor(F.col("t") / window))
    order = Window.partitionBy("k").orderBy("c")
    cells = c.select("k", "c").distinct().withColumn("s", F.when(F.col("c") - F.lag("c").over(order) <= 1, 0).otherwise(1))
    return c.join(cells.withColumn("s", F.sum("s").over(order)), ["k", "c"]).drop("c")


def limited(events: DataFrame, key: str, limit: int = USER_LIMIT, window: float = WINDOW) -> DataFrame:
    """(event_id, allowed) of (event_id, ts, key). Rows are sorted by Spark and read as batches, so a key of any size needs the memory of its window only; a key is split where it pauses for a window."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for b in batches:
            out = []
            for k, s, t in zip(b["k"], b["s"], b["t"]):
                if (k, s) != now or state is None:
                    now, state = (k, s), SlidingWindow(limit, window)
                out.append(state.allow(t))
            yield pd.DataFrame({"event_id": b["event_id"], "allowed": out})

    rows = events.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).select("event_id", F.col(key).alias("k"), _seconds())
    return _stretches(rows, window).select("event_id", "k", "s", "t").repartition("k", "s").sortWithinPartitions("k", "s", "t", "event_id").mapInPandas(fold, _OUT)


class TwoLevels:
    """The windows of a tenant and of its users; a request needs room in both and uses both or neither."""

    def __init__(self, user_limit: int, tenant_limit: int, window: float, hits=()):
        self.whole = SlidingWindow(tenant_limit, window)
        self.users: dict = {}
        self.user_limit, self.window = user_limit, window
        for user, t in hits:
            self._own(user).take(t)
            self.whole.take(t)

    def _own(self, user) -> SlidingWindow:
        if user not in self.users:
            self.users[user] = SlidingWindow(self.user_limit, self.window)
        return self.users[user]

    def allow(self, user, now: float) -> bool:
        own = self._own(user)
        ok = own.room(now) and self.whole.room(now)
        if ok:
            own.take(now)
            self.whole.take(now)
        return ok

    def hits(self) -> list[tuple]:
        """What is remembered, oldest first: no more than the tenant's limit."""
        oldest = self.whole.times[0] if self.whole.times else float("inf")
        return sorted(((u, t) for u, w in self.users.items() for t in w.times if t >= oldest), key=lambda h: h[1])


def limited_two_levels(events: DataFrame, tenant: str = "tenant_id", user: str = "user_id", user_limit: int = USER_LIMIT, tenant_limit: int = TENANT_LIMIT, window: float = WINDOW) -> DataFrame:
    """(event_id, allowed): both the user's and the tenant's window must have room, and both are used only then. A tenant is split where it pauses for a window."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for b in batches:
            out = []
            for k, s, u, t in zip(b["k"], b["s"], b["u"], b["t"]):
                if (k, s) != now or state is None:
                    now, state = (k, s), TwoLevels(user_limit, tenant_limit, window)
                out.append(state.allow(u, t))
            yield pd.DataFrame({"event_id": b["event_id"], "allowed": out})

    rows = events.where(F.col(tenant).isNotNull() & F.col(user).isNotNull() & F.col("ts").isNotNull()).select("event_id", F.col(tenant).alias("k"), F.col(user).alias("u"), _seconds())
    return _stretches(rows, window).select("event_id", "k", "s", "u", "t").repartition("k", "s").sortWithinPartitions("k", "s", "t", "event_id").mapInPandas(fold, _OUT)


class TwoLevelProcessor(StatefulProcessor):
    """The two-level limiter as a stateful streaming operator keyed by tenant; state is the allowed requests within the window, user by user, so at most the tenant's limit of them."""

    def __init__(self, user: str, user_limit: int, tenant_limit: int, window: float):
        self.user, self.user_limit, self.tenant_limit, self.window = user, user_limit, tenant_limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hits = handle.getValueState("hits", StructType([StructField("users", ArrayType(LongType())), StructField("micros", ArrayType(LongType()))]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self.hits.get()
        known = zip(state[0], (m / 1e6 for m in state[1])) if state else ()
        both = TwoLevels(self.user_limit, self.tenant_limit, self.window, known)
        every = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        out = [both.allow(int(u), t.timestamp()) for u, t in zip(every[self.user], every["ts"])]
        hits = both.hits()
        self.hits.update(([int(u) for u, _ in hits], [round(t * 1e6) for _, t in hits]))
        yield pd.DataFrame({"event_id": every["event_id"].to_numpy(), "allowed": out})

    def close(self) -> None:
        pass


def limited_two_levels_stream(events: DataFrame, tenant: str = "tenant_id", user: str = "user_id", user_limit: int = USER_LIMIT, tenant_limit: int = TENANT_LIMIT, window: float = WINDOW) -> DataFrame:
    """``limited_two_levels`` for a streaming DataFrame; rows of a tenant must not arrive in an earlier batch than older ones."""
    e = events.where(F.col(tenant).isNotNull() & F.col(user).isNotNull() & F.col("ts").isNotNull())
    return e.groupBy(tenant).transformWithStateInPandas(TwoLevelProcessor(user, user_limit, tenant_limit, window), outputStructType=_OUT, outputMode="Append", timeMode="None")


class LimiterProcessor(StatefulProcessor):
    """The single-key limiter as a stateful streaming operator; state is the allowed times of the key within the window."""

    def __init__(self, limit: int = USER_LIMIT, window: float = WINDOW):
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getValueState("times", StructType([StructField("micros", ArrayType(LongType()))]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self.times.get()
        window = SlidingWindow(self.limit, self.window, [m / 1e6 for m in (state[0] if state else [])])
        every = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        out = [window.allow(t.timestamp()) for t in every["ts"]]
        self.times.update(([round(t * 1e6) for t in window.times],))
        yield pd.DataFrame({"event_id": every["event_id"].to_numpy(), "allowed": out})

    def close(self) -> None:
        pass


def limited_stream(events: DataFrame, key: str, limit: int = USER_LIMIT, window: float = WINDOW) -> DataFrame:
    """``limited`` for a streaming DataFrame, by ``transformWithState``; rows of a key must not arrive in an earlier batch than older ones."""
    return events.groupBy(key).transformWithStateInPandas(LimiterProcessor(limit, window), outputStructType=_OUT, outputMode="Append", timeMode="None")
