"""Sequential admission rules per key: sliding window, token bucket, call budget.

Rejected events leave no trace in the sliding window, so the rules depend on the order
of events and no window function expresses them.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass
from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from salesloom import contracts as C

MICROS = 1_000_000
OUTCOME = "admitted boolean, remaining double, retry_after long"


@dataclass(frozen=True)
class SlidingWindow:
    """Admit while fewer than limit admitted events lie within the last window."""
    limit: int = C.ADMISSION_LIMIT
    window: int = C.ADMISSION_WINDOW_SECONDS

    @property
    def idle(self) -> int:
        return self.window

    def start(self, numbers: list[float] = ()) -> deque:
        return deque(int(x) for x in numbers)

    def step(self, kept: deque, now: int):
        while kept and now - kept[0] >= self.window * MICROS:
            kept.popleft()
        if len(kept) >= self.limit:
            retry = max(1, int(self.window - (now - kept[0]) / MICROS))
            return kept, (False, 0.0, retry)
        kept.append(now)
        return kept, (True, float(self.limit - len(kept)), 0)


@dataclass(frozen=True)
class TokenBucket:
    """Admit while a token is left; tokens refill at a rate up to the capacity."""
    rate: float = C.BUCKET_RATE
    capacity: float = C.BUCKET_CAPACITY

    @property
    def idle(self) -> int:
        return int(self.capacity / self.rate) + 1

    def start(self, numbers: list[float] = ()) -> list[float]:
        return list(numbers)

    def step(self, state: list[float], now: int):
        tokens, last = state if state else (self.capacity, now)
        tokens = min(self.capacity, tokens + (now - last) / MICROS * self.rate)
        if tokens >= 1:
            return [tokens - 1, now], (True, tokens - 1, 0)
        return [tokens, now], (False, tokens, 0)


@dataclass(frozen=True)
class CallBudget:
    """At most limit calls per window; a window starts with the first call after the last one expired."""
    limit: int = C.DAILY_BUDGET
    window: int = C.BUDGET_WINDOW_SECONDS

    @property
    def idle(self) -> int:
        return self.window

    def start(self, numbers: list[float] = ()) -> list[float]:
        return list(numbers)

    def step(self, state: list[float], now: int):
        calls, resets = state if state else (0, None)
        if resets is None or now > resets:
            calls, resets = 0, now + self.window * MICROS
        if calls >= self.limit:
            return [calls, resets], (False, 0.0, 0)
        return [calls + 1, resets], (True, float(self.limit - calls - 1), 0)


# ---------------------------------------------------------------- batch

def _micros(events: DataFrame, ts: str) -> Column:
    """Microseconds since 1970; a time without zone is read as it stands, whatever the session's zone."""
    if dict(events.dtypes)[ts] == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts))
    return F.unix_micros(F.col(ts).cast("timestamp"))


def with_busy_stretch(events: DataFrame, key: str, ts: str, idle_seconds: int) -> DataFrame:
    """Number the stretches of each key that no idle gap interrupts.

    After an idle gap every rule is back in its first state, so stretches are
    independent and a hot key splits into many. Gaps are found on one row per key and
    idle-wide time cell: their number is bounded by the time span, not by the traffic.
    """
    micros = _micros(events, ts)
    idle = idle_seconds * MICROS
    placed = events.withColumns({"_us": micros, "_cell": F.floor(micros / idle)})
    cells = placed.groupBy(key, "_cell").agg(F.min("_us").alias("_from"), F.max("_us").alias("_to"))
    order = W.partitionBy(key).orderBy("_cell")
    gap = F.coalesce(F.col("_from") - F.lag("_to").over(order) > idle, F.lit(False))
    cells = cells.withColumn("_gap", gap).withColumn("stretch", F.count_if("_gap").over(order))
    return placed.join(cells.select(key, "_cell", "stretch"), [key, "_cell"]).drop("_cell")


def admit(events: DataFrame, rule, key: str = "user_id", ts: str = "ts", id: str = "event_id") -> DataFrame:
    """Apply a rule to a table of events, in time order per key.

    A task streams sorted batches of many stretches and holds only the state of the current one.
    """
    cut = with_busy_stretch(events.select(key, id, ts), key, ts, rule.idle)
    ordered = cut.repartition(key, "stretch").sortWithinPartitions(key, "stretch", "_us", id)
    types = dict(ordered.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, rule.start()
        for batch in batches:
            results = []
            for who, stretch, now in zip(batch[key], batch["stretch"], batch["_us"]):
                if (who, stretch) != current:
                    current, state = (who, stretch), rule.start()
                state, result = rule.step(state, int(now))
                results.append(result)
            outcome = pd.DataFrame(results, columns=["admitted", "remaining", "retry_after"])
            yield pd.concat([batch[[key, id]].reset_index(drop=True), outcome], axis=1)

    return ordered.select(key, id, "stretch", "_us").mapInPandas(run, f"{key} {types[key]}, {id} {types[id]}, {OUTCOME}")


# ---------------------------------------------------------------- streaming

class AdmissionProcessor(StatefulProcessor):
    """One rule per key on a stream. Events wait until the watermark has passed them and are then taken in time order;
    events older than the watermark are counted and marked late.

    A key has one timer at most: for the first event that waits, or else for the moment from which an idle rule is as good
    as new, when all that is known of the key is forgotten. Whatever is due when it goes off is taken at once, so a batch
    of many events of one key costs one sort of them.
    """

    def __init__(self, rule, key: str, id: str):
        self.rule, self.key, self.id = rule, key, id

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "numbers array<double>, last long")
        self.waiting = handle.getListState("waiting", "us long, id long")
        self.timer = handle.getValueState("timer", "ms long")
        self.late = handle.getValueState("late", "n long")

    def _rows(self, key, columns):
        who = pd.Series([key[0]] * len(columns[0]))
        return pd.DataFrame(dict(zip([self.key, self.id, "admitted", "remaining", "retry_after", "late"], [who, *columns])))

    def _wake_at(self, ms: int | None) -> None:
        now = self.timer.get()[0] if self.timer.exists() else None
        if now == ms:
            return
        if now is not None:
            self.handle.deleteTimer(now)
        if ms is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        first = None
        for batch in rows:
            us, ids = batch["micros"].to_numpy("int64"), batch[self.id].to_numpy("int64")
            old = us // 1000 < mark
            if old.any():
                n = int(old.sum())
                self.late.update(((self.late.get()[0] if self.late.exists() else 0) + n,))
                yield self._rows(key, [ids[old], [False] * n, [0.0] * n, [0] * n, [True] * n])
            if not old.all():
                self.waiting.appendList(list(zip(us[~old].tolist(), ids[~old].tolist())))
                least = int(us[~old].min())
                first = least if first is None else min(first, least)
        if first is not None:
            now = self.timer.get()[0] if self.timer.exists() else None
            idle = not self._still_waiting(now)
            self._wake_at(first // 1000 + 1 if now is None or idle else min(now, first // 1000 + 1))

    def _still_waiting(self, now: int | None) -> bool:
        """Is the timer one for a waiting event rather than for the end of an idle time?"""
        if now is None:
            return False
        last = self.state.get()[1] if self.state.exists() else None
        return last is None or now != self._idle_from(last)

    def _idle_from(self, last: int) -> int:
        return last // 1000 + self.rule.idle * 1000 + 2

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        upto = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        every = list(self.waiting.get())
        due = sorted(w for w in every if w[0] // 1000 < upto)
        if not due:
            if every:
                self._wake_at(min(w[0] for w in every) // 1000 + 1)
            else:
                self.state.clear()
            return
        state = self.rule.start(self.state.get()[0] if self.state.exists() else ())
        out = []
        for us, event in due:
            state, result = self.rule.step(state, us)
            out.append((event, *result, False))
        last = due[-1][0]
        self.state.update(([float(x) for x in state], last))
        left = [w for w in every if w[0] // 1000 >= upto]
        if left:
            self.waiting.put(left)
            self._wake_at(min(w[0] for w in left) // 1000 + 1)
        else:
            self.waiting.clear()
            self._wake_at(self._idle_from(last))
        yield self._rows(key, list(zip(*out)))

    def close(self) -> None:
        pass


def admit_stream(events: DataFrame, rule, key: str = "user_id", ts: str = "ts", id: str = "event_id",
                 delay: str = "1 minute") -> DataFrame:
    """The same rule on a stream. Needs the RocksDB state store."""
    stamped = events.select(key, id, F.col(ts).cast("timestamp").alias("seen_at"),
                            _micros(events, ts).alias("micros")).withWatermark("seen_at", delay)
    types = dict(stamped.dtypes)
    return stamped.groupBy(key).transformWithStateInPandas(
        AdmissionProcessor(rule, key, id), f"{key} {types[key]}, {id} {types[id]}, {OUTCOME}, late boolean",
        "Append", "EventTime")
