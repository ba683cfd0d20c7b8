"""Period carry-over along the turns of a session, on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from salesloom.operators.questions import is_follow_up, understand, with_lowered

ROW = "own_period string, follow boolean, in_scope boolean, asked boolean"


class CarryProcessor(StatefulProcessor):
    """Takes the turns of a session in their order, whatever order they come in.

    A turn that comes before those that precede it waits under its number. It is released when they have come, or when the
    watermark has passed the first that waits by the patience given: then what is missing is passed over. A turn that comes
    after its place was passed is late: marked, given its own period, and without effect on others.
    """

    def __init__(self, first: int, patience_ms: int | None, ttl_ms: int | None):
        self.first, self.patience_ms, self.ttl_ms = first, patience_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "next long, period string", self.ttl_ms)
        self.waiting = handle.getMapState("waiting", "turn long", ROW, self.ttl_ms)
        self.timer = handle.getValueState("timer", "ms long", self.ttl_ms)

    def _release(self, turn: int, last: str | None, here: dict) -> tuple[int, str | None, list]:
        """All turns from `turn` on that are there; here: those of this batch by number."""
        out = []
        while True:
            if turn in here:
                row = here.pop(turn)
            elif self.waiting.containsKey((turn,)):
                row = self.waiting.getValue((turn,))
                self.waiting.removeKey((turn,))
            else:
                return turn, last, out
            own, follow, in_scope, asked = row
            if asked:
                period = last if (follow and last) else own
                out.append((turn, period, False))
                if in_scope:
                    last = period
            turn += 1

    def _frame(self, key, out) -> pd.DataFrame:
        turns, periods, late = zip(*out)
        return pd.DataFrame({"session_id": [key[0]] * len(out), "turn": turns, "period": periods, "late": late})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        place = self.place.get() if self.place.exists() else None
        turn, last = place if place else (self.first, None)
        for batch in rows:
            here, out = {}, []
            text = batch["own_period"].astype(object).where(batch["own_period"].notna(), None)
            for t, own, follow, in_scope, asked in zip(batch["turn"], text, batch["follow"], batch["in_scope"], batch["asked"]):
                late = pd.isna(t) or t < turn or int(t) in here or self.waiting.containsKey((int(t),))
                if late and asked:
                    out.append((None if pd.isna(t) else int(t), own, True))
                elif not late:
                    here[int(t)] = (own, bool(follow), bool(in_scope), bool(asked))
            turn, last, released = self._release(turn, last, here)
            for t, row in here.items():
                self.waiting.updateValue((t,), row)
            if here and self.patience_ms is not None and not self.timer.exists():
                at = timerValues.getCurrentWatermarkInMs() + self.patience_ms + 1
                self.handle.registerTimer(at)
                self.timer.update((at,))
            if out or released:
                yield self._frame(key, out + released)
        self.place.update((turn, last))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        turns = [k[0] for k in self.waiting.keys()]
        if not turns:
            return
        _, last = self.place.get()
        turn, last, out = self._release(min(turns), last, {})
        self.place.update((turn, last))
        if len(turns) > turn - min(turns):
            at = timerValues.getCurrentWatermarkInMs() + self.patience_ms + 1
            self.handle.registerTimer(at)
            self.timer.update((at,))
        if out:
            yield self._frame(key, out)

    def close(self) -> None:
        pass


def carry_period_stream(questions: DataFrame, first: int = 0, patience: str | None = None, ttl_ms: int | None = None) -> DataFrame:
    """(session_id, turn, period, late) for a stream of (session_id, turn, question) and, if turns of others count in the
    numbering, role: only rows of the role `user` are answered, the others take their place in the order.

    Turns are numbered from `first` without gaps. With `patience`, which needs a column ts, a gap is passed over once the
    watermark is that far behind. A time to live needs processing time, under which Spark keeps starting batches: give one to
    a stream that runs on. Patience and time to live exclude each other.
    """
    if patience and ttl_ms is not None:
        raise ValueError("either patience or a time to live")
    role = F.col("role") == "user" if "role" in questions.columns else F.lit(True)
    stamped = questions
    patience_ms = None
    if patience:
        stamped = questions.withColumn("_seen", F.col("ts").cast("timestamp")).withWatermark("_seen", "0 seconds")
        patience_ms = int(questions.sparkSession.sql(f"SELECT unix_millis(timestamp_seconds(0) + INTERVAL '{patience}')").first()[0])
    df = with_lowered(understand(stamped)).select(
        "session_id", F.col("turn").cast("long").alias("turn"), "own_period", is_follow_up(F.col("_q")).alias("follow"),
        (~F.col("refused") & ~F.col("out_of_scope")).alias("in_scope"), F.coalesce(role, F.lit(False)).alias("asked"),
        *(["_seen"] if patience else []))
    types = dict(df.dtypes)
    mode = "EventTime" if patience else "None" if ttl_ms is None else "ProcessingTime"
    return df.groupBy("session_id").transformWithStateInPandas(
        CarryProcessor(first, patience_ms, ttl_ms), f"session_id {types['session_id']}, turn long, period string, late boolean",
        "Append", mode)
