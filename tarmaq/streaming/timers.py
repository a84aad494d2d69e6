"""Holds that lapse at their own limit: keyed state with event-time timers."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tarmaq.streaming import event_time, with_keyed_state

EPOCH = datetime(1970, 1, 1)


class HoldTimers(StatefulProcessor):
    """Per user: open holds and recent payments, each with its moment in microseconds.

    The earliest open limit has a timer. When the watermark has passed it, all
    payments up to there have come, and every hold whose limit lies before the
    watermark goes: it was paid if a payment lies between. Payments that no open or
    later hold can need go with it, so the state is what happened within a limit of
    the watermark. A user's state is one value, read and written once a call,
    however many events the call brings.
    """

    def __init__(self, hold_type: str, ttl_minutes: int):
        self.hold_type = hold_type
        self.ttl = ttl_minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(
            "state", f"ids array<{self.hold_type}>, moments array<bigint>, payments array<bigint>, timer bigint")

    def _read(self) -> tuple[dict, set, int | None]:
        """Open holds with their moments, payments, and the timer that is set."""
        ids, moments, payments, timer = self.state.get() or ([], [], [], None)
        return dict(zip(ids, moments)), set(payments), timer

    def _write(self, holds: dict, payments: set, timer: int | None) -> None:
        """The state, with a timer for the earliest limit."""
        if holds:
            first = self._timer(min(holds.values()))
            if timer is None or first < timer:
                self.handle.registerTimer(first)
                timer = first
        if holds or payments:
            self.state.update((list(holds), list(holds.values()), list(payments), timer))
        else:
            self.state.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        holds, payments, timer = self._read()
        for row in rows:
            if row["hold"] is None:
                payments.add(row["micros"])
            else:
                holds[row["hold"]] = row["micros"]
        self._write(holds, payments, timer)
        return iter(())

    def _timer(self, micros: int) -> int:
        return -((-micros - self.ttl) // 1000)  # milliseconds, not before the limit

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        expired = expiredTimerInfo.getExpiryTimeInMs()
        now = max(expired, timerValues.getCurrentWatermarkInMs() - 1)
        holds, payments, timer = self._read()
        paid = sorted(payments)
        done = [(hold, micros) for hold, micros in holds.items() if self._timer(micros) <= now]
        for hold, micros in done:
            del holds[hold]
        # holds up to now are decided, later ones begin after it
        left = {p for p in paid if p >= now * 1000 - self.ttl}
        self._write(holds, left, None if timer is not None and timer <= now else timer)
        for hold, micros in done:
            after = bisect_left(paid, micros)
            if after == len(paid) or paid[after] > micros + self.ttl:
                yield Row(hold_id=hold, user_id=key[0], held_at=EPOCH + timedelta(microseconds=micros))

    def close(self) -> None:
        pass


def lapsed_at_limit(holds: DataFrame, payments: DataFrame, user: str, hold_id: str, ts: str, ttl_minutes: int,
                    delay: str = "1 hour") -> DataFrame:
    """Holds without a payment in [ts, ts + ttl], each as soon as the watermark passes its limit.

    Returns (hold_id, user, held_at) under the names of the columns. A batch
    looks at the users that have events or limits in it.
    """
    with_keyed_state(holds.sparkSession)
    kinds = {c: holds.schema[c].dataType.simpleString() for c in (hold_id, user)}

    def rows(df, hold):
        # without a zone the moments are UTC, as the session is
        return df.select(F.col(user).alias("_user"), hold.alias("hold"),
                         F.unix_micros(F.col(ts).cast("timestamp")).alias("micros"), F.col(ts).alias("_at"))

    both = rows(holds, F.col(hold_id)).unionByName(rows(payments, F.lit(None).cast(kinds[hold_id])))
    return (event_time(both, "_at", delay).groupBy("_user")
            .transformWithState(HoldTimers(kinds[hold_id], ttl_minutes),
                                f"hold_id {kinds[hold_id]}, user_id {kinds[user]}, held_at timestamp_ntz", "Append", "EventTime")
            .toDF(hold_id, user, "held_at"))
