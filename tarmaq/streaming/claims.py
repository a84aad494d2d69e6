"""Seat claims over a stream of requests, with the free seats as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tarmaq.plans.claims import SEAT
from tarmaq.streaming import drain, with_keyed_state

PLACE = ("s_row", "s_column")


class SeatClaims(StatefulProcessor):
    """A flight's seats as state: a seat is there while it is free.

    The first batch puts the free seats in. A batch looks up the seats that it
    asks for and takes out those it gives away, so it costs what was asked, not
    what went before. It holds the orders of one batch and flight.
    """

    def __init__(self, seat_type: str):
        self.seat_type = seat_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.free = handle.getMapState("free", self.seat_type, "free boolean")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.free.updateValue(tuple(initialState[c] for c in PLACE), (True,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        orders: dict = {}
        for row in rows:
            first, seats = orders.get(row["order_id"], (row["requested_ts"], []))
            seats.append(tuple(row[c] for c in PLACE))
            orders[row["order_id"]] = min(first, row["requested_ts"]), seats
        for _, order, seats in sorted((ts, order, seats) for order, (ts, seats) in orders.items()):
            accepted = len(set(seats)) == len(seats) and all(self.free.containsKey(s) for s in seats)
            for seat in seats if accepted else ():
                self.free.removeKey(seat)
            yield Row(order_id=order, flight_id=key[0], seats=len(seats), accepted=accepted)

    def close(self) -> None:
        pass


def claims(requests: DataFrame, seats: DataFrame) -> DataFrame:
    """Decide a stream of requests: (order_id, flight_id, seats, accepted).

    ``requests``: order_id, flight_id, s_row, s_column, requested_ts, a row per
    seat; the rows of an order come in one batch. Earlier batches come first, and
    inside a batch the earlier request. ``seats``: the seat table at the start of
    the stream; it is read once, for the first batch.
    """
    with_keyed_state(requests.sparkSession)
    types = {c: requests.schema[c].dataType.simpleString() for c in ("order_id", *SEAT)}
    place = ", ".join(f"{c} {types[c]}" for c in PLACE)
    start = seats.filter(F.col("order_id").isNull()).select(
        *[F.col(c).cast(types[c]).alias(c) for c in SEAT]).dropDuplicates(SEAT)
    return requests.select("order_id", *SEAT, "requested_ts").groupBy("flight_id").transformWithState(
        SeatClaims(place), f"order_id {types['order_id']}, flight_id {types['flight_id']}, seats bigint, accepted boolean",
        "Append", "None", initialState=start.groupBy("flight_id"))


def drain_claims(requests: DataFrame, seats: DataFrame, target: str) -> DataFrame:
    """Decide the requests that are there. A later run with the same ``target`` folder goes on."""
    return drain(claims(requests, seats), target)
