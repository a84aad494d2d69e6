"""Seat claims against the sequential rule."""

import random
from datetime import datetime, timedelta

import pytest

from tarmaq.plans.claims import apply_claims, claim_all_or_nothing, claim_single

BASE = datetime(2024, 1, 1)
REQUEST = "order_id string, flight_id string, s_row int, s_column int, requested_ts timestamp_ntz"
SEAT = "flight_id string, s_row int, s_column int, order_id string"


def sequential(requests, free=None):
    """The rule, one order after another."""
    orders = {}
    for order, flight, row, column, ts in requests:
        orders.setdefault(order, (ts, order, []))[2].append((flight, row, column))
    taken, accepted = set(), set()
    for _, order, seats in sorted(orders.values()):
        if len(set(seats)) == len(seats) and not taken & set(seats) and (
                free is None or set(seats) <= free):
            taken |= set(seats)
            accepted.add(order)
    return accepted


def random_requests(seed, flights=3, orders=60, seats=12, most=4):
    rng = random.Random(seed)
    out = []
    for n in range(orders):
        # One flight gets most of the demand; some orders ask at the same instant.
        flight = "F0" if rng.random() < 0.6 else f"F{rng.randrange(flights)}"
        ts = BASE + timedelta(minutes=rng.randrange(orders // 2))
        for _ in range(rng.randint(1, most)):
            seat = rng.randrange(seats)
            out.append((f"O{n:03d}", flight, seat // 4 + 1, seat % 4 + 1, ts))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_rounds_equal_the_sequential_rule(spark, seed):
    requests = random_requests(seed)
    decided = claim_all_or_nothing(spark.createDataFrame(requests, REQUEST))
    got = {r.order_id for r in decided.filter("accepted").collect()}
    assert got == sequential(requests)
    assert decided.count() == len({r[0] for r in requests})


@pytest.mark.parametrize("fold", [1, 3, 7])
def test_crowded_flights_are_thinned_first(spark, fold):
    requests = random_requests(fold, orders=80, seats=16)
    decided = claim_all_or_nothing(spark.createDataFrame(requests, REQUEST), fold=fold)
    assert {r.order_id for r in decided.filter("accepted").collect()} == sequential(requests)


def test_only_the_first_of_a_seat_set_is_folded(spark):
    """A popular flight is as large as its different sets, however many orders ask."""
    requests = [(f"O{n:05d}", "F", 1, seat, BASE + timedelta(seconds=n)) for n in range(4000) for seat in (n % 2, n % 2 + 1)]
    decided = claim_all_or_nothing(spark.createDataFrame(requests, REQUEST), fold=2)  # two sets: nothing is thinned
    assert [r.order_id for r in decided.filter("accepted").collect()] == ["O00000"]


def test_only_free_existing_seats_can_be_claimed(spark):
    requests = random_requests(42)
    seats = [(f"F{f}", s // 4 + 1, s % 4 + 1, "X" if (s + f) % 5 == 0 else None)
             for f in range(3) for s in range(10)]
    free = {s[:3] for s in seats if s[3] is None}
    frame = spark.createDataFrame(seats, SEAT)
    asked = spark.createDataFrame(requests, REQUEST)
    decided = claim_all_or_nothing(asked, frame)
    want = sequential(requests, free)
    assert {r.order_id for r in decided.filter("accepted").collect()} == want
    after = apply_claims(frame, asked, decided)
    assert after.count() == len(seats)
    assert {r.order_id for r in after.collect()} - {None, "X"} == want


def test_a_long_chain_of_dependent_orders(spark):
    # Each order shares a seat with the next: accepted, rejected, accepted, ...
    requests = [(f"O{n:02d}", "F", 1, n + step, BASE + timedelta(minutes=n))
                for n in range(90) for step in (0, 1)]
    decided = claim_all_or_nothing(spark.createDataFrame(requests, REQUEST))
    assert {r.order_id for r in decided.filter("accepted").collect()} == {
        f"O{n:02d}" for n in range(0, 90, 2)}


def test_same_seat_twice_fails_and_blocks_nobody(spark):
    requests = [("A", "F", 1, 1, BASE), ("A", "F", 1, 1, BASE),
                ("B", "F", 1, 1, BASE + timedelta(minutes=1))]
    decided = claim_all_or_nothing(spark.createDataFrame(requests, REQUEST))
    assert {r.order_id: r.accepted for r in decided.collect()} == {"A": False, "B": True}


def test_seats_of_another_class_are_not_claimed(spark):
    seats = spark.createDataFrame([("F", 1, 1, None, "Business"), ("F", 2, 1, None, "Economy")], SEAT + ", class_type string")
    requests = spark.createDataFrame(
        [("A", "F", 1, 1, BASE, "Economy"), ("B", "F", 1, 1, BASE + timedelta(minutes=1), "Business"),
         ("C", "F", 2, 1, BASE, None), ("D", "F", 2, 1, BASE + timedelta(minutes=1), "Economy")], REQUEST + ", class_type string")
    decided = claim_all_or_nothing(requests, seats)
    assert {r.order_id: r.accepted for r in decided.collect()} == {"A": False, "B": True, "C": False, "D": True}


def test_nothing_to_decide(spark):
    assert claim_all_or_nothing(spark.createDataFrame([], REQUEST)).count() == 0


def test_single_seat_claims(spark, rows):
    requests = [("B", "F", 1, 1, BASE), ("A", "F", 1, 1, BASE),
                ("C", "F", 1, 2, BASE + timedelta(minutes=1))]
    won = claim_single(spark.createDataFrame(requests, REQUEST), ["requested_ts", "order_id"])
    assert rows(won, "s_column", "order_id") == [(1, "A"), (2, "C")]
