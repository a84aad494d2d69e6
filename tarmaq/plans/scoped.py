"""State changes of some flights in a store that is kept in buckets by flight.

A change is a function of the tables, written for whole tables. Flights, orders,
seats and prices of one flight lie in the same bucket, so the change gives the
same rows when it sees the buckets of the flights that it touches and no others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmaq import params as P
from tarmaq.functions.scalars import moment
from tarmaq.plans import flows, transitions
from tarmaq.schemas import schema_of
from tarmaq.sources import buckets

Tables = dict[str, DataFrame]
Schemas = dict[str, T.StructType]

#: The tables that are cut by flight; the others are read whole.
BY_FLIGHT = ("flight", "orders", "seat", "pricing")


def read(spark: SparkSession, store: str, only: list[int] | None = None, schemas: Schemas | None = None) -> Tables:
    """The tables of a store, or some buckets of them; of a booking store unless other schemas are given."""
    schemas = schemas or {name: schema_of(name) for name in BY_FLIGHT}
    return {name: buckets.read(spark, store, name, schema, only) for name, schema in schemas.items()}


def apply(spark: SparkSession, store: str, flights: DataFrame, change: Callable[[Tables], Tables],
          others: Tables | None = None, schemas: Schemas | None = None) -> Tables:
    """Run a change on the buckets of the given flights (flight_id) and write those buckets.

    ``others`` are tables that the change reads whole. What the change returns
    besides tables of the store (decisions, refunds) is returned; it reads the
    versions from before the change. No flights: nothing is written.
    """
    key, n = buckets.layout(spark, store)
    only = buckets.touched(flights, key, n)
    tables = read(spark, store, only, schemas)
    after = change({**(others or {}), **tables})
    if only:
        buckets.rewrite(spark, store, {name: df for name, df in after.items() if name in tables}, only)
    return {name: df for name, df in after.items() if name not in tables}


def flights_of(orders: DataFrame, requests: DataFrame) -> DataFrame:
    """The flights of some orders; two columns of the order table are read."""
    return (orders.select("order_id", "flight_id")
            .join(requests.select("order_id").distinct(), "order_id", "left_semi").select("flight_id"))


def cancel_orders(spark: SparkSession, store: str, requests: DataFrame, as_of: str) -> DataFrame:
    """Customers cancel (order_id, email); the decisions."""
    involved = flights_of(read(spark, store)["orders"], requests)
    return apply(spark, store, involved, lambda t: flows.cancel_orders(t, requests, as_of))["decisions"]


def cancel_flights(spark: SparkSession, store: str, requests: DataFrame, as_of: str) -> Tables:
    """Managers cancel flights (flight_id, manager_id); decisions and refunds."""
    return apply(spark, store, requests.select("flight_id"), lambda t: flows.cancel_requests(t, requests, as_of))


def book(spark: SparkSession, store: str, requests: DataFrame, payments: DataFrame, as_of: str) -> Tables:
    """Requests and payments; holds of the same flights that lapsed are freed. What was rejected.

    An order_id in use on a flight of another bucket is in use as well.
    """
    orders = read(spark, store)["orders"]
    involved = requests.select("flight_id").unionByName(flights_of(orders, payments)).unionByName(
        flights_of(orders, requests))
    return apply(spark, store, involved, lambda t: flows.book(t, requests, payments, as_of))


def expire_holds(spark: SparkSession, store: str, as_of: str, ttl_minutes: int = P.HOLD_MINUTES) -> None:
    """Unpaid orders that are too old go, and their seats are free."""
    def change(t: Tables) -> Tables:
        orders, seats = transitions.expire_holds(t["orders"], t["seat"], as_of, ttl_minutes)
        return {"orders": orders, "seat": seats}

    stale = read(spark, store)["orders"].filter(transitions.is_expired(as_of, ttl_minutes)).select("flight_id")
    apply(spark, store, stale, change)


def refresh_status(spark: SparkSession, store: str, as_of: str) -> None:
    """Flights that have left are completed, with the active orders on them."""
    def change(t: Tables) -> Tables:
        flights = transitions.refresh_status(t["flight"], as_of)
        return {"flight": flights, "orders": transitions.derive_order_completed(t["orders"], flights)}

    gone = read(spark, store)["flight"].filter(
        F.col("flight_status").isin(*P.OPEN_FLIGHT) & (F.col("takeoff_ts") < moment(as_of)))
    apply(spark, store, gone.select("flight_id"), change)


def delete_flights(spark: SparkSession, store: str, gone: DataFrame) -> None:
    """Flights (flight_id) go, with their seats, prices and orders."""
    def change(t: Tables) -> Tables:
        return {name: t[name].join(gone.select("flight_id").distinct(), "flight_id", "left_anti") for name in BY_FLIGHT}

    apply(spark, store, gone.select("flight_id"), change)
