"""Shared views over the driver tables, in Spark and in oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmaq import params as P
from tarmaq.functions.scalars import money, plus_minutes
from tarmaq.sources.scans import scan

AS_OF = "1999-01-01 00:00:00"          # flights
EVENTS_AS_OF = "2024-01-20 00:00:00"   # events, mid-month
EVENTS_END = "2024-02-01 00:00:00"     # events, all past
HOLD_TTL = 360                         # minutes; events are sparse


def portable(df: DataFrame) -> DataFrame:
    """Result types every client shows alike: bigint, double, text, boolean."""
    def convert(field):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            return c.cast("double")
        if isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            return c.cast("bigint")
        if isinstance(field.dataType, T.DateType):
            return F.date_format(c, "yyyy-MM-dd")
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        return c
    return df.select(*[convert(f).alias(f.name) for f in df.schema])


# --- orders as flights ------------------------------------------------------

FLIGHT_CODES = {"F": P.COMPLETED, "O": P.SCHEDULED, "P": P.FULL}
LINE_CODES = {"N": P.ACTIVE, "R": P.BY_CUSTOMER, "A": P.BY_SYSTEM}


def _decoded(df: DataFrame, column: str, codes: dict[str, str], wanted: tuple[str, ...]):
    """The coded column as a state, and the rows in the wanted states.

    The filter is on the stored code, so it reaches the file scan.
    """
    state = F.col(column)
    for code, name in codes.items():
        state = F.when(F.col(column) == code, name).otherwise(state)
    if wanted:
        df = df.filter(F.col(column).isin(*[c for c, n in codes.items() if n in wanted]))
    return df, state


def flights(spark: SparkSession, sf: str, *statuses: str) -> DataFrame:
    """All flights, or those in the given statuses."""
    orders, status = _decoded(scan(spark, sf, "orders"), "o_orderstatus", FLIGHT_CODES, statuses)
    minutes = (F.lit(60) + (F.col("o_orderkey") % 20) * 60).cast("int")
    return orders.select(
        F.col("o_orderkey").alias("flight_id"), F.col("o_custkey").alias("owner"),
        F.col("o_orderdate").alias("takeoff_ts"), status.alias("flight_status"),
        minutes.alias("minutes"), F.col("o_orderpriority").alias("priority"))


FLIGHT = """flight AS (
  SELECT o_orderkey AS flight_id, o_custkey AS owner, o_orderdate AS takeoff_ts,
         CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Scheduled'
              ELSE 'Full' END AS flight_status,
         60 + (o_orderkey % 20) * 60 AS minutes, o_orderpriority AS priority
  FROM orders)"""


# --- orders as bookings -----------------------------------------------------

def bookings(spark: SparkSession, sf: str) -> DataFrame:
    status = (F.when(F.col("o_orderstatus") == "P", P.PENDING)
              .when(F.col("o_orderpriority") == "1-URGENT", P.BY_CUSTOMER)
              .when(F.col("o_orderstatus") == "F", P.COMPLETED).otherwise(P.ACTIVE))
    return scan(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("owner"),
        F.col("o_orderdate").alias("date_of_purchase"), status.alias("order_status"))


BOOKING = """booking AS (
  SELECT o_orderkey AS order_id, o_custkey AS owner, o_orderdate AS date_of_purchase,
         CASE WHEN o_orderstatus = 'P' THEN 'Pending'
              WHEN o_orderpriority = '1-URGENT' THEN 'Cancelled by customer'
              WHEN o_orderstatus = 'F' THEN 'Completed' ELSE 'Active' END AS order_status
  FROM orders)"""


# --- lineitem as seat lines -------------------------------------------------

def seat_lines(spark: SparkSession, sf: str, *fates: str) -> DataFrame:
    """All seat lines, or those whose order is in one of the given states."""
    lines, fate = _decoded(scan(spark, sf, "lineitem"), "l_returnflag", LINE_CODES, fates)
    return lines.select(
        F.col("l_orderkey").alias("flight_id"), F.col("l_partkey").alias("partkey"),
        F.col("l_suppkey").alias("suppkey"), F.col("l_linenumber").alias("s_row"),
        F.col("l_linestatus").alias("class_type"), fate.alias("order_status"),
        money("l_extendedprice").alias("price"), F.col("l_shipdate").alias("shipped"))


SEATLINE = """seatline AS (
  SELECT l_orderkey AS flight_id, l_partkey AS partkey, l_suppkey AS suppkey,
         l_linenumber AS s_row, l_linestatus AS class_type,
         CASE l_returnflag WHEN 'N' THEN 'Active' WHEN 'R' THEN 'Cancelled by customer'
              ELSE 'Cancelled by system' END AS order_status,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS price, l_shipdate AS shipped
  FROM lineitem)"""


def tally(lines: DataFrame) -> DataFrame:
    kept = F.count_if(F.col("order_status") == P.ACTIVE)
    return lines.groupBy("flight_id").agg(F.count(F.lit(1)).alias("seats"), kept.alias("kept"))


TALLY = """tally AS (
  SELECT flight_id, count(*) AS seats,
         count(*) FILTER (WHERE order_status = 'Active') AS kept
  FROM seatline GROUP BY flight_id)"""


# --- part as cabins ---------------------------------------------------------

def cabins(spark: SparkSession, sf: str) -> DataFrame:
    return (scan(spark, sf, "part", ["p_brand", "p_type", "p_size"])
            .groupBy(F.col("p_brand").alias("plane_id"), F.col("p_type").alias("class_type"))
            .agg(F.max("p_size").alias("rows_num")).withColumn("columns_num", F.lit(4)))


CABIN = """cabin AS (
  SELECT p_brand AS plane_id, p_type AS class_type, max(p_size) AS rows_num, 4 AS columns_num
  FROM part GROUP BY p_brand, p_type)"""


# --- events -----------------------------------------------------------------

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType())])


def events(spark: SparkSession, sf: str, *kinds: str) -> DataFrame:
    df = scan(spark, sf, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    return df.filter(F.col("event_type").isin(*kinds)) if kinds else df


def spans(spark: SparkSession, sf: str, *kinds: str) -> DataFrame:
    """Events as busy intervals of as many whole minutes as their value."""
    return events(spark, sf, *kinds).select(
        "event_id", "user_id", "event_type", F.col("ts").alias("start_ts"),
        plus_minutes("ts", F.col("value").cast("int")).alias("end_ts"))


SPAN = """span AS (
  SELECT event_id, user_id, event_type, ts AS start_ts,
         ts + to_minutes(CAST(trunc(value) AS BIGINT)) AS end_ts
  FROM events)"""


def seat_requests(clicks: DataFrame) -> DataFrame:
    """Each click asks for two of twenty seats (sometimes the same one twice)."""
    asked = F.array(F.col("event_id") % 20, F.floor(F.col("event_id") / 20) % 20)
    return clicks.select(
        F.col("event_id").alias("order_id"), F.col("user_id").alias("flight_id"),
        F.col("ts").alias("requested_ts"), F.explode(asked).alias("seat")).select(
        "order_id", "flight_id", "requested_ts",
        F.floor(F.col("seat") / 4 + 1).cast("int").alias("s_row"),
        (F.col("seat") % 4 + 1).cast("int").alias("s_column"))
